"""The trade tape: scans, dedup, upserts, appends and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dedup(tape: DataFrame, key: str = "trade_id", dealt: bool = False) -> DataFrame:
    """One whole row for each key: the least by all other columns, so that the choice doesn't depend on row order.

    Few rows share a key, so they are dealt by key before they are sorted, once, instead of being sorted and combined on both sides.
    dealt: the tape is a table bucketed by the key, and nothing is shuffled; of another tape the rows are the same.
    """
    rest = [c for c in tape.columns if c != key]
    best = (tape if dealt else tape.repartition(key)).groupBy(key).agg(F.min(F.struct(*rest)).alias("r"))
    return best.select(key, "r.*").select(tape.columns)


def scan(tape: DataFrame, months: list[str] | None = None, tickers: DataFrame | None = None, columns: list[str] | None = None, deduped: bool = False, dealt: bool = False) -> DataFrame:
    """Rows of the months and tickers, deduplicated on trade_id.

    Month and ticker are fixed for a trade, so both filters come before the dedup, and only the asked columns enter it.
    Unknown columns are an error; an empty list of months or set of tickers gives no rows.
    """
    wanted = columns or tape.columns
    if missing := sorted(set(wanted) - set(tape.columns)):
        raise ValueError(f"unknown columns: {', '.join(missing)}")
    rows = tape if months is None else tape.where(F.col("month").isin(months) if months else F.lit(False))
    if tickers is not None:
        rows = rows.join(tickers.select("ticker"), "ticker", "left_semi")
    needed = [c for c in tape.columns if c in wanted or c == "trade_id"]
    rows = rows.select(needed)
    return (rows if deduped else dedup(rows, dealt=dealt)).select(wanted)


def months_on_disk(tape: DataFrame) -> DataFrame:
    return tape.select("month").distinct()


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old_if_null: tuple[str, ...] = (), sticky: tuple[str, ...] = (), first_seen: tuple[str, ...] = ()) -> DataFrame:
    """old with new's rows merged in by keys; new must have one row a key.

    A new value wins, null included; columns in keep_old_if_null win only when not null; sticky flags stay true once they were;
    first_seen columns keep the old value. Rows that new lacks stay.
    """
    o = old.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.struct(*old.columns).alias("o"))
    n = new.select(*[F.col(k).alias(f"n_{k}") for k in keys], F.struct(*old.columns).alias("n"))
    on = [F.col(f"o_{k}") == F.col(f"n_{k}") for k in keys]
    both = o.join(n, on, "full")
    is_new, is_old = F.col("n").isNotNull(), F.col("o").isNotNull()

    def merged(c: str):
        a, b = F.col("o").getField(c), F.col("n").getField(c)
        if c in keep_old_if_null:
            return F.coalesce(b, a)
        if c in sticky:
            return F.greatest(F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False)))
        if c in first_seen:
            return F.when(is_old, a).otherwise(b)
        return F.when(is_new, b).otherwise(a)

    return both.select([merged(c).alias(c) for c in old.columns])


def append(batch: DataFrame, path: str) -> None:
    """Adds a batch to the tape: rows without key or time are dropped, the rest deduplicated, in new files by month only."""
    rows = dedup(batch.where(F.col("trade_id").isNotNull() & F.col("t").isNotNull()))
    rows.repartition("month").write.partitionBy("month").mode("append").parquet(path)


def compact(spark, path: str, month: str, aside: str, files: int = 1) -> None:
    """Rewrites one month without duplicates, in few files; written aside first, as a job can't overwrite what it reads."""
    rows = spark.read.parquet(path).where(F.col("month") == month)
    dedup(rows).repartition(files).write.partitionBy("month").mode("overwrite").parquet(aside)
    merged = spark.read.parquet(aside)
    merged.write.partitionBy("month").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def add_to_buckets(batch: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Appends a batch to a table by month, each month in buckets of trade_id, and returns the table.

    The rows are shuffled here, once; dedup, counts, volumes and joins on trade_id of the table read bucket by bucket without a shuffle. Rows
    without key or time are dropped. Each batch adds up to one file a bucket and month, and replays in later batches stay until they are
    read. A table has one number of buckets for good, chosen by the size of a bucket over all months, as a bucket is one task. A new session
    without a lasting catalog declares the table again by `open_buckets`.
    """
    rows = batch.where(F.col("trade_id").isNotNull() & F.col("t").isNotNull()).repartition(buckets, "trade_id")
    rows.write.partitionBy("month").bucketBy(buckets, "trade_id").option("path", path).mode("append").saveAsTable(table)
    return batch.sparkSession.table(table)


def open_buckets(spark: SparkSession, table: str, path: str, buckets: int) -> DataFrame:
    """The table that `add_to_buckets` wrote to path, declared in this session's catalog; buckets must be the number it was written with."""
    columns = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY (month) CLUSTERED BY (trade_id) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    return spark.table(table)


def newest_before(tape: DataFrame, t: int, sources: tuple[str, ...] = ("live", "historical")) -> DataFrame:
    """(ticker, trade_id): the last fill at or before t of the first source that has one; ties of time by the greater trade_id."""
    best = tape.where(F.col("t") <= t).groupBy("ticker", "source").agg(F.max(F.struct("t", "trade_id")).alias("r"))
    rank = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    return best.where(rank > 0).groupBy("ticker").agg(F.min_by("r", rank).alias("r")).select("ticker", "r.trade_id")


def trade_counts(tape: DataFrame, dealt: bool = False) -> DataFrame:
    return dedup(tape.select("trade_id", "ticker"), dealt=dealt).groupBy("ticker").agg(F.count("*").alias("trades"))


def dollar_volume(tape: DataFrame, dealt: bool = False) -> DataFrame:
    rows = dedup(tape.select("trade_id", "ticker", "count_fp", "price"), dealt=dealt)
    return rows.groupBy("ticker").agg(F.sum(F.col("count_fp") * F.col("price")).alias("dollars"))


def completeness(recorded: DataFrame, counted: DataFrame) -> DataFrame:
    """(ticker, recorded, counted, delta) of recorded against counted trades; either side may lack a ticker."""
    both = recorded.join(counted, "ticker", "full").select("ticker", F.coalesce("recorded", F.lit(0)).alias("recorded"), F.coalesce("trades", F.lit(0)).alias("counted"))
    return both.withColumn("delta", F.col("counted") - F.col("recorded"))
