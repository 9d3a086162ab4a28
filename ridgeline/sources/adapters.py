"""Domain tables derived from the relational test tables: tape, markets, quotes, fees, control venue.

Every derivation is a projection of one table, so scans stay prunable and no shuffle is added.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400
EPOCH_1997 = 852_076_800
WINDOW_END = 915_148_800  # 1999-01-01, end of the first window and the fee boundary
PUBLICATION = 938_736_000  # 1999-10-01
CONTROL_COVERAGE = (EPOCH_1997, WINDOW_END)
CONTROL_MONTHS = (23_964, 23_987)  # 1997-01 to 1998-12, as year x 12 + month - 1
FROZEN_YEAR = 1998


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Epoch seconds of a zone-less timestamp read as UTC, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def utc(epoch: Column) -> Column:
    return F.timestamp_seconds(epoch)


def raw_fills(spark: SparkSession, sf_dir: str, months: list[str] | None = None) -> DataFrame:
    """Fills as they arrive: a replayed line is a second row with the same trade_id. Months reach the scan as a range of dates."""
    line = table(spark, sf_dir, "lineitem")
    if months:
        first, last = (datetime.date.fromisoformat(f"{m}-01") for m in (min(months), max(months)))
        after = (last + datetime.timedelta(days=31)).replace(day=1)
        line = line.where((F.col("l_shipdate") >= F.lit(str(first)).cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit(str(after)).cast("timestamp_ntz")))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    trade = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents, F.col("l_quantity").cast("long"))
    side = F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "R", "no").when(F.col("l_linestatus") == "O", "yes")
    return line.select(
        trade.alias("trade_id"),
        F.concat(F.lit("P"), "l_partkey").alias("ticker"),
        (cents % 99 + 1).cast("int").alias("cents"),
        ((cents % 99 + 1) / 100.0).cast("double").alias("price"),
        F.col("l_quantity").alias("count_fp"),
        side.alias("taker_side"),
        F.when(F.col("l_linestatus") == "O", "live").otherwise("historical").alias("source"),
        seconds(F.col("l_shipdate")).alias("t"),
        F.date_format("l_shipdate", "yyyy-MM").alias("month"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape without replays (they are identical rows here)."""
    return raw_fills(spark, sf_dir).dropDuplicates(["trade_id"])


def event_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An intraday tape with microsecond times: many fills of few tickers over a month."""
    e = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    side = F.when(F.col("event_type").isin("click", "purchase"), "yes").otherwise("no")
    return e.select(
        F.col("event_id").cast("string").alias("trade_id"),
        F.concat(F.lit("U"), "user_id").alias("ticker"),
        ((F.abs(cents) % 99 + 1) / 100.0).cast("double").alias("price"),
        F.lit(1.0).alias("count_fp"),
        side.alias("taker_side"),
        micros(F.col("ts")).alias("t"),
    )


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    group = F.floor(k / 4).cast("long")
    close = F.lit(EPOCH_1997) + (k * 37 % 1500) * DAY + 72_000
    result = F.when(k % 41 == 0, None).when((k * 7919) % 100 < 2 * F.col("p_size"), "yes").otherwise("no")
    won = F.when(result == "yes", 1.0).when(result == "no", 0.0)
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), k).alias("ticker"),
        k.alias("key"),
        F.concat(F.lit("E"), group).alias("event_ticker"),
        F.concat(F.lit("S"), group % 25).alias("series_ticker"),
        F.concat(F.lit("C"), group % 25 % 6).alias("category"),
        result.alias("result"),
        close.cast("long").alias("close_t"),
        (close - F.col("p_size") * 28_800).cast("long").alias("open_t"),
        ((k * 613) % 5000).cast("double").alias("volume_fp"),
        F.when(k % 97 == 0, 1.0 - won).otherwise(won).alias("settlement_value"),
        (close < WINDOW_END).alias("in_r1_window"),
        (close >= WINDOW_END).alias("in_r2_window"),
        (k % 53 != 0).alias("tape_done"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each market whose quote was tried; a null spread says that none exists."""
    k = F.col("p_partkey")
    spread = F.when(k % 12 == 0, None).otherwise(((k * 31) % 26).cast("double") / 100)
    return table(spark, sf_dir, "part").where(k % 29 != 0).select(
        F.concat(F.lit("P"), k).alias("ticker"), spread.alias("spread"), F.when(k % 2 == 0, "live").otherwise("historical").alias("quote_source")
    )


#: Fixed values: (order, effective from, role, form, rate, scope kind, scope values).
FEE_ROWS = [
    (1, "1995-01-01", "taker", "quadratic", 0.14, "all", None),
    (2, "1996-01-01", "taker", "quadratic", 0.07, "all", None),
    (3, "1997-07-01", "taker", "quadratic", 0.035, "ticker_prefix", ["P1"]),
    (4, "1995-01-01", "maker", "none", 0.0, "all", None),
    (5, "1999-02-01", "maker", "flat_per_contract", 0.0025, "series", ["S1", "S2", "S3"]),
    (6, "1999-04-01", "maker", "quadratic", 0.0175, "series", ["S1", "S2", "S3", "S4", "S5", "S6"]),
    (7, "2000-01-01", "maker", "quadratic", 0.0175, "series", ["S2", "S3", "S4", "S5", "S6", "S7", "S8"]),
]


def fee_schedule(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(FEE_ROWS, "ord int, effective string, role string, form string, rate double, scope_kind string, scope_values array<string>")
    return rows.withColumn("effective_from", F.to_date("effective")).drop("effective")


def listed_schedule(markets: DataFrame) -> DataFrame:
    """A long schedule drawn from the markets: each closing month lists the series of its large contracts for makers, each quarter
    the ticker prefixes of its largest for takers, and one rate holds for all other takers."""
    closed = F.timestamp_seconds("close_t").cast("date")
    ordinal = F.year(closed) * 12 + F.month(closed) - 1
    rows = markets.select("ticker", "series_ticker", "volume_fp", closed.alias("day"), ordinal.alias("ordinal"))
    series = rows.where("volume_fp >= 2500").groupBy(F.trunc("day", "month").alias("effective_from"), "ordinal").agg(F.sort_array(F.collect_set("series_ticker")).alias("scope_values"))
    series = series.select((F.col("ordinal") + 100).alias("ord"), "effective_from", F.lit("maker").alias("role"), F.lit("quadratic").alias("form"), (F.lit(0.01) + F.col("ordinal") % 4 * F.lit(0.0025)).alias("rate"), F.lit("series").alias("scope_kind"), "scope_values")
    prefixes = rows.where("volume_fp >= 4000").groupBy(F.trunc("day", "quarter").alias("effective_from"), F.floor(F.col("ordinal") / 3).cast("int").alias("quarter")).agg(F.sort_array(F.collect_set(F.left("ticker", F.lit(3)))).alias("scope_values"))
    prefixes = prefixes.select((F.col("quarter") + 100_000).alias("ord"), "effective_from", F.lit("taker").alias("role"), F.lit("quadratic").alias("form"), F.lit(0.035).alias("rate"), F.lit("ticker_prefix").alias("scope_kind"), "scope_values")
    return series.union(prefixes).union(fee_schedule(markets.sparkSession).where("ord = 2").select(series.columns))


def control_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    prices = F.when(k % 17 == 0, "[]").when(k % 2 == 0, "['1', '0']").otherwise("[0.0, 1.0]")
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("condition_id"),
        prices.alias("outcome_prices"),
        (F.lit(EPOCH_1997) + (k * 53 % 900) * DAY).cast("long").alias("end_t"),
        F.lower(F.concat_ws("-", F.col("c_mktsegment"), F.col("c_name"))).alias("slug"),
        F.abs("c_acctbal").alias("volume"),
    )


def control_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("condition_id"),
        ((cents % 101) / 100.0).cast("double").alias("price"),
        seconds(F.col("o_orderdate")).alias("t"),
        F.col("o_orderkey").alias("trade_no"),
    )
