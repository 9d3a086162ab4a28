"""Streaming ingest of tape pages, and running counts."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ridgeline.operators import snapshots
from ridgeline.operators.tape import dedup


def stored(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The table at path; None where there is nothing yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def add_page(page: DataFrame, path: str) -> None:
    """Adds the page's fills that the tape lacks. A page that is seen again, or retried, adds nothing.

    Only the months that the page touches are read. Old fills that arrive late are kept: there is no watermark.
    """
    spark = page.sparkSession
    fresh = dedup(page.where(F.col("trade_id").isNotNull() & F.col("t").isNotNull()))
    if (tape := stored(spark, path, page.schema)) is not None:
        months = [r["month"] for r in fresh.select("month").distinct().collect()]
        known = tape.where(F.col("month").isin(months) if months else F.lit(False)).select("trade_id", "month")
        fresh = fresh.join(known, ["trade_id", "month"], "left_anti")
    fresh.write.partitionBy("month").mode("append").parquet(path)


def ingest(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over the pages that are there and stops."""
    return pages.writeStream.foreachBatch(lambda page, _: add_page(page, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_snapshots(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """ingest() into a tape of snapshots: readers see whole batches alone, and a batch that is run again after its version was
    published is known by its number in the manifest and not read against the tape."""
    return pages.writeStream.foreachBatch(lambda page, n: snapshots.append(page, path, (checkpoint, n))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accepted(pages: DataFrame) -> DataFrame:
    """Streaming fills with id and time, each trade_id once: a page that comes again, in this run or after a restart, adds nothing.

    The ids seen are the stream's state, kept under its checkpoint and dealt by id; as old pages may come at any time, none is forgotten.
    """
    return pages.where(F.col("trade_id").isNotNull() & F.col("t").isNotNull()).dropDuplicates(["trade_id"])


def running_totals(pages: DataFrame) -> DataFrame:
    """Streaming count and dollar volume by ticker, over each trade once. For output mode complete."""
    return accepted(pages).groupBy("ticker").agg(F.count("*").alias("trades"), F.sum(F.col("count_fp") * F.col("price")).alias("dollars"))


def population_monitor(pages: DataFrame, time: str = "ts", late: str = "2 days") -> DataFrame:
    """Streaming daily share of fills with a known taker side, each trade once. Rows later than the watermark are missing here, and only
    here: late_rows() tells how many."""
    day = F.window(time, "1 day")
    once = pages.withWatermark(time, late).dropDuplicates(["trade_id", time])
    return once.groupBy(day.alias("day")).agg(F.count("*").alias("n"), (F.count("taker_side") / F.count("*")).alias("rate"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and so were dropped, over the progress that the query still holds."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def pages_in(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(os.path.join(folder, "*"))
