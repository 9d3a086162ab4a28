"""Backward as-of join: the last fill at or before an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

FILL = ("price", "count_fp", "taker_side", "trade_id")


def usable(ticks: DataFrame) -> DataFrame:
    return ticks.where("price is not null and t is not null")


def tick_collapse(ticks: DataFrame) -> DataFrame:
    """One fill for each ticker and instant: the whole row of the smallest trade_id."""
    best = usable(ticks).groupBy("ticker", "t")
    return best.agg(F.min_by(F.struct(*FILL), "trade_id").alias("fill")).select("ticker", "t", "fill.*")


def latest() -> Column:
    """Aggregate: the last fill; of one instant the one of the smallest trade_id."""
    return F.min_by(F.struct("t", *FILL), F.struct((-F.col("t")).alias("t"), F.col("trade_id").alias("trade_id")))


def of_refs(ticks: DataFrame, refs: DataFrame) -> DataFrame:
    return usable(ticks).join(refs.select("ticker").distinct(), "ticker", "left_semi")


def merged_rows(refs: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """References and usable fills as rows of one table (ticker, t, is_ref, ref, fill, trade_id)."""
    asked = refs.select("ticker", F.col("ref_t").alias("t"), F.lit(1).alias("is_ref"), F.struct("ref_t", *keys).alias("ref"), F.lit(None).cast("string").alias("trade_id"))
    known = known.select("ticker", "t", F.lit(0).alias("is_ref"), F.struct("t", *FILL).alias("fill"), "trade_id")
    return asked.unionByName(known, allowMissingColumns=True)


def in_order(*by: str) -> WindowSpec:
    """Fills up to a row: of one instant the fill of the smallest trade_id comes last, and references after fills."""
    return Window.partitionBy(*by).orderBy("t", "is_ref", F.desc("trade_id")).rowsBetween(Window.unboundedPreceding, 0)


def span_of(t: str, bucket: int) -> Column:
    return F.floor(F.col(t) / bucket).cast("long")


def answers(found: DataFrame) -> DataFrame:
    return found.where("fill is not null").select("ticker", "ref.*", F.col("fill.t").alias("t"), "fill.price", "fill.count_fp", "fill.taker_side", "fill.trade_id")


def segmented(refs: DataFrame, ticks: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """The as-of join by spans: rows of a ticker's span are sorted apart, and a reference before its span's first fill takes what is carried over.

    The last fills of the spans, one small row each, alone meet by ticker.
    """
    known = of_refs(ticks, refs)
    ends = known.groupBy("ticker", span_of("t", bucket).alias("span")).agg(latest().alias("own"))
    merged = merged_rows(refs, known, keys).withColumn("span", span_of("t", bucket))
    asked = refs.select("ticker", span_of("ref_t", bucket).alias("span")).distinct()
    marks = ends.unionByName(asked, allowMissingColumns=True).groupBy("ticker", "span").agg(F.first("own", ignorenulls=True).alias("own"))
    before = Window.partitionBy("ticker").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("ticker", "span", F.last("own", ignorenulls=True).over(before).alias("carried")).where("carried is not null")
    seen = merged.withColumn("fill", F.last("fill", ignorenulls=True).over(in_order("ticker", "span"))).where("is_ref = 1")
    return answers(seen.join(carried, ["ticker", "span"], "left").withColumn("fill", F.coalesce("fill", "carried")))


def last_trade_at_or_before(refs: DataFrame, ticks: DataFrame, keys: list[str], bucket: int | None = None) -> DataFrame:
    """refs (ticker, keys, ref_t) with the last fill of the ticker at t <= ref_t; refs without one are left out.

    References and fills are merged into one ordered window per ticker, so a ticker's rows are read once, not fills times
    references. Among fills of one instant the smallest trade_id wins: it comes last in the order. Fills without price or
    time don't count. Replayed fills do no harm.

    With a bucket, a span in the unit of t, a ticker is parted into spans that are sorted apart, so that a hot ticker is the work of many
    tasks; the last fill of each span, one small row, is carried over to the spans after it.
    """
    if bucket is not None:
        return segmented(refs, ticks, keys, bucket)
    merged = merged_rows(refs, of_refs(ticks, refs), keys)
    return answers(merged.withColumn("fill", F.last("fill", ignorenulls=True).over(in_order("ticker"))).where("is_ref = 1"))
