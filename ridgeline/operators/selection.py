"""Exact order statistics without a group's values in one place."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.stages import stored


def ranked(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(by, v, n, below, total): each different value, how often it occurs, how many rows of its group are smaller, and the group's size.

    Values are counted first, so a frequent one is one row; the counts are dealt by ranges of (by, v), which parts a group of any
    size, and stored with the number of their range, so that a lost executor can't move a border. A range sums its own counts;
    what lies before it comes from the ranges' sums, a row for each. Nulls don't count; a null group is a group.
    """
    counts = rows.select(*by, value.alias("v")).where("v is not null").groupBy(*by, "v").agg(F.count("*").alias("n"))
    spans = stored(counts.repartitionByRange(*by, "v").withColumn("span", F.spark_partition_id()), "spans")
    whole, earlier = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sums = spans.groupBy(*by, "span").agg(F.sum("n").alias("m"))
    sums = sums.select(*[F.col(b).alias(f"s_{b}") for b in by], F.col("span").alias("s_span"), F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"), F.sum("m").over(whole).alias("total"))
    within = Window.partitionBy(*by, "span").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    each = spans.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0)))
    same = functools.reduce(operator.and_, (F.col(b).eqNullSafe(F.col(f"s_{b}")) for b in by), F.col("span") == F.col("s_span"))
    return each.join(sums, same).select(*by, "v", "n", (F.col("before") + F.col("within")).alias("below"), "total")


def nearest_rank(rows: DataFrame, by: list[str], value: Column, shares: list[float]) -> DataFrame:
    """(by, share, value): the value at index floor(share x n) of each group's sorted values, or the last one. An empty group has no row."""
    asked = ranked(rows, by, value).withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    at = F.least(F.floor(F.col("share") * F.col("total")), F.col("total") - 1)
    return asked.where((F.col("below") <= at) & (at < F.col("below") + F.col("n"))).select(*by, "share", F.col("v").alias("value"))


def percentiles(rows: DataFrame, by: list[str], value: Column, shares: list[float]) -> DataFrame:
    """(by, share, value): percentiles by linear interpolation between the two nearest of each group's sorted values."""
    asked = ranked(rows, by, value).withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    place = F.col("share") * (F.col("total") - 1)
    last = F.col("below") + F.col("n") - 1
    near = asked.select(*by, "share", F.col("v").cast("double").alias("v"), place.alias("place"), (F.col("below") <= F.floor(place)) & (F.floor(place) <= last), (F.col("below") <= F.ceil(place)) & (F.ceil(place) <= last))
    near = near.toDF(*by, "share", "v", "place", "is_low", "is_high").where("is_low or is_high")
    ends = near.groupBy(*by, "share").agg(F.max(F.when(F.col("is_low"), F.col("v"))).alias("low"), F.max(F.when(F.col("is_high"), F.col("v"))).alias("high"), F.max("place").alias("place"))
    between = F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))
    return ends.select(*by, "share", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between).alias("value"))
