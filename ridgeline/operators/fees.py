"""Dated, scoped fee schedules: lookup, sweeps and text-built versions."""

from __future__ import annotations

import datetime
import functools
import operator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions.scalars import order_fee
from ridgeline.operators.stages import stored

MOST_ENTRIES = 200  # scope values, as each becomes a literal


def kind_rank() -> Column:
    """More specific scopes win."""
    return F.when(F.col("scope_kind") == "series", 1).when(F.col("scope_kind") == "ticker_prefix", 2).otherwise(3)


def lookup(asked: DataFrame, schedule: DataFrame) -> DataFrame:
    """asked (role, as_of date, ticker, series_ticker, ...) with form, rate and scope_kind of the entry in force; nulls for a gap.

    For each kind of scope the newest generation at the date counts, and of the kinds with a match the most specific. A
    schedule of up to MOST_ENTRIES scope values, as configurations are, becomes one expression over the row itself, so nothing is
    shuffled; a longer one is joined. An entry without values counts as one.
    """
    each = F.size(F.coalesce("scope_values", F.array().cast("array<string>")))
    if (schedule.agg(F.sum(F.greatest(each, F.lit(1)))).first()[0] or 0) > MOST_ENTRIES:
        return joined_lookup(asked, schedule)
    entries = schedule.select("ord", "effective_from", "role", "form", "rate", "scope_kind", "scope_values").collect()
    begins: dict[tuple, list] = {}
    for e in entries:
        begins.setdefault((e["role"], e["scope_kind"]), []).append(e["effective_from"])
    rank = {"series": 1, "ticker_prefix": 2}
    fee = F.lit(None).cast("struct<form:string,rate:double,scope_kind:string>")
    for e in sorted(entries, key=lambda e: (rank.get(e["scope_kind"], 3), e["ord"]), reverse=True):
        until = min((d for d in begins[e["role"], e["scope_kind"]] if d > e["effective_from"]), default=None)
        fits = (F.col("role") == e["role"]) & (F.col("as_of") >= F.lit(e["effective_from"]))
        if until is not None:
            fits = fits & (F.col("as_of") < F.lit(until))
        values = e["scope_values"] or []
        if e["scope_kind"] == "series":
            fits = fits & F.col("series_ticker").isin(values)
        elif e["scope_kind"] == "ticker_prefix":
            fits = fits & functools.reduce(operator.or_, (F.startswith(F.col("ticker"), F.lit(v)) for v in values), F.lit(False))
        fields = (F.lit(e["form"]).cast("string").alias("form"), F.lit(e["rate"]).cast("double").alias("rate"), F.lit(e["scope_kind"]).alias("scope_kind"))
        fee = F.when(fits, F.struct(*fields)).otherwise(fee)
    return asked.select(*asked.columns, fee.alias("fee_")).select(*asked.columns, "fee_.form", "fee_.rate", "fee_.scope_kind")


def calendar(schedule: DataFrame) -> DataFrame:
    """(k_role, k_day, series_from, prefix_from, general): the generations in force on each day, up to the one that the last begins on.

    general is the fee of the kinds without values. The rows are days that the schedule spans, whatever the length of the tape.
    """
    entry = ["role", "scope_kind", "effective_from"]
    generations = schedule.select(*entry).where("effective_from is not null").distinct()
    until = F.lead("effective_from").over(Window.partitionBy("role", "scope_kind").orderBy("effective_from"))
    ends = F.coalesce(F.date_sub("until", 1), schedule.agg(F.max("effective_from")).scalar())
    days = generations.withColumn("until", until).withColumn("k_day", F.explode(F.sequence("effective_from", ends))).drop("until")
    rows = schedule.where(~F.col("scope_kind").isin("series", "ticker_prefix")).groupBy(*entry)
    general = rows.agg(F.min_by(F.struct("form", "rate", "scope_kind"), F.struct("ord")).alias("fee"), F.min(F.struct("ord")).alias("place"))
    begins = lambda kind, name: F.max(F.when(F.col("scope_kind") == kind, F.col("effective_from"))).alias(name)
    found = days.join(general, entry, "left").groupBy(F.col("role").alias("k_role"), "k_day")
    return found.agg(begins("series", "series_from"), begins("ticker_prefix", "prefix_from"), F.min_by("fee", "place").alias("general"))


def joined_lookup(asked: DataFrame, schedule: DataFrame) -> DataFrame:
    """lookup() for schedules of any length, by joins of equality that read asked once.

    The generation in force depends on role and date alone: a row of the calendar. Within it a series is found by its name, and a prefix
    by a join for each length that prefixes have. What is joined is stored first and the joins carry no hints: Spark broadcasts what
    it has measured to be small, so the rows aren't shuffled, and parts a hot key of a longer schedule.
    """
    listed = schedule.withColumn("k_value", F.explode("scope_values")).where("k_value is not null")
    best = F.min(F.struct("ord", "form", "rate", "scope_kind"))

    def values(kind: str, since: str, fee: str) -> DataFrame:
        keys = [F.col("role").alias("k_role"), F.col("effective_from").alias(since), "k_value"]
        return listed.where(F.col("scope_kind") == kind).groupBy(*keys).agg(best.alias(fee))

    series, prefixes = stored(values("series", "k_from", "series_fee"), "series"), stored(values("ticker_prefix", "k_from", "prefix_fee"), "prefixes")
    lengths = sorted(r[0] for r in prefixes.select(F.length("k_value")).distinct().collect())
    last = schedule.agg(F.max("effective_from")).scalar()
    day = F.when(F.col("as_of") >= last, last).otherwise(F.col("as_of"))
    out = asked.withColumn("day_", day).join(stored(calendar(schedule), "calendar"), [F.col("role") == F.col("k_role"), F.col("day_") == F.col("k_day")], "left").drop("k_role", "k_day", "day_")
    met = lambda since, value: [F.col("role") == F.col("k_role"), F.col(since) == F.col("k_from"), value == F.col("k_value")]
    key = ("k_role", "k_from", "k_value")
    out = out.join(series, met("series_from", F.col("series_ticker")), "left").drop(*key)
    for n in lengths:
        own = prefixes.where(F.length("k_value") == n).withColumnRenamed("prefix_fee", f"fee_{n}")
        out = out.join(own, met("prefix_from", F.left(F.col("ticker"), F.lit(n))), "left").drop(*key)
    fees = [F.col("series_fee"), F.array_min(F.array_compact(F.array(*(F.col(f"fee_{n}") for n in lengths)))) if lengths else F.col("series_fee")]
    plain = [F.when(x.isNotNull(), F.struct(x.form.alias("form"), x.rate.alias("rate"), x.scope_kind.alias("scope_kind"))) for x in fees]
    return out.select(*asked.columns, F.coalesce(*plain, "general").alias("fee_")).select(*asked.columns, "fee_.form", "fee_.rate", "fee_.scope_kind")


SCHEDULE = "ord int, effective_from date, role string, form string, rate double, scope_kind string, scope_values array<string>"


def load_schedule(spark: SparkSession, path: str) -> DataFrame:
    """The schedule in JSON lines at path; a missing file is an empty schedule, in which every lookup is a gap."""
    try:
        return spark.read.schema(SCHEDULE).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEDULE)


def uniform_schedule(spark: SparkSession, since: datetime.date, taker_rate: float = 0.07) -> DataFrame:
    """The schedule of one formula for all: takers pay the quadratic fee everywhere, makers nothing."""
    rows = [(1, since, "taker", "quadratic", taker_rate, "all", None), (2, since, "maker", "none", 0.0, "all", None)]
    return spark.createDataFrame(rows, SCHEDULE)


def swept(schedule: DataFrame, grid: DataFrame) -> DataFrame:
    """The schedule at every grid rate: rows that charge makers take it, all others stay; grid has a column grid_rate."""
    charging = (F.col("role") == "maker") & (F.col("form") != "none") & (F.col("rate") != 0)
    return schedule.crossJoin(F.broadcast(grid)).withColumn("rate", F.when(charging, F.col("grid_rate")).otherwise(F.col("rate")))


def sourced_maker_rate(schedule: DataFrame) -> DataFrame:
    """(rate): that of the latest row that charges makers."""
    charging = schedule.where("role = 'maker' and form <> 'none' and rate <> 0")
    return charging.agg(F.max_by("rate", F.struct("effective_from", "ord")).alias("rate"))


def default_grid(sourced: DataFrame, band: float = 0.5, points: int = 10) -> DataFrame:
    """(grid_rate): zero, and evenly spaced rates from (1 - band) to (1 + band) times the sourced one."""
    step = F.lit(2 * band / (points - 1))
    steps = sourced.select("rate", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    rates = steps.select(F.round(F.col("rate") * (1 - band) + F.col("i") * F.col("rate") * step, 8).alias("grid_rate"))
    return rates.union(sourced.select(F.lit(0.0))).distinct()


def fee_of(count: Column, price: Column) -> Column:
    return order_fee(F.col("form"), F.col("rate"), count, price)
