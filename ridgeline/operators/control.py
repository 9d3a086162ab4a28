"""The control venue: last price before each market's own end, outcome, category."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.scalars import classify, first_listed_outcome, iso_to_epoch, outcome_value

ROLES = {
    "id": ("condition_id", "market_id", "id"),
    "outcome": ("outcome", "outcome_prices"),
    "end": ("end_date_iso", "end_date", "end_t"),
    "price": ("price",),
    "time": ("timestamp", "t"),
}
#: (category, pattern): the first that matches wins.
RULES = [
    ("transport", r"\bauto(mobile)?s?\b"),
    ("home", r"\b(furniture|household)\b"),
    ("industry", r"\b(machinery|tools?)\b"),
]


def detect(df: DataFrame, role: str) -> str:
    """The column of df that plays a role: candidates in order, case ignored. None is an error."""
    own = {c.lower(): c for c in df.columns}
    for name in ROLES[role]:
        if name in own:
            return own[name]
    raise ValueError(f"no column for {role} among {', '.join(df.columns)}")


def rules_of(rows: list[dict], allowed: list[str]) -> list[tuple[str, str]]:
    """Rules from configuration rows (category, patterns); a category that isn't allowed is an error."""
    out = []
    for r in rows:
        if r["category"] not in allowed:
            raise ValueError(f"category {r['category']!r} isn't allowed")
        out.append((r["category"], rf"\b(?:{'|'.join(r['patterns'])})\b"))
    for _, p in out:
        re.compile(p)
    return out


def load_rules(spark: SparkSession, path: str, allowed: list[str]) -> list[tuple[str, str]]:
    """rules_of() the JSON lines (place, category, patterns) at path, in order of place; no rules where there is no file."""
    try:
        rows = spark.read.schema("place int, category string, patterns array<string>").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return rules_of([r.asDict() for r in rows.orderBy("place").collect()], allowed)


def epoch_of(df: DataFrame, name: str) -> Column:
    """Epoch seconds of a column that holds a time, a number of seconds, or an ISO string, as its type says."""
    kind = dict(df.dtypes)[name]
    if kind in ("timestamp", "date"):
        return F.unix_seconds(F.col(name).cast("timestamp"))
    if kind == "timestamp_ntz":
        return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(name))
    return iso_to_epoch(F.col(name)) if kind == "string" else F.floor(F.col(name)).cast("long")


def within(start: int, end: int, coverage: tuple[int, int] | None) -> None:
    """An error if [start, end] reaches outside the coverage: what isn't controlled is never extrapolated."""
    if coverage and (start < coverage[0] or end > coverage[1]):
        raise ValueError(f"[{start}, {end}] reaches outside the controlled coverage {list(coverage)}")


def control_panel(
    markets: DataFrame, trades: DataFrame, start: int, end: int, rules: list[tuple[str, str]], texts: list[str], extra: tuple[str, ...] = (), coverage: tuple[int, int] | None = None
) -> DataFrame:
    """(ticker, category, close_t, y, p, event_ticker): markets that end within [start, end] and have an outcome and a last price.

    The last trade at or before the market's own end counts; among trades of one instant the highest price, so that the choice is
    fixed. Prices of 0 and 1 drop out. Each market is its own cluster. A window outside the coverage is an error.
    """
    if start > end:
        raise ValueError("the window ends before it starts")
    within(start, end, coverage)
    mid, outcome = detect(markets, "id"), detect(markets, "outcome")
    value = first_listed_outcome(F.col(outcome)) if outcome == "outcome_prices" else outcome_value(F.col(outcome))
    m = markets.select(F.col(mid).alias("ticker"), value.alias("y"), epoch_of(markets, detect(markets, "end")).alias("close_t"), classify(rules, *texts).alias("category"), *extra)
    m = m.where(F.col("close_t").between(start, end) & F.col("y").isNotNull())
    t = trades.select(F.col(detect(trades, "id")).alias("ticker"), F.col(detect(trades, "price")).alias("price"), epoch_of(trades, detect(trades, "time")).alias("t"))
    met = t.where("price is not null").join(m.select("ticker", "close_t"), "ticker").where("t <= close_t")
    last = met.groupBy("ticker").agg(F.max(F.struct("t", "price")).alias("last"))
    out = m.join(last, "ticker").select("ticker", "category", "close_t", "y", F.col("last.price").alias("p"), F.col("ticker").alias("event_ticker"), *extra)
    return out.where("p > 0 and p < 1")


def with_spine(monthly: DataFrame, first: int, last: int, coverage: tuple[int, int] | None = None) -> DataFrame:
    """monthly (month as year x 12 + month - 1, ...) with a row for every month from first to last; outside the covered months an error."""
    within(first, last, coverage)
    spine = monthly.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("month"))
    return spine.join(monthly, "month", "left")
