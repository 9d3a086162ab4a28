"""The analysis panel: up to eleven prices for each resolved contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.scalars import eastern_day_start, eastern_days_before
from ridgeline.operators.asof import latest, span_of, usable
from ridgeline.operators.stages import stored

DAYS = 10
#: Days in a span of a ticker's time: what the second pass reads or leaves out together.
SPAN_DAYS, SECONDS_A_DAY = 120, 86_400
UNITS = {"SECOND": 1, "MILLISECOND": 1_000, "MICROSECOND": 1_000_000}
CONTRACT = ("event_ticker", "series_ticker", "category", "close_t", "result", "in_r1_window", "in_r2_window")


def closing_refs(markets: DataFrame) -> DataFrame:
    return markets.where(F.col("result").isin("yes", "no")).select("ticker", F.lit(0).alias("lookback_day"), F.col("close_t").alias("ref_t"))


def lookback_refs(day0: DataFrame, unit: str = "SECOND") -> DataFrame:
    """Ten references for each day-0 fill: its own instant, k Eastern calendar days earlier at the same wall-clock time."""
    days = day0.select("ticker", "t", F.explode(F.sequence(F.lit(1), F.lit(DAYS))).alias("lookback_day"))
    return days.select("ticker", "lookback_day", eastern_days_before(F.col("t"), F.col("lookback_day"), unit).alias("ref_t"))


def lookback_prices(markets: DataFrame, fills: DataFrame, unit: str = "SECOND", span_days: int = SPAN_DAYS) -> DataFrame:
    """(ticker, lookback_day, ref_t, t, price, ...): the day-0 fill and its ten lookbacks, carried over silent days.

    Two passes over spans of a ticker's time. The first hashes instants alone: of each span the first and last fill's, and the last one's up to
    the close; stored, one row a ticker and span. These rows say where the day-0 fill lies, hence where the lookbacks stand, and which span
    answers each: the last one to begin at or before it. A reference's stop is its instant or its span's last fill, whichever is earlier. The
    second pass reads whole fills of the spans asked, and keeps the last one of each stretch between stops, combined before it is dealt; each of
    these few rows answers the references from its stop to the next. So no window holds the fills of a ticker, hot or not.
    The day-0 fill is its own lookback of no days, at its own instant.
    """
    bucket = span_days * SECONDS_A_DAY * UNITS[unit]
    closing = closing_refs(markets).select("ticker", F.col("ref_t").alias("close_ref"))
    held = usable(fills).join(closing, "ticker").groupBy("ticker", "close_ref", span_of("t", bucket).alias("span"))
    closed = F.max(F.when(F.col("t") <= F.col("close_ref"), F.col("t")))
    spans = stored(held.agg(F.min("t").alias("begins"), F.max("t").alias("ends"), closed.alias("closed")), "spans")

    def within(of: str, instant: Callable[[Column], Column], since: str) -> Column:
        """The references whose instant lies from one row's to the next one's."""
        return F.filter(of, lambda r: (instant(r) >= F.col(since)) & (F.col("next").isNull() | (instant(r) < F.col("next"))))

    contract = Window.partitionBy("ticker", "close_ref")
    by_span = contract.orderBy("span")
    marked = spans.withColumns({"next": F.lead("begins").over(by_span), "day0": F.max("closed").over(by_span.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})

    # most spans are told to answer nothing before a time zone is asked: ten Eastern days are less than eleven days
    earliest = F.col("day0") - (DAYS + 1) * SECONDS_A_DAY * UNITS[unit]
    near = marked.where((F.col("begins") <= F.col("day0")) & (F.col("next").isNull() | (F.col("next") > earliest)))
    instants = F.transform(F.sequence(F.lit(0), F.lit(DAYS)), lambda k: F.when(k == 0, F.col("day0")).otherwise(eastern_days_before(F.col("day0"), k, unit)))
    back = near.withColumn("back", F.transform(instants, lambda at, k: F.struct(k.alias("lookback_day"), at.alias("ref_t"), F.least(at, "ends").alias("stop"))))
    asked = back.select("ticker", "close_ref", "span", within("back", lambda r: r.ref_t, "begins").alias("refs"))
    read = usable(fills).withColumn("span", span_of("t", bucket)).join(asked, ["ticker", "span"])
    stretch = read.withColumn("stop", F.array_min(F.filter("refs.stop", lambda stop: stop >= F.col("t")))).where("stop is not null")
    # without the span as a key, rows are combined before they are dealt, and a skewed join can be split
    few = stretch.groupBy("ticker", "close_ref", "stop").agg(latest().alias("fill"), F.first("refs").alias("refs"))
    few = few.withColumn("next", F.lead("stop").over(contract.orderBy("stop")))
    found = few.withColumn("ref", F.explode(within("refs", lambda r: r.stop, "stop")))
    ref_t = F.when(F.col("ref.lookback_day") == 0, F.col("close_ref")).otherwise(F.col("ref.ref_t"))
    return found.select("ticker", "ref.lookback_day", ref_t.alias("ref_t"), "fill.*")


def dressed(prices: DataFrame, markets: DataFrame) -> DataFrame:
    rows = prices.join(markets.select("ticker", *CONTRACT), "ticker").where("price > 0 and price < 1")
    return rows.select(
        "ticker",
        "event_ticker",
        "series_ticker",
        "lookback_day",
        "category",
        "close_t",
        F.lit("yes").alias("side"),
        F.when(F.col("result") == "yes", 1.0).otherwise(0.0).alias("y"),
        F.col("price").alias("p"),
        "count_fp",
        "taker_side",
        "in_r1_window",
        "in_r2_window",
    )


def backfilled_panel(markets: DataFrame, fills: DataFrame, unit: str = "SECOND") -> DataFrame:
    """One row a contract and day, the last price at or before each lookback, however old."""
    return dressed(lookback_prices(markets, fills, unit), markets)


def skip_panel(markets: DataFrame, fills: DataFrame, unit: str = "SECOND") -> DataFrame:
    """As the backfilled panel, but a day counts only if its fill lies in that Eastern day.

    A contract without a fill on its closing day drops out altogether.
    """
    prices = lookback_prices(markets, fills, unit)
    own_day = prices.where(F.col("t") >= eastern_day_start(F.col("ref_t"), unit))
    closed = own_day.where("lookback_day = 0").select("ticker")
    return dressed(own_day.join(closed, "ticker", "left_semi"), markets)


def doubled(yes_only: DataFrame) -> DataFrame:
    """Yes rows and their complements: price and outcome turned, the taker's side as it was."""
    no = yes_only.withColumns({"side": F.lit("no"), "y": 1 - F.col("y"), "p": 1 - F.col("p")})
    return yes_only.unionByName(no)


def pooled_scope(markets: DataFrame) -> DataFrame:
    """(ticker): markets of the first window, and those of the second whose tape is complete."""
    return markets.where("in_r1_window or (in_r2_window and tape_done)").select("ticker").distinct()


def cluster_key() -> Column:
    """The event, or the contract itself where the event is null or empty."""
    return F.coalesce(F.when(F.col("event_ticker") != "", F.col("event_ticker")), F.col("ticker"))


def role() -> Column:
    """taker or maker of a doubled row; null where the taker's side isn't known or the price isn't between 0 and 1."""
    known = F.col("taker_side").isin("yes", "no") & (F.col("p") > 0) & (F.col("p") < 1)
    return F.when(known, F.when(F.col("side") == F.col("taker_side"), "taker").otherwise("maker"))
