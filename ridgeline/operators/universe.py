"""Which contracts count: reason-coded filters, logs, scopes and work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_VOLUME, MOST_SPREAD, LEAST_OPEN = 1000.0, 0.20, 24 * 3600
DOLLAR_LABEL = "r1_dollar_volume"
STRUCTURAL, OPERATIONAL = "spread_filter_not_computable", "spread_filter_not_yet_fetched"


def with_quotes(markets: DataFrame, quotes: DataFrame) -> DataFrame:
    """No quote row, and a row without spread, stay apart."""
    return markets.join(quotes.select("ticker", "spread", F.lit(True).alias("attempted")), "ticker", "left").withColumn("attempted", F.coalesce("attempted", F.lit(False)))


def settlement_contradicts() -> Column:
    """The settlement value contradicts the result; false where either is unknown."""
    known = F.col("result").isin("yes", "no") & F.col("settlement_value").isNotNull()
    return F.coalesce(known & ((F.col("result") == "yes") != (F.col("settlement_value") >= 0.5)), F.lit(False))


def window_label() -> Column:
    """The label of the window that a contract closes in; null outside both."""
    return F.when(F.col("in_r1_window"), "r1").when(F.col("in_r2_window"), "r2")


def reasons(markets: DataFrame, quotes: DataFrame, dollars: DataFrame | None = None, window: str | None = None) -> DataFrame:
    """(ticker, passed, reasons, window): every reason that a contract fails for, one of each family.

    window ("r1" or "r2"): contracts of that window only; else of all, each with the label of its own.
    dollars (ticker, dollars): threshold the notional volume instead of the contract count, for contracts whose tape is complete.
    """
    rows = with_quotes(markets.withColumn("window", window_label()), quotes)
    if window is not None:
        rows = rows.where(F.col("window") == window)
    if dollars is None:
        volume = F.when(F.col("volume_fp").isNull() | (F.col("volume_fp") < LEAST_VOLUME), "volume_below_1000")
    else:
        rows = rows.join(dollars.select("ticker", "dollars"), "ticker", "left")
        volume = F.when(~F.coalesce("tape_done", F.lit(False)), "dollar_volume_not_yet_fetched").when(F.coalesce("dollars", F.lit(0.0)) < LEAST_VOLUME, "volume_below_1000")
    spread = F.when(~F.col("attempted"), OPERATIONAL).when(F.col("spread").isNull(), STRUCTURAL).when(F.col("spread") > MOST_SPREAD, "spread_above_20c")
    hours = F.when(F.col("open_t").isNull() | F.col("close_t").isNull(), "missing_open_or_close_time").when(F.col("close_t") - F.col("open_t") < LEAST_OPEN, "open_below_24h")
    settled = F.when(~F.coalesce(F.col("result").isin("yes", "no"), F.lit(False)), "result_missing_or_invalid").when(settlement_contradicts(), "settlement_contradicts_result")
    codes = F.array_compact(F.array(volume, spread, hours, settled))
    return rows.select("ticker", "window", codes.alias("reasons")).select("ticker", (F.size("reasons") == 0).alias("passed"), "reasons", "window")


def summary(found: DataFrame) -> DataFrame:
    """(window, item, n) for each window: total, passed and failed contracts, and how often each reason occurs."""
    marks = F.concat(F.array(F.lit("total"), F.when(F.col("passed"), "passed").otherwise("failed")), "reasons")
    return found.select("window", F.explode(marks).alias("item")).groupBy("window", "item").agg(F.count("*").alias("n"))


def exclusion_log(found: DataFrame, label: str | None = None) -> DataFrame:
    """(window, ticker, reason_code), under the contracts' own windows or another label, such as that of a sensitivity branch."""
    return found.select(F.col("window") if label is None else F.lit(label).alias("window"), "ticker", F.explode("reasons").alias("reason_code"))


def replace_exclusions(log: DataFrame, label: str, log_path: str, stamp_path: str) -> None:
    """Replaces one label's rows of the stored log, leaving others alone, and stamps the build, for a label may log nothing."""
    spark = log.sparkSession
    rows = log.where(F.col("window") == label)
    if rows.isEmpty():
        # nothing to overwrite the old partition with: an explicit empty marker row that readers ignore
        rows = spark.createDataFrame([(label, None, None)], "window string, ticker string, reason_code string")
    rows.write.partitionBy("window").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(log_path)
    spark.createDataFrame([(label,)], "window string").withColumn("built_at", F.current_timestamp()).write.mode("append").parquet(stamp_path)


def in_scope(markets: DataFrame, log: DataFrame, label: str, flag: str, stamps: DataFrame) -> DataFrame:
    """Tickers of the window that the label's log doesn't exclude; an error if the label was never built."""
    if stamps.where(F.col("window") == label).isEmpty():
        raise ValueError(f"the universe {label!r} was never built")
    out = log.where((F.col("window") == label) & F.col("ticker").isNotNull()).select("ticker")
    return markets.where(flag).select("ticker").join(out, "ticker", "left_anti")


def cheap_scope(least_volume: float | None = None, least_open: int | None = None) -> Column:
    """A predicate on market columns alone; parts that aren't given don't restrict."""
    out = F.lit(True)
    if least_volume is not None:
        out = out & (F.col("volume_fp") >= least_volume)
    if least_open is not None:
        out = out & (F.col("close_t") - F.col("open_t") >= least_open)
    return out


def work_list(markets: DataFrame, quotes: DataFrame, flag: str | None = None, close_from: int | None = None, close_to: int | None = None) -> DataFrame:
    """Contracts that pass the filters and whose tape isn't complete."""
    passed = reasons(markets, quotes).where("passed").select("ticker")
    rows = markets.where(~F.coalesce("tape_done", F.lit(False)))
    if flag:
        rows = rows.where(flag)
    if close_from is not None:
        rows = rows.where(F.col("close_t") >= close_from)
    if close_to is not None:
        rows = rows.where(F.col("close_t") < close_to)
    return rows.select("ticker").join(passed, "ticker", "left_semi")


def quote_work_list(markets: DataFrame, quotes: DataFrame) -> DataFrame:
    """Contracts that pass the cheap predicate and have no quote row."""
    return markets.where(cheap_scope(LEAST_VOLUME, LEAST_OPEN)).select("ticker").join(quotes.select("ticker"), "ticker", "left_anti")


def orphans(panel: DataFrame, quotes: DataFrame) -> DataFrame:
    """Contracts with panel rows but no quote row."""
    return panel.select("ticker").distinct().join(quotes.select("ticker"), "ticker", "left_anti")


def resolution_state(events: DataFrame, lookup: DataFrame) -> DataFrame:
    """(event_ticker, state): resolved, terminal (answered without a parent) or unresolved; lookup has (event_ticker, series_ticker)."""
    both = events.join(lookup.select("event_ticker", F.col("series_ticker").alias("found"), F.lit(True).alias("answered")), "event_ticker", "left")
    state = F.when(F.col("answered").isNull(), "unresolved").when(F.col("found").isNull(), "terminal").otherwise("resolved")
    return both.select("event_ticker", state.alias("state"))


def funnel(markets: DataFrame, quotes: DataFrame) -> DataFrame:
    """Cumulative stages of each window in one pass: contracts and events left, lost against the stage before, and that as a share."""
    rows = with_quotes(markets.withColumn("window", window_label()), quotes).where("window is not null")
    stages = [
        ("1_all", F.lit(True)),
        ("2_volume", F.col("volume_fp") >= LEAST_VOLUME),
        ("3_open_24h", F.col("close_t") - F.col("open_t") >= LEAST_OPEN),
        ("4_quoted", F.col("attempted")),
        ("5_computable", F.col("spread").isNotNull()),
        ("6_spread", F.col("spread") <= MOST_SPREAD),
        ("7_result", F.col("result").isin("yes", "no")),
    ]
    aggs, keep = [], F.lit(True)
    for name, cond in stages:
        keep = keep & F.coalesce(cond, F.lit(False))
        aggs += [F.count_if(keep).alias(f"m_{name}"), F.count_distinct(F.when(keep, F.col("event_ticker"))).alias(f"e_{name}")]
    wide = rows.groupBy("window").agg(*aggs)
    items = F.array(*(F.struct(F.lit(n).alias("stage"), F.col(f"m_{n}").alias("markets"), F.col(f"e_{n}").alias("events")) for n, _ in stages))
    # seven rows a window: the stage before is the neighbour in the array
    pairs = F.transform(items, lambda x, i: F.struct(x["stage"].alias("stage"), x["markets"].alias("markets"), x["events"].alias("events"), F.get(items, i - 1)["markets"].alias("before")))
    out = wide.select("window", F.explode(pairs).alias("r")).select("window", "r.*")
    lost = F.col("before") - F.col("markets")
    return out.select("window", "stage", "markets", "events", lost.alias("lost"), F.round(F.when(F.col("before") > 0, lost * 100.0 / F.col("before")), 6).alias("lost_pct"))
