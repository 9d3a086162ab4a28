"""Counts, coverage and validation tables over the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.scalars import ERAS, era, month_key, utc_date
from ridgeline.operators.panel import DAYS
from ridgeline.operators.universe import LEAST_OPEN, LEAST_VOLUME, MOST_SPREAD, OPERATIONAL, STRUCTURAL, with_quotes


def reconcile(yes_only: DataFrame, doubled: DataFrame, targets: dict[str, int]) -> DataFrame:
    """(item, actual, target, delta, delta_pct) of distinct events, contracts, prices, doubled prices and both tails."""
    yes = yes_only.agg(F.count_distinct("event_ticker").alias("events"), F.count_distinct("ticker").alias("yes_contracts"), F.count("*").alias("yes_prices"))
    p = F.round(F.col("p") * 100, 6)
    two = doubled.agg(F.count("*").alias("doubled_prices"), F.count_if((p > 0) & (p <= 10)).alias("tail_low"), F.count_if((p > 90) & (p <= 99)).alias("tail_high"))
    wide = yes.crossJoin(two)
    long = wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("item"), F.col(k).alias("actual"), F.lit(v).cast("long").alias("target")) for k, v in targets.items()))).alias("r")).select("r.*")
    delta = F.col("actual") - F.col("target")
    return long.withColumns({"delta": delta, "delta_pct": F.when(F.col("target") != 0, F.round(delta * 100.0 / F.col("target"), 2))})


def gap_breakdown(log: DataFrame) -> DataFrame:
    """(window, structural, operational, other): logged reasons of each window by whether the spread can't or couldn't yet be computed."""
    r = F.col("reason_code")
    return log.groupBy("window").agg(F.count_if(r == STRUCTURAL).alias("structural"), F.count_if(r == OPERATIONAL).alias("operational"), F.count_if(~r.isin(STRUCTURAL, OPERATIONAL)).alias("other"))


def basis_counts(yes_only: DataFrame, doubled: DataFrame) -> DataFrame:
    both = yes_only.agg(F.count("*").alias("yes_rows")).crossJoin(doubled.agg(F.count("*").alias("doubled_rows")))
    return both.withColumn("holds", F.col("doubled_rows") == 2 * F.col("yes_rows"))


def population_by_era(fills: DataFrame, columns: list[str]) -> DataFrame:
    """(era, n, rates): rows and non-null shares in each era; eras without rows are listed with 0."""
    counted = fills.groupBy(F.coalesce(era(F.col("t")), F.lit("_unassigned")).alias("era")).agg(F.count("*").alias("n"), *[F.round(F.count(c) / F.count("*"), 4).alias(f"rate_{c}") for c in columns])
    all_eras = fills.sparkSession.createDataFrame([(e,) for e in ERAS], "era string")
    return F.broadcast(all_eras).join(counted, "era", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def spread_loss(markets: DataFrame, quotes: DataFrame) -> DataFrame:
    """What becomes of contracts that pass volume and duration at the spread filter, with shares."""
    rows = with_quotes(markets, quotes).where((F.col("volume_fp") >= LEAST_VOLUME) & (F.col("close_t") - F.col("open_t") >= LEAST_OPEN))
    bucket = F.when(~F.col("attempted"), "not_fetched").when(F.col("spread").isNull(), "not_computable").when(F.col("spread") > MOST_SPREAD, "too_wide").otherwise("passes")
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def panel_depth(panel: DataFrame, markets: DataFrame) -> DataFrame:
    """Contracts, prices and prices a contract by how long the market was open, and in total."""
    hours = (F.col("close_t") - F.col("open_t")) / 3600
    bucket = F.when(hours < 48, "a_under_2d").when(hours < 168, "b_2d_to_7d").otherwise("c_over_7d")
    rows = panel.join(markets.select("ticker", bucket.alias("bucket")), "ticker")
    out = rows.rollup("bucket").agg(F.count_distinct("ticker").alias("contracts"), F.count("*").alias("prices"))
    return out.select(F.coalesce("bucket", F.lit("total")).alias("bucket"), "contracts", "prices", (F.col("prices") / F.col("contracts")).alias("depth"))


def readiness(markets: DataFrame, quotes: DataFrame, passed: DataFrame) -> DataFrame:
    """Per closing month and in total: eligible, quoted, in scope and analysable contracts; ready if all eligible are quoted."""
    rows = with_quotes(markets, quotes).join(passed.select("ticker", "passed"), "ticker", "left")
    eligible = (F.col("volume_fp") >= LEAST_VOLUME) & (F.col("close_t") - F.col("open_t") >= LEAST_OPEN)
    counts = rows.rollup(month_key(F.col("close_t")).alias("month")).agg(
        F.count_if(eligible).alias("eligible"), F.count_if(eligible & F.col("attempted")).alias("quoted"), F.count_if("passed").alias("in_scope"), F.count_if(F.col("passed") & F.col("tape_done")).alias("analysable")
    )
    return counts.withColumns({"month": F.coalesce("month", F.lit("total")), "ready": F.col("eligible") == F.col("quoted")})


def tail_yield(markets: DataFrame, quotes: DataFrame, passed: DataFrame, forecast: float) -> DataFrame:
    """Per window: pass rate of quoted contracts against a forecast, and how many have no quote yet."""
    rows = with_quotes(markets, quotes).join(passed.select("ticker", "passed"), "ticker")
    rate = F.count_if(F.col("attempted") & F.col("passed")) / F.count_if("attempted")
    return rows.groupBy(F.when(F.col("in_r1_window"), "r1").otherwise("r2").alias("window")).agg(rate.alias("pass_rate"), (rate - forecast).alias("against_forecast"), F.count_if(~F.col("attempted")).alias("unquoted"))


def treated_share(flagged_markets: DataFrame) -> DataFrame:
    """Per closing month: share of contracts, and of their volume, that pay a maker fee."""
    v = F.coalesce("volume_fp", F.lit(0.0))
    return flagged_markets.groupBy(month_key(F.col("close_t")).alias("month")).agg(F.count("*").alias("n"), F.avg(F.col("now").cast("double")).alias("share"), (F.sum(v * F.col("now")) / F.sum(v)).alias("volume_share"))


def exceedances(rows: DataFrame, value: Column, thresholds: list[float]) -> DataFrame:
    each = rows.select(value.alias("v"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return each.groupBy("threshold").agg(F.count_if(F.col("v") > F.col("threshold")).alias("n"), F.avg(F.when(F.col("v") > F.col("threshold"), 1.0).otherwise(0.0)).alias("rate"))


def projected_depth(day0: DataFrame, fills: DataFrame, refs: DataFrame) -> DataFrame:
    """(ticker, depth): 1 plus the lookback references that don't precede the first trade."""
    first = fills.groupBy("ticker").agg(F.min("t").alias("first_t"))
    later = refs.join(first, "ticker").groupBy("ticker").agg(F.count_if(F.col("ref_t") >= F.col("first_t")).alias("later"))
    return day0.select("ticker").distinct().join(later, "ticker").select("ticker", (1 + F.col("later")).alias("depth"))


def mixed_sources(fills: DataFrame) -> DataFrame:
    """(tickers, mixed, share): tickers whose fills come from more than one source."""
    per = fills.groupBy("ticker").agg((F.count_distinct("source") > 1).alias("mixed"))
    return per.agg(F.count("*").alias("tickers"), F.count_if("mixed").alias("mixed"), F.avg(F.col("mixed").cast("double")).alias("share"))


def sources_by_month(fills: DataFrame) -> DataFrame:
    wide = fills.groupBy("month").pivot("source", ["live", "historical"]).count()
    live, old = F.coalesce("live", F.lit(0)), F.coalesce("historical", F.lit(0))
    return wide.select("month", live.alias("live"), old.alias("historical"), (live / (live + old)).alias("live_share"))


def coverage(classified: DataFrame) -> DataFrame:
    """(category, n, share, volume_share) of classified rows; null is a stratum."""
    per = classified.groupBy("category").agg(F.count("*").alias("n"), F.sum("volume").alias("v"))
    total = Window.partitionBy()
    return per.select("category", "n", (F.col("n") / F.sum("n").over(total)).alias("share"), (F.col("v") / F.sum("v").over(total)).alias("volume_share"))


def quote_availability(markets: DataFrame, quotes: DataFrame, enough: float = 0.95) -> DataFrame:
    """(year, n, share, verdict): share of contracts with a spread by closing year; PASS, PARTIAL or FAIL."""
    rows = with_quotes(markets, quotes).groupBy(F.year(utc_date(F.col("close_t"))).alias("year"))
    out = rows.agg(F.count("*").alias("n"), F.avg(F.when(F.col("spread").isNotNull(), 1.0).otherwise(0.0)).alias("share"))
    return out.withColumn("verdict", F.when(F.col("share") >= enough, "PASS").when(F.col("share") > 0, "PARTIAL").otherwise("FAIL"))


def volume_consistency(markets: DataFrame, counts: DataFrame) -> DataFrame:
    """(ticker, consistent): volume above zero means at least one fill."""
    rows = markets.join(counts, "ticker", "left")
    return rows.select("ticker", (~((F.coalesce("volume_fp", F.lit(0.0)) > 0) & (F.coalesce("trades", F.lit(0)) == 0))).alias("consistent"))


def compare_builds(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows by key that one build lacks or in which a value differs; none if the builds are equal."""
    x = a.select(*keys, F.struct(*values).alias("a"))
    y = b.select(*keys, F.struct(*values).alias("b"))
    diff = x.join(y, keys, "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return diff.select(*keys, F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("differs").alias("kind"))


def closing_quotes(markets: DataFrame, candles: DataFrame, hours: int = 24) -> DataFrame:
    """The latest two-sided candle in the hours before the close, for every market: nulls where there is none."""
    near = candles.join(markets.select("ticker", "close_t"), "ticker").where((F.col("end_t") <= F.col("close_t")) & (F.col("end_t") > F.col("close_t") - hours * 3600))
    best = near.where("bid is not null and ask is not null").groupBy("ticker").agg(F.max_by(F.struct("end_t", "bid", "ask"), F.struct("end_t", "bid", "ask")).alias("q"))
    return markets.select("ticker").join(best, "ticker", "left").select("ticker", "q.end_t", "q.bid", "q.ask", F.round(F.col("q.ask") - F.col("q.bid"), 4).alias("spread"))


def frequency_profile(rows: DataFrame, by: list[str], member: str) -> DataFrame:
    """by, n and the last member of each combination, the most frequent first."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.max(member).alias("last_member")).orderBy(F.desc("n"))


def samples_per_group(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group in an order."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("place_", place).where(F.col("place_") <= n).drop("place_")


def changes(versions: DataFrame, key: str, order: list[str], signature: list[str]) -> DataFrame:
    """versions with changed: the signature differs from the version before; the first one counts as changed."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(F.struct(*signature)).over(w)
    return versions.withColumn("changed", ~before.eqNullSafe(F.struct(*signature)) | before.isNull())
