"""The registered queries over the domain tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import scalars as S
from ridgeline.operators import asof, compose, control, did, fees, panel, profiles, regression, returns, selection, tape, universe
from ridgeline.operators.stages import stored
from ridgeline.plans.oracle import BAND, DAY_START, FEE, LOOKUP, MONTH, ORDINAL, SHIFT, UTC_DAY, did_sql, event_moments_sql, mz_sql, sql, wild_shifts_sql
from ridgeline.sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The domain tables of one data folder, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.schedule = A.fee_schedule(spark)

    def __getattr__(self, name: str) -> DataFrame:
        made = getattr(self, f"make_{name}")() if hasattr(type(self), f"make_{name}") else getattr(A, name)(self.spark, self.dir)
        setattr(self, name, made)
        return made

    def base(self, name: str) -> DataFrame:
        return A.table(self.spark, self.dir, name)

    def fills_of(self, months: list[str]) -> DataFrame:
        return A.raw_fills(self.spark, self.dir, months)

    def make_side_fills(self) -> DataFrame:
        """What pricing both sides of a fill needs, without replays, which are whole rows again."""
        return self.raw_fills.select("trade_id", "ticker", "price", "count_fp", "taker_side", "t").distinct()

    def make_reasons(self) -> DataFrame:
        return universe.reasons(self.markets, self.quotes)

    def make_passed(self) -> DataFrame:
        return self.reasons.where("passed").select("ticker")

    def make_scope_markets(self) -> DataFrame:
        return self.markets.join(self.passed, "ticker", "left_semi")

    def make_panel(self) -> DataFrame:
        return panel.backfilled_panel(self.scope_markets, self.raw_fills)

    def make_stored(self) -> DataFrame:
        """The panel, computed once for all parts of a query that read it."""
        return stored(self.panel, "panel")

    def make_doubled(self) -> DataFrame:
        return panel.doubled(self.panel)

    def make_fits(self) -> DataFrame:
        return regression.boundary_shifts(self.stored.where("category is not null"), ["category"], A.WINDOW_END, A.PUBLICATION)

    def make_intervals(self) -> DataFrame:
        return regression.boundary_intervals(self.stored.where("category is not null"), ["category"], A.WINDOW_END, A.PUBLICATION)

    def make_frozen(self) -> DataFrame:
        return compose.category_mix(self.stored.where("in_r1_window"), A.FROZEN_YEAR)

    def make_weights(self) -> DataFrame:
        return compose.category_mix(self.stored.where("in_r2_window"))

    def make_first_psi(self) -> DataFrame:
        return regression.mz(self.stored.where("in_r1_window"), []).select("psi")

    def make_did(self) -> DataFrame:
        return did.did_pair(self.stored, self.schedule)

    def make_side_cells(self) -> DataFrame:
        """What margins and ribbon read, computed once: the tape is told from its replays and priced in one pass."""
        return stored(returns.side_cells(self.side_fills, self.scope_markets, self.schedule), "sides")

    def make_margins(self) -> DataFrame:
        return returns.margins_of(self.side_cells)

    def make_ribbon(self) -> DataFrame:
        return returns.ribbon_of(self.side_cells, self.grid)

    def make_publication_bar(self) -> DataFrame:
        return compose.delta_bar(self.intervals, self.frozen, "delta_pub")

    def make_escalated(self) -> DataFrame:
        return compose.escalation(self.did, self.publication_bar, self.margins, returns.ribbon_summary(self.ribbon))

    def make_flagged(self) -> DataFrame:
        return did.treated_flags(self.panel, self.schedule)

    def make_control(self) -> DataFrame:
        return control.control_panel(self.control_markets, self.control_trades, A.EPOCH_1997, A.WINDOW_END, control.RULES, ["slug"], ("volume",), A.CONTROL_COVERAGE)

    def make_listed(self) -> DataFrame:
        """The long schedule, drawn from the markets once."""
        return stored(A.listed_schedule(self.markets), "listed")

    def make_grid(self) -> DataFrame:
        return fees.default_grid(fees.sourced_maker_rate(self.schedule))


def query(oracle: str | None = None):
    """Registers f(tables) under its name."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle)
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- scans and maintenance -------------------------------------------------------------------------------------------

REPLAYED = "SELECT * FROM raw_fills UNION ALL SELECT * REPLACE (count_fp + 1 AS count_fp) FROM raw_fills WHERE month < '1996-01'"


@query("SELECT trade_id, ticker, price, count_fp FROM fills WHERE month IN ('1998-01', '1998-02', '1998-03')")
def a1_tape_scan_months(d):
    months = ["1998-01", "1998-02", "1998-03"]
    return tape.scan(d.fills_of(months), months=months, columns=["trade_id", "ticker", "price", "count_fp"])


@query("SELECT f.trade_id, f.ticker, f.price, f.taker_side FROM fills f SEMI JOIN passed p ON f.ticker = p.ticker WHERE month IN ('1999-05', '1999-06')")
def a2_scoped_scan(d):
    months = ["1999-05", "1999-06"]
    return tape.scan(d.fills_of(months), months=months, tickers=d.passed, columns=["trade_id", "ticker", "price", "taker_side"])


@query("SELECT trade_id, t, price, count_fp FROM fills WHERE ticker = 'P7'")
def a3_ticker_fills(d):
    return tape.scan(d.raw_fills.where("ticker = 'P7'"), columns=["trade_id", "t", "price", "count_fp"])


@query(
    f"SELECT trade_id, ticker, price, count_fp, t FROM ({REPLAYED}) QUALIFY row_number() OVER (PARTITION BY trade_id "
    "ORDER BY ticker NULLS FIRST, cents NULLS FIRST, price NULLS FIRST, count_fp NULLS FIRST, taker_side NULLS FIRST) = 1"
)
def a4_dedup_tape(d):
    replay = d.raw_fills.where("month < '1996-01'").withColumn("count_fp", F.col("count_fp") + 1)
    return tape.dedup(d.raw_fills.unionByName(replay)).select("trade_id", "ticker", "price", "count_fp", "t")


@query("SELECT DISTINCT month FROM fills")
def a7_months_on_disk(d):
    return tape.months_on_disk(d.raw_fills)


def old_new_markets(d):
    """Old and new markets that overlap and together are all."""
    cols = ["ticker", "series_ticker", "category", "result", "in_r1_window", "volume_fp"]
    old = d.markets.where("in_r1_window or volume_fp >= 1000").select(*cols, F.col("close_t").alias("first_seen"))
    new = d.markets.where("in_r2_window or volume_fp >= 1000").select(
        "ticker", F.when(F.col("key") % 4 != 0, F.concat(F.col("series_ticker"), F.lit("x"))).alias("series_ticker"), F.lit(None).cast("string").alias("category"),
        F.when(F.col("key") % 10 != 0, F.col("result")).alias("result"), F.lit(False).alias("in_r1_window"), (F.col("volume_fp") + 1).alias("volume_fp"), F.lit(0).cast("long").alias("first_seen"))
    return old, new


@query(
    "SELECT ticker, coalesce(n.series_ticker, o.series_ticker) AS series_ticker, o.category AS category, CASE WHEN n.ticker IS NOT NULL THEN n.result ELSE o.result END AS result, "
    "coalesce(o.in_r1_window, FALSE) AS in_r1_window, CASE WHEN n.ticker IS NOT NULL THEN n.volume_fp ELSE o.volume_fp END AS volume_fp, CASE WHEN o.ticker IS NOT NULL THEN o.first_seen ELSE 0 END AS first_seen "
    "FROM (SELECT ticker, series_ticker, category, result, in_r1_window, volume_fp, close_t AS first_seen FROM markets WHERE in_r1_window OR volume_fp >= 1000) o FULL JOIN "
    "(SELECT ticker, CASE WHEN key % 4 <> 0 THEN series_ticker || 'x' END AS series_ticker, CASE WHEN key % 10 <> 0 THEN result END AS result, volume_fp + 1 AS volume_fp FROM markets WHERE in_r2_window OR volume_fp >= 1000) n USING (ticker)"
)
def a8_market_upsert(d):
    old, new = old_new_markets(d)
    return tape.upsert(old, new, ["ticker"], keep_old_if_null=("series_ticker", "category"), sticky=("in_r1_window",), first_seen=("first_seen",))


@query(
    "SELECT ticker, CASE WHEN n.ticker IS NOT NULL THEN n.spread ELSE o.spread END AS spread, CASE WHEN n.ticker IS NOT NULL THEN 'new' ELSE o.quote_source END AS quote_source "
    "FROM (SELECT * FROM quotes WHERE spread <> 0.05 OR spread IS NULL) o FULL JOIN (SELECT ticker, CASE WHEN spread < 0.1 THEN spread END AS spread FROM quotes WHERE spread < 0.15) n USING (ticker)"
)
def a9_quote_upsert(d):
    new = d.quotes.where("spread < 0.15").select("ticker", F.when(F.col("spread") < 0.1, F.col("spread")).alias("spread"), F.lit("new").alias("quote_source"))
    return tape.upsert(d.quotes.where("spread <> 0.05 or spread is null"), new, ["ticker"])


@query(
    "SELECT ticker, lookback_day, CASE WHEN n.ticker IS NOT NULL THEN n.p ELSE o.p END AS p FROM (SELECT ticker, lookback_day, p FROM panel WHERE lookback_day <= 6) o "
    "FULL JOIN (SELECT ticker, lookback_day, CASE WHEN p > 0.5 THEN 1 - p END AS p FROM panel WHERE lookback_day >= 4) n USING (ticker, lookback_day)"
)
def a10_panel_upsert(d):
    old = d.panel.where("lookback_day <= 6").select("ticker", "lookback_day", "p")
    new = d.panel.where("lookback_day >= 4").select("ticker", "lookback_day", F.when(F.col("p") > 0.5, 1 - F.col("p")).alias("p"))
    return tape.upsert(old, new, ["ticker", "lookback_day"])


@query(
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) END AS close_t, "
    "CASE WHEN o_orderkey % 7 <> 0 THEN CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) BETWEEN 852076800 AND 915148800 END AS in_window FROM orders"
)
def a16_market_rows(d):
    iso = F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    rows = d.base("orders").select(F.col("o_orderkey").alias("id"), S.iso_to_epoch(iso).alias("close_t"))
    return rows.withColumn("in_window", F.col("close_t").between(A.EPOCH_1997, A.WINDOW_END))


def candles(d):
    k = F.col("o_orderkey")
    made = d.base("orders").select(
        F.concat(F.lit("P"), k % 200).alias("ticker"), k.alias("key"), (k % 60 * 3600).alias("back"),
        F.when(k % 5 != 0, (k % 40).cast("double") / 100).alias("bid"), F.when(k % 7 != 0, (k % 40 + k % 25).cast("double") / 100).alias("ask"))
    return made.join(d.markets.select("ticker", "close_t"), "ticker").select("ticker", (F.col("close_t") + 3600 * 6 - F.col("back")).alias("end_t"), "bid", "ask")


@query(
    "SELECT ticker, end_t, bid, ask, round(ask - bid, 4) AS spread FROM markets LEFT JOIN (SELECT * FROM (SELECT m.ticker, m.close_t + 21600 - o.o_orderkey % 60 * 3600 AS end_t, m.close_t AS c, "
    "CASE WHEN o.o_orderkey % 5 <> 0 THEN CAST(o.o_orderkey % 40 AS DOUBLE) / 100 END AS bid, CASE WHEN o.o_orderkey % 7 <> 0 THEN CAST(o.o_orderkey % 40 + o.o_orderkey % 25 AS DOUBLE) / 100 END AS ask "
    "FROM orders o JOIN markets m ON m.ticker = concat('P', o.o_orderkey % 200)) WHERE bid IS NOT NULL AND ask IS NOT NULL AND end_t <= c AND end_t > c - 86400 "
    "QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY end_t DESC, bid DESC, ask DESC) = 1) USING (ticker)"
)
def a17_closing_quotes(d):
    return profiles.closing_quotes(d.markets, candles(d))


@query(
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(max(o_custkey) AS BIGINT) AS last_member FROM orders GROUP BY ALL ORDER BY n DESC"
)
def a23_frequency_profile(d):
    return profiles.frequency_profile(d.base("orders"), ["o_orderstatus", "o_orderpriority"], "o_custkey")


@query(
    "SELECT o_custkey, o_orderkey, coalesce((o_orderstatus, o_orderpriority) <> lag((o_orderstatus, o_orderpriority)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), TRUE) AS changed FROM orders"
)
def a24_version_changes(d):
    return profiles.changes(d.base("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"]).select("o_custkey", "o_orderkey", "changed")


# --- universe --------------------------------------------------------------------------------------------------------


#: The label of a contract's window, as in universe.window_label().
LABEL = "CASE WHEN in_r1_window THEN 'r1' WHEN in_r2_window THEN 'r2' END"


@query(f"SELECT ticker, {LABEL} AS \"window\", len(reasons) = 0 AS passed, array_to_string(reasons, ',') AS reasons FROM reasons")
def b1_universe_reasons(d):
    return d.reasons.select("ticker", "window", "passed", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT ticker, coalesce(settlement_value IS NOT NULL AND result IN ('yes', 'no') AND (result = 'yes') != (settlement_value >= 0.5), FALSE) AS contradicts FROM markets")
def b2_settlement_contradicts(d):
    return d.markets.select("ticker", universe.settlement_contradicts().alias("contradicts"))


@query(
    "SELECT ticker, array_to_string(list_concat(CASE WHEN NOT tape_done THEN ['dollar_volume_not_yet_fetched'] WHEN coalesce(dollars, 0) < 1000 THEN ['volume_below_1000'] ELSE [] END, "
    "list_filter(reasons, lambda x: x <> 'volume_below_1000')), ',') AS reasons FROM reasons LEFT JOIN (SELECT ticker, sum(count_fp * price) AS dollars FROM fills GROUP BY ticker) USING (ticker)"
)
def b3_dollar_universe(d):
    found = universe.reasons(d.markets, d.quotes, tape.dollar_volume(d.raw_fills))
    return found.select("ticker", F.array_join("reasons", ",").alias("reasons"))


@query(
    f"SELECT {LABEL} AS \"window\", item, count(*) AS n FROM (SELECT *, unnest(list_concat(['total', CASE WHEN len(reasons) = 0 THEN 'passed' ELSE 'failed' END], reasons)) AS item FROM reasons) GROUP BY ALL"
)
def b4_filter_summary(d):
    return universe.summary(d.reasons)


@query(f"SELECT {LABEL} AS \"window\", ticker, unnest(reasons) AS reason_code FROM reasons")
def b5_exclusion_log(d):
    return universe.exclusion_log(d.reasons)


@query("SELECT ticker FROM passed WHERE in_r1_window")
def b6_in_scope(d):
    stamps = d.spark.createDataFrame([("r1",)], "window string")
    return universe.in_scope(d.markets, universe.exclusion_log(universe.reasons(d.markets, d.quotes, window="r1")), "r1", "in_r1_window", stamps)


@query("SELECT ticker FROM markets WHERE volume_fp >= 1000 AND close_t - open_t >= 86400")
def b7_cheap_scope(d):
    return d.markets.where(universe.cheap_scope(universe.LEAST_VOLUME, universe.LEAST_OPEN)).select("ticker")


@query("SELECT ticker FROM passed WHERE NOT tape_done AND in_r2_window AND close_t < 960000000")
def b8_work_list(d):
    return universe.work_list(d.markets, d.quotes, "in_r2_window", close_to=960_000_000)


@query("SELECT ticker FROM quoted WHERE NOT attempted AND volume_fp >= 1000 AND close_t - open_t >= 86400")
def b9_quote_work_list(d):
    return universe.quote_work_list(d.markets, d.quotes)


@query("SELECT DISTINCT ticker FROM fills ANTI JOIN quotes USING (ticker)")
def b9_orphans(d):
    return universe.orphans(d.raw_fills, d.quotes)


@query(
    "SELECT DISTINCT event_ticker, CASE WHEN n % 3 = 0 THEN 'unresolved' WHEN n % 7 = 0 THEN 'terminal' ELSE 'resolved' END AS state FROM (SELECT event_ticker, CAST(substr(event_ticker, 2) AS BIGINT) AS n FROM markets)"
)
def b10_resolution_state(d):
    n = F.substr(F.col("event_ticker"), F.lit(2)).cast("long")
    events = d.markets.select("event_ticker").distinct()
    lookup = events.where(n % 3 != 0).select("event_ticker", F.when(n % 7 != 0, F.lit("S")).alias("series_ticker"))
    return universe.resolution_state(events, lookup)


@query("SELECT ticker FROM passed WHERE tape_done")
def b11_analysable(d):
    return d.scope_markets.where("tape_done").select("ticker")


@query(f"SELECT DISTINCT cents, {BAND.format(p='price')} AS band, {BAND.format(p='(1 - price)')} AS band_no FROM fills")
def b13_price_bands(d):
    return d.raw_fills.select("cents", S.price_band(F.col("price")).alias("band"), S.price_band(1 - F.col("price")).alias("band_no")).distinct()


@query("SELECT side, CASE WHEN taker_side IN ('yes', 'no') THEN CASE WHEN side = taker_side THEN 'taker' ELSE 'maker' END END AS role, count(*) AS n FROM doubled GROUP BY ALL")
def b14_roles(d):
    return d.doubled.groupBy("side", panel.role().alias("role")).agg(F.count("*").alias("n"))


@query("SELECT ticker, NOT (volume_fp > 0 AND n IS NULL) AS consistent FROM markets LEFT JOIN (SELECT ticker, count(*) AS n FROM fills GROUP BY ticker) USING (ticker)")
def b16_volume_consistency(d):
    return profiles.volume_consistency(d.markets, tape.trade_counts(d.raw_fills))


# --- joins -----------------------------------------------------------------------------------------------------------

EVENT_REFS = "SELECT concat('U', user_id) AS ticker, event_id AS ref_id, epoch_us(ts) + 3600000000 * (event_id % 5) - 7200000000 AS ref_t FROM events"


@query(
    f"SELECT r.ticker, r.ref_id, r.ref_t, k.t, k.price, k.taker_side, k.trade_id FROM ({EVENT_REFS}) r "
    "ASOF JOIN (SELECT * FROM event_fills QUALIFY row_number() OVER (PARTITION BY ticker, t ORDER BY trade_id) = 1) k ON r.ticker = k.ticker AND r.ref_t >= k.t"
)
def c1_asof_last_trade(d):
    shift = F.col("event_id") % 5 * 3_600_000_000 - 7_200_000_000
    refs = d.base("events").select(F.concat(F.lit("U"), "user_id").alias("ticker"), F.col("event_id").alias("ref_id"), (A.micros(F.col("ts")) + shift).alias("ref_t"))
    return asof.last_trade_at_or_before(refs, d.event_fills, ["ref_id"], bucket=7 * 86_400_000_000).select("ticker", "ref_id", "ref_t", "t", "price", "taker_side", "trade_id")


@query("SELECT ticker, t, price, count_fp, taker_side, trade_id FROM ticks")
def c2_tick_collapse(d):
    return asof.tick_collapse(d.raw_fills)


@query("SELECT ticker, lookback_day, ref_t FROM back_refs")
def c3_lookback_refs(d):
    day0 = asof.last_trade_at_or_before(panel.closing_refs(d.scope_markets), d.raw_fills, ["lookback_day"])
    return panel.lookback_refs(day0)


@query("SELECT ticker, lookback_day, event_ticker, category, close_t, y, p, count_fp, taker_side FROM panel")
def c4_panel_backfilled(d):
    return d.panel.select("ticker", "lookback_day", "event_ticker", "category", "close_t", "y", "p", "count_fp", "taker_side")


EVENT_MARKETS = "SELECT concat('U', user_id) AS ticker, max(epoch_us(ts)) - 3600000000 * (user_id % 50) AS close_t, CASE WHEN user_id % 2 = 0 THEN 'yes' ELSE 'no' END AS result FROM events GROUP BY user_id"


@query(
    f"""WITH em AS ({EVENT_MARKETS}), ek AS (SELECT * FROM event_fills QUALIFY row_number() OVER (PARTITION BY ticker, t ORDER BY trade_id) = 1),
  e0 AS (SELECT m.ticker, 0 AS lookback_day, m.close_t AS ref_t, k.t, k.price FROM em m ASOF JOIN ek k ON m.ticker = k.ticker AND m.close_t >= k.t),
  er AS (SELECT ticker, CAST(k AS INTEGER) AS lookback_day, epoch_us((make_timestamptz(t) AT TIME ZONE 'America/New_York' - to_days(CAST(k AS INTEGER))) AT TIME ZONE 'America/New_York') AS ref_t FROM e0, range(1, 11) r(k)),
  ep AS (SELECT * FROM e0 UNION ALL SELECT r.ticker, r.lookback_day, r.ref_t, k.t, k.price FROM er r ASOF JOIN ek k ON r.ticker = k.ticker AND r.ref_t >= k.t),
  own AS (SELECT * FROM ep WHERE t >= epoch_us(date_trunc('day', make_timestamptz(ref_t) AT TIME ZONE 'America/New_York') AT TIME ZONE 'America/New_York'))
  SELECT ticker, lookback_day, price AS p FROM own WHERE ticker IN (SELECT ticker FROM own WHERE lookback_day = 0) AND price > 0 AND price < 1"""
)
def c5_panel_skip_rule(d):
    e = d.base("events").groupBy("user_id").agg(F.max(A.micros(F.col("ts"))).alias("last"))
    none = F.lit(None).cast("string")
    m = e.select(
        F.concat(F.lit("U"), "user_id").alias("ticker"), none.alias("event_ticker"), none.alias("series_ticker"), none.alias("category"),
        (F.col("last") - F.col("user_id") % 50 * 3_600_000_000).alias("close_t"), F.when(F.col("user_id") % 2 == 0, "yes").otherwise("no").alias("result"),
        F.lit(True).alias("in_r1_window"), F.lit(False).alias("in_r2_window"))
    return panel.skip_panel(m, d.event_fills, "MICROSECOND").select("ticker", "lookback_day", "p")


@query("SELECT ticker, close_t, y, p, category FROM control_panel")
def c6_last_trade_before_end(d):
    return d.control.select("ticker", "close_t", "y", "p", "category")


FEE_ASKED = f"SELECT DISTINCT unnest(['taker', 'maker']) AS role, {UTC_DAY.format(t='t')} AS as_of, ticker, series_ticker FROM fills JOIN markets USING (ticker)"


def fee_asked(d: Tables) -> DataFrame:
    """Every ticker's days with fills, for both roles; the days are told apart before they are doubled."""
    rows = d.raw_fills.join(d.markets.select("ticker", "series_ticker"), "ticker")
    days = rows.select(S.utc_date(F.col("t")).alias("as_of"), "ticker", "series_ticker").distinct()
    return days.select(F.explode(F.array(F.lit("taker"), F.lit("maker"))).alias("role"), "as_of", "ticker", "series_ticker")


@query(f"WITH fa AS ({FEE_ASKED}) SELECT role, as_of, ticker, series_ticker, form, rate, scope_kind FROM ({LOOKUP.format(asked='fa')})")
def c9_fee_lookup(d):
    return fees.lookup(fee_asked(d), d.schedule)


@query(f"WITH fa AS ({FEE_ASKED}) SELECT role, as_of, ticker, series_ticker, form, rate, scope_kind FROM ({LOOKUP.format(asked='fa').replace('fee_rows', 'listed_rows')})")
def c10_listed_fee_lookup(d):
    """Every day's fills against a schedule of many generations, series and prefixes, by joins of equality."""
    return fees.lookup(fee_asked(d), d.listed)


@query("SELECT f.trade_id, m.event_ticker, m.series_ticker, m.category FROM fills f LEFT JOIN markets m USING (ticker)")
def c11_enrichment(d):
    rows = tape.scan(d.raw_fills, columns=["trade_id", "ticker"])
    return rows.join(d.markets.select("ticker", "event_ticker", "series_ticker", "category"), "ticker", "left").drop("ticker")


@query(
    "SELECT count(*) FILTER (WHERE has) AS with_fills, count(*) FILTER (WHERE NOT has) AS without_fills FROM (SELECT EXISTS (SELECT 1 FROM fills f WHERE f.ticker = m.ticker) AS has FROM markets m)"
)
def c12_exists_probes(d):
    traded = d.raw_fills.select("ticker")
    has = d.markets.join(traded, "ticker", "left_semi").agg(F.count("*").alias("with_fills"))
    return has.crossJoin(d.markets.join(traded, "ticker", "left_anti").agg(F.count("*").alias("without_fills")))


OTHER = "SELECT ticker, lookback_day, CASE WHEN lookback_day = 3 THEN p + 0.01 ELSE p END AS p FROM panel WHERE lookback_day <> 5"


@query(
    f"SELECT ticker, lookback_day, CASE WHEN b.ticker IS NULL THEN 'only_a' ELSE 'differs' END AS kind FROM panel a LEFT JOIN ({OTHER}) b USING (ticker, lookback_day) WHERE b.ticker IS NULL OR a.p <> b.p"
)
def c13_compare_builds(d):
    other = d.panel.where("lookback_day <> 5").withColumn("p", F.when(F.col("lookback_day") == 3, F.col("p") + 0.01).otherwise(F.col("p")))
    return profiles.compare_builds(d.panel, other, ["ticker", "lookback_day"], ["p"])


NETS = "SELECT *, {b} AS band, (y - p - fee / count_fp) / p AS net FROM panel_fee".format(b=BAND.format(p="p"))
NETS_100 = "SELECT *, {b} AS band, (y - p - {f} / 100) / p AS net FROM panel_fee".format(b=BAND.format(p="p"), f=FEE.format(f="form", r="rate", c="100", p="p"))


@query(
    f"SELECT band, round((b.net - a.net) * 10000, 4) AS bp FROM (SELECT band, avg(net) AS net FROM ({NETS}) GROUP BY band) a JOIN (SELECT band, avg(net) AS net FROM ({NETS_100}) GROUP BY band) b USING (band)"
)
def c14_compare_fee_models(d):
    own = returns.returns_by_band(d.panel, d.schedule).select("band", F.col("mean_net").alias("own"))
    fixed = returns.returns_by_band(d.panel.withColumn("count_fp", F.lit(100.0)), d.schedule).select("band", F.col("mean_net").alias("fixed"))
    return own.join(fixed, "band").select("band", F.round((F.col("fixed") - F.col("own")) * 10_000, 4).alias("bp"))


# --- aggregations ----------------------------------------------------------------------------------------------------


@query("SELECT ticker, count(*) AS trades FROM fills GROUP BY ticker")
def d1_trade_counts(d):
    return tape.trade_counts(d.raw_fills)


@query("SELECT ticker, round(sum(count_fp * price), 4) AS dollars FROM fills GROUP BY ticker")
def d2_dollar_volume(d):
    return rounded(tape.dollar_volume(d.raw_fills), 4)


@query(
    "SELECT ticker, coalesce(r.n, 0) AS recorded, coalesce(c.n, 0) AS counted, coalesce(c.n, 0) - coalesce(r.n, 0) AS delta FROM (SELECT ticker, key % 40 AS n FROM markets) r "
    "FULL JOIN (SELECT ticker, count(*) AS n FROM fills GROUP BY ticker) c USING (ticker)"
)
def d3_completeness(d):
    return tape.completeness(d.markets.select("ticker", (F.col("key") % 40).alias("recorded")), tape.trade_counts(d.raw_fills))


#: Targets of the adapted universe; round numbers to measure distance from.
TARGETS = {"events": 500, "yes_contracts": 1_000, "yes_prices": 10_000, "doubled_prices": 20_000, "tail_low": 2_000, "tail_high": 2_000}


@query(
    "WITH c AS (SELECT (SELECT count(DISTINCT event_ticker) FROM panel) AS events, (SELECT count(DISTINCT ticker) FROM panel) AS yes_contracts, (SELECT count(*) FROM panel) AS yes_prices, "
    "(SELECT count(*) FROM doubled) AS doubled_prices, (SELECT count(*) FROM doubled WHERE round(p * 100, 6) > 0 AND round(p * 100, 6) <= 10) AS tail_low, "
    "(SELECT count(*) FROM doubled WHERE round(p * 100, 6) > 90 AND round(p * 100, 6) <= 99) AS tail_high), l AS (UNPIVOT c ON COLUMNS(*) INTO NAME item VALUE actual) "
    "SELECT item, actual, target, actual - target AS delta, round((actual - target) * 100.0::DOUBLE / target, 2) AS delta_pct FROM l JOIN (VALUES "
    + ", ".join(f"('{k}', CAST({v} AS BIGINT))" for k, v in TARGETS.items())
    + ") v(item, target) USING (item)"
)
def d4_reconcile_counts(d):
    return profiles.reconcile(d.panel, d.doubled, TARGETS)


@query(
    "SELECT \"window\", count(*) FILTER (WHERE r = 'spread_filter_not_computable') AS structural, count(*) FILTER (WHERE r = 'spread_filter_not_yet_fetched') AS operational, "
    f"count(*) FILTER (WHERE r NOT IN ('spread_filter_not_computable', 'spread_filter_not_yet_fetched')) AS other FROM (SELECT {LABEL} AS \"window\", unnest(reasons) AS r FROM reasons) GROUP BY 1"
)
def d5_gap_breakdown(d):
    return profiles.gap_breakdown(universe.exclusion_log(d.reasons))


MIX = "SELECT coalesce(category, 'unknown') AS category, n / sum(n) OVER () AS weight FROM (SELECT category, count(DISTINCT ticker) AS n FROM panel WHERE {where} GROUP BY category)"
FROZEN = MIX.format(where="in_r1_window AND year(make_timestamp(close_t * 1000000)) = 1998")
NOW = MIX.format(where="in_r2_window")


@query(f"SELECT category, round(weight, 6) AS weight FROM ({FROZEN})")
def d6_category_mix(d):
    return rounded(d.frozen)


@query(f"SELECT category, round(weight, 6) AS weight FROM ({NOW})")
def d7_category_weights(d):
    return rounded(d.weights)


@query("SELECT (SELECT count(*) FROM panel) AS yes_rows, (SELECT count(*) FROM doubled) AS doubled_rows, TRUE AS holds")
def d8_basis_counts(d):
    return profiles.basis_counts(d.panel, d.doubled)


@query(
    "SELECT era, coalesce(n, 0) AS n, rate_taker_side, rate_count_fp FROM (VALUES ('y1996'), ('y1997'), ('y1998'), ('y1999'), ('y2000'), ('_unassigned')) e(era) LEFT JOIN (SELECT "
    "CASE WHEN year(make_timestamp(t * 1000000)) BETWEEN 1996 AND 2000 THEN 'y' || year(make_timestamp(t * 1000000)) ELSE '_unassigned' END AS era, count(*) AS n, "
    "round(count(taker_side) / count(*), 4) AS rate_taker_side, round(count(count_fp) / count(*), 4) AS rate_count_fp FROM fills GROUP BY 1) USING (era)"
)
def d9_field_population(d):
    return profiles.population_by_era(d.fills, ["taker_side", "count_fp"])


@query(
    f"SELECT {BAND.format(p='p')} AS band, count(*) AS n, CAST(sum(CAST(y AS BIGINT)) AS DOUBLE) / count(*) AS win_rate, CAST(sum(CAST(round(p * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100) AS mean_price FROM doubled GROUP BY 1"
)
def d10_win_rate_by_band(d):
    return returns.win_rate_by_band(d.doubled)


@query(
    f"SELECT band, count(*) AS n, round(avg((y - p) / p), 6) AS mean_gross, round(avg(net), 6) AS mean_net, count(*) FILTER (WHERE fee IS NULL) AS excluded FROM ({NETS}) GROUP BY band"
)
def d11_returns_by_band(d):
    return rounded(returns.returns_by_band(d.panel, d.schedule))


@query(
    f"SELECT coalesce(band, 'all') AS band, round(avg((y - p) / p) FILTER (WHERE who = 'maker'), 6) AS maker_return, round(avg((y - p - fee / count_fp) / p) FILTER (WHERE who = 'taker'), 6) AS taker_return, "
    "round(avg((y - p) / p) FILTER (WHERE who = 'maker' AND p >= 0.5), 6) AS maker_return_50c, count(*) FILTER (WHERE who = 'maker') AS n_maker, count(*) FILTER (WHERE who = 'taker' AND fee IS NOT NULL) AS n_taker, "
    "count(*) FILTER (WHERE who = 'taker' AND fee IS NULL) AS excluded, round(avg(CASE WHEN who = 'maker' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS maker_share "
    f"FROM (SELECT *, {BAND.format(p='p')} AS band FROM doubled_fee) GROUP BY ROLLUP (band)"
)
def d12_maker_taker_split(d):
    return rounded(returns.maker_taker_split(d.doubled, d.schedule))


NET = "(y - p - " + FEE.format(f="form", r="rate", c="count_fp", p="p") + " / count_fp) / p"
LAYER = "SELECT avg(v) FILTER (WHERE role = 'maker') - avg(v) FILTER (WHERE role = 'taker') AS m, count(v) FILTER (WHERE role = 'maker') AS nm, count(v) FILTER (WHERE role = 'taker') AS nt, count(*) FILTER (WHERE v IS NULL) AS gaps FROM "
A_, B_, C_ = f"{LAYER} (SELECT role, (y - p) / p AS v FROM sides)", f"{LAYER} (SELECT role, {NET} AS v FROM sides_b)", f"{LAYER} (SELECT role, {NET} AS v FROM sides_c)"


@query(
    f"SELECT round(a.m, 6) AS margin_a, round(b.m, 6) AS margin_b, round(c.m, 6) AS margin_c, a.nm AS n_maker_a, a.nt AS n_taker_a, b.nm AS n_maker_b, b.nt AS n_taker_b, b.gaps AS gaps_b, c.nm AS n_maker_c, c.nt AS n_taker_c, c.gaps AS gaps_c FROM ({A_}) a, ({B_}) b, ({C_}) c"
)
def d13_maker_margin_layers(d):
    return rounded(returns.maker_margins(d.side_fills, d.scope_markets, d.schedule))


FUNNEL = [
    ("1_all", "TRUE"), ("2_volume", "volume_fp >= 1000"), ("3_open_24h", "close_t - open_t >= 86400"), ("4_quoted", "attempted"), ("5_computable", "spread IS NOT NULL"), ("6_spread", "spread <= 0.20"), ("7_result", "result IN ('yes', 'no')")]


BEFORE = "lag(markets) OVER (PARTITION BY \"window\" ORDER BY stage)"
STAGED = " UNION ALL ".join(
    f"SELECT {LABEL} AS \"window\", '{n}' AS stage, count(*) FILTER (WHERE {' AND '.join(c for _, c in FUNNEL[: i + 1])}) AS markets, "
    f"count(DISTINCT event_ticker) FILTER (WHERE {' AND '.join(c for _, c in FUNNEL[: i + 1])}) AS events FROM quoted GROUP BY 1"
    for i, (n, _) in enumerate(FUNNEL)
)


@query(f"SELECT \"window\", stage, markets, events, {BEFORE} - markets AS lost, round(({BEFORE} - markets) * 100.0::DOUBLE / {BEFORE}, 6) AS lost_pct FROM ({STAGED}) WHERE \"window\" IS NOT NULL")
def d15_funnel(d):
    return universe.funnel(d.markets, d.quotes)


@query(
    "SELECT bucket, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT CASE WHEN NOT attempted THEN 'not_fetched' WHEN spread IS NULL THEN 'not_computable' WHEN spread > 0.20 THEN 'too_wide' ELSE 'passes' END AS bucket, count(*) AS n "
    "FROM quoted WHERE volume_fp >= 1000 AND close_t - open_t >= 86400 GROUP BY 1)"
)
def d16_spread_loss(d):
    return rounded(profiles.spread_loss(d.markets, d.quotes))


@query(
    "SELECT coalesce(bucket, 'total') AS bucket, count(DISTINCT ticker) AS contracts, count(*) AS prices, round(count(*) / count(DISTINCT ticker), 6) AS depth FROM (SELECT ticker, CASE WHEN (m.close_t - open_t) / 3600.0 < 48 THEN 'a_under_2d' "
    "WHEN (m.close_t - open_t) / 3600.0 < 168 THEN 'b_2d_to_7d' ELSE 'c_over_7d' END AS bucket FROM panel JOIN markets m USING (ticker)) GROUP BY ROLLUP (bucket)"
)
def d17_panel_depth(d):
    return rounded(profiles.panel_depth(d.panel, d.markets))


ELIGIBLE = "volume_fp >= 1000 AND close_t - open_t >= 86400"


@query(
    f"SELECT coalesce(month, 'total') AS month, count(*) FILTER (WHERE e) AS eligible, count(*) FILTER (WHERE e AND attempted) AS quoted, count(*) FILTER (WHERE ok) AS in_scope, count(*) FILTER (WHERE ok AND tape_done) AS analysable, "
    f"count(*) FILTER (WHERE e) = count(*) FILTER (WHERE e AND attempted) AS ready FROM (SELECT *, {MONTH.format(t='close_t')} AS month, {ELIGIBLE} AS e, len(reasons) = 0 AS ok FROM reasons) GROUP BY ROLLUP (month)"
)
def d18_readiness(d):
    return profiles.readiness(d.markets, d.quotes, d.reasons)


@query(
    "SELECT CASE WHEN in_r1_window THEN 'r1' ELSE 'r2' END AS \"window\", round(count(*) FILTER (WHERE attempted AND len(reasons) = 0) / count(*) FILTER (WHERE attempted), 6) AS pass_rate, "
    "round(count(*) FILTER (WHERE attempted AND len(reasons) = 0) / count(*) FILTER (WHERE attempted) - 0.6, 6) AS against_forecast, count(*) FILTER (WHERE NOT attempted) AS unquoted FROM reasons GROUP BY 1"
)
def d19_tail_yield(d):
    return rounded(profiles.tail_yield(d.markets, d.quotes, d.reasons, 0.6))


@query(
    f"WITH ma AS (SELECT DISTINCT 'maker' AS role, {UTC_DAY.format(t='close_t')} AS as_of, CAST(NULL AS VARCHAR) AS ticker, series_ticker FROM markets), mc AS (SELECT series_ticker, as_of, CASE WHEN form <> 'none' AND rate <> 0 THEN 1 ELSE 0 END AS now FROM ({LOOKUP.format(asked='ma')})) "
    f"SELECT {MONTH.format(t='close_t')} AS month, count(*) AS n, round(avg(CAST(coalesce(now, 0) AS DOUBLE)), 6) AS share, round(sum(volume_fp * coalesce(now, 0)) / sum(volume_fp), 6) AS volume_share FROM markets m LEFT JOIN mc c ON m.series_ticker = c.series_ticker AND {UTC_DAY.format(t='m.close_t')} = c.as_of GROUP BY 1"
)
def d20_treated_share(d):
    return rounded(profiles.treated_share(did.treated_flags(d.markets.withColumn("month_", F.lit(0)), d.schedule)))


REPORTED = "SELECT abs(p - CAST((CAST(round(p * 100) AS BIGINT) + CAST(substr(ticker, 2) AS BIGINT) % 7) AS DOUBLE) / 100) AS v FROM panel WHERE lookback_day = 0"


def reported_gap(d):
    shown = (F.round(F.col("p") * 100).cast("long") + F.substr(F.col("ticker"), F.lit(2)).cast("long") % 7).cast("double") / 100
    return d.panel.where("lookback_day = 0").select(F.abs(F.col("p") - shown).alias("v"))


@query(
    f"WITH s AS (SELECT round(v, 6) AS v, row_number() OVER (ORDER BY round(v, 6)) - 1 AS i, count(*) OVER () AS n FROM ({REPORTED})) SELECT CAST(q AS DOUBLE) AS share, v AS value FROM s, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) x(q) WHERE i = least(CAST(floor(q * n) AS BIGINT), n - 1)"
)
def d21_close_validation_ranks(d):
    return selection.nearest_rank(reported_gap(d), [], F.round("v", 6), [0.5, 0.9, 0.95])


@query(
    f"SELECT CAST(th AS DOUBLE) AS threshold, count(*) FILTER (WHERE round(v, 6) > th) AS n, round(avg(CASE WHEN round(v, 6) > th THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rate FROM ({REPORTED}), (VALUES (0.0::DOUBLE), (0.01::DOUBLE), (0.05::DOUBLE)) x(th) GROUP BY th"
)
def d21_close_validation_exceedances(d):
    return rounded(profiles.exceedances(reported_gap(d), F.round("v", 6), [0.0, 0.01, 0.05]))


@query("SELECT ticker, 1 + count(*) FILTER (WHERE ref_t >= first_t) AS depth FROM back_refs JOIN (SELECT ticker, min(t) AS first_t FROM fills GROUP BY ticker) USING (ticker) GROUP BY ticker")
def d22_depth_projection(d):
    day0 = asof.last_trade_at_or_before(panel.closing_refs(d.scope_markets), d.raw_fills, ["lookback_day"])
    return profiles.projected_depth(day0, d.raw_fills, panel.lookback_refs(day0))


@query("SELECT count(*) AS tickers, count(*) FILTER (WHERE m) AS mixed, round(avg(CAST(m AS DOUBLE)), 6) AS share FROM (SELECT ticker, count(DISTINCT source) > 1 AS m FROM fills GROUP BY ticker)")
def d23_mixed_sources(d):
    return rounded(profiles.mixed_sources(d.raw_fills))


@query(
    "SELECT month, count(*) FILTER (WHERE source = 'live') AS live, count(*) FILTER (WHERE source = 'historical') AS historical, round(count(*) FILTER (WHERE source = 'live') / count(*), 6) AS live_share FROM fills GROUP BY month"
)
def d24_sources_by_month(d):
    return rounded(profiles.sources_by_month(d.fills))


@query("SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(sum(volume) / sum(sum(volume)) OVER (), 6) AS volume_share FROM control_panel GROUP BY category")
def d25_classification_coverage(d):
    return rounded(profiles.coverage(d.control))


@query("SELECT month, count(*) FILTER (WHERE now = 1) AS treated, count(*) FILTER (WHERE now = 0) AS control, count(*) FILTER (WHERE now = 1) > 0 AND count(*) FILTER (WHERE now = 0) > 0 AS \"both\" FROM flagged GROUP BY month")
def d26_arm_sizes(d):
    return did.arm_sizes(d.flagged)


@query("SELECT series_ticker, min(month) AS cohort FROM flagged WHERE now = 1 GROUP BY series_ticker")
def d27_cohorts(d):
    return did.cohorts(d.flagged)


@query(
    "SELECT CAST(year(make_timestamp(close_t * 1000000)) AS INTEGER) AS year, count(*) AS n, round(avg(CASE WHEN spread IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share, "
    "CASE WHEN avg(CASE WHEN spread IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.9 THEN 'PASS' WHEN count(spread) > 0 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM quoted GROUP BY 1"
)
def d28_quote_availability(d):
    return rounded(profiles.quote_availability(d.markets, d.quotes, 0.9))


@query("SELECT event_type, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi FROM events GROUP BY event_type")
def d29_percentiles(d):
    ends = selection.percentiles(d.base("events"), ["event_type"], F.col("value"), [0.025, 0.975])
    return rounded(ends.groupBy("event_type").agg(F.max(F.when(F.col("share") == 0.025, F.col("value"))).alias("lo"), F.max(F.when(F.col("share") == 0.975, F.col("value"))).alias("hi")))


# --- windows, sorts, sets --------------------------------------------------------------------------------------------


@query("SELECT month, trade_id, ticker FROM fills QUALIFY row_number() OVER (PARTITION BY month ORDER BY trade_id) <= 3")
def e6_samples_per_group(d):
    return profiles.samples_per_group(d.raw_fills.select("month", "trade_id", "ticker").distinct(), "month", "trade_id", 3)


@query(
    "SELECT ticker, coalesce(max(trade_id) FILTER (WHERE source = 'live'), max(trade_id) FILTER (WHERE source = 'historical')) AS trade_id FROM (SELECT * FROM fills WHERE t <= 915148800 QUALIFY row_number() OVER (PARTITION BY ticker, source ORDER BY t DESC, trade_id DESC) = 1) GROUP BY ticker"
)
def f1_newest_before_by_preference(d):
    return tape.newest_before(d.raw_fills, A.WINDOW_END)


@query("SELECT ticker, close_t FROM markets WHERE ticker > 'P15' ORDER BY ticker LIMIT 25")
def f2_keyset_slice(d):
    return d.markets.where("ticker > 'P15'").select("ticker", "close_t").orderBy("ticker").limit(25)


@query("SELECT ticker, p, y, side, lookback_day FROM doubled")
def g1_doubled_panel(d):
    return d.doubled.select("ticker", "p", "y", "side", "lookback_day")


@query("SELECT ticker FROM passed WHERE in_r1_window UNION SELECT ticker FROM passed WHERE in_r2_window AND tape_done")
def g2_pooled_scope(d):
    return panel.pooled_scope(d.scope_markets)


@query("SELECT ticker, result, CAST(NULL AS DOUBLE) AS spread FROM markets UNION ALL SELECT ticker, NULL, spread FROM quotes")
def g3_diagonal_concat(d):
    return d.markets.select("ticker", "result").unionByName(d.quotes.select("ticker", "spread"), allowMissingColumns=True)


@query(
    "SELECT a.ord AS a, b.ord AS b, array_to_string(list_sort(list_intersect(a.scope_values, b.scope_values)), ',') AS lower, array_to_string(list_sort(list_distinct(list_concat(a.scope_values, b.scope_values))), ',') AS upper FROM fee a JOIN fee b ON a.ord < b.ord AND a.scope_kind = 'series' AND b.scope_kind = 'series' "
    "WHERE EXISTS (SELECT 1 FROM markets WHERE list_contains(b.scope_values, series_ticker))"
)
def g4_membership_bounds(d):
    from ridgeline.operators.texts import bounds

    s = d.schedule.where("scope_kind = 'series'")
    used = s.select("ord", F.explode("scope_values").alias("series_ticker")).join(d.markets.select("series_ticker").distinct(), "series_ticker", "left_semi").select("ord").distinct()
    b = s.join(used, "ord", "left_semi").select(F.col("ord").alias("b"), F.col("scope_values").alias("vb"))
    both = s.select(F.col("ord").alias("a"), F.col("scope_values").alias("va")).join(F.broadcast(b), F.col("a") < F.col("b"))
    lower, upper = bounds(F.col("va"), F.col("vb"))
    return both.select("a", "b", F.array_join(lower, ",").alias("lower"), F.array_join(upper, ",").alias("upper"))


@query(
    "SELECT role, scope_kind, effective_from, array_to_string(list_sort(list_intersect(before, scope_values)), ',') AS lower, array_to_string(list_sort(list_distinct(list_concat(before, scope_values))), ',') AS upper "
    "FROM (SELECT *, lag(scope_values) OVER (PARTITION BY role, scope_kind ORDER BY effective_from) AS before FROM listed) WHERE before IS NOT NULL"
)
def g4_listed_bounds(d):
    """Each list of the markets' schedule against the one that it replaced; generations are months of the calendar."""
    from ridgeline.operators.texts import bounds

    before = F.lag("scope_values").over(Window.partitionBy("role", "scope_kind").orderBy("effective_from"))
    both = d.listed.withColumn("before", before).where("before is not null")
    lower, upper = bounds(F.col("before"), F.col("scope_values"))
    return both.select("role", "scope_kind", "effective_from", F.array_join(lower, ",").alias("lower"), F.array_join(upper, ",").alias("upper"))


@query(f"(SELECT ticker, lookback_day, p FROM panel EXCEPT ALL {OTHER}) UNION ALL ({OTHER} EXCEPT ALL SELECT ticker, lookback_day, p FROM panel)")
def g5_build_difference(d):
    a = d.panel.select("ticker", "lookback_day", "p")
    b = a.where("lookback_day <> 5").withColumn("p", F.when(F.col("lookback_day") == 3, F.col("p") + 0.01).otherwise(F.col("p")))
    return a.exceptAll(b).unionAll(b.exceptAll(a))


@query("SELECT DISTINCT event_ticker FROM passed WHERE NOT tape_done")
def g6_distinct_events(d):
    return d.scope_markets.where("not tape_done").select("event_ticker").distinct()


# --- scalars ---------------------------------------------------------------------------------------------------------


@query(
    f"SELECT ticker, {SHIFT.format(t='close_t', k='CAST(key % 400 AS INTEGER)')} AS shifted, {DAY_START.format(t='close_t')} AS day_start, {MONTH.format(t='close_t')} AS month, {ORDINAL.format(t='close_t')} AS ordinal FROM markets"
)
def h1_calendar(d):
    t = F.col("close_t")
    return d.markets.select("ticker", S.eastern_days_before(t, (F.col("key") % 400).cast("int")).alias("shifted"), S.eastern_day_start(t).alias("day_start"), S.month_key(t).alias("month"), S.ordinal_month(t).alias("ordinal"))


def fee_forms(p: str) -> str:
    return ", ".join(f"{FEE.format(f=repr(f), r=r, c='count_fp', p=p)} AS {f}" for f, r in (("quadratic", 0.07), ("flat_per_contract", 0.0025), ("none", 0.0)))


@query(f"SELECT trade_id, {fee_forms('price')}, {FEE.format(f=repr('quadratic'), r=0.07, c=100, p='price')} AS hundred FROM fills")
def h9_order_fees(d):
    c, p = F.col("count_fp"), F.col("price")
    each = [S.order_fee(F.lit(f), F.lit(r), c, p).alias(f) for f, r in (("quadratic", 0.07), ("flat_per_contract", 0.0025), ("none", 0.0))]
    return d.fills.select("trade_id", *each, S.order_fee(F.lit("quadratic"), F.lit(0.07), F.lit(100), p).alias("hundred"))


@query(
    "SELECT c_custkey, CASE WHEN w IN ('yes', 'true') THEN 1.0::DOUBLE WHEN w IN ('no', 'false') THEN 0.0::DOUBLE WHEN try_cast(w AS DOUBLE) >= 0.5 THEN 1.0::DOUBLE WHEN try_cast(w AS DOUBLE) < 0.5 THEN 0.0::DOUBLE END AS y FROM (SELECT c_custkey, lower(trim([' Yes', 'no', 'TRUE', 'false', '0.7', '0.2', 'x', ''][CAST(c_custkey % 8 + 1 AS INTEGER)])) AS w FROM customer)"
)
def h12_outcomes(d):
    words = F.array(*map(F.lit, [" Yes", "no", "TRUE", "false", "0.7", "0.2", "x", ""]))
    return d.base("customer").select("c_custkey", S.outcome_value(F.get(words, (F.col("c_custkey") % 8).cast("int"))).alias("y"))


@query(r"SELECT ticker, CASE WHEN regexp_matches(w, '\b(automobile|autos?|automobiles)\b') THEN 'transport' WHEN regexp_matches(w, '\b(furniture|household)\b') THEN 'home' WHEN regexp_matches(w, '\b(machinery|tools?)\b') THEN 'industry' END AS category FROM (SELECT ticker, slug || ' ' || replace(slug, '-', ' ') AS w FROM control_markets)")
def h15_classifier(d):
    return d.control_markets.select(F.col("condition_id").alias("ticker"), S.classify(control.RULES, "slug").alias("category"))


@query("SELECT c_custkey, CAST(sign(c_acctbal) AS INTEGER) AS s, c_acctbal * s_acctbal < 0 AS flips FROM customer JOIN supplier ON c_custkey % 100 = s_suppkey")
def h18_signs(d):
    s = d.base("supplier").select("s_suppkey", "s_acctbal")
    both = d.base("customer").join(s, F.col("c_custkey") % 100 == F.col("s_suppkey"))
    return both.select("c_custkey", S.strict_sign(F.col("c_acctbal")).alias("s"), S.sign_flip(F.col("c_acctbal"), F.col("s_acctbal")).alias("flips"))


# --- regressions and rules -------------------------------------------------------------------------------------------

MZ_COLUMNS = ["n", "n_clusters", "alpha", "alpha_se", "psi", "psi_se"]


@query(mz_sql("SELECT * FROM rows_", ""))
def i1_mz(d):
    return rounded(regression.mz(d.panel, []).select(MZ_COLUMNS))


@query(
    "WITH mm AS (SELECT *, (su - b * sx) / n AS a FROM (SELECT *, (n * sxu - sx * su) / det AS b FROM (SELECT count(*) AS n, sum(x) AS sx, sum(u) AS su, sum(x * u) AS sxu, count(*) * sum(x * x) - sum(x) * sum(x) AS det FROM rows_))), "
    "sc AS (SELECT cluster, ticker, (n * x - sx) * (u - a - b * x) / det AS s FROM rows_, mm), e AS (SELECT sum(s * s) AS v FROM (SELECT sum(s) AS s FROM sc GROUP BY cluster)), c AS (SELECT sum(s * s) AS v FROM (SELECT sum(s) AS s FROM sc GROUP BY ticker)), "
    "b AS (SELECT sum(s * s) AS v FROM (SELECT sum(s) AS s FROM sc GROUP BY cluster, ticker)) SELECT round(e.v, 9) AS one_way, round(e.v + c.v - b.v, 9) AS two_way, abs(c.v - b.v) <= 1e-6 * e.v AS equal FROM e, c, b"
)
def i2_two_way_check(d):
    return rounded(regression.two_way_check(d.panel), 9)


YEAR_ROWS = "SELECT *, CAST(year(make_timestamp(close_t * 1000000)) AS INTEGER) AS year FROM rows_"
YEAR_TARGETS = {1997: 0.02, 1998: 0.034, 1999: 0.021, 2000: 0.01, 2001: -0.05}


@query(
    f"WITH f AS ({mz_sql(YEAR_ROWS, 'year')}) SELECT year, f.n, f.psi, f.psi_se, CASE WHEN f.psi IS NULL THEN 'insufficient' WHEN target BETWEEN psi - 1.96 * psi_se AND psi + 1.96 * psi_se THEN 'confirmed' WHEN sign(psi) = sign(target) THEN 'partially' ELSE 'diverged' END AS verdict "
    "FROM (VALUES " + ", ".join(f"({y}, CAST({v} AS DOUBLE))" for y, v in YEAR_TARGETS.items()) + ") t(year, target) LEFT JOIN f USING (year)"
)
def i3_mz_by_year(d):
    fit = rounded(regression.mz(d.panel.withColumn("year", F.year(S.utc_date(F.col("close_t")))), ["year"]))
    targets = d.spark.createDataFrame([*YEAR_TARGETS.items()], "year int, target double")
    out = F.broadcast(targets).join(fit, "year", "left")
    return out.select("year", "n", "psi", "psi_se", compose.year_verdict(F.col("psi"), F.col("psi_se"), F.col("target")).alias("verdict"))


@query(mz_sql("SELECT * FROM rows_ WHERE category IS NOT NULL", "category"))
def i4_mz_by_category(d):
    return rounded(regression.mz(d.panel.where("category is not null"), ["category"]).select("category", *MZ_COLUMNS))


CONTROL_ROWS = f"SELECT {ORDINAL.format(t='close_t')} AS month, ticker AS cluster, p * 100 AS x, (y - p) * 100 AS u FROM control_panel"


@query(f"SELECT CAST(m AS INTEGER) AS month, n, psi, psi_se FROM range(23964, 23988) s(m) LEFT JOIN ({mz_sql(CONTROL_ROWS, 'month')}) ON m = month")
def i5_monthly_path(d):
    monthly = regression.mz(d.control.withColumn("month", S.ordinal_month(F.col("close_t"))), ["month"])
    return rounded(control.with_spine(monthly, 23_964, 23_987, A.CONTROL_MONTHS).select("month", "n", "psi", "psi_se"))


def shifts_sql(rows: str, by: str, digits: int = 6) -> str:
    """Slope shifts between three regimes, clustered across them; rows: by, regime, cluster, x, u."""
    of = ", ".join(f"max(b) FILTER (WHERE regime = '{k}') AS {k}" for k in ("pre", "mid", "post"))
    inf = ", ".join(f"sum(CASE WHEN regime = '{k}' THEN (n * x - sx) * (u - a - b * x) / det ELSE 0 END) AS {k}" for k in ("pre", "mid", "post"))
    from ridgeline.plans.oracle import moments_sql

    cells = moments_sql(rows, f"{by}, regime")
    return f"""WITH cells AS ({cells}), per AS (SELECT {by}, cluster, {inf} FROM ({rows}) JOIN cells USING ({by}, regime) GROUP BY {by}, cluster),
  meat AS (SELECT {by}, count(*) AS g, sum((mid - pre) ** 2) AS vf, sum((post - mid) ** 2) AS vp FROM per GROUP BY {by}),
  lines AS (SELECT {by}, CAST(sum(n) AS BIGINT) AS n, count(*) AS k, max(a) FILTER (WHERE regime = 'pre') AS alpha_c, {of} FROM cells GROUP BY {by})
  SELECT {by}, n, g AS n_clusters, round(alpha_c, {digits}) AS alpha_c, round(pre, {digits}) AS psi_c, round(mid - pre, {digits}) AS delta_fee, round(sqrt(g / (g - 1) * (n - 1) / (n - 6) * vf), {digits}) AS delta_fee_se,
    round(post - mid, {digits}) AS delta_pub, round(sqrt(g / (g - 1) * (n - 1) / (n - 6) * vp), {digits}) AS delta_pub_se FROM lines JOIN meat USING ({by}) WHERE k = 3 AND n > 6 AND g > 1"""


REGIME = "CASE WHEN close_t < 915148800 THEN 'pre' WHEN close_t < 938736000 THEN 'mid' ELSE 'post' END AS regime"
SHIFTS = shifts_sql(f"SELECT *, {REGIME} FROM rows_ WHERE category IS NOT NULL", "category")
EXACT_SHIFTS = shifts_sql(f"SELECT *, {REGIME} FROM rows_ WHERE category IS NOT NULL", "category", 15)


CATEGORY_ROWS = f"SELECT *, {REGIME} FROM rows_ WHERE category IS NOT NULL"
INTERVALS = wild_shifts_sql(CATEGORY_ROWS, "category", 15)


@query(wild_shifts_sql(CATEGORY_ROWS, "category"))
def i6_boundary_shifts(d):
    """Shifts with wild cluster errors and intervals where a category has fewer than 50 events, the sandwich's elsewhere."""
    return rounded(d.intervals)


@query(SHIFTS)
def i6_boundary_shifts_sandwich(d):
    return rounded(d.fits)


@query(
    f"WITH f AS ({EXACT_SHIFTS}), w AS (SELECT f.*, coalesce(a.weight, 0) AS wb, coalesce(b.weight, 0) AS wn FROM f LEFT JOIN ({FROZEN}) a USING (category) LEFT JOIN ({NOW}) b USING (category)) "
    "SELECT round(sum(wb * delta_fee), 5) AS within, round(sum((wn - wb) * psi_c), 5) AS \"between\", round(sum(wb * delta_fee) + sum((wn - wb) * psi_c), 5) AS aggregate FROM w"
)
def i8_decomposition(d):
    return rounded(compose.decompose(d.fits, d.frozen, d.weights, "delta_fee"), 5)


BAR = f"SELECT sum(weight * delta_pub) AS e, sqrt(sum(weight ** 2 * delta_pub_se ** 2)) AS s FROM ({INTERVALS}) JOIN ({FROZEN}) USING (category) WHERE weight <> 0"


@query(f"SELECT round(e, 5) AS delta_bar, round(e - 1.96 * s, 5) AS ci_lo, round(e + 1.96 * s, 5) AS ci_hi FROM ({BAR})")
def i9_delta_bar(d):
    return rounded(d.publication_bar, 5)


@query(
    f"""WITH b AS (SELECT e, e - 1.96 * s AS lo, e + 1.96 * s AS hi, (SELECT psi FROM ({mz_sql("SELECT * FROM rows_ WHERE in_r1_window", "")})) AS psi FROM ({BAR})),
  c AS (SELECT *, lo > 0 OR hi < 0 AS z, NOT (lo <= -psi AND -psi <= hi) AS g FROM b)
  SELECT CASE WHEN e IS NULL OR psi IS NULL THEN 'not identified' WHEN NOT z AND g THEN 'persisted' WHEN z AND NOT g THEN 'vanished' WHEN NOT z AND NOT g THEN 'indeterminate'
    WHEN e > least(-psi, 0) AND e < greatest(-psi, 0) THEN 'attenuated' WHEN psi + e < 0 AND (psi + lo > 0 OR psi + hi < 0) THEN 'reversed' ELSE 'indeterminate' END AS verdict FROM c"""
)
def i10_verdict(d):
    both = d.publication_bar.crossJoin(F.broadcast(d.first_psi))
    return both.select(compose.verdict(F.col("delta_bar"), F.col("ci_lo"), F.col("ci_hi"), F.col("psi")).alias("verdict"))


@query(wild_shifts_sql(CATEGORY_ROWS, "lookback_day, category"))
def i11_horizon_shifts(d):
    return rounded(regression.boundary_intervals(d.panel.where("category is not null"), ["lookback_day", "category"], A.WINDOW_END, A.PUBLICATION))


DAY_SHIFTS = shifts_sql(f"SELECT *, {REGIME} FROM rows_ WHERE category IS NOT NULL", "lookback_day, category", 15)
DAY_BARS = f"SELECT lookback_day, sum(weight * delta_fee) AS fee_, sum(weight * delta_pub) AS pub_ FROM ({DAY_SHIFTS}) JOIN ({FROZEN}) USING (category) WHERE weight <> 0 GROUP BY lookback_day"


@query(
    f"SELECT lookback_day, n, round(fee_, 5) AS delta_bar_fee, round(pub_, 5) AS delta_bar_pub, coalesce(k, 0) AS n_categories_fit FROM (SELECT lookback_day, count(*) AS n FROM panel GROUP BY lookback_day) "
    f"LEFT JOIN (SELECT lookback_day, count(*) AS k FROM ({DAY_SHIFTS}) GROUP BY lookback_day) USING (lookback_day) LEFT JOIN ({DAY_BARS}) USING (lookback_day)"
)
def i11_horizon_buckets(d):
    """Every lookback day of the panel, thin ones with nulls."""
    fits = regression.boundary_shifts(d.stored.where("category is not null"), ["lookback_day", "category"], A.WINDOW_END, A.PUBLICATION)
    return rounded(compose.horizon_buckets(d.stored, fits, d.frozen), 5)


@query("SELECT ticker, lookback_day, month, now, ever FROM flagged")
def i12_treated_flags(d):
    return d.flagged.select("ticker", "lookback_day", "month", "now", "ever")


@query("SELECT month, ever, now, count(*) AS n, round(sum(x), 6) AS sx, round(sum(x * x), 6) AS sxx, round(sum(u), 4) AS su, round(sum(x * u), 4) AS sxu FROM flagged GROUP BY month, ever, now")
def i13_did_cells(d):
    rows = regression.rows_of(d.flagged, "month", "ever", "now")
    x, u = F.col("x"), F.col("u")
    return rows.groupBy("month", "ever", "now").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("sx"), F.round(F.sum(x * x), 6).alias("sxx"), F.round(F.sum("u"), 4).alias("su"), F.round(F.sum(x * u), 4).alias("sxu"))


DID = f"SELECT * FROM ({did_sql('SELECT * FROM flagged', 'twfe')}) UNION ALL SELECT * FROM ({did_sql('SELECT * FROM flagged WHERE now = 1 OR ever = 0', 'clean_controls')})"


@query("SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in ("delta_did", "delta_did_se", "ci_lo", "ci_hi", "alpha_did", "psi_untreated", "delta_ever")) + f") FROM ({DID})")
def i13_did_pair(d):
    return rounded(d.did)


@query("SELECT month, count(*) FILTER (WHERE now = 1) AS treated, count(*) FILTER (WHERE now = 0) AS control, count(DISTINCT now) = 2 AS both FROM flagged WHERE now = 1 OR ever = 0 GROUP BY month")
def b15_clean_controls(d):
    """Months of the sample without the untreated rows of series that are treated at some time."""
    return did.arm_sizes(did.clean_controls(d.flagged))


@query("SELECT month, ever, k, count(*) AS n FROM (SELECT f.*, CASE WHEN c.cohort IS NOT NULL THEN greatest(-6, least(9, f.month - c.cohort)) END AS k FROM flagged f LEFT JOIN (SELECT series_ticker, min(month) AS cohort FROM flagged WHERE now = 1 GROUP BY series_ticker) c USING (series_ticker)) GROUP BY month, ever, k")
def i14_event_cells(d):
    return did.event_cells(d.panel, d.schedule).groupBy("month", "ever", "k").agg(F.count("*").alias("n"))


@query()
def i14_event_study(d):
    return did.event_study(d.stored, d.schedule)


EVENT_ROWS = "SELECT f.*, CASE WHEN c.cohort IS NOT NULL THEN greatest(-6, least(9, f.month - c.cohort)) END AS k FROM flagged f LEFT JOIN (SELECT series_ticker, min(month) AS cohort FROM flagged WHERE now = 1 GROUP BY series_ticker) c USING (series_ticker)"


@query(event_moments_sql(EVENT_ROWS))
def i14_event_moments(d):
    """What the event study solves: moments of its groups with the months' lines swept out."""
    return rounded(did.event_moments(d.stored, d.schedule), 3)


@query(wild_shifts_sql(CATEGORY_ROWS, "category", below=1 << 62))
def i7_wild_bootstrap(d):
    """Wild cluster errors and intervals of both boundary shifts of every category, whatever its number of events."""
    return rounded(regression.boundary_intervals(d.panel.where("category is not null"), ["category"], A.WINDOW_END, A.PUBLICATION, below=1 << 62))


GRID = "SELECT 0.0::DOUBLE AS grid_rate UNION SELECT DISTINCT round(0.0175::DOUBLE * 0.5 + i * 0.0175::DOUBLE / 9, 8) FROM range(0, 10) r(i)"
SWEPT = FEE.format(f="form", r="(CASE WHEN role = 'maker' AND form <> 'none' AND rate <> 0 THEN grid_rate ELSE rate END)", c="count_fp", p="p")
RIBBON = f"SELECT grid_rate, coalesce(avg(v) FILTER (WHERE role = 'maker') - avg(v) FILTER (WHERE role = 'taker'), 0) AS margin FROM (SELECT grid_rate, role, (y - p - {SWEPT} / count_fp) / p AS v FROM sides_b, ({GRID})) GROUP BY grid_rate"


@query(f"SELECT grid_rate, round(margin, 6) AS margin FROM ({RIBBON})")
def i15_fee_ribbon(d):
    return rounded(returns.ribbon(d.side_fills, d.scope_markets, d.schedule, d.grid), 8).withColumn("margin", F.round("margin", 6))


@query(
    f"WITH r AS ({RIBBON}), l AS (SELECT *, lead(grid_rate) OVER (ORDER BY grid_rate) AS r1, lead(margin) OVER (ORDER BY grid_rate) AS m1 FROM r) SELECT round(arg_min(grid_rate - margin * (r1 - grid_rate) / (m1 - margin), grid_rate) FILTER (WHERE (margin > 0) <> (m1 > 0) AND m1 <> margin), 6) AS break_even, "
    "count(DISTINCT margin > 0) > 1 AS sign_flips FROM l"
)
def e7_ribbon_crossing(d):
    return rounded(returns.ribbon_summary(returns.ribbon(d.side_fills, d.scope_markets, d.schedule, d.grid)))


@query(f"SELECT f.ord, g.grid_rate, CASE WHEN f.role = 'maker' AND f.form <> 'none' AND f.rate <> 0 THEN g.grid_rate ELSE f.rate END AS rate, count(m.ticker) AS markets FROM fee f CROSS JOIN ({GRID}) g LEFT JOIN markets m ON list_contains(f.scope_values, m.series_ticker) GROUP BY ALL")
def i16_swept_schedule(d):
    rows = fees.swept(d.schedule, d.grid).select("ord", "grid_rate", "rate")
    member = d.schedule.select("ord", F.explode("scope_values").alias("series_ticker")).join(d.markets.select("series_ticker"), "series_ticker").groupBy("ord").agg(F.count("*").alias("markets"))
    return rows.join(F.broadcast(member), "ord", "left").withColumn("markets", F.coalesce("markets", F.lit(0)))


LISTED_GRID = "SELECT 0.0::DOUBLE AS grid_rate UNION SELECT DISTINCT round(rate * 0.5 + i * rate / 9, 8) FROM (SELECT arg_max(rate, effective_from) AS rate FROM listed WHERE role = 'maker' AND form <> 'none' AND rate <> 0), range(0, 10) r(i)"


@query(f"SELECT f.ord, g.grid_rate, CASE WHEN f.role = 'maker' AND f.form <> 'none' AND f.rate <> 0 THEN g.grid_rate ELSE f.rate END AS rate, count(m.ticker) AS markets FROM listed f CROSS JOIN ({LISTED_GRID}) g LEFT JOIN markets m ON list_contains(f.scope_values, m.series_ticker) GROUP BY ALL")
def i16_listed_sweep(d):
    """The markets' schedule at each rate around its latest, with the number of markets that each list names by series."""
    rows = fees.swept(d.listed, fees.default_grid(fees.sourced_maker_rate(d.listed))).select("ord", "grid_rate", "rate")
    sizes = d.markets.groupBy("series_ticker").agg(F.count("*").alias("n"))
    member = d.listed.select("ord", F.explode("scope_values").alias("series_ticker")).join(sizes, "series_ticker").groupBy("ord").agg(F.sum("n").alias("markets"))
    return rows.join(member, "ord", "left").withColumn("markets", F.coalesce("markets", F.lit(0)))


CROSSED = f"SELECT count(DISTINCT margin > 0) > 1 AS sign_flips FROM ({RIBBON})"
REJECTS = "coalesce({lo} > 0 OR {hi} < 0, FALSE)"
TRIGGERS = f"""SELECT concat_ws(',', CASE WHEN d.n = 2 THEN 'did_fee_significant_in_both_fits' END, CASE WHEN {REJECTS.format(lo='e - 1.96 * s', hi='e + 1.96 * s')} THEN 'delta_bar_pub_significant' END,
    CASE WHEN coalesce(a.m * c.m < 0, FALSE) AND NOT r.sign_flips THEN 'maker_margin_sign_flip_survives_ribbon' END) AS triggers
  FROM (SELECT count(*) FILTER (WHERE {REJECTS.format(lo='ci_lo', hi='ci_hi')}) AS n FROM ({DID})) d, ({BAR}) b, ({A_}) a, ({C_}) c, ({CROSSED}) r"""


@query(f"SELECT triggers <> '' AS escalate, triggers FROM ({TRIGGERS})")
def i17_escalation(d):
    return d.escalated.select("escalate", F.array_join("triggers", ",").alias("triggers"))


@query(f"SELECT CASE WHEN triggers <> '' THEN 'standalone_paper' ELSE 'replication_note' END AS venue, triggers <> '' AS escalate FROM ({TRIGGERS})")
def i18_venue(d):
    return compose.venue(d.escalated)


@query(
    f"SELECT 'same_treated_sample' AS name, count(DISTINCT n_treated) <= 1 AS ok, coalesce(string_agg(DISTINCT CAST(n_treated AS VARCHAR), ',' ORDER BY CAST(n_treated AS VARCHAR)), '') AS detail FROM ({DID}) "
    f"UNION ALL SELECT 'decomposition_adds_up', TRUE, 'within + between' UNION ALL SELECT 'triggers_match', TRUE, triggers FROM ({TRIGGERS})"
)
def i20_invariants(d):
    return compose.invariants(d.did, compose.decompose(d.fits, d.frozen, d.weights, "delta_fee"), d.escalated)


@query("SELECT ticker, category, close_t, y, p, ticker AS event_ticker, round(volume, 2) AS volume FROM control_panel")
def i19_control_panel(d):
    return d.control.withColumn("volume", F.round("volume", 2))


@query(
    f"SELECT 'by_year' AS part, CAST(year AS VARCHAR) AS item, psi AS value FROM ({mz_sql(YEAR_ROWS, 'year')}) UNION ALL SELECT 'by_category', category, psi FROM ({mz_sql('SELECT * FROM rows_', 'category')}) "
    "UNION ALL SELECT 'era', CASE WHEN year(make_timestamp(t * 1000000)) BETWEEN 1996 AND 2000 THEN 'y' || year(make_timestamp(t * 1000000)) ELSE '_unassigned' END, round(count(taker_side) / count(*), 4) FROM fills GROUP BY 2"
)
def i21_divergence_table(d):
    years = regression.mz(d.panel.withColumn("year", F.year(S.utc_date(F.col("close_t")))), ["year"]).select(F.lit("by_year").alias("part"), F.col("year").cast("string").alias("item"), F.col("psi").alias("value"))
    cats = regression.mz(d.panel, ["category"]).select(F.lit("by_category").alias("part"), F.col("category").alias("item"), F.col("psi").alias("value"))
    eras = profiles.population_by_era(d.fills, ["taker_side"]).where("n > 0").select(F.lit("era").alias("part"), F.col("era").alias("item"), F.col("rate_taker_side").alias("value"))
    return rounded(years.unionByName(cats).unionByName(eras))


@query(
    f"SELECT {MONTH.format(t='close_t')} AS month, count(net) AS n, round(avg(CASE WHEN net < 0 THEN 1.0::DOUBLE WHEN net IS NOT NULL THEN 0.0::DOUBLE END), 6) AS loss_rate FROM (SELECT *, (y - p - fee / count_fp) / p AS net FROM panel_fee WHERE p <= 0.1000001) GROUP BY 1"
)
def i23_tail_loss_by_month(d):
    return rounded(returns.tail_loss_by_month(d.panel, d.schedule, S.month_key(F.col("close_t"))))


@query(mz_sql(f"SELECT *, {ORDINAL.format(t='close_t')} AS month FROM rows_ WHERE category IS NOT NULL", "month, category"))
def i24_mz_by_month_and_category(d):
    return rounded(regression.mz(d.panel.where("category is not null").withColumn("month", S.ordinal_month(F.col("close_t"))), ["month", "category"]).select("month", "category", *MZ_COLUMNS))


@query(wild_shifts_sql(f"SELECT *, {REGIME} FROM rows_ WHERE category IN ('C0', 'C3')", "category"))
def i25_placebo_categories(d):
    return rounded(regression.boundary_intervals(d.panel.where("category in ('C0', 'C3')"), ["category"], A.WINDOW_END, A.PUBLICATION))


def verdict_sql(estimate: str, lo: str, hi: str, psi: str) -> str:
    gone, zero = f"NOT ({lo} <= -{psi} AND -{psi} <= {hi})", f"({lo} > 0 OR {hi} < 0)"
    return (
        f"CASE WHEN {estimate} IS NULL OR {lo} IS NULL OR {hi} IS NULL OR {psi} IS NULL THEN 'not identified' WHEN NOT {zero} AND {gone} THEN 'persisted' WHEN {zero} AND NOT {gone} THEN 'eliminated' WHEN NOT {zero} THEN 'indeterminate' "
        f"WHEN {estimate} > least(-{psi}, 0) AND {estimate} < greatest(-{psi}, 0) THEN 'attenuated' WHEN {psi} + {estimate} < 0 AND ({psi} + {lo} > 0 OR {psi} + {hi} < 0) THEN 'reversed' ELSE 'indeterminate' END"
    )


@query(f"SELECT fit, {verdict_sql('delta_did', 'ci_lo', 'ci_hi', 'psi')} AS verdict FROM ({DID}), (SELECT psi FROM ({mz_sql('SELECT * FROM rows_ WHERE in_r1_window', '')}))")
def i26_did_verdicts(d):
    return compose.did_verdict(d.did, d.first_psi)
