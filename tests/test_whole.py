"""Queries over whole tables: what a slice of the input would miss."""

import hashlib
from bisect import bisect_right

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import compose, control, did, regression
from ridgeline.plans import registry
from ridgeline.sources import adapters as A
from tests.test_operators import brute, frame

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "part orders lineitem events customer".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    have = sorted((tuple(r) for r in df.select(columns).collect()), key=str)
    assert have == sorted(want.project(",".join(f'"{c}"' for c in columns)).fetchall(), key=str)
    return df


def test_every_event_is_a_reference(spark, duck):
    df = equals_oracle(spark, duck, "c1_asof_last_trade")
    by: dict[str, list] = {}
    for r in A.event_fills(spark, SF).collect():
        by.setdefault(r.ticker, []).append((r.t, r.trade_id))
    want = {}
    for ticker, rows in by.items():
        first: dict[int, str] = {}
        for t, k in sorted(rows):
            first.setdefault(t, k)
        times = sorted(first)
        for _, k in rows:
            t = next(x for x, y in rows if y == k) + 3_600_000_000 * (int(k) % 5) - 7_200_000_000
            at = bisect_right(times, t)
            if at:
                want[int(k)] = (ticker, times[at - 1], first[times[at - 1]])
    assert {r.ref_id: (r.ticker, r.t, r.trade_id) for r in df.collect()} == want
    assert {k % 6 for k in want} == set(range(6))


def wild_by_refits(spark, x, u, cluster, design, at, reps=999):
    """The reference's procedure: replicates of the restricted fit's residuals, each fitted again; signs as the code draws them."""
    words = {(k, c): int(hashlib.md5(f"0:{k // 4}:{c}".encode()).hexdigest()[k % 4 * 8 :][:8], 16) for c in set(cluster) for k in range(32)}
    bits = {(k + 1, c): words[k // 32, c] >> k % 32 & 1 for c in set(cluster) for k in range(reps)}
    d = np.asarray(design, float)
    less = np.delete(d, at, axis=1)
    fitted = less @ np.linalg.lstsq(less, u, rcond=None)[0]
    signs = np.array([[1.0 if bits[k, c] == 0 else -1.0 for c in cluster] for k in range(1, reps + 1)])
    boot = np.array([np.linalg.lstsq(d, fitted + (u - fitted) * w, rcond=None)[0][at] for w in signs])
    lo, hi = np.percentile(boot, [2.5, 97.5])
    return boot.std(ddof=1), (hi - lo) / 2


def test_few_clusters_have_wild_intervals_of_boundary_shifts(spark):
    df, rows = frame(spark, 120)
    fee, pub = 940_000_000, 952_000_000
    x = 100 * np.array([r[7] for r in rows])
    u, close, cluster = 100 * np.array([r[6] for r in rows]) - x, np.array([r[4] for r in rows]), [r[1] for r in rows]
    f, q = (close >= fee).astype(float), (close >= pub).astype(float)
    design = np.column_stack([np.ones(len(x)), x, f, f * x, q, q * x])
    got = regression.boundary_intervals(df.withColumn("all", F.lit(1)), ["all"], fee, pub).first()
    assert got.n_clusters == 40 and got.used_wild
    for k, at in (("fee", 3), ("pub", 5)):
        se, half = wild_by_refits(spark, x, u, cluster, design, at)
        delta = brute(x, u, cluster, design)[0][at]
        assert (got[f"delta_{k}"], got[f"delta_{k}_se"]) == (pytest.approx(delta), pytest.approx(se))
        assert (got[f"delta_{k}_lo"], got[f"delta_{k}_hi"]) == (pytest.approx(delta - half), pytest.approx(delta + half))
    many = regression.boundary_intervals(frame(spark, 900)[0].withColumn("all", F.lit(1)), ["all"], fee, pub).first()
    plain = regression.boundary_shifts(frame(spark, 900)[0].withColumn("all", F.lit(1)), ["all"], fee, pub).first()
    assert not many.used_wild and many.delta_fee_se == pytest.approx(plain.delta_fee_se)
    assert many.delta_pub_hi == pytest.approx(plain.delta_pub + 1.96 * plain.delta_pub_se)


def test_few_clusters_have_wild_intervals_of_did(spark):
    df, rows = frame(spark, 2400, seed=3)
    df = df.withColumn("event_ticker", F.concat(F.lit("E"), F.substring("ticker", 2, 9).cast("int") % 40))
    cluster = [f"E{int(r[0][1:]) % 40}" for r in rows]
    schedule = A.fee_schedule(spark)
    flagged = {r.ticker: r for r in did.treated_flags(df, schedule).collect()}
    now, ever = (np.array([flagged[r[0]][c] for r in rows], float) for c in ("now", "ever"))
    month = np.array([flagged[r[0]].month for r in rows])
    x = 100 * np.array([r[7] for r in rows])
    u = 100 * np.array([r[6] for r in rows]) - x
    months = [c for m in sorted(set(month))[1:] for c in ((month == m).astype(float), (month == m) * x)]
    design = np.column_stack([np.ones(len(x)), x, ever, ever * x, now, now * x, *months])
    se, half = wild_by_refits(spark, x, u, cluster, design, 5)
    got = {r.fit: r for r in did.did_pair(df, schedule).collect()}["twfe"]
    assert got.n_clusters == 40 and got.used_wild and got.delta_did_se == pytest.approx(se, rel=1e-5)
    assert (got.ci_lo, got.ci_hi) == (pytest.approx(got.delta_did - half, rel=1e-4), pytest.approx(got.delta_did + half, rel=1e-4))


def test_verdicts_and_escalation_take_the_wild_intervals(spark):
    got = registry.QUERIES["i6_boundary_shifts"](spark, SF).collect()
    plain = {r.category: r for r in registry.QUERIES["i6_boundary_shifts_sandwich"](spark, SF).collect()}
    assert got and {r.category for r in got} == set(plain)
    for r in got:
        assert r.used_wild == (r.n_clusters < 50) and r.delta_pub == plain[r.category].delta_pub
        assert not r.used_wild or r.delta_pub_se != plain[r.category].delta_pub_se


@pytest.mark.parametrize("name", ["a8_market_upsert", "b16_volume_consistency", "c11_enrichment", "c12_exists_probes", "g3_diagonal_concat"])
def test_whole_tables_equal_oracle(spark, duck, name):
    df = equals_oracle(spark, duck, name)
    markets, fills = A.markets(spark, SF), A.fills(spark, SF)
    if name[:2] == "c1":
        want = fills.count() if "c11" in name else markets.join(fills, "ticker", "left_semi").count()
        assert (df.count() if "c11" in name else df.first().with_fills) == want
    elif name[:2] != "b1":
        assert df.select("ticker").distinct().count() == markets.count()
    else:
        late = fills.groupBy("ticker").agg(F.min("month").alias("m")).where("m >= '1997-01'")
        assert df.join(late, "ticker", "left_semi").where("not consistent").count() == 0


def test_markets_without_fills_are_found(spark):
    """Negative cases by fixture, not by a cut table: one market never trades, one trades late only."""
    from ridgeline.operators import profiles, tape

    m = spark.createDataFrame([("A", 5.0), ("B", 5.0), ("C", 0.0)], "ticker string, volume_fp double")
    fills = spark.createDataFrame([("1", "A", 0.5, 1.0, "yes", 1, "2001-01")], "trade_id string, ticker string, price double, count_fp double, taker_side string, t long, month string")
    got = {r.ticker: r.consistent for r in profiles.volume_consistency(m, tape.trade_counts(fills)).select("ticker", "consistent").collect()}
    assert got == {"A": True, "B": False, "C": True}


def test_thin_days_stay_with_nulls(spark, duck):
    panel = spark.createDataFrame([(k,) for k in (0, 0, 0, 1, 1, 2)], "lookback_day int")
    fits = spark.createDataFrame([(0, "A", 0.2, 0.4), (0, "B", 0.1, -0.2), (1, "Z", 0.5, 0.5)], "lookback_day int, category string, delta_fee double, delta_pub double").withColumns({"delta_fee_se": F.lit(0.1), "delta_pub_se": F.lit(0.1)})
    frozen = spark.createDataFrame([("A", 0.5), ("B", 0.5)], "category string, weight double")
    got = {r.lookback_day: tuple(r)[1:] for r in compose.horizon_buckets(panel, fits, frozen).collect()}
    assert got == {0: (3, pytest.approx(0.15), pytest.approx(0.1), 2), 1: (2, None, None, 1), 2: (1, None, None, 0)}
    df = equals_oracle(spark, duck, "i11_horizon_buckets")
    assert {r.lookback_day for r in df.collect()} == set(range(11))


def test_control_windows_outside_the_coverage_are_errors(spark):
    none = spark.createDataFrame([], "condition_id string, outcome string, end_t long, slug string, price double, t long")
    monthly = spark.createDataFrame([(23_970, 1.0)], "month int, psi double")
    for start, end in ((A.EPOCH_1997 - 1, A.WINDOW_END), (A.EPOCH_1997, A.WINDOW_END + 1)):
        with pytest.raises(ValueError, match="coverage"):
            control.control_panel(none, none, start, end, control.RULES, ["slug"], coverage=A.CONTROL_COVERAGE)
    for first, last in ((23_963, 23_987), (23_964, 23_988)):
        with pytest.raises(ValueError, match="coverage"):
            control.with_spine(monthly, first, last, A.CONTROL_MONTHS)
    assert control.with_spine(monthly, *A.CONTROL_MONTHS, A.CONTROL_MONTHS).count() == 24


HOT = "trade_id string, ticker string, price double, count_fp double, taker_side string, t long"


def hot_tape(spark):
    """A ticker with most of the tape, over four years with silent stretches and ties, beside quiet ones."""
    r = np.random.default_rng(8)
    close = 1_400_000_000
    days = np.concatenate((r.integers(0, 30, 3000), r.integers(700, 720, 500), r.integers(1300, 1400, 500)))
    rows = [(f"h{i:05d}", "HOT", float(r.integers(1, 99)) / 100, 1.0, "yes", close - int(d) * 86_400 - int(r.integers(0, 5)) * 3600) for i, d in enumerate(days)]
    rows += [(f"q{i}", f"Q{i % 7}", 0.5, 1.0, None, close - i * 40 * 86_400) for i in range(40)]
    rows += [("late", "HOT", 0.99, 1.0, "no", close + 5), ("none", "HOT", None, 1.0, "no", close - 1)]
    m = [(t, "E", "S", "C", "yes", close - (7 if t == "Q3" else 0) * 86_400 * 100, True, False) for t in ["HOT", *(f"Q{i}" for i in range(7)), "SILENT"]]
    markets = spark.createDataFrame(m, "ticker string, event_ticker string, series_ticker string, category string, result string, close_t long, in_r1_window boolean, in_r2_window boolean")
    return markets, spark.createDataFrame(rows, HOT), m, rows


@pytest.mark.parametrize("span_days", [1, 45, 5000])
def test_a_hot_ticker_is_parted_into_spans_in_both_panels(spark, span_days, monkeypatch):
    from datetime import datetime, timedelta
    from zoneinfo import ZoneInfo

    from ridgeline.operators import panel

    monkeypatch.setattr(panel.lookback_prices, "__defaults__", ("SECOND", span_days))
    markets, fills, m, rows = hot_tape(spark)
    eastern = ZoneInfo("America/New_York")

    def last(ticker, t):
        known = [x for x in rows if x[1] == ticker and x[2] is not None and x[5] <= t]
        return min(known, key=lambda x: (-x[5], x[0])) if known else None

    want, skip = {}, {}
    for ticker, *_, close, _, _ in ((x[0], *x[1:]) for x in m):
        first = last(ticker, close)
        for k in range(11) if first else ():
            at = close if k == 0 else int((datetime.fromtimestamp(first[5], eastern).replace(tzinfo=None) - timedelta(days=k)).replace(tzinfo=eastern).timestamp())
            if found := last(ticker, at):
                want[ticker, k] = found[2]
                if datetime.fromtimestamp(found[5], eastern).date() == datetime.fromtimestamp(at, eastern).date():
                    skip[ticker, k] = found[2]
    both = {}
    for name, make in (("all", panel.backfilled_panel), ("skip", panel.skip_panel)):
        df = make(markets, fills)
        both[name] = {(x.ticker, x.lookback_day): x.p for x in df.collect()}
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [w for w in plan.splitlines() if "Window [" in w and "last(fill" in w and "span" not in w], "fills are sorted by span, never by ticker alone"
    assert both["all"] == want
    assert both["skip"] == {k: v for k, v in skip.items() if (k[0], 0) in skip}


def test_totals_take_each_trade_once_over_replays_old_pages_and_restarts(spark, tmp_path):
    from ridgeline.operators import tape
    from ridgeline.streaming import ingest

    rows = [(f"t{i}", f"M{i % 3}", 0.25 + i % 2 / 2, 2.0, "yes" if i % 4 else None, 900_000_000 + i * 3600) for i in range(24)]
    pages = [rows[:8], rows[4:12], rows[:8], rows[12:], [rows[0], rows[0], rows[23]]]
    make = lambda part: spark.createDataFrame(part, HOT).withColumn("ts", F.timestamp_seconds("t"))
    for n, page in enumerate(pages):
        make(page).write.parquet(f"{tmp_path}/pages/{n}")
        stream = ingest.running_totals(ingest.pages_in(spark, f"{tmp_path}/pages", make([]).schema))
        q = stream.writeStream.format("memory").queryName(f"totals{n}").outputMode("complete").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    tape_ = spark.createDataFrame(rows, HOT)
    want = tape.trade_counts(tape_).join(tape.dollar_volume(tape_), "ticker")
    assert sorted(map(tuple, spark.table("totals4").collect())) == sorted(map(tuple, want.select("ticker", "trades", "dollars").collect()))


def test_the_monitor_counts_each_trade_once_and_tells_of_late_rows(spark, tmp_path):
    from ridgeline.streaming import ingest

    day = 86_400
    make = lambda part: spark.createDataFrame(part, HOT).withColumn("ts", F.timestamp_seconds("t"))
    pages = [[("a", "M", 0.5, 1.0, "yes", 900_000_000), ("b", "M", 0.5, 1.0, None, 900_000_060)], [("a", "M", 0.5, 1.0, "yes", 900_000_000), ("c", "M", 0.5, 1.0, "no", 900_000_000 + 9 * day)], [("old", "M", 0.5, 1.0, "no", 900_000_000 - day), ("d", "M", 0.5, 1.0, "no", 900_000_000 + 20 * day)]]
    dropped = 0
    for n, page in enumerate(pages):
        make(page).coalesce(1).write.parquet(f"{tmp_path}/pages/{n}")
        stream = ingest.population_monitor(ingest.pages_in(spark, f"{tmp_path}/pages", make([]).schema))
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
        dropped += ingest.late_rows(q)
    got = {r.day.start.day: (r.n, r.rate) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert (2, 0.5) in got.values() and dropped >= 1
