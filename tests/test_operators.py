"""Hand cases of the domain operators."""

import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import scalars as S
from ridgeline.operators import asof, compose, control, did, fees, panel, profiles, regression, returns, tape, texts, universe
from ridgeline.sources import adapters
from ridgeline.streaming import ingest

TICKS = "trade_id string, ticker string, price double, count_fp double, taker_side string, t long"
MARKETS = "ticker string, event_ticker string, series_ticker string, category string, result string, open_t long, close_t long, volume_fp double, settlement_value double, in_r1_window boolean, in_r2_window boolean, tape_done boolean"
PANEL = "ticker string, event_ticker string, series_ticker string, category string, close_t long, side string, y double, p double, count_fp double, taker_side string"
DAY = 86_400


def one(df):
    return [tuple(r) for r in df.collect()]


def market(ticker="M", result="yes", close=1_000_000, hours=48, volume=5000.0, settle=None, **more):
    base = dict(ticker=ticker, event_ticker="E", series_ticker="S", category="C", result=result, open_t=close - hours * 3600, close_t=close, volume_fp=volume, settlement_value=settle, in_r1_window=True, in_r2_window=False, tape_done=True)
    return tuple((base | more).values())


def test_asof_takes_the_last_fill_at_or_before(spark):
    ticks = spark.createDataFrame([("a", "M", 0.1, 1.0, "yes", 10), ("b", "M", 0.2, 1.0, "yes", 20), ("c", "M", 0.3, 1.0, "yes", 30), ("d", "M", None, 1.0, "yes", 24)], TICKS)
    refs = spark.createDataFrame([("M", 1, 25), ("M", 2, 20), ("M", 3, 5), ("X", 4, 99)], "ticker string, k int, ref_t long")
    assert sorted(one(asof.last_trade_at_or_before(refs, ticks, ["k"]).select("k", "price", "t"))) == [(1, 0.2, 20), (2, 0.2, 20)]


def test_ties_go_to_the_smallest_id_as_a_whole_row(spark):
    ticks = spark.createDataFrame([("t_c", "M", 0.3, 3.0, "yes", 10), ("t_a", "M", 0.1, None, None, 10), ("t_b", "M", 0.2, 2.0, "no", 10)], TICKS)
    refs = spark.createDataFrame([("M", 1, 10)], "ticker string, k int, ref_t long")
    assert one(asof.last_trade_at_or_before(refs, ticks, ["k"]).select("price", "count_fp", "taker_side")) == [(0.1, None, None)]
    assert one(asof.tick_collapse(ticks).select("trade_id", "count_fp")) == [("t_a", None)]


def test_backfill_carries_prices_and_skip_drops_silent_days(spark):
    close = 1_700_000_000
    m = spark.createDataFrame([market(close=close)], MARKETS)
    ticks = spark.createDataFrame([("a", "M", 0.8, 1.0, "yes", close - 60), ("b", "M", 0.4, 1.0, "yes", close - 3 * DAY - 120)], TICKS)
    rows = sorted(one(panel.backfilled_panel(m, ticks).select("lookback_day", "p")))
    assert rows == [(0, 0.8), (1, 0.4), (2, 0.4), (3, 0.4)]
    assert sorted(one(panel.skip_panel(m, ticks).select("lookback_day", "p"))) == [(0, 0.8), (3, 0.4)]
    late = spark.createDataFrame([("b", "M", 0.4, 1.0, "yes", close - 3 * DAY)], TICKS)
    assert panel.skip_panel(m, late).count() == 0
    assert panel.backfilled_panel(m, late).count() > 0


def test_doubled_and_bands(spark):
    p = spark.createDataFrame([("M", "E", "S", "C", 1, "yes", 1.0, 0.9, 1.0, "yes")], PANEL)
    assert sorted((r.side, round(r.p, 6), r.y) for r in panel.doubled(p).collect()) == [("no", 0.1, 0.0), ("yes", 0.9, 1.0)]
    bands = spark.createDataFrame([(0.10,), (0.11,), (0.50,), (0.51,), (0.99,), (1 - 0.70,), (0.01,)], "p double")
    assert [r[0] for r in bands.select(S.price_band(F.col("p"))).collect()] == ["1-10c", "11-20c", "41-50c", "51-60c", "91-99c", "21-30c", "1-10c"]


def test_filter_reasons(spark):
    m = spark.createDataFrame(
        [
            market("low", volume=500.0), market("wide"), market("none"), market("null"), market("exact", hours=24), market("short", hours=23), market("open", result=None),
            market("contra", result="yes", settle=0.0), market("good", settle=1.0)],
        MARKETS)
    q = spark.createDataFrame([("wide", 0.25), ("null", None)] + [(t, 0.1) for t in ("low", "exact", "short", "open", "contra", "good")], "ticker string, spread double")
    found = {r.ticker: r.reasons for r in universe.reasons(m, q).collect()}
    assert found["low"] == ["volume_below_1000"] and found["wide"] == ["spread_above_20c"]
    assert found["none"] == ["spread_filter_not_yet_fetched"] and found["null"] == ["spread_filter_not_computable"]
    assert found["exact"] == [] and found["short"] == ["open_below_24h"] and found["good"] == []
    assert found["open"] == ["result_missing_or_invalid"] and found["contra"] == ["settlement_contradicts_result"]
    log = universe.exclusion_log(universe.reasons(m, q), "r1")
    with pytest.raises(ValueError, match="never built"):
        universe.in_scope(m, log, "r2", "in_r1_window", spark.createDataFrame([("r1",)], "window string"))


def test_exclusion_log_replaces_one_label(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    make = lambda label, t: spark.createDataFrame([(label, t, "x")], "window string, ticker string, reason_code string")
    for log, label in ((make("r1", "A"), "r1"), (make("r2", "B"), "r2"), (make("r1", "C"), "r1")):
        universe.replace_exclusions(log, label, f"{d}/log", f"{d}/stamps")
    assert sorted(one(spark.read.parquet(f"{d}/log").select("window", "ticker"))) == [("r1", "C"), ("r2", "B")]
    assert spark.read.parquet(f"{d}/stamps").count() == 3


def asked(spark, *rows):
    return spark.createDataFrame([(r, d, t, s) for r, d, t, s in rows], "role string, day string, ticker string, series_ticker string").withColumn("as_of", F.to_date("day")).drop("day")


def test_fee_lookup(spark):
    rows = asked(
        spark, ("taker", "1995-12-31", "Q", None), ("taker", "1996-01-01", "Q", None), ("taker", "1998-01-01", "P1x", "S1"), ("maker", "1999-03-01", "P", "S1"),
        ("maker", "1999-05-01", "P", "S1"), ("maker", "2000-05-01", "P", "S1"), ("maker", "2000-05-01", "P", "S8"), ("taker", "1990-01-01", "Q", None))
    found = {(r.role, str(r.as_of), r.ticker, r.series_ticker): (r.form, r.rate) for r in fees.lookup(rows, adapters.fee_schedule(spark)).collect()}
    assert len(found) == 8
    assert found["taker", "1995-12-31", "Q", None] == ("quadratic", 0.14) and found["taker", "1996-01-01", "Q", None] == ("quadratic", 0.07)
    assert found["taker", "1998-01-01", "P1x", "S1"] == ("quadratic", 0.035)
    assert found["maker", "1999-03-01", "P", "S1"] == ("flat_per_contract", 0.0025) and found["maker", "1999-05-01", "P", "S1"] == ("quadratic", 0.0175)
    assert found["maker", "2000-05-01", "P", "S1"] == ("none", 0.0), "a series that left the list pays no more"
    assert found["maker", "2000-05-01", "P", "S8"] == ("quadratic", 0.0175) and found["taker", "1990-01-01", "Q", None] == (None, None)


def test_roles_and_layers(spark):
    m = spark.createDataFrame([market(result="yes")], MARKETS)
    fills = spark.createDataFrame([("a", "M", 0.5, 1.0, "yes", 800_000_000)], TICKS)
    r = returns.maker_margins(fills, m, adapters.fee_schedule(spark)).first()
    assert r.margin_a == -2 and (r.n_maker_a, r.n_taker_a) == (1, 1)
    p = spark.createDataFrame([("M", "E", "S", "C", 800_000_000, "yes", 1.0, 0.9, 1.0, "yes")], PANEL)
    split = {x.band: x for x in returns.maker_taker_split(panel.doubled(p), adapters.fee_schedule(spark)).collect()}
    assert split["all"].maker_return == pytest.approx(-1) and split["all"].taker_return < 0.1 / 0.9


def test_ribbon_crossing_and_flat_zero(spark):
    points = spark.createDataFrame([(0.0, 0.2), (0.1, 0.1), (0.2, -0.1)], "grid_rate double, margin double")
    assert one(returns.ribbon_summary(points)) == [(pytest.approx(0.15), True)]
    flat = spark.createDataFrame([(0.0, 0.0), (0.1, -0.1)], "grid_rate double, margin double")
    assert one(returns.ribbon_summary(flat)) == [(None, False)]


def brute(x, u, cluster, design):
    d = np.asarray(design, float)
    inv = np.linalg.inv(d.T @ d)
    beta = inv @ d.T @ u
    r = u - d @ beta
    meat = sum(np.outer(s, s) for g in set(cluster) if (s := d[np.array(cluster) == g].T @ r[np.array(cluster) == g]) is not None)
    g, n, k = len(set(cluster)), len(u), d.shape[1]
    return beta, g / (g - 1) * (n - 1) / (n - k) * inv @ meat @ inv


def frame(spark, n=600, seed=1, shift=0.0):
    r = np.random.default_rng(seed)
    rows = []
    months = [852_076_800 + 31 * DAY * k for k in range(24, 40)]
    for i in range(n):
        close, series = int(r.choice(months)), f"S{r.integers(0, 12)}"
        p = float(r.integers(5, 95)) / 100
        rows.append((f"T{i}", f"E{i // 3}", series, f"C{i % 2}", close, "yes", float(r.random() < p + shift * p), p, 1.0, "yes"))
    return spark.createDataFrame(rows, PANEL), rows


def test_line_equals_brute_force(spark):
    df, rows = frame(spark)
    p, y = np.array([r[7] for r in rows]), np.array([r[6] for r in rows])
    beta, cov = brute(p, 100 * (y - p), [r[1] for r in rows], np.column_stack([np.ones(len(p)), 100 * p]))
    f = regression.mz(df, []).first()
    assert (f.alpha, f.psi) == (pytest.approx(beta[0]), pytest.approx(beta[1]))
    assert (f.alpha_se, f.psi_se) == (pytest.approx(math.sqrt(cov[0, 0])), pytest.approx(math.sqrt(cov[1, 1])))
    assert regression.two_way_check(df).first().equal


def test_line_guards(spark):
    df, _ = frame(spark, 12)
    assert regression.mz(df.limit(0), []).count() == 0
    assert regression.mz(df.where("ticker in ('T0', 'T1')"), []).count() == 0
    assert regression.mz(df.withColumn("event_ticker", F.lit("E")), []).count() == 0
    assert regression.mz(df.withColumn("p", F.lit(0.5)), []).count() == 0


def test_boundary_shifts_equal_brute_force(spark):
    df, rows = frame(spark, 900)
    close = np.array([r[4] for r in rows])
    p, y = np.array([r[7] for r in rows]), np.array([r[6] for r in rows])
    fee, pub = (close >= 940_000_000).astype(float), (close >= 952_000_000).astype(float)
    x = 100 * p
    beta, cov = brute(p, 100 * (y - p), [r[1] for r in rows], np.column_stack([np.ones(len(x)), x, fee, fee * x, pub, pub * x]))
    f = regression.boundary_shifts(df.withColumn("all", F.lit(1)), ["all"], 940_000_000, 952_000_000).first()
    assert (f.psi_c, f.delta_fee, f.delta_pub) == tuple(pytest.approx(beta[i]) for i in (1, 3, 5))
    assert (f.delta_fee_se, f.delta_pub_se) == tuple(pytest.approx(math.sqrt(cov[i, i])) for i in (3, 5))
    assert regression.boundary_shifts(df.withColumn("all", F.lit(1)), ["all"], 0, 1).count() == 0, "an empty regime isn't identified"


def test_did_equals_brute_force_and_guards(spark):
    df, rows = frame(spark, 900, seed=3)
    schedule = adapters.fee_schedule(spark)
    flagged = {r.ticker: r for r in did.treated_flags(df, schedule).collect()}
    now = np.array([flagged[r[0]].now for r in rows], float)
    ever = np.array([flagged[r[0]].ever for r in rows], float)
    month = np.array([flagged[r[0]].month for r in rows])
    assert 0 < now.sum() < ever.sum() < len(rows)
    x = 100 * np.array([r[7] for r in rows])
    u = 100 * np.array([r[6] for r in rows]) - x
    months = [c for m in sorted(set(month))[1:] for c in ((month == m).astype(float), (month == m) * x)]
    beta, cov = brute(x, u, [r[1] for r in rows], np.column_stack([np.ones(len(x)), x, ever, ever * x, now, now * x, *months]))
    pair = {r.fit: r for r in did.did_pair(df, schedule).collect()}
    assert pair["twfe"].delta_did == pytest.approx(beta[5]) and pair["twfe"].delta_did_se == pytest.approx(math.sqrt(cov[5, 5]))
    assert pair["twfe"].delta_ever == pytest.approx(beta[3]) and pair["clean_controls"].n == int(((now == 1) | (ever == 0)).sum())
    never = did.did_pair(df.withColumn("series_ticker", F.lit("S99")), schedule).collect()
    assert all(r.delta_did is None for r in never), "not identified is null, never zero"
    study = did.event_study(df, schedule).collect()
    assert study and all(r.k != did.REFERENCE for r in study) and 0 <= study[0].pre_p <= 1
    assert did.event_study(df.withColumn("series_ticker", F.lit("S99")), schedule).count() == 0


def test_chi2_tail():
    assert regression.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert regression.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert regression.chi2_tail(0.0, 3) == 1.0


def test_bootstrap_signs_are_digest_bits_on_any_partitioning(spark):
    import hashlib

    z = {f"E{i}": (i * 37 % 11) - 5.0 for i in range(23)}
    per = spark.createDataFrame([(0, c, x, 2 * x) for c, x in z.items()], "_g int, cluster string, z double, w double")
    a, b = (regression.sign_replicates(df, ["z", "w"], 999, 4).first() for df in (per, per.repartition(7)))
    sums = []
    for r in range(999):
        bits = {c: int(hashlib.md5(f"4:{r // 128}:{c}".encode()).hexdigest()[r // 32 % 4 * 8 :][:8], 16) >> r % 32 & 1 for c in z}
        sums.append(sum(-x if bits[c] else x for c, x in z.items()))
    lo, hi = np.percentile(sums, [2.5, 97.5])
    assert a.reps == 999 and a == b
    assert (a.z_se, a.z_half, a.w_se) == (pytest.approx(np.std(sums, ddof=1)), pytest.approx((hi - lo) / 2), pytest.approx(2 * np.std(sums, ddof=1)))
    assert a.z_se == pytest.approx(math.sqrt(sum(x * x for x in z.values())), rel=0.1)


def test_verdicts(spark):
    cases = [(0.0, -0.01, 0.01, 0.034, "persisted"), (-0.034, -0.05, -0.02, 0.034, "vanished"), (-0.015, -0.02, -0.01, 0.034, "attenuated"), (-0.08, -0.09, -0.07, 0.034, "reversed"), (-0.02, -0.05, 0.01, 0.034, "indeterminate"), (0.05, 0.04, 0.06, 0.034, "indeterminate"), (None, None, None, 0.034, "not identified")]
    df = spark.createDataFrame(cases, "e double, lo double, hi double, psi double, want string")
    assert all(r.got == r.want for r in df.select("want", compose.verdict(*map(F.col, ("e", "lo", "hi", "psi"))).alias("got")).collect())


def test_decomposition_and_escalation(spark):
    fits = spark.createDataFrame([("A", 0.1, 0.02, 0.01), ("B", 0.2, -0.01, 0.01)], "category string, psi_c double, delta_fee double, delta_fee_se double")
    frozen, now = (spark.createDataFrame(x, "category string, weight double") for x in ([("A", 0.5), ("Z", 0.5)], [("A", 0.2), ("B", 0.8)]))
    r = compose.decompose(fits, frozen, now, "delta_fee").first()
    assert r.within == pytest.approx(0.01) and r.between == pytest.approx((0.2 - 0.5) * 0.1 + 0.8 * 0.2)
    assert compose.delta_bar(fits, frozen.where("category = 'Z'"), "delta_fee").first().delta_bar is None
    pair = spark.createDataFrame([("twfe", 0.1, 0.2), ("clean_controls", None, None)], "fit string, ci_lo double, ci_hi double")
    margins, ribbon = spark.createDataFrame([(0.1, -0.1)], "margin_a double, margin_c double"), spark.createDataFrame([(None, False)], "break_even double, sign_flips boolean")
    none = spark.createDataFrame([(None, None)], "ci_lo double, ci_hi double")
    assert one(compose.escalation(pair, none, margins, ribbon)) == [(True, ["maker_margin_sign_flip_survives_ribbon"])]


def test_lock_is_written_once(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    report = spark.createDataFrame([("persisted",)], "verdict string")
    compose.write_lock(report, f"{d}/lock")
    assert compose.load_lock(spark, f"{d}/lock").first().verdict == "persisted"
    with pytest.raises(Exception, match="(?i)exists"):
        compose.write_lock(report, f"{d}/lock")
    report.write.parquet(f"{d}/open")
    with pytest.raises(ValueError, match="locked"):
        compose.load_lock(spark, f"{d}/open")


def test_control_panel(spark):
    m = spark.createDataFrame([("M1", "['1', '0']", 100), ("M3", "['1', '0']", 900), ("M4", "[]", 100)], "condition_id string, outcome_prices string, end_date long").withColumnRenamed("end_date", "end_t").withColumn("slug", F.lit("auto-race"))
    t = spark.createDataFrame([("M1", 0.4, 50), ("M1", 0.7, 90), ("M1", 0.9, 150), ("M3", 0.5, 50), ("M4", 0.5, 50)], "condition_id string, price double, timestamp long")
    rows = control.control_panel(m, t, 0, 500, control.RULES, ["slug"]).collect()
    assert [(r.ticker, r.p, r.y, r.category) for r in rows] == [("M1", 0.7, 1.0, "transport")]
    with pytest.raises(ValueError):
        control.control_panel(m, t, 500, 0, control.RULES, ["slug"])
    with pytest.raises(ValueError, match="price"):
        control.detect(m, "price")
    with pytest.raises(ValueError, match="allowed"):
        control.rules_of([{"category": "x", "patterns": ["a"]}], ["y"])


def test_outcomes_and_times(spark):
    lists = spark.createDataFrame([("['1', '0']",), ("[0.0, 1.0]",), ("[]",), ("42",), ("junk",), (None,)], "x string")
    assert [r[0] for r in lists.select(S.first_listed_outcome(F.col("x"))).collect()] == [1.0, 0.0, None, None, None, None]
    iso = spark.createDataFrame([("2024-03-10T06:59:59.9Z",), ("2024-03-10T01:00:00-05:00",), ("bad",)], "x string")
    assert [r[0] for r in iso.select(S.iso_to_epoch(F.col("x"))).collect()] == [1710053999, 1710050400, None]
    # noon in New York across the change of clocks
    t = spark.createDataFrame([(1710172800,)], "t long")
    assert t.select(S.eastern_days_before(F.col("t"), F.lit(2))).first()[0] == 1710172800 - 2 * DAY + 3600


def test_fee_rounding(spark):
    df = spark.createDataFrame([("quadratic", 0.07, 1.0, 0.5, 0.02), ("quadratic", 0.07, 100.0, 0.5, 1.75), ("flat_per_contract", 0.0025, 100.0, 0.5, 0.25), ("none", 0.0, 5.0, 0.5, 0.0), (None, None, 1.0, 0.5, None)], "f string, r double, c double, p double, want double")
    assert all(r.got == (pytest.approx(r.want) if r.want is not None else None) for r in df.select("want", S.order_fee(*map(F.col, "frcp")).alias("got")).collect())


def test_tape_append_compact_and_upsert(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    rows = spark.createDataFrame([("a", "M", 0.5, 100.0, "yes", 1, "1998-01"), ("b", "M", 0.25, 200.0, "no", 2, "1998-01"), (None, "M", 0.5, 1.0, "yes", 3, "1998-01"), ("a", "M", 0.5, 100.0, "yes", 1, "1998-01")], TICKS + ", month string")
    tape.append(rows, f"{d}/tape")
    tape.append(rows, f"{d}/tape")
    stored = spark.read.parquet(f"{d}/tape")
    assert stored.count() == 4 and tape.dollar_volume(stored).first().dollars == 100 and tape.trade_counts(stored).first().trades == 2
    tape.compact(spark, f"{d}/tape", "1998-01", f"{d}/aside")
    assert spark.read.parquet(f"{d}/tape").count() == 2
    with pytest.raises(ValueError, match="unknown"):
        tape.scan(stored, columns=["nope"])
    assert tape.scan(stored, months=[]).count() == 0


def test_ingest_is_free_of_duplicates_and_keeps_old_fills(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    schema = TICKS + ", month string"
    page = lambda rows, n: spark.createDataFrame(rows, schema).write.parquet(f"{d}/pages/{n}")
    a, b, old = ("a", "M", 0.5, 1.0, "yes", 90, "1998-03"), ("b", "M", 0.5, 1.0, "yes", 95, "1998-03"), ("z", "M", 0.5, 1.0, None, 5, "1998-01")
    page([a, b], 1)
    ingest.ingest(ingest.pages_in(spark, f"{d}/pages", spark.createDataFrame([a], schema).schema), f"{d}/tape", f"{d}/check").awaitTermination()
    page([b, old, old], 2)
    ingest.ingest(ingest.pages_in(spark, f"{d}/pages", spark.createDataFrame([a], schema).schema), f"{d}/tape", f"{d}/check").awaitTermination()
    assert sorted(r.trade_id for r in spark.read.parquet(f"{d}/tape").collect()) == ["a", "b", "z"]


def test_schedule_texts(spark):
    text = "Fee schedule\nEffective July 8, 2024\nTaker fee: 7% of\nMaker fees apply to KXABC, KXDEF and KXABC\n\nOther XYZ"
    docs = spark.createDataFrame([("f2", "20240710000000", text), ("f1", "20240709000000", text), ("f3", "20240101000000", "no date")], "file string, capture string, text string")
    r = texts.schedule_of(texts.versions(docs)).collect()
    assert [(x.effective, x.file, x.taker_rate, x.maker_series) for x in r] == [("2024-07-08", "f1", 0.07, ["KXABC", "KXDEF"])]
    feed = spark.createDataFrame([("1.5", None), ("", "2"), ("x", None)], "close_dollars string, close string")
    assert [r[0] for r in feed.select(texts.first_of(feed, "close_dollars", "close", "missing")).collect()] == [1.5, 2.0, None]


def test_profiles(spark):
    versions = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, None), ("k", 4, None)], "k string, i int, s string")
    assert [r.changed for r in profiles.changes(versions, "k", ["i"], ["s"]).orderBy("i").collect()] == [True, False, True, False]
    fills = spark.createDataFrame([(900_000_000, "yes", 1.0), (900_000_001, None, None)], "t long, taker_side string, count_fp double")
    eras = {r.era: (r.n, r.rate_taker_side) for r in profiles.population_by_era(fills, ["taker_side"]).collect()}
    assert eras["y1998"] == (2, 0.5) and eras["y1997"] == (0, None) and len(eras) == 6


def test_reports_and_running_totals(spark):
    from ridgeline.plans import jobs
    from ridgeline.plans.registry import Tables

    d = Tables(spark, "/root/testdata/sf0.001")
    reports = jobs.build(d) | jobs.first_report(d)
    assert {"summary", "panel", "by_year", "divergence"} <= set(reports) and all(x.columns for x in reports.values())
    assert {r.window: r.n for r in reports["summary"].where("item = 'total'").collect()} == {r.window: r["count"] for r in d.reasons.groupBy("window").count().collect()}
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = spark.createDataFrame([("a", "M", 0.5, 2.0, "yes", 1), ("b", "M", 0.25, 4.0, None, 2)], TICKS)
    rows.withColumn("ts", F.timestamp_seconds("t")).write.parquet(f"{folder}/pages/1")
    pages = ingest.pages_in(spark, f"{folder}/pages", rows.withColumn("ts", F.timestamp_seconds("t")).schema)
    for name, df in (("totals", ingest.running_totals(pages)), ("population", ingest.population_monitor(pages))):
        q = df.writeStream.outputMode("complete" if name == "totals" else "update").format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert one(spark.sql("select trades, dollars from totals")) == [(2, 2.0)] and one(spark.sql("select n, rate from population")) == [(2, 0.5)]
