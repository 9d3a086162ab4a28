"""What the plans must not cost, hot keys, configuration files and windows."""

import datetime
import json
import os
import random
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import asof, compose, control, did, fees, panel, profiles, returns, selection, tape, texts, universe
from ridgeline.plans import jobs, registry
from ridgeline.sources import adapters as A

SF = "/root/testdata/sf0.001"
TICKS = "trade_id string, ticker string, price double, count_fp double, taker_side string, t long"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scattered(spark, n=400):
    r = random.Random(4)
    ticks = [(f"{i:04d}", r.choice(["HOT"] * 8 + ["B", "C"]), r.choice([None, 0.2, 0.5, 0.9]), 1.0, "yes", r.choice([None, *range(0, 500, 7)])) for i in range(n)]
    refs = [(r.choice(["HOT", "HOT", "B", "D"]), k, r.randrange(-20, 900)) for k in range(200)]
    return spark.createDataFrame(ticks, TICKS), spark.createDataFrame(refs, "ticker string, ref_id int, ref_t long")


@pytest.mark.parametrize("bucket", [1, 13, 100, 10_000])
def test_hot_tickers_are_parted_without_a_difference(spark, bucket):
    ticks, refs = scattered(spark)
    whole = asof.last_trade_at_or_before(refs, ticks, ["ref_id"])
    parted = asof.last_trade_at_or_before(refs, ticks, ["ref_id"], bucket=bucket)
    assert sorted(map(tuple, parted.collect())) == sorted(map(tuple, whole.collect())) != []


def test_panel_reads_and_deals_the_tape_once(spark):
    plan = plan_of(registry.QUERIES["c4_panel_backfilled"](spark, SF))
    assert len(re.findall(r"\bWindow \[", plan)) == 2 and len(re.findall(r"lineitem", plan)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(ticker", plan)) <= 4


def test_lookbacks_equal_two_joins(spark):
    """Day 0 and its lookbacks from the one pass against the as-of join called twice."""
    markets, fills = A.markets(spark, SF), A.raw_fills(spark, SF)
    day0 = asof.last_trade_at_or_before(panel.closing_refs(markets), fills, ["lookback_day"])
    want = day0.unionByName(asof.last_trade_at_or_before(panel.lookback_refs(day0), fills, ["lookback_day"]))
    got = panel.lookback_prices(markets, fills)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_fees_are_looked_up_in_the_row(spark):
    d = registry.Tables(spark, SF)
    rows = returns.sides(d.side_fills, d.scope_markets).withColumn("as_of", F.col("traded"))
    before, after = (len(re.findall(r"\bExchange\b", plan_of(x))) for x in (rows, fees.lookup(rows, d.schedule)))
    assert before == after


def test_escalation_prices_the_tape_once(spark, monkeypatch):
    """Margins and ribbon read the same stored cells, so replays are dropped and both sides priced in one pass."""
    priced, sides = [], returns.sides
    monkeypatch.setattr(returns, "sides", lambda *a: priced.append(1) or sides(*a))
    d = registry.Tables(spark, SF)
    margins, points = d.margins.first(), d.ribbon.count()
    assert len(priced) == 1 and points > 1 and margins["n_maker_a"] > 0
    assert all("lineitem" not in plan_of(x) for x in (d.margins, d.ribbon))


def test_lookup_equals_the_join(spark, monkeypatch):
    r = random.Random(8)
    asked = [(r.choice(["maker", "taker", None]), r.choice([None, datetime.date(1994, 1, 1), datetime.date(r.randrange(1995, 2002), r.randrange(1, 13), r.randrange(1, 28))]), r.choice([None, "P1", "P12", "Q1"]), r.choice([None, "S1", "S3", "S8", "S9"])) for _ in range(300)]
    df = spark.createDataFrame(asked, "role string, as_of date, ticker string, series_ticker string")
    schedule = A.fee_schedule(spark).unionByName(spark.createDataFrame([(8, datetime.date(1997, 7, 1), "taker", "none", 0.0, "ticker_prefix", ["P12", "Q"])], fees.SCHEDULE))
    want = fees.joined_lookup(df, schedule)
    assert sorted(map(str, fees.lookup(df, schedule).collect())) == sorted(map(str, want.collect()))
    monkeypatch.setattr(fees, "MOST_ENTRIES", 3)
    assert sorted(map(str, fees.lookup(df, schedule).collect())) == sorted(map(str, want.collect()))


def test_long_schedules_are_joined_by_equality(spark):
    """500 prefixes and 5,000 series in many generations, against a plain loop over the entries."""
    r = random.Random(5)
    day = lambda: datetime.date(r.randrange(1995, 2002), r.randrange(1, 13), 1)
    entries = [(1, day(), "taker", "quadratic", 0.07, "all", None), (2, day(), "maker", "none", 0.0, "all", []), (3, day(), "taker", "none", 0.0, "all", ["ignored"])]
    for n in range(4, 44):
        kind = r.choice(["series", "ticker_prefix"])
        values = [f"S{r.randrange(5000)}" for _ in range(250)] if kind == "series" else ["P" * r.randrange(0, 3) + str(r.randrange(500)) for _ in range(25)]
        entries.append((n, day(), r.choice(["taker", "maker"]), "quadratic", n / 1000, kind, [*values, None]))
    schedule = spark.createDataFrame(entries, fees.SCHEDULE)
    asked = [(r.choice(["maker", "taker", None]), r.choice([None, day(), day(), day()]), r.choice([None, f"P{r.randrange(900)}", f"PP{r.randrange(900)}", "", f"{r.randrange(99)}"]), r.choice([None, f"S{r.randrange(5000)}", f"S{r.randrange(5000)}"])) for _ in range(400)]
    found = fees.lookup(spark.createDataFrame(asked, "role string, as_of date, ticker string, series_ticker string"), schedule)
    plan = plan_of(found)
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan

    def fee(role, as_of, ticker, series):
        hits = []
        for n, begins, entry_role, form, rate, kind, values in entries:
            newest = max((e[1] for e in entries if as_of and (e[2], e[5]) == (role, kind) and e[1] <= as_of), default=None)
            named = {"all": True, "series": series is not None and series in (values or []), "ticker_prefix": ticker is not None and any(v is not None and ticker.startswith(v) for v in values or [])}[kind]
            if entry_role == role and newest == begins and named:
                hits.append((["series", "ticker_prefix", "all"].index(kind), n, form, rate, kind))
        return min(hits)[2:] if hits else (None, None, None)

    rows = [tuple(x) for x in found.collect()]
    assert sorted(map(str, rows)) == sorted(str((*a, *fee(*a))) for a in asked)
    assert {x[6] for x in rows} == {None, "all", "series", "ticker_prefix"}


def test_long_schedules_read_what_is_asked_once(spark):
    """Neither dates nor distinct keys are drawn from the tape first, and a small schedule leaves its rows where they are."""
    entries = [(n, datetime.date(1995 + n, 1, 1), "maker", "quadratic", n / 100, "series", [f"S{n}-{k}" for k in range(150)]) for n in range(4)]
    entries += [(9, datetime.date(1995, 1, 1), "taker", "quadratic", 0.07, "all", None), (10, datetime.date(1996, 1, 1), "taker", "quadratic", 0.03, "ticker_prefix", ["1", "22"])]
    day = F.date_add(F.lit("1994-06-01").cast("date"), (F.col("id") % 3000).cast("int"))
    asked = spark.range(6000).select(F.when(F.col("id") % 2 == 0, "maker").otherwise("taker").alias("role"), day.alias("as_of"), F.col("id").cast("string").alias("ticker"), F.lit("S2-7").alias("series_ticker"))
    found = fees.lookup(asked, spark.createDataFrame(entries, fees.SCHEDULE))
    plan = plan_of(found)
    assert len(re.findall(r"Range \(", plan)) == 1 and "hashpartitioning" not in plan
    assert found.count() == 6000 and found.where("scope_kind = 'ticker_prefix'").count() > 0


def test_months_reach_the_scan(spark):
    plan = plan_of(registry.QUERIES["a1_tape_scan_months"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_shipdate", plan)


def lines(rows) -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "rows.json")
    with open(path, "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    return path


def test_schedules_from_files_and_the_uniform_one(spark):
    asked = spark.createDataFrame([("taker", datetime.date(2020, 1, 1), "A", "S"), ("maker", datetime.date(2022, 1, 1), "A", "S")], "role string, as_of date, ticker string, series_ticker string")
    uniform = fees.lookup(asked, fees.uniform_schedule(spark, datetime.date(2021, 1, 1))).collect()
    assert [(x.form, x.rate) for x in uniform] == [(None, None), ("none", 0.0)]
    path = lines([{"ord": 1, "effective_from": "2019-01-01", "role": "taker", "form": "quadratic", "rate": 0.07, "scope_kind": "series", "scope_values": ["S"]}])
    assert [(x.form, x.rate) for x in fees.lookup(asked, fees.load_schedule(spark, path)).collect()] == [("quadratic", 0.07), (None, None)]
    assert fees.load_schedule(spark, path + ".none").count() == 0


def test_rules_from_files(spark):
    path = lines([{"place": 2, "category": "b", "patterns": ["y"]}, {"place": 1, "category": "a", "patterns": ["x", "z"]}])
    assert control.load_rules(spark, path, ["a", "b"]) == [("a", r"\b(?:x|z)\b"), ("b", r"\b(?:y)\b")]
    assert control.load_rules(spark, path + ".none", ["a"]) == []
    with pytest.raises(ValueError, match="allowed"):
        control.load_rules(spark, path, ["a"])


def test_a_frozen_mix_is_never_made_up(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    with pytest.raises(FileNotFoundError):
        compose.load_mix(spark, f"{folder}/mix")
    mix = spark.createDataFrame([("A", 0.25), ("B", 0.75)], "category string, weight double")
    compose.write_mix(mix, f"{folder}/mix")
    assert sorted(map(tuple, compose.load_mix(spark, f"{folder}/mix").collect())) == [("A", 0.25), ("B", 0.75)]


def test_texts_are_composed(spark):
    df = spark.createDataFrame([("é − x",), (None,)], "t string")
    assert [x[0] for x in df.select(texts.composed(texts.fold_dashes(F.col("t")))).collect()] == ["é - x", None]


def test_windows_keep_their_own_contracts(spark):
    markets, quotes = A.markets(spark, SF), A.quotes(spark, SF)
    first = universe.reasons(markets, quotes, window="r1")
    assert first.count() == markets.where("in_r1_window").count() and {x.window for x in first.select("window").distinct().collect()} == {"r1"}
    log = universe.exclusion_log(universe.reasons(markets, quotes))
    both = log.join(markets.select("ticker", "in_r1_window"), "ticker")
    assert both.where("(window = 'r1') <> in_r1_window").count() == 0 and log.select("window").distinct().count() == 2
    assert {x.window for x in universe.exclusion_log(first, "branch").select("window").distinct().collect()} == {"branch"}


@pytest.mark.parametrize("digits", [0, 2, 9])
def test_nearest_ranks_and_percentiles(spark, digits):
    """Groups of very different size, one value that is a third of its group, a null group, nulls, and a group of nulls alone."""
    r = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in np.round(r.normal(size=500), digits)] + [("hot", 0.25)] * 250 + [("one", 7.0), ("two", 1.0), ("two", 2.0), (None, 3.0), (None, -0.0), (None, 0.0), ("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.025, 0.5, 0.9, 1.0]
    near = {(x.g, x.share): x.value for x in selection.nearest_rank(df, ["g"], F.col("v"), shares).collect()}
    lines = {(x.g, x.share): x.value for x in selection.percentiles(df, ["g"], F.col("v"), shares).collect()}
    assert {g for g, _ in near} == {"hot", "one", "two", None} and near.keys() == lines.keys()
    for g, q in near:
        values = np.sort([v for k, v in rows if k == g and v is not None])
        assert near[g, q] == values[min(int(q * len(values)), len(values) - 1)]
        assert lines[g, q] == pytest.approx(np.percentile(values, q * 100), abs=1e-12)
    whole = {x.share: x.value for x in selection.nearest_rank(df, [], F.col("v"), shares).collect()}
    every = np.sort([v for _, v in rows if v is not None])
    assert whole == {q: every[min(int(q * len(every)), len(every) - 1)] for q in shares}
    assert selection.percentiles(df.where("false"), ["g"], F.col("v"), shares).count() == 0


def test_newest_fills_by_source(spark):
    rows = [("1", "A", "live", 5), ("2", "A", "historical", 9), ("3", "B", "historical", 7), ("4", "B", "historical", 7), ("5", "B", "live", 50), ("6", "C", "other", 1)]
    df = spark.createDataFrame(rows, "trade_id string, ticker string, source string, t long")
    assert sorted(map(tuple, tape.newest_before(df, 10).collect())) == [("A", "1"), ("B", "4")]


def test_reports_hold_every_part(spark):
    """The second and the escalation report run, and agree with the queries that give their parts."""
    d = registry.Tables(spark, SF)
    second, last = jobs.second_report(d), jobs.escalation_report(d)
    assert {k: v.count() > 0 for k, v in second.items() if k not in ("horizons",)} == {k: True for k in second if k not in ("horizons",)}
    assert second["verdict"].select("verdict").collect() == registry.QUERIES["i10_verdict"](spark, SF).collect()
    row = last["escalation"].first()
    assert row.escalate == bool(row.triggers) and last["venue"].first().venue == ("standalone_paper" if row.escalate else "replication_note")
    assert last["ribbon"].count() == d.grid.count()


def test_event_study_equals_least_squares(spark):
    """Slopes and clustered errors of the study against a plain regression on all rows."""
    r = np.random.default_rng(12)
    rows = []
    for i in range(600):
        series = i % 12
        month = 24_200 + int(r.integers(0, 6))
        p = round(float(r.uniform(0.05, 0.95)), 2)
        rows.append((f"M{i}", f"E{i % 90}", f"S{series}", "C", int(r.integers(0, 11)), month, p, float(r.random() < p), "yes"))
    close = {m: int(datetime.datetime((m) // 12, m % 12 + 1, 15, tzinfo=datetime.UTC).timestamp()) for m in range(24_200, 24_206)}
    df = spark.createDataFrame([(t, e, s, c, k, close[m], p, y, side) for t, e, s, c, k, m, p, y, side in rows], "ticker string, event_ticker string, series_ticker string, category string, lookback_day int, close_t long, p double, y double, side string")
    day = datetime.date(24_202 // 12, 24_202 % 12 + 1, 1)
    schedule = spark.createDataFrame([(1, day, "maker", "quadratic", 0.02, "series", [f"S{i}" for i in range(5)])], fees.SCHEDULE)
    found = {x.k: x for x in did.event_study(df, schedule).collect()}
    cells = did.event_cells(df, schedule).collect()
    months, times = sorted({c.month for c in cells}), sorted({c.k for c in cells if c.k is not None and c.k != -1})
    assert sorted(found) == times
    x, u = np.array([c.p * 100 for c in cells]), np.array([(c.y - c.p) * 100 for c in cells])
    flags = [[1.0, c.ever, *(float(c.k == j) for j in times), *(float(c.month == m) for m in months[1:])] for c in cells]
    base = np.array(flags)
    design = np.stack([base, base * x[:, None]], axis=2).reshape(len(cells), -1)
    keep = np.linalg.matrix_rank(design)
    beta, *_ = np.linalg.lstsq(design, u, rcond=None)
    for i, j in enumerate(times):
        if keep == design.shape[1]:
            assert found[j].slope == pytest.approx(beta[2 * (2 + i) + 1], rel=1e-6, abs=1e-8)
    residual = u - design @ beta
    cluster = np.unique([c.event_ticker for c in cells], return_inverse=True)[1]
    scores = np.zeros((cluster.max() + 1, design.shape[1]))
    np.add.at(scores, cluster, design * residual[:, None])
    bread = np.linalg.pinv(design.T @ design)
    g, n = len(scores), len(cells)
    cov = g / (g - 1) * (n - 1) / (n - keep) * bread @ (scores.T @ scores) @ bread
    for i, j in enumerate(times):
        at = 2 * (2 + i) + 1
        assert found[j].se == pytest.approx(np.sqrt(cov[at, at]), rel=1e-5)
        assert found[j].n == n and found[j].n_clusters == g
