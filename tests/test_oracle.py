"""Registered queries against their DuckDB counterparts on the smallest tables."""

import duckdb
import pytest

from ridgeline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One for each family first, so that a broken table shows early; then all others.
SOME = ["a4_dedup_tape", "a8_market_upsert", "a17_closing_quotes", "b1_universe_reasons", "b4_filter_summary", "c1_asof_last_trade", "c4_panel_backfilled", "c9_fee_lookup", "d10_win_rate_by_band", "d12_maker_taker_split", "d13_maker_margin_layers", "d15_funnel", "i4_mz_by_category", "i6_boundary_shifts", "i15_fee_ribbon"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME + sorted(set(registry.ORACLE_SQL) - set(SOME)))
def test_query_equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    have = sorted((tuple(r) for r in df.select(columns).collect()), key=str)
    assert have == sorted(want.project(",".join(f'"{c}"' for c in columns)).fetchall(), key=str)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
