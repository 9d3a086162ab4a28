"""The tape as a table bucketed by trade id: same rows, no shuffle before the dedup."""

import re
import uuid

import pytest

from ridgeline.operators import tape

ROWS = [(f"T{i % 90}", f"K{i % 90 % 4}", 0.25, float(i % 90 % 7), i % 90 if i % 30 else None, f"2024-{i % 90 % 3 + 1}") for i in range(300)]
SCHEMA = "trade_id string, ticker string, price double, count_fp double, t long, month string"
BUCKETS = 4


def exchanges(df) -> int:
    return len(re.findall(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString()))


def rows(df) -> list[str]:
    return sorted(map(str, df.collect()))


@pytest.fixture
def table(spark, tmp_path):
    name, path = f"tape_{uuid.uuid4().hex}", str(tmp_path / "tape")
    df = spark.createDataFrame([*ROWS, (None, "K1", 0.5, 1.0, 3, "2024-1")], SCHEMA)
    tape.add_to_buckets(df.where("trade_id is null or trade_id < 'T5'"), name, path, BUCKETS)
    yield name, path, tape.add_to_buckets(df, name, path, BUCKETS)  # the second batch replays the first
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_buckets_hold_the_tape_and_deal_nothing(spark, table):
    *_, got = table
    plain = spark.createDataFrame(ROWS, SCHEMA).where("t is not null")
    assert got.count() > plain.count() and got.where("trade_id is null").count() == 0
    for make, most in ((tape.dedup, 0), (tape.trade_counts, 1), (tape.dollar_volume, 1), (lambda x, **k: tape.scan(x, ["2024-2"], columns=["ticker", "t"], **k), 0)):
        have, want = make(got, dealt=True), make(plain)
        assert rows(have.select(want.columns) if set(have.columns) == set(want.columns) else have) == rows(want) != []
        assert exchanges(have) == most


def test_upserts_by_trade_id_meet_bucket_by_bucket(spark, table):
    *_, got = table
    once = tape.dedup(got, dealt=True)
    merged = tape.upsert(once, once, ["trade_id"])
    assert rows(merged) == rows(once) and len(rows(once)) == 90 - 3
    assert exchanges(merged) == 0


def test_a_table_is_declared_again(spark, table):
    name, path, got = table
    before = rows(got)
    again = tape.open_buckets(spark, f"{name}_again", path, BUCKETS)
    assert rows(again.select(got.columns)) == before and exchanges(tape.dedup(again, dealt=True)) == 0
    spark.sql(f"DROP TABLE {name}_again")


def test_dealt_is_safe_on_any_tape(spark):
    plain = spark.createDataFrame(ROWS, SCHEMA)
    assert rows(tape.dedup(plain, dealt=True)) == rows(tape.dedup(plain))
