"""Versions of a tape: what readers see when a writer dies at each step, repeats itself, or meets another."""

import tempfile

import pytest

from ridgeline.operators import snapshots
from ridgeline.streaming import ingest

SCHEMA = "trade_id string, t long, month string"


class Died(Exception):
    pass


def died(*_args, **_kwargs):
    raise Died


def page(spark, *ids, month="1998-01"):
    return spark.createDataFrame([(i, 1, month) for i in ids], SCHEMA)


@pytest.fixture
def path():
    return tempfile.mkdtemp(prefix="spark-") + "/tape"


def ids(spark, path, **more):
    return sorted(x.trade_id for x in snapshots.read(spark, path, page(spark).schema, **more).collect())


def test_appends_compaction_and_months(spark, path):
    assert ids(spark, path) == []
    snapshots.append(page(spark, "a", "a", None), path)
    snapshots.append(page(spark, "a", "b"), path)
    snapshots.append(page(spark, "c", month="1998-02"), path)
    assert ids(spark, path) == ["a", "b", "c"] and ids(spark, path, months=["1998-02"]) == ["c"] and ids(spark, path, months=[]) == []
    snapshots.compact(spark, path, page(spark).schema, "1998-01")
    snapshots.compact(spark, path, page(spark).schema, "2001-01")
    parts = snapshots.current(spark, path)[1]["parts"]
    assert sorted(parts.values()) == ["1998-01", "1998-02"] and ids(spark, path) == ["a", "b", "c"]
    plan = snapshots.read(spark, path, page(spark).schema, months=["1998-02"]).inputFiles()
    assert plan and all("month=1998-02" in f for f in plan)
    snapshots.replace(page(spark, "z"), path)
    assert ids(spark, path) == ["z"]


@pytest.mark.parametrize("step", ["write_part", "switch", "publish"])
def test_a_writer_that_dies_leaves_the_version(spark, path, step, monkeypatch):
    snapshots.append(page(spark, "a", "b"), path)
    for work in (lambda: snapshots.append(page(spark, "c"), path), lambda: snapshots.compact(spark, path, page(spark).schema, "1998-01"), lambda: snapshots.replace(page(spark, "x"), path)):
        with monkeypatch.context() as m:
            m.setattr(snapshots, step, died)
            with pytest.raises(Died):
                work()
        assert ids(spark, path) == ["a", "b"]
    snapshots.append(page(spark, "c"), path)
    snapshots.vacuum(spark, path)
    assert len(snapshots.versions(spark, path)) == 2, "what is young stays"
    snapshots.vacuum(spark, path, hours=-1)
    named = {p.split("/")[0] for p in snapshots.current(spark, path)[1]["parts"]}
    assert {name for name, _ in snapshots.children(spark, f"{path}/data")} == named and len(snapshots.versions(spark, path)) == 1
    assert ids(spark, path) == ["a", "b", "c"]


def test_two_writers(spark, path, monkeypatch):
    snapshots.append(page(spark, "a", "a2"), path)
    write = snapshots.write_part

    def beside(rows, where, other):
        added = write(rows, where)
        with monkeypatch.context() as m:
            m.setattr(snapshots, "write_part", write)
            other()
        return added

    with monkeypatch.context() as m:
        m.setattr(snapshots, "write_part", lambda rows, where: beside(rows, where, lambda: snapshots.append(page(spark, "b"), path)))
        snapshots.compact(spark, path, page(spark).schema, "1998-01")
    assert ids(spark, path) == ["a", "a2", "b"], "an append beside a compaction stays"
    with monkeypatch.context() as m:
        m.setattr(snapshots, "write_part", lambda rows, where: beside(rows, where, lambda: snapshots.compact(spark, path, page(spark).schema, "1998-01")))
        with pytest.raises(snapshots.Conflict):
            snapshots.compact(spark, path, page(spark).schema, "1998-01")
    assert ids(spark, path) == ["a", "a2", "b"]
    number, state = snapshots.current(spark, path)
    assert not snapshots.publish(spark, path, number, {"parts": {}, "batches": {}}) and snapshots.current(spark, path) == (number, state)


def test_a_batch_counts_once_and_is_not_read_again(spark, path, monkeypatch):
    snapshots.append(page(spark, "a"), path, ("s", 0))
    with monkeypatch.context() as m:
        m.setattr(snapshots, "read", died)
        snapshots.append(page(spark, "a"), path, ("s", 0))
    snapshots.append(page(spark, "b"), path, ("other", 0))
    assert ids(spark, path) == ["a", "b"] and snapshots.current(spark, path)[1]["batches"] == {"s": 0, "other": 0}


def test_ingest_after_a_death_between_write_and_version(spark, path, monkeypatch):
    folder = tempfile.mkdtemp(prefix="spark-")
    page(spark, "a", "b").write.parquet(f"{folder}/pages/1")
    pages = ingest.pages_in(spark, f"{folder}/pages", page(spark).schema)
    with monkeypatch.context() as m:
        m.setattr(snapshots, "publish", died)
        with pytest.raises(Exception, match="Died"):
            ingest.ingest_snapshots(pages, path, f"{folder}/check").awaitTermination()
    assert ids(spark, path) == []
    page(spark, "b", "c", month="1998-01").write.parquet(f"{folder}/pages/2")
    for _ in range(2):
        ingest.ingest_snapshots(pages, path, f"{folder}/check").awaitTermination()
    assert ids(spark, path) == ["a", "b", "c"]
