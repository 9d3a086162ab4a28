"""Helpers shared by the corpus operators: table reading, cutting lineage, Arrow maps, connected components."""

from __future__ import annotations

import ctypes
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each context, unless their path has it already."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    on_path = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    context = spark.sparkContext
    if root in on_path or getattr(context, "_ridgeline_shipped", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "ridgeline"), "zip", root, "ridgeline")
    context.addPyFile(archive)
    context._ridgeline_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets a temporary
    one; a cluster has no folder that would do, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back.

    The files outlive executors, so a lost executor costs only the task it ran.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about `most` bytes, so that what is made of a part stays small beside the batch itself."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(batch.nbytes, 1))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


class Kept:
    """What a Python worker keeps for tasks to come. Workers serve all operators of a session, so one keeps things of one operator at a time."""

    name: tuple = ()
    value: object = None

    @classmethod
    def get(cls, *name, make: Callable[[], object]) -> object:
        """The value kept under that name; another one's goes before it is made."""
        if cls.name != name:
            cls.drop()
            cls.name, cls.value = name, make()
        return cls.value

    @classmethod
    def drop(cls) -> None:
        if cls.name:
            cls.name, cls.value = (), None
            give_back()


def give_back() -> None:
    """Returns what the allocators hold free to the system: workers live on and wait."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def append_columns(
    df: DataFrame,
    columns: dict[str, T.DataType],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    drop: Iterable[str] = (),
    most: int = 4 << 20,
) -> DataFrame:
    """Adds columns computed from whole Arrow batches; make() runs once in each task and returns the batch function.

    A column of df with the name of a new one is replaced by it. Columns in drop are inputs that aren't passed on. A batch has about
    `most` bytes.
    """
    ship(df.sparkSession)
    dropped = {*drop, *columns}
    kept = [c for c in df.columns if c not in dropped]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, t) for c, t in columns.items()])
    names = [*kept, *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Kept.drop()
        f = make()
        for batch in slices(batches, most):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + f(batch), names)
        del f
        give_back()

    return df.mapInArrow(run, schema)


def pieces(texts: Iterable[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about `most` characters, so that intermediate lists stay small."""
    run: list[str] = []
    n = 0
    for t in texts:
        run.append(t)
        n += len(t)
        if n >= most:
            yield run
            run, n = [], 0
    if run:
        yield run


SPACES_BEGIN = re.compile(r"(?<=\S)\s")


def stretches(text: str, most: int) -> Iterator[str]:
    """A text in parts of about `most` characters, cut where white space begins; longer only where a part holds none."""
    at = 0
    while len(text) - at > most and (cut := SPACES_BEGIN.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The slices flat[starts[i]:starts[i] + lens[i]], one after another."""
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    return flat[np.repeat(starts - before, lens) + np.arange(total)]


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of an undirected graph.

    edges: columns (a, b) of one orderable type; null ends and self-loops are ignored. Returns (node, component) with the
    smallest node reachable as component, for every node that has an edge. Each round hooks every component under the
    smallest neighbouring one and then halves the paths by following the label of the label, so a chain of n nodes takes
    a number of rounds logarithmic in practice. Every round is written to the shared folder; only counts reach the driver.
    A node of very many edges, or a giant component's label, meets one row on the other side of its joins, whose sorted side Spark's
    adaptive execution splits; sums by node or label combine before they are dealt.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = stage_table(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component"))
    labels = stage_table(labels, f"{tag}-labels")
    while True:
        heard = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("heard"))
        )
        own = labels.join(heard, "node").select("node", "component", F.least("component", "heard").alias("best"))
        # the old root hears of the best label that any of its members heard of
        root = own.groupBy(F.col("component").alias("node")).agg(F.min("best").alias("hooked"))
        step = own.join(root, "node", "left").select(
            "node", F.col("component").alias("old"), F.least("best", F.coalesce("hooked", "best")).alias("near")
        )
        up = step.select(F.col("node").alias("near"), F.col("near").alias("far"))
        new = step.join(up, "near").select("node", "old", F.least("near", "far").alias("component"))
        new = stage_table(new, f"{tag}-labels")
        changed = new.where("old <> component").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
