"""A tape of snapshots: parts that are never changed, and a manifest that is switched at once.

Under the table's folder, data/part=<id>/month=<month> holds Parquet files, and manifest/<number> names the parts that make up
one version. Readers follow the newest manifest. A writer that dies before its manifest is published leaves parts that nobody
reads; vacuum() removes them. Manifests are published by a rename that fails where the number is taken, so of two writers one
begins again on what the other left. The folder is reached by Hadoop paths alone.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ridgeline.operators.tape import dedup


class Conflict(Exception):
    """Another writer has replaced the parts that this one read."""


def reach(spark: SparkSession, path: str):
    """The Hadoop file system and path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def children(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of change in milliseconds) of what lies in a folder; none if it isn't there."""
    fs, where = reach(spark, path)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(where)] if fs.exists(where) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name) for name, _ in children(spark, f"{path}/manifest") if name.isdigit())


def manifest(spark: SparkSession, path: str, number: int) -> dict:
    """parts: month by part folder; batches: the last batch that each stream has added."""
    fs, where = reach(spark, f"{path}/manifest/{number}")
    stream = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The newest version; number 0 without parts where there is none."""
    numbers = versions(spark, path)
    return (numbers[-1], manifest(spark, path, numbers[-1])) if numbers else (0, {"parts": {}, "batches": {}})


def publish(spark: SparkSession, path: str, number: int, state: dict) -> bool:
    """Writes a manifest under a name of its own and renames it to its number; False if that number is taken."""
    fs, draft = reach(spark, f"{path}/manifest/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(state), "utf-8"))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.FileContext.getFileContext(fs.getUri(), fs.getConf())
    try:
        files.rename(draft, hadoop.Path(f"{path}/manifest/{number}"), spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.toString():
            raise
        fs.delete(draft, False)
        return False
    return True


def switch(spark: SparkSession, path: str, added: dict[str, str], gone: list[str] = [], batch: tuple[str, int] | None = None) -> None:
    """Publishes the newest version with parts added and gone. A part that is no longer there to go is a Conflict."""
    while True:
        number, state = current(spark, path)
        if batch and state["batches"].get(batch[0], -1) >= batch[1]:
            return
        if missing := set(gone) - state["parts"].keys():
            raise Conflict(f"replaced by another writer: {', '.join(sorted(missing))}")
        parts = {p: m for p, m in state["parts"].items() if p not in set(gone)} | added
        if publish(spark, path, number + 1, {"parts": parts, "batches": state["batches"] | dict([batch] if batch else [])}):
            return


def read(spark: SparkSession, path: str, schema: StructType, months: list[str] | None = None) -> DataFrame:
    """The newest version, or some months of it: parts of other months aren't listed or opened. The schema has a column month."""
    return of_parts(spark, path, schema, [p for p, m in current(spark, path)[1]["parts"].items() if months is None or m in months])


def of_parts(spark: SparkSession, path: str, schema: StructType, parts: list[str]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    there = StructType([*schema.fields]).add("part", StringType())
    return spark.read.schema(there).option("basePath", f"{path}/data").parquet(*[f"{path}/data/{p}" for p in parts]).select(schema.names)


def write_part(rows: DataFrame, path: str) -> dict[str, str]:
    """Writes rows by month into a part of its own; a month of many rows is the work of several tasks. Returns month by folder."""
    spark, part = rows.sparkSession, f"part={uuid.uuid4().hex}"
    rows.hint("rebalance", "month").write.partitionBy("month").parquet(f"{path}/data/{part}")
    found = (name for name, _ in children(spark, f"{path}/data/{part}") if name.startswith("month="))
    return {f"{part}/{name}": name.removeprefix("month=") for name in found}


def append(page: DataFrame, path: str, batch: tuple[str, int] | None = None) -> None:
    """Adds the page's fills that the tape lacks; rows without id, time or month are dropped.

    batch is (stream, number): a batch that the version already has is left without reading the tape. Otherwise ids and months
    of the months that the page touches are read. One stream appends at a time; compact() may run beside it.
    """
    spark = page.sparkSession
    if batch and current(spark, path)[1]["batches"].get(batch[0], -1) >= batch[1]:
        return
    rows = dedup(page.where("trade_id is not null and t is not null and month is not null"))
    months = [r["month"] for r in page.select("month").distinct().collect()]
    known = read(spark, path, page.schema, months).select("trade_id", "month")
    switch(spark, path, write_part(rows.join(known, ["trade_id", "month"], "left_anti").select(page.columns), path), batch=batch)


def compact(spark: SparkSession, path: str, schema: StructType, month: str) -> None:
    """Rewrites a month without duplicates as one part. Readers see the old parts or the new one; appends in between stay."""
    parts = [p for p, m in current(spark, path)[1]["parts"].items() if m == month]
    if parts:
        switch(spark, path, write_part(dedup(of_parts(spark, path, schema, parts)), path), parts)


def replace(rows: DataFrame, path: str) -> None:
    """Puts rows, which have a column month, in the place of the whole table."""
    spark = rows.sparkSession
    old = list(current(spark, path)[1]["parts"])
    switch(spark, path, write_part(rows, path), old)


def vacuum(spark: SparkSession, path: str, keep: int = 1, hours: float = 24) -> None:
    """Removes all but the newest manifests, and parts and drafts that none of those names. What is younger than some hours stays, as
    its writer may be at work."""
    before = (time.time() - hours * 3600) * 1000
    kept = versions(spark, path)[-keep:]
    named = {p for n in kept for p in manifest(spark, path, n)["parts"]}
    stale = [f"manifest/{name}" for name, t in children(spark, f"{path}/manifest") if t <= before and not (name.isdigit() and int(name) in kept)]
    for part, t in children(spark, f"{path}/data"):
        inside = children(spark, f"{path}/data/{part}")
        if t <= before and not any(f"{part}/{name}" in named for name, _ in inside):
            stale.append(f"data/{part}")
        else:
            stale += [f"data/{part}/{name}" for name, u in inside if name.startswith("month=") and u <= before and f"{part}/{name}" not in named]
    for name in stale:
        fs, where = reach(spark, f"{path}/{name}")
        fs.delete(where, True)
