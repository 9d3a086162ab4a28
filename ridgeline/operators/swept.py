"""Cluster-robust fits in which every month has a level and a slope of its own, swept out month by month.

Rows belong to groups (ever treated, treated now, so many months from treatment), each with a level and a slope too. Within a month the regressors of
the groups and the outcome are freed of the month's line by its 2 x 2 block; what is left of them, summed over months, is a system with two
rows a group, whatever the number of months. It is solved in a task, as one row; the driver sees none of it.
Rows come as moments by cluster, month and set of groups (see cell_sums()).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.stages import stored

MOMENTS = ("n", "sx", "sxx", "su", "sxu")
#: A pivot below this share of its diagonal is none: the regressor depends on those before it.
LEAST_PIVOT = 1e-9


def totals(df: DataFrame, *by: str) -> DataFrame:
    """Moments summed by the columns."""
    return df.groupBy(*by).agg(*(F.sum(c).alias(c) for c in MOMENTS), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def cell_table(sums: DataFrame) -> DataFrame:
    """Moments by month and groups, stored: as many rows as the calendar has months times sets of groups, so one partition holds them."""
    return stored(totals(sums, "month", "groups").coalesce(1), "cells").coalesce(1)


def month_blocks(cells: DataFrame) -> DataFrame:
    """(month, m_n, m_sx, m_sxx, det, level, slope): each month's block and its own line; no line without price variance."""
    det = F.when(F.col("hi") > F.col("lo"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    line = totals(cells, "month").withColumn("det", det)
    level = (F.col("sxx") * F.col("su") - F.col("sx") * F.col("sxu")) / F.col("det")
    slope = (F.col("n") * F.col("sxu") - F.col("sx") * F.col("su")) / F.col("det")
    return line.select("month", *(F.col(c).alias(f"m_{c}") for c in ("n", "sx", "sxx")), "det", level.alias("level"), slope.alias("slope"))


def moments(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left after the sweep: pairs of groups (i, j, s00, s01, s10, s11) and groups with the outcome (i, r0, r1).

    cells: month, groups (array of int), moments. s00 is level with level, s01 level of i with slope of j, and so on.
    """
    c = F.col
    held = totals(cells.withColumn("i", F.explode("groups")), "month", "i").join(month_blocks(cells), "month")
    # the months' lines through the group's level and through its slope
    to_level = ((c("m_sxx") * c("n") - c("m_sx") * c("sx")) / c("det"), (c("m_n") * c("sx") - c("m_sx") * c("n")) / c("det"))
    to_slope = ((c("m_sxx") * c("sx") - c("m_sx") * c("sxx")) / c("det"), (c("m_n") * c("sxx") - c("m_sx") * c("sx")) / c("det"))
    lines = held.select("month", c("i").alias("j"), *(x.alias(k) for k, x in zip(("h00", "h10", "h01", "h11"), (*to_level, *to_slope), strict=True)))
    swept = held.select("month", "i", "n", "sx", "sxx").join(lines, "month")
    gone = {"g00": c("n") * c("h00") + c("sx") * c("h10"), "g01": c("n") * c("h01") + c("sx") * c("h11"), "g10": c("sx") * c("h00") + c("sxx") * c("h10"), "g11": c("sx") * c("h01") + c("sxx") * c("h11")}
    gone = swept.groupBy("i", "j").agg(*(F.sum(x).alias(k) for k, x in gone.items()))
    both = cells.withColumn("i", F.explode("groups")).withColumn("j", F.explode("groups")).groupBy("i", "j").agg(*(F.sum(k).alias(k) for k in ("n", "sx", "sxx")))
    left = gone.join(both, ["i", "j"], "left")

    def less(total: str, share: str) -> Column:
        return (F.coalesce(c(total).cast("double"), F.lit(0.0)) - c(share)).alias("s" + share[1:])

    pairs = left.select("i", "j", less("n", "g00"), less("sx", "g01"), less("sx", "g10"), less("sxx", "g11"))
    sides = held.groupBy("i").agg(F.sum(c("su") - c("n") * c("level") - c("sx") * c("slope")).alias("r0"), F.sum(c("sxu") - c("sx") * c("level") - c("sxx") * c("slope")).alias("r1"))
    return pairs, sides


SOLVED = "n long, months long, clusters long, thin long, ok boolean, beta array<double>, null array<double>, weights array<array<double>>, present array<int>"


def solved(sums: DataFrame, cells: DataFrame, groups: int, targets: list[int]) -> DataFrame:
    """One row: coefficients (level and slope of each group), those with the first target's slope held at zero, and the rows of the inverse
    that belong to the targets' slopes; groups without rows have zeros.

    ok: enough rows and clusters, price variance in each of at least two months, and no regressor that others explain.
    """
    pairs, sides = moments(cells)
    blocks = month_blocks(cells)
    facts = blocks.agg(F.sum("m_n").alias("n"), F.count("*").alias("months"), F.count_if(F.col("det").isNull()).alias("thin"))
    row = facts.crossJoin(sums.agg(F.count_distinct("cluster").alias("clusters")))
    row = row.crossJoin(pairs.agg(F.collect_list(F.struct(*pairs.columns)).alias("pairs"))).crossJoin(sides.agg(F.collect_list(F.struct(*sides.columns)).alias("sides")))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                present = sorted(s["i"] for s in r["sides"])
                at = np.array([2 * g + k for g in present for k in (0, 1)], dtype=int)
                system, side = np.zeros((2 * groups, 2 * groups)), np.zeros(2 * groups)
                good = not r["thin"] and r["months"] > 1 and r["clusters"] > 1 and (r["n"] or 0) > 2 * (r["months"] + len(present))
                if good:
                    for p in r["pairs"]:
                        system[2 * p["i"] : 2 * p["i"] + 2, 2 * p["j"] : 2 * p["j"] + 2] = [[p["s00"], p["s01"]], [p["s10"], p["s11"]]]
                    for s in r["sides"]:
                        side[2 * s["i"] : 2 * s["i"] + 2] = s["r0"], s["r1"]
                    small = system[np.ix_(at, at)]
                    good = pivots(small)
                beta, null, weights = np.zeros(2 * groups), np.zeros(2 * groups), np.zeros((len(targets), 2 * groups))
                if good:
                    inverse = np.linalg.inv(small)
                    beta[at] = inverse @ side[at]
                    for k, g in enumerate(targets):
                        if g in present:
                            weights[k, at] = inverse[2 * present.index(g) + 1]
                    own = 2 * targets[0] + 1
                    null = beta - weights[0] * (beta[own] / weights[0, own]) if targets[0] in present else beta
                out.append({k: r[k] for k in ("n", "months", "clusters", "thin")} | {"ok": bool(good), "beta": beta.tolist(), "null": null.tolist(), "weights": weights.tolist(), "present": present})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("n", pa.int64()), ("months", pa.int64()), ("clusters", pa.int64()), ("thin", pa.int64()), ("ok", pa.bool_()), ("beta", pa.list_(pa.float64())), ("null", pa.list_(pa.float64())), ("weights", pa.list_(pa.list_(pa.float64()))), ("present", pa.list_(pa.int32()))]))

    return stored(row.mapInArrow(solve, SOLVED).coalesce(1), "system").coalesce(1)


def pivots(system: np.ndarray) -> bool:
    """Elimination finds no pivot that is nothing beside its diagonal."""
    a = system.copy()
    scale = np.diag(system).copy()
    for k in range(len(a)):
        if not a[k, k] > LEAST_PIVOT * max(scale[k], 0.0) or not scale[k] > 0:
            return False
        a[k + 1 :] -= np.outer(a[k + 1 :, k] / a[k, k], a[k])
    return True


def cell_lines(cells: DataFrame, system: DataFrame, targets: int) -> DataFrame:
    """(month, groups, w, a, b, a0, b0, base): for each cell the targets' weights on its rows, a level and a slope each, the fitted line, that of the null, and the
    month's own slope. Each month is one small task.
    """

    def lines(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        block = np.array([[sum(r["n"] for r in rows), sum(r["sx"] for r in rows)], [sum(r["sx"] for r in rows), sum(r["sxx"] for r in rows)]], dtype=float)
        inverse = np.linalg.inv(block)
        outcome = np.array([sum(r["su"] for r in rows), sum(r["sxu"] for r in rows)])
        of = [np.array([[r["n"], r["sx"]], [r["sx"], r["sxx"]]], dtype=float) for r in rows]
        one = rows[0]

        def through(v: list[float]) -> tuple[np.ndarray, list[np.ndarray]]:
            """The month's line through the groups' part v of all rows, and v's own line in each cell."""
            own = [sum((np.array(v[2 * g : 2 * g + 2]) for g in r["groups"]), np.zeros(2)) for r in rows]
            return inverse @ sum((m @ x for m, x in zip(of, own, strict=True)), np.zeros(2)), own

        free = inverse @ outcome
        (at, own), (at0, own0) = through(one["beta"]), through(one["null"])
        weights = [through(v) for v in one["weights"]]
        out = []
        for k, r in enumerate(rows):
            w = [float(x) for mean, each in weights for x in each[k] - mean]
            line, line0 = free - at + own[k], free - at0 + own0[k]
            out.append({"month": r["month"], "groups": r["groups"], "w": w, "a": line[0], "b": line[1], "a0": line0[0], "b0": line0[1], "base": (free - at)[1]})
        doubles = pa.float64()
        return pa.Table.from_pylist(out, schema=pa.schema([("month", pa.int32()), ("groups", pa.list_(pa.int32())), ("w", pa.list_(doubles)), *((c, doubles) for c in ("a", "b", "a0", "b0", "base"))]))

    given = cells.crossJoin(F.broadcast(system.where("ok").select("beta", "null", "weights")))
    schema = "month int, groups array<int>, w array<double>, a double, b double, a0 double, b0 double, base double"
    return stored(given.groupBy("month").applyInArrow(lines, schema), "lines").coalesce(1)


def influence(sums: DataFrame, lines: DataFrame, targets: int) -> DataFrame:
    """(cluster, z0, z1, ..., null): each cluster's influence on the targets' slopes, and on the first one with the residuals of its null."""
    met = sums.join(F.broadcast(lines), ["month", "groups"])

    def of(k: int, a: str, b: str) -> Column:
        c = F.col
        s0, s1 = c("su") - c(a) * c("n") - c(b) * c("sx"), c("sxu") - c(a) * c("sx") - c(b) * c("sxx")
        return F.sum(c("w")[2 * k] * s0 + c("w")[2 * k + 1] * s1)

    per = met.groupBy("cluster").agg(*(of(k, "a", "b").alias(f"z{k}") for k in range(targets)), of(0, "a0", "b0").alias("null"))
    return stored(per, "influence")
