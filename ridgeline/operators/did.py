"""Staggered difference-in-differences in slopes, and its event study."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.scalars import ordinal_month, utc_date
from ridgeline.operators import swept
from ridgeline.operators.fees import lookup
from ridgeline.operators.regression import WILD_BELOW, cell_sums, chi2_tail, rows_of, sign_replicates
from ridgeline.operators.stages import stored

LEADS, LAGS, REFERENCE = 6, 9, -1


def treated_flags(panel: DataFrame, schedule: DataFrame) -> DataFrame:
    """Adds month, now (a maker fee is charged on the close date) and ever (now for any row of the series in the panel).

    The fee of a series on a date is looked up in the row; only the series' own flags, one row each, are joined. A null series is never
    treated.
    """
    dated = panel.withColumns({"as_of": utc_date(F.col("close_t")), "month": ordinal_month(F.col("close_t")), "role": F.lit("maker")})
    # scopes by ticker don't count here: a series pays or doesn't
    asked = dated.withColumnRenamed("ticker", "ticker_").withColumn("ticker", F.lit(None).cast("string"))
    found = lookup(asked, schedule).drop("ticker").withColumnRenamed("ticker_", "ticker")
    charged = F.col("series_ticker").isNotNull() & (F.col("form") != "none") & (F.col("rate") != 0)
    out = found.withColumn("now", F.coalesce(charged, F.lit(False)).cast("int")).drop("as_of", "role", "form", "rate", "scope_kind")
    ever = out.where("now = 1").select("series_ticker").distinct().withColumn("any", F.lit(1))
    return out.join(ever, "series_ticker", "left").withColumn("ever", F.coalesce("any", F.lit(0))).drop("any")


def clean_controls(flagged: DataFrame) -> DataFrame:
    """Without the untreated rows of series that are treated at some time."""
    return flagged.where("now = 1 or ever = 0")


def arm_sizes(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("month").agg(F.count_if(F.col("now") == 1).alias("treated"), F.count_if(F.col("now") == 0).alias("control"), (F.count_distinct("now") == 2).alias("both"))


def cohorts(flagged: DataFrame) -> DataFrame:
    """(series_ticker, cohort): the first month in which each treated series pays."""
    return flagged.where("now = 1").groupBy("series_ticker").agg(F.min("month").alias("cohort"))


EVER, NOW = 0, 1


def groups_of(*flags: Column) -> Column:
    """The numbers of the groups whose flag is 1, as a sorted array."""
    return F.array_compact(F.array(*(F.when(f == 1, F.lit(k)) for k, f in enumerate(flags))))


def did_sums(panel: DataFrame, schedule: DataFrame) -> DataFrame:
    """Moments by cluster, month, ever and now, which serve both fits; stored, so that the panel is computed once."""
    return stored(cell_sums(rows_of(treated_flags(panel, schedule), "month", "ever", "now"), ["month", "ever", "now"]), "did-sums")


DID_SCHEMA = "fit string, delta_did double, delta_did_se double, ci_lo double, ci_hi double, alpha_did double, psi_untreated double, delta_ever double, n long, n_clusters long, n_treated long, n_control long, months int, used_wild boolean"


def fit_did(sums: DataFrame, clean: bool = False, reps: int = 999, seed: int = 0) -> DataFrame:
    """One row: the slope shift of treated contracts with month levels and slopes; nulls where the design isn't identified.

    Below WILD_BELOW clusters, error and half width come from wild cluster weights with the null of no shift imposed.
    """
    sums = clean_controls(sums) if clean else sums
    # without the rows that set ever apart, ever and now are one regressor
    sums = sums.withColumn("groups", groups_of(F.lit(0) if clean else F.col("ever"), F.col("now")))
    cells = swept.cell_table(sums)
    system = swept.solved(sums, cells, 2, [NOW])
    lines = swept.cell_lines(cells, system, 1)
    per = swept.influence(sums, lines, 1)
    arms = sums.agg(F.sum(F.when(F.col("now") == 1, F.col("n")).otherwise(0)).alias("n_treated"), F.sum(F.when(F.col("now") == 0, F.col("n")).otherwise(0)).alias("n_control"))
    meat = per.agg(F.sum(F.col("z0") ** 2).alias("meat"))
    first = lines.agg(F.min_by("base", "month").alias("psi_untreated"))
    few = per.crossJoin(F.broadcast(system.select("clusters"))).where(F.col("clusters") < WILD_BELOW).select(F.lit(0).alias("_g"), "cluster", F.col("null").alias("z"))
    drawn = sign_replicates(few, ["z"], reps, seed).select("z_se", "z_half")
    one = system.where("ok").crossJoin(arms).crossJoin(meat).crossJoin(first).where("n_treated > 0 and n_control > 0")
    one = one.join(drawn, F.lit(True), "left")
    c = F.col
    wild = c("clusters") < WILD_BELOW
    k = 2 * (c("months") + F.size("present"))
    sandwich = F.sqrt(c("clusters") / (c("clusters") - 1) * (c("n") - 1) / (c("n") - k) * c("meat"))
    delta, half = c("beta")[2 * NOW + 1], F.when(wild, c("z_half")).otherwise(1.96 * sandwich)
    found = one.select(
        delta.alias("delta_did"),
        F.when(wild, c("z_se")).otherwise(sandwich).alias("delta_did_se"),
        (delta - half).alias("ci_lo"),
        (delta + half).alias("ci_hi"),
        c("beta")[2 * NOW].alias("alpha_did"),
        "psi_untreated",
        (F.lit(None).cast("double") if clean else c("beta")[2 * EVER + 1]).alias("delta_ever"),
        "n",
        c("clusters").alias("n_clusters"),
        "n_treated",
        "n_control",
        c("months").cast("int").alias("months"),
        wild.alias("used_wild"),
    )
    name = sums.sparkSession.range(1).select(F.lit("clean_controls" if clean else "twfe").alias("fit"))
    return name.join(found, F.lit(True), "left")


def did_pair(panel: DataFrame, schedule: DataFrame) -> DataFrame:
    """Both fits as rows; one that isn't identified has nulls for its numbers, never zeros."""
    sums = did_sums(panel, schedule)
    return fit_did(sums).unionByName(fit_did(sums, clean=True))


def event_cells(panel: DataFrame, schedule: DataFrame) -> DataFrame:
    """Flagged rows with k, the months since the series' first treated month, clipped to the leads and lags; null if never treated."""
    flagged = treated_flags(panel, schedule)
    met = flagged.join(cohorts(flagged), "series_ticker", "left")
    return met.withColumn("k", F.when(F.col("cohort").isNotNull(), F.greatest(F.lit(-LEADS), F.least(F.lit(LAGS), F.col("month") - F.col("cohort")))))


EVENT_SCHEMA = "k int, slope double, se double, ci_lo double, ci_hi double, pre_chi2 double, pre_df int, pre_p double, post_chi2 double, post_df int, post_p double, n long, n_clusters long"
EVENT_TYPES = {x.split()[0]: {"int": pa.int32(), "double": pa.float64(), "long": pa.int64()}[x.split()[1]] for x in EVENT_SCHEMA.split(", ")}

#: Event times with a coefficient; group k + 1 is the k-th of them.
TIMES = [k for k in range(-LEADS, LAGS + 1) if k != REFERENCE]


def event_sums(panel: DataFrame, schedule: DataFrame) -> DataFrame:
    """Moments by cluster, month and groups: ever treated, and the event time but for the reference; stored."""
    sums = cell_sums(rows_of(event_cells(panel, schedule), "month", "ever", "k"), ["month", "ever", "k"])
    flags = [F.col("ever"), *(F.when(F.col("k") == k, 1).otherwise(0) for k in TIMES)]
    return stored(sums.withColumn("groups", groups_of(*flags)), "event-sums")


def event_moments(panel: DataFrame, schedule: DataFrame) -> DataFrame:
    """(i, j, s00, s01, s10, s11): the event study's moments with the months swept out, by pairs of groups; j = -1 is the outcome (s00, s10)."""
    pairs, sides = swept.moments(swept.cell_table(event_sums(panel, schedule)))
    none = F.lit(None).cast("double")
    return pairs.unionByName(sides.select("i", F.lit(-1).alias("j"), F.col("r0").alias("s00"), none.alias("s01"), F.col("r1").alias("s10"), none.alias("s11")))


def event_study(panel: DataFrame, schedule: DataFrame) -> DataFrame:
    """Slope shifts by months since treatment, against the month before it, with joint tests of leads and of lags on every row.

    Event times without rows are absent, not zero. No rows at all where the design isn't identified.
    """
    sums = event_sums(panel, schedule)
    cells = swept.cell_table(sums)
    targets = [*range(1, len(TIMES) + 1)]
    system = swept.solved(sums, cells, len(TIMES) + 1, targets)
    per = swept.influence(sums, swept.cell_lines(cells, system, len(targets)), len(targets))
    t = len(targets)
    meat = per.agg(F.array(*(F.sum(F.col(f"z{min(i, j)}") * F.col(f"z{max(i, j)}")) for i in range(t) for j in range(t))).alias("meat"))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                scale = r["clusters"] / (r["clusters"] - 1) * (r["n"] - 1) / (r["n"] - 2 * (r["months"] + len(r["present"])))
                cov = scale * np.array(r["meat"], dtype=float).reshape(t, t)
                held = [k for k in range(t) if k + 1 in r["present"]]
                beta = {k: r["beta"][2 * (k + 1) + 1] for k in held}

                def joint(ks: list[int]) -> tuple[float | None, int, float | None]:
                    if not ks:
                        return None, 0, None
                    b = np.array([beta[k] for k in ks])
                    w = float(b @ np.linalg.pinv(cov[np.ix_(ks, ks)]) @ b)
                    return w, len(ks), chi2_tail(w, len(ks))

                pre, post = joint([k for k in held if TIMES[k] < REFERENCE]), joint([k for k in held if TIMES[k] > REFERENCE])
                for k in held:
                    se = math.sqrt(max(0.0, cov[k, k]))
                    out.append((TIMES[k], beta[k], se, beta[k] - 1.96 * se, beta[k] + 1.96 * se, *pre, *post, r["n"], r["clusters"]))
            columns = [*zip(*out, strict=True)] or [[]] * len(EVENT_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(columns, EVENT_TYPES.values(), strict=True)], [*EVENT_TYPES])

    found = system.where("ok").crossJoin(meat).where("exists(present, g -> g > 0)")
    return found.mapInArrow(report, EVENT_SCHEMA)
