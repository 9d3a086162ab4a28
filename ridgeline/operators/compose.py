"""Composition weights, decomposition, verdicts and the escalation rule: small tables, still columns."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.scalars import sign_flip, utc_date


def category_mix(panel: DataFrame, year: int | None = None) -> DataFrame:
    """(category, weight): shares of distinct contracts, of those closing in the year if one is given; null counts as unknown."""
    rows = panel if year is None else panel.where(F.year(utc_date(F.col("close_t"))) == year)
    counts = rows.select("ticker", "category").distinct().groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))
    return counts.select("category", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("weight"))


def weighted(fits: DataFrame, frozen: DataFrame, window: DataFrame) -> DataFrame:
    """Fits with their frozen and window weights, zero where missing. Categories without a fit contribute nothing."""
    out = fits.join(frozen.withColumnRenamed("weight", "w_bar"), "category", "left").join(window.withColumnRenamed("weight", "w_now"), "category", "left")
    return out.withColumns({"w_bar": F.coalesce("w_bar", F.lit(0.0)), "w_now": F.coalesce("w_now", F.lit(0.0))})


def decompose(fits: DataFrame, frozen: DataFrame, window: DataFrame, delta: str) -> DataFrame:
    """(within, between, aggregate) of the shift in the weighted slope; zeros if there are no fits."""
    rows = weighted(fits, frozen, window)
    within = F.coalesce(F.sum(F.col("w_bar") * F.col(delta)), F.lit(0.0))
    between = F.coalesce(F.sum((F.col("w_now") - F.col("w_bar")) * F.col("psi_c")), F.lit(0.0))
    return rows.agg(within.alias("within"), between.alias("between"), (within + between).alias("aggregate"))


def delta_bar(fits: DataFrame, frozen: DataFrame, delta: str, by: list[str] | None = None) -> DataFrame:
    """(delta_bar, ci_lo, ci_hi): weighted shift with a normal interval, categories independent; nulls if none has weight."""
    rows = fits.join(frozen.where("weight <> 0"), "category")
    bar, se = F.sum(F.col("weight") * F.col(delta)), F.sqrt(F.sum(F.col("weight") ** 2 * F.col(f"{delta}_se") ** 2))
    return rows.groupBy(*(by or [])).agg(bar.alias("delta_bar"), (bar - 1.96 * se).alias("ci_lo"), (bar + 1.96 * se).alias("ci_hi"))


def horizon_buckets(panel: DataFrame, fits: DataFrame, frozen: DataFrame) -> DataFrame:
    """(lookback_day, n, delta_bar_fee, delta_bar_pub, n_categories_fit) for every day of the panel; null and 0 where nothing fits.

    fits: shifts by lookback_day and category. A day whose fitted categories have no frozen weight has null shifts.
    """
    out = panel.groupBy("lookback_day").agg(F.count("*").alias("n")).join(fits.groupBy("lookback_day").agg(F.count("*").alias("fits")), "lookback_day", "left")
    for k in ("fee", "pub"):
        bar = delta_bar(fits, frozen, f"delta_{k}", ["lookback_day"]).select("lookback_day", F.col("delta_bar").alias(f"delta_bar_{k}"))
        out = out.join(bar, "lookback_day", "left")
    return out.select("lookback_day", "n", "delta_bar_fee", "delta_bar_pub", F.coalesce("fits", F.lit(0)).alias("n_categories_fit"))


def verdict(estimate: Column, lo: Column, hi: Column, psi: Column) -> Column:
    """persisted, vanished, attenuated, reversed or indeterminate, from where the interval lies to 0 and to -psi; null: not identified."""
    gone = -psi
    off_zero, off_gone = (lo > 0) | (hi < 0), ~((lo <= gone) & (gone <= hi))
    between = (estimate > F.least(gone, F.lit(0.0))) & (estimate < F.greatest(gone, F.lit(0.0)))
    turned = (psi + estimate < 0) & ((psi + lo > 0) | (psi + hi < 0))
    return (
        F.when(estimate.isNull() | lo.isNull() | hi.isNull() | psi.isNull(), "not identified")
        .when(~off_zero & off_gone, "persisted")
        .when(off_zero & ~off_gone, "vanished")
        .when(~off_zero & ~off_gone, "indeterminate")
        .when(between, "attenuated")
        .when(turned, "reversed")
        .otherwise("indeterminate")
    )


def did_verdict(fits: DataFrame, psi: DataFrame) -> DataFrame:
    """The verdict's vocabulary on difference-in-differences fits, with eliminated for vanished; psi has one row."""
    word = verdict(F.col("delta_did"), F.col("ci_lo"), F.col("ci_hi"), F.col("psi"))
    return fits.crossJoin(F.broadcast(psi)).select("fit", F.when(word == "vanished", "eliminated").otherwise(word).alias("verdict"))


def rejects_zero(lo: Column, hi: Column) -> Column:
    return F.coalesce((lo > 0) | (hi < 0), F.lit(False))


def escalation(did: DataFrame, publication: DataFrame, margins: DataFrame, ribbon: DataFrame) -> DataFrame:
    """(escalate, triggers): all conditions that hold. A fit that isn't identified can't reject.

    did: rows of both fits; publication: ci_lo, ci_hi; margins: margin_a, margin_c; ribbon: sign_flips. One row each but for did.
    """
    both = did.agg((F.count_if(rejects_zero(F.col("ci_lo"), F.col("ci_hi"))) == 2).alias("did"))
    one = both.crossJoin(publication.agg(F.coalesce(F.first(rejects_zero(F.col("ci_lo"), F.col("ci_hi"))), F.lit(False)).alias("pub")))
    one = one.crossJoin(margins.agg(F.coalesce(F.first(sign_flip(F.col("margin_a"), F.col("margin_c"))), F.lit(False)).alias("flip")))
    one = one.crossJoin(ribbon.agg(F.coalesce(~F.first("sign_flips"), F.lit(False)).alias("firm")))
    fired = F.array_compact(
        F.array(
            F.when(F.col("did"), "did_fee_significant_in_both_fits"),
            F.when(F.col("pub"), "delta_bar_pub_significant"),
            F.when(F.col("flip") & F.col("firm"), "maker_margin_sign_flip_survives_ribbon"),
        )
    )
    return one.select((F.size(fired) > 0).alias("escalate"), fired.alias("triggers"))


def venue(escalated: DataFrame) -> DataFrame:
    return escalated.select(F.when(F.col("escalate"), "standalone_paper").otherwise("replication_note").alias("venue"), "escalate")


def year_verdict(psi: Column, se: Column, target: Column) -> Column:
    """confirmed if the target lies in the interval; partially if only the sign agrees; insufficient without a fit."""
    inside = (target >= psi - 1.96 * se) & (target <= psi + 1.96 * se)
    return F.when(psi.isNull() | se.isNull(), "insufficient").when(inside, "confirmed").when(F.signum(psi) == F.signum(target), "partially").otherwise("diverged")


def write_lock(report: DataFrame, path: str) -> None:
    """Writes the one-row report once, stamped; a second write is an error."""
    report.withColumn("locked_ts", F.current_timestamp()).write.mode("errorifexists").parquet(path)


def load_lock(spark, path: str) -> DataFrame:
    """The locked report; an error if there is none or it was never locked. Later stages read only through this gate."""
    report = spark.read.parquet(path)
    if "locked_ts" not in report.columns or report.where("locked_ts is not null").isEmpty():
        raise ValueError("the report isn't locked")
    return report


def write_mix(mix: DataFrame, path: str) -> None:
    mix.withColumn("computed_ts", F.current_timestamp()).write.mode("overwrite").parquet(path)


def load_mix(spark, path: str) -> DataFrame:
    """The frozen mix; an error where it is missing or empty, for it is never computed anew from later data."""
    try:
        mix = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no frozen mix at {path}") from e
    if mix.isEmpty():
        raise ValueError("the frozen mix is empty")
    return mix.select("category", "weight")


def invariants(fits: DataFrame, parts: DataFrame, escalated: DataFrame) -> DataFrame:
    """(name, ok, detail): both fits describe one sample, parts add up, and triggers are there exactly if it escalates."""
    a = fits.agg((F.count_distinct(F.col("n_treated")) <= 1).alias("ok"), F.concat_ws(",", F.sort_array(F.collect_set(F.col("n_treated").cast("string")))).alias("detail"))
    b = parts.select((F.abs(F.col("within") + F.col("between") - F.col("aggregate")) < 1e-9).alias("ok"), F.lit("within + between").alias("detail"))
    c = escalated.select((F.col("escalate") == (F.size("triggers") > 0)).alias("ok"), F.array_join("triggers", ",").alias("detail"))
    named = [x.select(F.lit(n).alias("name"), "ok", "detail") for n, x in (("same_treated_sample", a), ("decomposition_adds_up", b), ("triggers_match", c))]
    return named[0].unionByName(named[1]).unionByName(named[2])
