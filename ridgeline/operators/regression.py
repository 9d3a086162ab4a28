"""Cluster-robust regressions from grouped sufficient statistics.

Every fit explains u = 100 (y - p) by x = 100 p, with a level and a slope for each cell of a design; so per-cell moments give the
coefficients, and per-cluster sums of scores the sandwich. Rows never leave the cluster: one or two aggregations serve all strata.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.panel import cluster_key
from ridgeline.operators.stages import stored


def rows_of(panel: DataFrame, *keep: str) -> DataFrame:
    """Cluster, x = 100 p and u = 100 (y - p), with the columns to keep."""
    x, u = F.col("p") * 100, (F.col("y") - F.col("p")) * 100
    return panel.select(*keep, cluster_key().alias("cluster"), x.alias("x"), u.alias("u"))


def moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, spread of x, and the line through the rows of each group; no line without price variance."""
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum("u").alias("su"), F.sum(F.col("x") * F.col("u")).alias("sxu"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    return line(sums)


def line(sums: DataFrame) -> DataFrame:
    """Adds det, slope b and level a to sums; null without price variance."""
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(F.col("hi") > F.col("lo"), (F.col("n") * F.col("sxu") - F.col("sx") * F.col("su")) / det)
    return sums.withColumns({"det": det, "b": slope}).withColumn("a", (F.col("su") - F.col("b") * F.col("sx")) / F.col("n"))


def mz(panel: DataFrame, by: list[str]) -> DataFrame:
    """by, n, n_clusters, alpha, alpha_se, psi, psi_se, f_stat: one event-clustered fit for each group, all in one job.

    Groups that don't support a fit (two rows or fewer, one cluster, one price) are left out.
    """
    keyed = rows_of(panel.withColumn("_all", F.lit(0)), *by) if by else rows_of(panel)
    keyed = keyed.withColumn("_g", F.struct(*by) if by else F.struct(F.lit(0).alias("one")))
    fit = moments(keyed, ["_g"])
    small = fit.select("_g", "n", "sx", "sxx", "det", "a", "b").where("n > 2 and b is not null")
    r = F.col("u") - F.col("a") - F.col("b") * F.col("x")
    scores = keyed.join(small, "_g").groupBy("_g", "cluster").agg(F.sum(r).alias("s0"), F.sum(r * F.col("x")).alias("s1"))
    meat = scores.groupBy("_g").agg(F.count("*").alias("g"), F.sum(F.col("s0") ** 2).alias("m00"), F.sum(F.col("s0") * F.col("s1")).alias("m01"), F.sum(F.col("s1") ** 2).alias("m11")).where("g > 1")
    both = small.join(meat, "_g")
    n, sx, sxx, det, m00, m01, m11 = (F.col(c) for c in ("n", "sx", "sxx", "det", "m00", "m01", "m11"))
    c = F.col("g") / (F.col("g") - 1) * (n - 1) / (n - 2)
    # inverse of X'X is [[sxx, -sx], [-sx, n]] / det
    v_a = c * (sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11) / (det * det)
    v_b = c * (sx * sx * m00 - 2 * sx * n * m01 + n * n * m11) / (det * det)
    # rounding can leave a variance that is zero a little below it
    se_a, se_b = F.sqrt(F.greatest(v_a, F.lit(0.0))), F.sqrt(F.greatest(v_b, F.lit(0.0)))
    out = both.select(*[F.col(f"_g.{k}").alias(k) for k in by], "n", F.col("g").alias("n_clusters"), F.col("a").alias("alpha"), se_a.alias("alpha_se"), F.col("b").alias("psi"), se_b.alias("psi_se"))
    return out.withColumn("f_stat", F.when(F.col("psi_se") > 0, (F.col("psi") / F.col("psi_se")) ** 2))


def two_way_check(panel: DataFrame) -> DataFrame:
    """(one_way, two_way, equal): slope variance sums by event, and by event and contract less their intersection."""
    rows = rows_of(panel, "ticker")
    fit = moments(rows, []).select("a", "b", "sx", "n", "det")
    r = F.col("u") - F.col("a") - F.col("b") * F.col("x")
    scored = rows.crossJoin(F.broadcast(fit)).withColumn("s", (F.col("n") * F.col("x") - F.col("sx")) * r / F.col("det"))

    def part(keys: list[str], name: str) -> DataFrame:
        return scored.groupBy(*keys).agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") ** 2).alias(name))

    three = part(["cluster"], "v_event").crossJoin(part(["ticker"], "v_contract")).crossJoin(part(["cluster", "ticker"], "v_both"))
    two = F.col("v_event") + F.col("v_contract") - F.col("v_both")
    return three.select(F.col("v_event").alias("one_way"), two.alias("two_way"), (F.abs(two - F.col("v_event")) <= 1e-6 * F.col("v_event")).alias("equal"))


def regime(fee: int, publication: int) -> Column:
    return F.when(F.col("close_t") < fee, "pre").when(F.col("close_t") < publication, "mid").otherwise("post")


#: Below so many clusters the sandwich isn't trusted, and wild cluster weights give standard error and interval.
WILD_BELOW = 50


def boundary_sums(panel: DataFrame, by: list[str], fee: int, publication: int) -> DataFrame:
    """Moments by _g, regime and cluster."""
    keyed = rows_of(panel.withColumn("regime", regime(fee, publication)), *by, "regime")
    return cell_sums(keyed.withColumn("_g", F.struct(*by) if by else F.struct(F.lit(0).alias("one"))), ["_g", "regime"])


def boundary_parts(sums: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of the three regimes (wide, by _g), and influence numbers by _g and cluster, from boundary_sums().

    pre, mid, post: influence on the regime's slope, with the fit's residuals. z_fee, z_pub: influence on the shift, with residuals of the
    fit in which that shift is zero, so that the two regimes beside the boundary have levels of their own and a common slope.
    """
    cells = line(sums.groupBy("_g", "regime").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sxx", "su", "sxu")], F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    cells = cells.where("b is not null").select("_g", "regime", "det", "a", "b", F.col("n").alias("all_n"), F.col("sx").alias("all_sx"))

    def of(name: str, k: str):
        return F.max(F.when(F.col("regime") == k, F.col(name)))

    def common(k: str, j: str):
        spread = F.when(F.col("regime").isin(k, j), F.col("det") / F.col("all_n"))
        return F.sum(F.col("b") * spread) / F.sum(spread)

    lines = cells.groupBy("_g").agg(F.sum("all_n").alias("n"), F.count("*").alias("k"), of("a", "pre").alias("alpha_c"), of("b", "pre").alias("pre"), of("b", "mid").alias("mid"), of("b", "post").alias("post"), common("pre", "mid").alias("null_fee"), common("mid", "post").alias("null_pub"))

    def influence(slope: Column):
        # the line with that slope through the cell's means; (n x - sx) / det weighs its residuals
        level = F.col("a") + (F.col("b") - slope) * F.col("all_sx") / F.col("all_n")
        s0 = F.col("su") - level * F.col("n") - slope * F.col("sx")
        s1 = F.col("sxu") - level * F.col("sx") - slope * F.col("sxx")
        return (F.col("all_n") * s1 - F.col("all_sx") * s0) / F.col("det")

    def shift(slope: str, below: str, above: str):
        z = influence(F.col(slope))
        return F.sum(F.when(F.col("regime") == above, z).when(F.col("regime") == below, -z).otherwise(0.0))

    met = sums.join(cells.join(lines.select("_g", "null_fee", "null_pub"), "_g"), ["_g", "regime"])
    own = [F.sum(F.when(F.col("regime") == k, influence(F.col("b"))).otherwise(0.0)).alias(k) for k in ("pre", "mid", "post")]
    return lines, met.groupBy("_g", "cluster").agg(*own, shift("null_fee", "pre", "mid").alias("z_fee"), shift("null_pub", "mid", "post").alias("z_pub"))


def sandwich_shifts(lines: DataFrame, per: DataFrame) -> DataFrame:
    """_g, n, n_clusters, alpha_c, psi_c, and each shift with its clustered error; from boundary_parts()."""
    fee_, pub = F.col("mid") - F.col("pre"), F.col("post") - F.col("mid")
    meat = per.groupBy("_g").agg(F.count("*").alias("g"), F.sum(fee_**2).alias("vf"), F.sum(pub**2).alias("vp")).where("g > 1")
    both = lines.where("k = 3 and n > 6").join(meat, "_g")
    c = F.col("g") / (F.col("g") - 1) * (F.col("n") - 1) / (F.col("n") - 6)
    return both.select(
        "_g",
        "n",
        F.col("g").alias("n_clusters"),
        "alpha_c",
        F.col("pre").alias("psi_c"),
        fee_.alias("delta_fee"),
        F.sqrt(c * F.col("vf")).alias("delta_fee_se"),
        pub.alias("delta_pub"),
        F.sqrt(c * F.col("vp")).alias("delta_pub_se"),
    )


def boundary_shifts(panel: DataFrame, by: list[str], fee: int, publication: int) -> DataFrame:
    """by, n, n_clusters, alpha_c, psi_c, delta_fee, delta_fee_se, delta_pub, delta_pub_se, whose errors are always the sandwich's.

    A level and a slope for each of three regimes is the saturated form of the six-parameter design: shifts are differences of the
    regimes' slopes. Scores of all regimes add up within a cluster, as an event may span a boundary. A group that lacks a regime,
    or prices that differ within one, isn't identified and is left out.
    """
    out = sandwich_shifts(*boundary_parts(stored(boundary_sums(panel, by, fee, publication), "boundary-sums")))
    return out.select(*[F.col(f"_g.{k}").alias(k) for k in by], *out.columns[1:])


def boundary_intervals(panel: DataFrame, by: list[str], fee: int, publication: int, reps: int = 999, seed: int = 0, below: int = WILD_BELOW) -> DataFrame:
    """boundary_shifts() with an interval of each shift (delta_fee_lo, ...) and used_wild.

    A group of fewer than `below` clusters has error and half width from wild cluster weights with the null of that shift imposed, around
    the estimate; the others from the sandwich. The moments are stored, so that the panel is computed once.
    """
    lines, per = boundary_parts(stored(boundary_sums(panel, by, fee, publication), "boundary-sums"))
    out = sandwich_shifts(lines, per)
    few = out.where(F.col("n_clusters") < below).select("_g")
    drawn = sign_replicates(per.join(few, "_g", "left_semi"), ["z_fee", "z_pub"], reps, seed).drop("reps").withColumn("used_wild", F.lit(True))
    out = out.join(drawn, "_g", "left").withColumn("used_wild", F.coalesce("used_wild", F.lit(False)))
    for k in ("fee", "pub"):
        se = F.when(F.col("used_wild"), F.col(f"z_{k}_se")).otherwise(F.col(f"delta_{k}_se"))
        half = F.when(F.col("used_wild"), F.col(f"z_{k}_half")).otherwise(1.96 * F.col(f"delta_{k}_se"))
        out = out.withColumns({f"delta_{k}_se": se, f"delta_{k}_lo": F.col(f"delta_{k}") - half, f"delta_{k}_hi": F.col(f"delta_{k}") + half})
    names = ["n", "n_clusters", "alpha_c", "psi_c", *[f"delta_{k}{e}" for k in ("fee", "pub") for e in ("", "_se", "_lo", "_hi")], "used_wild"]
    return out.select(*[F.col(f"_g.{k}").alias(k) for k in by], *names)


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared with df degrees of freedom > x), by the regularised incomplete gamma function."""
    if df <= 0 or x <= 0:
        return 1.0 if df > 0 else float("nan")
    a, z = df / 2, x / 2
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * total:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c, d = z + 1 - a, 1e300, 1 / (z + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def cell_sums(rows: DataFrame, cells: list[str]) -> DataFrame:
    """Moments of rows (cluster, x, u, cells) by cluster and cell: all that any fit on these cells needs."""
    x, u = F.col("x"), F.col("u")
    return rows.groupBy("cluster", *cells).agg(
        F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum(x * x).alias("sxx"), F.sum("u").alias("su"), F.sum(x * u).alias("sxu"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )


#: Replicates that one word of signs serves, and words in a digest.
BITS, WORDS = 32, 4


def sign_replicates(per: DataFrame, names: list[str], reps: int, seed: int) -> DataFrame:
    """_g, reps, and {name}_se and {name}_half: spread of sums over clusters of a random sign times each cluster's number.

    per: _g, cluster, names. Signs are the bits of MD5 digests of seed, digest number and cluster, so any engine draws the same, on any
    partitioning. A word of bits serves BITS replicates, whose sums are one aggregation's columns: a cluster is a row for each word, not for each replicate.
    """
    drawn = per.withColumn("word", F.explode(F.sequence(F.lit(0), F.lit(-(-reps // BITS) - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.floor(F.col("word") / WORDS), "cluster"))
    drawn = drawn.withColumn("bits", F.conv(F.substr(digest, F.col("word") % WORDS * 8 + 1, F.lit(8)), 16, 10).cast("long"))

    def spread(z: str) -> list[Column]:
        return [F.sum(F.when(F.col("bits").bitwiseAND(1 << k) == 0, F.col(z)).otherwise(-F.col(z))) for k in range(BITS)]

    sums = drawn.groupBy("_g", "word").agg(*(F.array(*spread(z)).alias(z) for z in names))
    each = sums.select("_g", "word", F.posexplode(F.arrays_zip(*names)).alias("bit", "z")).where(F.col("word") * BITS + F.col("bit") < reps)
    each = each.select("_g", *(F.col(f"z.{z}").alias(z) for z in names))
    ends = [F.percentile(z, F.array(F.lit(0.025), F.lit(0.975))) for z in names]
    out = [c for z, e in zip(names, ends, strict=True) for c in (F.stddev_samp(z).alias(f"{z}_se"), ((e[1] - e[0]) / 2).alias(f"{z}_half"))]
    return each.groupBy("_g").agg(F.count("*").alias("reps"), *out)
