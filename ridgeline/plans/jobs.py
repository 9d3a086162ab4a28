"""Whole reports: the result tables of each stage by name, lazily, from one set of domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators import compose, panel, profiles, regression, returns, tape, universe
from ridgeline.plans import registry
from ridgeline.plans.registry import Tables
from ridgeline.sources import adapters as A


def build(d: Tables) -> dict[str, DataFrame]:
    """Universe, panels and reconciliation, with the skip rule and the dollar reading of the volume filter as sensitivities."""
    dollar = universe.reasons(d.markets, d.quotes, tape.dollar_volume(d.raw_fills), window="r1")
    return {
        "summary": universe.summary(d.reasons),
        "exclusions": universe.exclusion_log(d.reasons).unionByName(universe.exclusion_log(dollar, universe.DOLLAR_LABEL)),
        "panel": d.panel,
        "skip_panel": panel.skip_panel(d.scope_markets, d.raw_fills),
        "reconciliation": profiles.reconcile(d.panel, d.doubled, registry.TARGETS),
        "mix": d.frozen,
        "dollar_summary": universe.summary(dollar),
    }


def first_report(d: Tables) -> dict[str, DataFrame]:
    """Is price calibrated, and who earns, in the first window."""
    first = d.panel.where("in_r1_window")
    return {
        "line": regression.mz(first, []),
        "by_year": registry.i3_mz_by_year(d),
        "by_category": regression.mz(first.where("category is not null"), ["category"]),
        "win_rate": returns.win_rate_by_band(panel.doubled(first)),
        "returns": returns.returns_by_band(first, d.schedule),
        "split": returns.maker_taker_split(panel.doubled(first), d.schedule),
        "population": profiles.population_by_era(d.fills, ["taker_side", "count_fp"]),
        "divergence": registry.i21_divergence_table(d),
    }


def second_report(d: Tables) -> dict[str, DataFrame]:
    """Did it change at the two boundaries. Below 50 events, errors and intervals are the wild bootstrap's throughout."""
    word = compose.verdict(F.col("delta_bar"), F.col("ci_lo"), F.col("ci_hi"), F.col("psi"))
    return {
        "fits": d.intervals,
        "fee_parts": compose.decompose(d.intervals, d.frozen, d.weights, "delta_fee"),
        "publication_parts": compose.decompose(d.intervals, d.frozen, d.weights, "delta_pub"),
        "fee_shift": compose.delta_bar(d.intervals, d.frozen, "delta_fee"),
        "publication_shift": d.publication_bar,
        "verdict": d.publication_bar.crossJoin(F.broadcast(d.first_psi)).select("delta_bar", "ci_lo", "ci_hi", "psi", word.alias("verdict")),
        "horizons": regression.boundary_intervals(d.stored.where("category is not null"), ["lookback_day", "category"], A.WINDOW_END, A.PUBLICATION),
        "did": d.did,
    }


def escalation_report(d: Tables) -> dict[str, DataFrame]:
    """Fee layers, ribbon, and what they and the second report ask for."""
    return {"margins": d.margins, "ribbon": d.ribbon, "escalation": d.escalated, "venue": compose.venue(d.escalated)}
