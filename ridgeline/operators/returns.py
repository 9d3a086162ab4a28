"""Returns by band, maker and taker splits, three-layer maker margins, and the fee ribbon."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.scalars import gross_return, net_return, price_band, utc_date
from ridgeline.operators.fees import fee_of, lookup
from ridgeline.operators.panel import role

COUNTERFACTUAL_DATE = "1999-06-01"


def win_rate_by_band(doubled: DataFrame) -> DataFrame:
    """(band, n, win_rate, mean_price); prices are added up in whole cents, so that the mean doesn't depend on the order of rows."""
    cents = F.sum(F.round(F.col("p") * 100).cast("long"))
    return doubled.groupBy(price_band(F.col("p")).alias("band")).agg(
        F.count("*").alias("n"), (F.sum(F.col("y").cast("long")) / F.count("*")).alias("win_rate"), (cents / (F.count("*") * 100)).alias("mean_price")
    )


def with_taker_fee(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """Adds the taker's order fee at the close date; null where size or schedule is missing."""
    asked = rows.withColumns({"role": F.lit("taker"), "as_of": utc_date(F.col("close_t"))})
    sized = F.when(F.col("count_fp") > 0, F.col("count_fp"))
    return lookup(asked, schedule).withColumn("fee", fee_of(sized, F.col("p"))).drop("role", "as_of", "form", "rate", "scope_kind")


def returns_by_band(yes_only: DataFrame, schedule: DataFrame) -> DataFrame:
    """Gross and net-of-taker-fee mean return of buying at every panel price; rows without size or fee count as excluded."""
    rows = with_taker_fee(yes_only, schedule)
    return rows.groupBy(price_band(F.col("p")).alias("band")).agg(
        F.count("*").alias("n"),
        F.avg(gross_return(F.col("y"), F.col("p"))).alias("mean_gross"),
        F.avg(net_return(F.col("y"), F.col("p"), F.col("fee"), F.col("count_fp"))).alias("mean_net"),
        F.count_if(F.col("fee").isNull()).alias("excluded"),
    )


def maker_taker_split(doubled: DataFrame, schedule: DataFrame) -> DataFrame:
    """Makers gross, takers net, and the makers' share: one row for each band and a total (band 'all')."""
    rows = with_taker_fee(doubled.withColumn("who", role()).where("who is not null"), schedule)
    maker, taker = F.col("who") == "maker", F.col("who") == "taker"
    gross = gross_return(F.col("y"), F.col("p"))
    net = net_return(F.col("y"), F.col("p"), F.col("fee"), F.col("count_fp"))
    bands = rows.rollup(price_band(F.col("p")).alias("band")).agg(
        F.avg(F.when(maker, gross)).alias("maker_return"),
        F.avg(F.when(taker, net)).alias("taker_return"),
        F.avg(F.when(maker & (F.col("p") >= 0.5), gross)).alias("maker_return_50c"),
        F.count_if(maker).alias("n_maker"),
        F.count_if(taker & F.col("fee").isNotNull()).alias("n_taker"),
        F.count_if(taker & F.col("fee").isNull()).alias("excluded"),
        F.avg(F.when(maker, 1.0).otherwise(0.0)).alias("maker_share"),
    )
    return bands.withColumn("band", F.coalesce("band", F.lit("all")))


def sides(fills: DataFrame, markets: DataFrame) -> DataFrame:
    """Both sides of every usable fill of resolved contracts that are priced at 50 cents or more."""
    rows = fills.join(markets.select("ticker", "series_ticker", "result").where("result in ('yes', 'no')"), "ticker")
    rows = rows.where("taker_side in ('yes', 'no') and price > 0 and price < 1 and count_fp > 0 and t is not null")
    won = F.when(F.col("result") == "yes", 1.0).otherwise(0.0)

    def side(name: str, p, y):
        return F.struct(p.alias("p"), y.alias("y"), F.when(F.col("taker_side") == name, "taker").otherwise("maker").alias("role"))

    both = F.array(side("yes", F.col("price"), won), side("no", 1 - F.col("price"), 1 - won))
    out = rows.select("ticker", "series_ticker", "count_fp", utc_date(F.col("t")).alias("traded"), F.explode(both).alias("s"))
    return out.select("ticker", "series_ticker", "count_fp", "traded", "s.*").where("p >= 0.5")


def layer(rows: DataFrame, schedule: DataFrame, name: str, as_of) -> DataFrame:
    found = lookup(rows.withColumn("as_of", as_of), schedule).drop("as_of", "scope_kind")
    return found.withColumnsRenamed({"form": f"form_{name}", "rate": f"rate_{name}"})


def side_cells(fills: DataFrame, markets: DataFrame, schedule: DataFrame) -> DataFrame:
    """Sides counted (n) by all that their returns depend on: contract count, price, outcome, role, and the fees of the day (b) and of a fixed date (c).

    Margins and ribbon need no more, so a report that has both reads its tape once.
    """
    rows = layer(sides(fills, markets), schedule, "b", F.col("traded"))
    rows = layer(rows, schedule, "c", F.lit(COUNTERFACTUAL_DATE).cast("date"))
    return rows.groupBy("count_fp", "p", "y", "role", "form_b", "rate_b", "form_c", "rate_c").agg(F.count("*").alias("n"))


def margins_of(cells: DataFrame) -> DataFrame:
    """One row: the makers' mean return less the takers', gross (a), at the fees of the day (b), at those of a fixed date (c)."""
    gross = gross_return(F.col("y"), F.col("p"))
    nets = {"a": gross} | {
        x: net_return(F.col("y"), F.col("p"), F.when(F.col(f"form_{x}").isNotNull(), fee_from(f"form_{x}", f"rate_{x}")), F.col("count_fp")) for x in "bc"
    }
    aggs = []
    for x, value in nets.items():
        for who in ("maker", "taker"):
            mine = F.when(F.col("role") == who, value)
            n = F.sum(F.when(mine.isNotNull(), F.col("n")))
            aggs += [(F.sum(mine * F.col("n")) / n).alias(f"{who}_{x}"), F.coalesce(n, F.lit(0)).alias(f"n_{who}_{x}")]
        if x != "a":
            aggs.append(F.coalesce(F.sum(F.when(value.isNull(), F.col("n"))), F.lit(0)).alias(f"gaps_{x}"))
    wide = cells.agg(*aggs)
    return wide.select(*[(F.col(f"maker_{x}") - F.col(f"taker_{x}")).alias(f"margin_{x}") for x in nets], *[c for c in wide.columns if c[:2] == "n_" or c[:4] == "gaps"])


def maker_margins(fills: DataFrame, markets: DataFrame, schedule: DataFrame) -> DataFrame:
    return margins_of(side_cells(fills, markets, schedule))


def fee_from(form: str, rate: str):
    from ridgeline.functions.scalars import order_fee

    return order_fee(F.col(form), F.col(rate), F.col("count_fp"), F.col("p"))


def ribbon_of(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """(grid_rate, margin): the layer-b margin with every charging maker rate replaced, for all grid rates in one pass over side_cells().

    So the grid multiplies cells, not fills. A missing margin counts as zero.
    """
    met = cells.where("form_b is not null").crossJoin(F.broadcast(grid))
    charging = (F.col("role") == "maker") & (F.col("form_b") != "none") & (F.col("rate_b") != 0)
    met = met.withColumn("rate_b", F.when(charging, F.col("grid_rate")).otherwise(F.col("rate_b")))
    net = net_return(F.col("y"), F.col("p"), fee_from("form_b", "rate_b"), F.col("count_fp")) * F.col("n")

    def mean(who: str):
        mine = F.col("role") == who
        return F.sum(F.when(mine, net)) / F.sum(F.when(mine, F.col("n")))

    return met.groupBy("grid_rate").agg(F.coalesce(mean("maker") - mean("taker"), F.lit(0.0)).alias("margin"))


def ribbon(fills: DataFrame, markets: DataFrame, schedule: DataFrame, grid: DataFrame) -> DataFrame:
    return ribbon_of(side_cells(fills, markets, schedule), grid)


def ribbon_summary(points: DataFrame) -> DataFrame:
    """(break_even, sign_flips): the first crossing of zero by linear interpolation; exactly zero counts as not positive."""
    order = Window.orderBy("grid_rate")  # a grid is a dozen rows
    nxt = points.select("grid_rate", "margin", F.lead("grid_rate").over(order).alias("r1"), F.lead("margin").over(order).alias("m1"))
    crosses = ((F.col("margin") > 0) != (F.col("m1") > 0)) & (F.col("m1") != F.col("margin"))
    at = F.col("grid_rate") - F.col("margin") * (F.col("r1") - F.col("grid_rate")) / (F.col("m1") - F.col("margin"))
    return nxt.agg(F.min_by(F.when(crosses, at), F.when(crosses, F.col("grid_rate"))).alias("break_even"), (F.count_distinct(F.col("margin") > 0) > 1).alias("sign_flips"))


def tail_loss_by_month(yes_only: DataFrame, schedule: DataFrame, month) -> DataFrame:
    """(month, n, loss_rate): post-fee loss rate of contracts at ten cents and less."""
    rows = with_taker_fee(yes_only.where("p <= 0.1000001"), schedule)
    net = net_return(F.col("y"), F.col("p"), F.col("fee"), F.col("count_fp"))
    return rows.withColumn("net", net).groupBy(month.alias("month")).agg(F.count("net").alias("n"), F.avg(F.when(F.col("net") < 0, 1.0).when(F.col("net").isNotNull(), 0.0)).alias("loss_rate"))
