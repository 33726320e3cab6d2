"""Trading costs, exposures by regime, metric rows with costs, and bands over seeded runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trades(weights: DataFrame) -> DataFrame:
    """(strategy, decision, line, trade) of weights (strategy, decision, line, weight): each line's weight less that of the
    strategy's decision before, from nothing at the first one. A line that a decision doesn't name has weight 0 there, so
    it is sold; lines without a trade are left out. Each weight counts once for its decision and once against the next."""
    calendar = weights.select("strategy", "decision").distinct()
    following = calendar.withColumn("__next", F.lead("decision").over(Window.partitionBy("strategy").orderBy("decision")))
    both = weights.join(following, ["strategy", "decision"]).select(
        "strategy", "line", F.inline(F.array(F.struct("decision", F.col("weight").alias("w")), F.struct(F.col("__next").alias("decision"), (-F.col("weight")).alias("w"))))
    )
    return both.where("decision is not null").groupBy("strategy", "decision", "line").agg(F.sum("w").alias("trade")).where("trade <> 0")


def trade_costs(weights: DataFrame, vols: DataFrame, bps: float, coefficient: float, factors: tuple[float, ...] = (1.0,), cash: str | None = None) -> DataFrame:
    """(strategy, decision, factor, turnover, cost): half the absolute trades of a decision, and their cost: of each trade a
    fixed part of bps and a part in proportion to the line's volatility, vols (decision, line, vol), both times the factor.
    Lines without a volatility cost the fixed part; trades of the line `cash` cost nothing and count as turnover."""
    size = F.abs("trade")
    rate = F.lit(bps / 1e4) + coefficient * F.coalesce(F.col("vol"), F.lit(0.0))
    due = F.when(F.col("line") == cash, 0.0).otherwise(size * rate) if cash is not None else size * rate
    one = trades(weights).join(vols.select("decision", "line", "vol"), ["decision", "line"], "left").groupBy("strategy", "decision").agg((F.sum(size) / 2).alias("turnover"), F.sum(due).alias("__cost"))
    return one.select("strategy", "decision", F.explode(F.array(*map(F.lit, factors))).alias("factor"), "turnover", "__cost").withColumn("cost", F.col("factor") * F.col("__cost")).drop("__cost")


def regime_exposure(stress: Column, vol: Column, calm_target: float = 0.12, stress_target: float = 0.06, floor: float = 0.05) -> Column:
    """Share invested at a volatility target that goes from calm to stress with the stressed state's probability; NULL
    without a volatility or a probability."""
    target = (1 - stress) * calm_target + stress * stress_target
    raw = target / F.when(vol > floor, vol).otherwise(F.lit(floor))
    return F.when(vol.isNotNull() & stress.isNotNull(), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def metric_row(paths: DataFrame, bps: float, year: float = 252.0) -> DataFrame:
    """(strategy, n, gross_return, net_return, cost_drag, net_vol, net_sharpe, turnover) of paths (strategy, date, gross,
    turnover), a row a strategy: annualised growth before and after costs and their difference, the net returns' volatility
    and Sharpe ratio, and the turnover of a year. A path that loses all has growth of -1."""
    net, n = F.col("gross") - bps / 1e4 * F.col("turnover"), F.count(F.lit(1))
    kept = lambda x: F.product(1 + x)
    one = paths.groupBy("strategy").agg(n.alias("n"), kept(F.col("gross")).alias("g"), kept(net).alias("k"), F.avg(net).alias("m"), F.stddev_samp(net).alias("s"), F.avg("turnover").alias("t"))
    growth = lambda c: F.when(F.col(c) <= 0, -1.0).otherwise(F.pow(F.col(c), F.lit(year) / F.col("n")) - 1)
    root = math.sqrt(year)
    return one.select(
        "strategy", "n", growth("g").alias("gross_return"), growth("k").alias("net_return"), (growth("g") - growth("k")).alias("cost_drag"), (F.col("s") * root).alias("net_vol"),
        F.try_divide(F.col("m") * root, F.col("s")).alias("net_sharpe"), (F.col("t") * year).alias("turnover"),
    )


def derived_seed(master: int, *tags: Column) -> Column:
    """A seed of 32 bits that depends on the master seed and the tags alone: the first four bytes of the SHA-256 of them,
    joined by |, as a big-endian number. NULL tags are left out, as in concat_ws."""
    name = F.concat_ws("|", F.lit(str(master)), *[t.cast("string") for t in tags])
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")


def one_hot(value: Column, levels: int, prefix: str = "is") -> list[Column]:
    """Columns <prefix>_0 to <prefix>_<levels - 1>: 1.0 for the value's own level, else 0.0; all NULL for a NULL, all 0 for a
    value outside the levels."""
    return [F.when(value.isNotNull(), (value == j).cast("double")).alias(f"{prefix}_{j}") for j in range(levels)]


def seed_bands(results: DataFrame, config: str, metrics: list[str]) -> DataFrame:
    """(config, metric, n, mean, sd, low, high) of results (config, seed, metrics), in two steps: the mean of each seed's
    rows, then over the seeds their mean, sample deviation and range. Values that aren't there take no part."""
    each = results.unpivot([config, "seed"], metrics, "metric", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    means = each.groupBy(config, "metric", "seed").agg(F.avg("value").alias("v"))
    return means.groupBy(config, "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"))
