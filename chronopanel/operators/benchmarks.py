"""Benchmark portfolios: long tables of weights by decision, whole investment at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fixed_mix(decided: DataFrame, mix: dict[str, float]) -> DataFrame:
    """decided (decision, line) -> the weights of the mix; lines that it doesn't name get 0."""
    given = F.create_map(*[F.lit(x) for kv in mix.items() for x in kv])
    return decided.select("decision", "line", F.coalesce(given[F.col("line")], F.lit(0.0)).alias("weight"))


def capped_inverse_vol(vols: DataFrame, cap: float = 0.35) -> DataFrame:
    """vols (decision, line, vol) -> weights in inverse proportion to volatility, none above cap; what a cap cuts off goes
    to the others in proportion. Lines without a volatility get 0. If all are capped, the rest is not invested.

    With lines in order of 1/vol, the m largest are capped and the others share what is left: the least m at which the
    next line's share is no more than the cap is the one, so no repeated redistribution is needed."""
    line = vols.withColumn("__inverse", F.when(F.col("vol") > 0, 1 / F.col("vol")))
    order = Window.partitionBy("decision").orderBy(F.desc_nulls_last("__inverse"), "line")
    m = F.row_number().over(order) - 1
    level = (1 - m * cap) / F.sum("__inverse").over(order.rowsBetween(0, Window.unboundedFollowing))
    line = line.withColumns({"__m": m, "__level": level})
    fits = F.min(F.when((F.col("__inverse") * F.col("__level") <= cap) & (F.col("__level") >= 0), F.struct("__m", "__level"))).over(Window.partitionBy("decision"))
    weight = F.when(F.col("__inverse").isNull(), 0.0).otherwise(F.coalesce(F.least(F.lit(cap), F.col("__inverse") * fits["__level"]), F.lit(cap)))
    return line.select("decision", "line", weight.alias("weight"))


def buy_and_hold(prices: DataFrame, decided: DataFrame) -> DataFrame:
    """Equal weights at each line's first decision, never traded since: at a decision a line's share is its growth from the
    first decision over that of all. prices (date, line, close); decided (decision, line), all lines from the first on."""
    at = decided.join(prices.select(F.col("date").alias("decision"), "line", "close"), ["decision", "line"])
    first = F.first("close").over(Window.partitionBy("line").orderBy("decision").rowsBetween(Window.unboundedPreceding, 0))
    grown = at.withColumn("g", F.col("close") / first)
    return grown.select("decision", "line", (F.col("g") / F.sum("g").over(Window.partitionBy("decision"))).alias("weight"))


def vol_target_leg(vols: DataFrame, leg: str, target: float, floor: float = 0.05) -> DataFrame:
    """vols (decision, line, vol): the leg with target over its volatility, in 0 to 1; all other lines get 0."""
    exposure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), target / F.greatest(F.col("vol"), F.lit(floor))))
    return vols.select("decision", "line", F.when((F.col("line") == leg) & F.col("vol").isNotNull(), exposure).otherwise(0.0).alias("weight"))


def nearest_exposure(solutions: DataFrame, wanted: float = 0.70) -> DataFrame:
    """solutions (gamma, decision, line, weight) -> (gamma, exposure): the risk aversion whose mean investment over the
    decisions is nearest to the wanted one; of equal ones the smaller."""
    each = solutions.groupBy("gamma", "decision").agg(F.sum("weight").alias("w")).groupBy("gamma").agg(F.avg("w").alias("exposure"))
    return each.orderBy(F.abs(F.col("exposure") - wanted), "gamma").limit(1)
