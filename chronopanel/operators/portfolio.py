"""Portfolios: weights, schedules, drift between executions, costs, performance.

Long tables: prices (date, line, close), weights (strategy, decision, line, weight), paths (strategy, date, net).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.windows import by, full, trailing


def simple_returns(prices: DataFrame) -> DataFrame:
    return prices.withColumn("r", F.col("close") / F.lag("close").over(by("line")) - 1)


def equity(paths: DataFrame) -> DataFrame:
    """Adds equity, the running product of 1 + net, and drawdown from its peak; the start counts as a peak of 1."""
    run = by("strategy").rowsBetween(Window.unboundedPreceding, 0)
    rows = paths.withColumn("equity", F.product(1 + F.col("net")).over(run))
    return rows.withColumn("drawdown", F.col("equity") / F.greatest(F.max("equity").over(run), F.lit(1.0)) - 1)


def performance(paths: DataFrame, rf: float = 0.0, level: float = 0.95) -> DataFrame:
    """One row a strategy: annualised return and volatility, Sharpe, Sortino, Calmar, deepest drawdown and its longest run,
    value at risk and the mean beyond it, hit rate, tail ratio."""
    daily = (1 + rf) ** (1 / 252) - 1
    x = F.col("net") - daily
    q = F.percentile("net", F.array(F.lit(1 - level), F.lit(0.05), F.lit(0.95)))
    one = equity(paths).groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n"), F.product(1 + F.col("net")).alias("total"), F.stddev_samp("net").alias("sd"), F.avg(x).alias("excess"), F.stddev_samp(x).alias("xsd"),
        F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), 2))).alias("down"), F.min("drawdown").alias("max_dd"), q.alias("q"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"),
    )
    from chronopanel.operators.clean import runs

    longest = runs(equity(paths), F.col("drawdown") < 0, ("strategy",)).groupBy("strategy").agg(F.max("length").alias("dd_length"))
    beyond = paths.join(one.select("strategy", F.col("q")[0].alias("var")), "strategy").where("net <= var").groupBy("strategy").agg(F.avg("net").alias("cvar"))
    ann = F.when(F.col("total") <= 0, -1.0).otherwise(F.pow("total", 252 / F.col("n")) - 1)
    root = math.sqrt(252)
    return one.join(longest, "strategy", "left").join(beyond, "strategy").select(
        "strategy", "n", ann.alias("ann_return"), (F.col("sd") * root).alias("ann_vol"), F.try_divide(F.col("excess") * root, F.col("xsd")).alias("sharpe"),
        F.try_divide(F.col("excess") * root, F.col("down")).alias("sortino"), F.try_divide(ann, F.abs("max_dd")).alias("calmar"), "max_dd", F.coalesce("dd_length", F.lit(0)).alias("dd_length"),
        F.col("q")[0].alias("var"), "cvar", "hit_rate", F.try_divide(F.abs(F.col("q")[2]), F.abs(F.col("q")[1])).alias("tail_ratio"),
    )


def turnover(weights: DataFrame) -> DataFrame:
    """(strategy, decision, turnover): half the sum of absolute changes of the weights, the first against nothing."""
    w = Window.partitionBy("strategy", "line").orderBy("decision")
    moved = F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(0.0)))
    return weights.withColumn("m", moved).groupBy("strategy", "decision").agg((F.sum("m") / 2).alias("turnover"))


def inverse_vol_weights(vols: DataFrame) -> DataFrame:
    """vols (decision, line, vol) -> weights in inverse proportion to volatility; lines without one get nothing."""
    inverse = vols.withColumn("i", F.when(F.col("vol") > 0, 1 / F.col("vol")))
    return inverse.select("decision", "line", F.coalesce(F.col("i") / F.sum("i").over(Window.partitionBy("decision")), F.lit(0.0)).alias("weight"))


def equal_weights(decided: DataFrame) -> DataFrame:
    """decided (decision, line) -> the same weight for each line of a decision."""
    return decided.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("decision")))


def vol_target(vols: DataFrame, target: float = 0.10, floor: float = 0.05) -> DataFrame:
    """vols (date, vol) -> exposure: target over volatility, the volatility at least floor, the exposure in 0 to 1."""
    return vols.withColumn("exposure", F.when(F.col("vol").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), target / F.greatest(F.col("vol"), F.lit(floor))))))


def period_returns(weights: DataFrame, periods: DataFrame, prices: DataFrame, cash: float = 0.0) -> DataFrame:
    """(strategy, decision, ret): growth of each holding period without drift; what is not invested earns cash; lines
    without both prices are skipped."""
    at = lambda c: prices.select(F.col("date").alias(c), "line", F.col("close").alias(f"{c}_close"))
    held = weights.join(periods, "decision").join(at("start"), ["start", "line"], "left").join(at("end"), ["end", "line"], "left")
    growth = F.col("weight") * F.try_divide("end_close", "start_close")
    out = held.groupBy("strategy", "decision").agg(F.sum(growth).alias("g"), F.sum(F.when(growth.isNotNull(), F.col("weight"))).alias("w"))
    return out.select("strategy", "decision", (F.coalesce("g", F.lit(0.0)) + (1 - F.coalesce("w", F.lit(0.0))) * (1 + cash) - 1).alias("ret"))


def drift(weights: DataFrame, periods: DataFrame, returns: DataFrame) -> DataFrame:
    """(strategy, date, gross, turnover): weights drift with their lines' returns from one execution to the next. The day
    of an execution still earns the old weights; turnover is half the distance from the drifted to the new ones.

    Between executions a line's value is its target times its growth since then, so the day-by-day recursion becomes
    one running product within each segment. returns: (date, line, r), every date a session; missing returns are 0."""
    seg = weights.join(periods, "decision").select("strategy", "line", "weight", "decision", "start", "end")
    days = seg.join(returns, "line").where((F.col("date") > F.col("start")) & (F.col("date") <= F.col("end")))
    grow = Window.partitionBy("strategy", "line", "decision").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("value", F.col("weight") * F.product(1 + F.coalesce("r", F.lit(0.0))).over(grow))
    sums = days.groupBy("strategy", "decision", "start", "date").agg(F.sum("value").alias("total"))
    first = F.lag("total").over(Window.partitionBy("strategy", "decision").orderBy("date"))
    gross = sums.select("strategy", "decision", "date", "total", (F.col("total") / F.coalesce(first, F.lit(1.0)) - 1).alias("gross"))
    ends = days.where("date = end").join(gross.select("strategy", "decision", "date", "total"), ["strategy", "decision", "date"]).select("strategy", "line", F.col("date").alias("start"), (F.col("value") / F.col("total")).alias("old"))
    moved = seg.join(ends, ["strategy", "line", "start"], "full").groupBy("strategy", "start").agg(F.count("decision").alias("k"), (F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))) / 2).alias("turnover"))
    executed = moved.where("k > 0").select("strategy", F.col("start").alias("date"), "turnover")
    return gross.select("strategy", "date", "gross").join(executed, ["strategy", "date"], "full").select("strategy", "date", F.coalesce("gross", F.lit(0.0)).alias("gross"), F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def net(paths: DataFrame, bps: float) -> DataFrame:
    return paths.withColumn("net", F.col("gross") - bps / 1e4 * F.col("turnover"))


def cost_sensitivity(paths: DataFrame, levels: tuple[float, ...] = (0.0, 5.0, 10.0, 20.0)) -> DataFrame:
    """(strategy, bps, nav): final value at each cost level."""
    each = paths.withColumn("bps", F.explode(F.array(*map(F.lit, levels))))
    return each.groupBy("strategy", "bps").agg(F.product(1 + F.col("gross") - F.col("bps") / 1e4 * F.col("turnover")).alias("nav"))


def capped_simplex(x: Column, caps: Column, steps: int = 100) -> Column:
    """The point nearest to array x with entries in 0 to caps that sums to 1, by bisection of the common shift."""
    total = lambda t: F.aggregate(F.zip_with(x, caps, lambda a, c: F.least(F.greatest(a - t, F.lit(0.0)), c)), F.lit(0.0), lambda s, v: s + v)
    start = F.struct((F.array_min(x) - 1).cast("double").alias("lo"), F.array_max(x).cast("double").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        return F.struct(F.when(total(mid) > 1, mid).otherwise(s["lo"]).alias("lo"), F.when(total(mid) > 1, s["hi"]).otherwise(mid).alias("hi"))

    shift = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.zip_with(x, caps, lambda a, c: F.least(F.greatest(a - shift, F.lit(0.0)), c))


def trailing_vol(prices: DataFrame, n: int = 20) -> DataFrame:
    return simple_returns(prices).withColumn("vol", full(F.stddev_samp, "r", trailing(n, ("line",)), n) * math.sqrt(252))
