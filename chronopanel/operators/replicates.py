"""Stationary bootstrap with replicates as rows: intervals of any statistic, paired differences, resampled seeds.

Whether a block begins at a position of a replicate, and where in the series, is a hash of seed, replicate and position:
a counter-based generator that any task can ask about any position. Only the rows at which blocks begin, one in `block`
on average, are brought into order; each then spans positions to the next one. All series are resampled at the same dates
in a replicate, so that differences between them are paired.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators.stats import verdict


def uniform(seed: int, tag: str, *counters: Column) -> Column:
    """A number in 0 to 1 that depends on its arguments alone: 32 bits of the MD5 of seed:tag:counters."""
    name = F.concat_ws(":", F.lit(str(seed)), F.lit(tag), *[c.cast("string") for c in counters])
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / 4294967296.0


def replicates(dates: DataFrame, count: int, block: int, seed: int) -> DataFrame:
    """(rep, pos, date): dates (date, distinct) resampled: blocks begin anywhere, have geometric lengths of mean `block`,
    and wrap around. rep from 0, pos from 0; every replicate has as many rows as there are dates."""
    place = F.row_number().over(Window.orderBy("date")) - 1  # the calendar, one row a date
    numbered = dates.select("date", place.alias("idx"))
    size = numbered.agg(F.count(F.lit(1)).alias("n"))
    grid = size.select("n", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("rep")).where("n > 0").select("n", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("pos"))
    fresh = grid.where((F.col("pos") == 0) | (uniform(seed, "block", F.col("rep"), F.col("pos")) < 1 / block))
    until = F.coalesce(F.lead("pos").over(Window.partitionBy("rep").orderBy("pos")), F.col("n")) - 1
    begin = F.floor(uniform(seed, "start", F.col("rep"), F.col("pos")) * F.col("n"))
    blocks = fresh.select("n", "rep", F.col("pos").alias("first"), begin.alias("begin"), until.alias("until"))
    spans = blocks.select("n", "rep", "first", "begin", F.explode(F.sequence("first", "until")).alias("pos"))
    return spans.select("rep", "pos", ((F.col("begin") + F.col("pos") - F.col("first")) % F.col("n")).alias("idx")).join(numbered, "idx").select("rep", "pos", "date")


def resampled(rows: DataFrame, count: int, block: int, seed: int) -> DataFrame:
    """rows (date, ...) with rep and pos: those of each replicate's dates, a row as often as its date was drawn."""
    return rows.join(replicates(rows.select("date").distinct(), count, block, seed), "date")


def statistics(rows: DataFrame, keys: list[str], named: dict[str, Column], count: int = 200, block: int = 20, seed: int = 7) -> DataFrame:
    """(keys, rep, name, value) of aggregate expressions over rows (date, ...): each replicate, and rep -1 for the rows
    themselves."""
    mine = rows.groupBy(*keys).agg(*[e.cast("double").alias(n) for n, e in named.items()]).withColumn("rep", F.lit(-1))
    drawn = resampled(rows, count, block, seed).groupBy(*keys, "rep").agg(*[e.cast("double").alias(n) for n, e in named.items()])
    return drawn.unionByName(mine).unpivot([*keys, "rep"], list(named), "name", "value")


def path_metrics(rows: DataFrame, keys: list[str], level: float = 0.95) -> DataFrame:
    """(keys, name, value) of paths (keys, pos, net): annualised return and Sharpe ratio, deepest drawdown, and the mean of
    the returns up to the (1 - level) quantile."""
    path = Window.partitionBy(*keys)
    run = path.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("curve", F.exp(F.sum(F.log1p("net")).over(run))).withColumn("edge", F.percentile("net", round(1 - level, 12)).over(path))
    marked = marked.withColumn("down", F.col("curve") / F.greatest(F.max("curve").over(run), F.lit(1.0)) - 1)
    n = F.count(F.lit(1))
    one = marked.groupBy(*keys).agg(
        (F.exp(F.sum(F.log1p("net")) * 252 / n) - 1).alias("ann_return"), F.try_divide(F.avg("net") * 252**0.5, F.stddev_samp("net")).alias("sharpe"),
        F.min("down").alias("max_dd"), F.avg(F.when(F.col("net") <= F.col("edge"), F.col("net"))).alias("cvar"),
    )
    return one.unpivot(keys, ["ann_return", "sharpe", "max_dd", "cvar"], "name", "value")


def path_statistics(paths: DataFrame, count: int = 200, block: int = 20, seed: int = 7) -> DataFrame:
    """(strategy, rep, name, value) of path_metrics() over paths (strategy, date, net): each replicate, and rep -1 for the
    paths themselves. Net returns are above -1."""
    sound = paths.where("net is not null").select("strategy", "date", "net")
    mine = sound.withColumns({"rep": F.lit(-1), "pos": F.date_diff("date", F.lit("1970-01-01").cast("date")).cast("long")})
    return path_metrics(resampled(sound, count, block, seed).unionByName(mine), ["strategy", "rep"])


def intervals(values: DataFrame, keys: list[str], level: float = 0.95) -> DataFrame:
    """values (keys, rep, name, value) -> (keys, name, point, low, high, n): the value of rep -1, and percentiles of the
    replicates that have one."""
    q = F.percentile("value", F.array(F.lit(round((1 - level) / 2, 12)), F.lit(round((1 + level) / 2, 12))))
    drawn = values.where("rep >= 0").groupBy(*keys, "name").agg(q.alias("q"), F.count("value").alias("n"))
    point = values.where("rep = -1").select(*keys, "name", F.col("value").alias("point"))
    return point.join(drawn, [*keys, "name"], "left").select(*keys, "name", "point", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "n")


def paired(values: DataFrame, key: str, base: str, higher_is_better: bool = True, level: float = 0.95) -> DataFrame:
    """(key, name, point, low, high, n, verdict) of each other series' value less that of `base` in the same replicate."""
    b = values.where(F.col(key) == base).select("rep", "name", F.col("value").alias("__base"))
    diff = values.where(F.col(key) != base).join(b, ["rep", "name"]).withColumn("value", F.col("value") - F.col("__base")).drop("__base")
    return intervals(diff, [key], level).withColumn("verdict", verdict(F.col("low"), F.col("high"), not higher_is_better))


def seed_replicates(values: DataFrame, keys: list[str], count: int, seed: int) -> DataFrame:
    """values (keys, run, value), a row a seeded run -> (keys, rep, value): the mean over as many runs as there are, drawn
    with replacement, and rep -1 for the mean of all. Runs are few."""
    w = Window.partitionBy(*keys).orderBy("run")
    numbered = values.withColumn("__no", F.row_number().over(w) - 1)
    size = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    draws = size.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("rep")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__draw"))
    draws = draws.withColumn("__no", F.floor(uniform(seed, "seed", F.col("rep"), F.col("__draw")) * F.col("__n")).cast("int"))
    drawn = draws.join(numbered, [*keys, "__no"]).groupBy(*keys, "rep").agg(F.avg("value").alias("value"))
    return drawn.unionByName(values.groupBy(*keys).agg(F.avg("value").alias("value")).withColumn("rep", F.lit(-1)))


def r2_statistic() -> dict[str, Column]:
    """For statistics(): 1 - squared error over that of base, of rows (y, pred, base)."""
    e, b = (F.sum(F.pow(F.col("y") - F.col(c), 2)) for c in ("pred", "base"))
    return {"r2": 1 - F.try_divide(e, b)}


def loss_difference(models: list[str]) -> dict[str, Column]:
    """For statistics(): the first model's mean squared error less each other's; columns hold predictions of y."""
    first, *others = [F.pow(F.col("y") - F.col(m), 2) for m in models]
    return {f"{models[0]}_less_{m}": F.avg(first - o) for m, o in zip(models[1:], others, strict=True)}


def all_favourable(table: DataFrame, key: str, needed: int = 3) -> DataFrame:
    """(key, favourable, adverse, passed) of a paired() table: at least `needed` favourable names and no adverse one."""
    counts = reduce(lambda d, v: d.withColumn(v, (F.col("verdict") == v).cast("int")), ("favourable", "adverse"), table)
    out = counts.groupBy(key).agg(F.sum("favourable").alias("favourable"), F.sum("adverse").alias("adverse"))
    return out.withColumn("passed", (F.col("favourable") >= needed) & (F.col("adverse") == 0))
