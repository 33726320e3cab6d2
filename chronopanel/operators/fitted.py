"""Transforms with a fit and a transform: statistics come from the rows of the fit window only, and transforming other
rows never changes them. Inputs are long: keys, a column name, a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_winsor(rows: DataFrame, fit: Column, value: str = "value", by: str = "name", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(name, low, high): exact quantiles with linear interpolation."""
    q = F.percentile(value, F.array(F.lit(low), F.lit(high)))
    return rows.where(fit).groupBy(by).agg(q.alias("q")).select(by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def winsorise(rows: DataFrame, fitted: DataFrame, value: str = "value", by: str = "name") -> DataFrame:
    clipped = F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), F.col("low")), F.col("high")))
    return rows.join(fitted, by).withColumn(value, clipped).drop("low", "high")


def fit_scaler(rows: DataFrame, fit: Column, value: str = "value", by: str = "name", robust: bool = False) -> DataFrame:
    """(name, centre, scale): mean and population deviation, or median and the quartiles' distance over 1.349; a scale of
    0 becomes 1."""
    inside = rows.where(fit).groupBy(by)
    if robust:
        s = inside.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).select(by, F.col("q")[1].alias("centre"), ((F.col("q")[2] - F.col("q")[0]) / 1.349).alias("scale"))
    else:
        s = inside.agg(F.avg(value).alias("centre"), F.stddev_pop(value).alias("scale"))
    return s.withColumn("scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")))


def scaled(rows: DataFrame, fitted: DataFrame, value: str = "value", by: str = "name") -> DataFrame:
    return rows.join(fitted, by).withColumn(value, (F.col(value) - F.col("centre")) / F.col("scale")).drop("centre", "scale")


def corr(a: str, b: str) -> Column:
    """Correlation over rows that have both, NULL if one of them is constant there (F.corr is an error then)."""
    return F.try_divide(F.regr_sxy(a, b), F.sqrt(F.regr_sxx(a, b) * F.regr_syy(a, b)))


def correlations(wide: DataFrame, columns: list[str], fit: Column) -> DataFrame:
    """(a, b, rho) for each pair of columns in their order, over the fit window, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = wide.where(fit).agg(*[corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("rho")) for i, (a, b) in enumerate(pairs)])))


def prune(wide: DataFrame, columns: list[str], fit: Column, threshold: float = 0.95) -> DataFrame:
    """(name, dropped_for): columns in their order, each dropped for the first survivor that it correlates with beyond
    the threshold, else NULL. The pairs of columns are few, so the greedy choice runs over a small result."""
    rho = {(r[0], r[1]): r[2] for r in correlations(wide, columns, fit).collect()}
    kept: list[str] = []
    out = []
    for b in columns:
        mate = next((a for a in kept if abs(rho.get((a, b)) or 0.0) > threshold), None)
        out.append((b, mate))
        if mate is None:
            kept.append(b)
    return wide.sparkSession.createDataFrame(out, "name string, dropped_for string")


def prune_groups(wide: DataFrame, groups: dict[str, list[str]], fit: Column, threshold: float = 0.95) -> DataFrame:
    """(grp, name, dropped_for, abs_corr): the columns of each group in their declared order, each dropped for the first
    survivor of its own group that it correlates with beyond the threshold over the fit window, else NULL. Columns of
    different groups are never compared, so the pass over the data has only the groups' own pairs. A correlation that isn't
    a number drops nothing; an empty fit window keeps all."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    pairs = [(a, b) for names in groups.values() for i, a in enumerate(names) for b in names[i + 1 :]]
    key = lambda a, b: F.concat(a, F.lit("|"), b)
    # A group of one column has no pair; the count keeps the aggregate and the map from being empty.
    one = wide.where(fit).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.abs(F.nanvl(corr(a, b), F.lit(None).cast("double"))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rho = F.map_from_arrays(F.array(F.lit("|"), *[F.lit(f"{a}|{b}") for a, b in pairs]), F.array(F.col("n"), *[f"c{i}" for i in range(len(pairs))]))
    members = F.array(*[F.struct(F.lit(g).alias("grp"), F.array(*map(F.lit, names)).alias("names")) for g, names in groups.items()])
    each = one.select(rho.alias("rho"), F.explode(members).alias("m")).select("rho", "m.*")

    def take(done: Column, name: Column) -> Column:
        at = lambda other: F.col("rho")[key(other["name"], name)]
        clash = F.get(F.filter(done, lambda x: x["dropped_for"].isNull() & (at(x) > threshold)), F.lit(0))
        return F.concat(done, F.array(F.struct(name.alias("name"), clash["name"].alias("dropped_for"), at(clash).alias("abs_corr"))))

    start = F.array().cast("array<struct<name:string,dropped_for:string,abs_corr:double>>")
    return each.select("grp", F.inline(F.aggregate("names", start, take)))
