"""The assembled feature frame and what is fitted on it: blocks joined by date, columns without values dropped, families
of columns, statistics of a fit window with a record of what they were fitted on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.windows import by, change
from chronopanel.operators import clean, features

#: Families by a part of a column's name, the first that fits.
FAMILIES = {"vol": "volatility", "down": "volatility", "mom": "momentum", "ret": "return", "corr": "cross", "dispersion": "cross", "breadth": "cross", "beta": "beta", "skew": "shape", "kurt": "shape", "dist": "trend"}


def cross_block(panel: DataFrame, n: int = 60) -> DataFrame:
    """(date, avg_corr, std_corr, corr_change, dispersion, breadth) of the panel's tickers."""
    corr = features.pairwise_correlation(panel, n).withColumn("one", F.lit(1))
    corr = corr.withColumn("corr_change", change(F.col("avg_corr"), keys=("one",))).drop("one")
    return corr.join(features.return_dispersion(panel), "date", "full").join(features.breadth(panel), "date", "full")


def assembled(panel: DataFrame, universe: list[str], extra: list[DataFrame] | None = None) -> DataFrame:
    """One row a date: asset features of each ticker of the universe, the cross block over these tickers only, and extra
    tables (date, ...). Dates are those of the universe's rows; rows of other tickers touch nothing."""
    mine = panel.where(F.col("ticker").isin(universe))
    blocks = [features.wide(features.asset_features(mine), universe, features.ASSET), cross_block(mine), *(extra or [])]
    return reduce(lambda a, b: a.join(b, "date", "left"), blocks)


def drop_empty(wide: DataFrame, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """The frame without columns that are NULL in every row, by one pass of counts; an empty table keeps only its keys."""
    columns = [c for c in wide.columns if c not in keys]
    counts = wide.agg(*[F.count(F.col(c)).alias(c) for c in columns]).first()
    return wide.select(*keys, *[c for c in columns if counts[c]])


def warm_start(wide: DataFrame, columns: list[str]) -> DataFrame:
    """(date): the first date on which each of the columns is a finite number, NULL if there is none."""
    finite = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in columns], F.lit(True))
    return wide.where(finite).agg(F.min("date").alias("date"))


def trimmed(wide: DataFrame, columns: list[str]) -> DataFrame:
    """The rows from the warm start on; later gaps stay, and a frame that is never whole keeps no row."""
    return wide.where(F.col("date") >= warm_start(wide, columns).scalar())


def complete(panel: DataFrame, universe: list[str], sessions: DataFrame, macro: DataFrame | None = None, limit: int = 3, drop: bool = True) -> DataFrame:
    """The whole build: the universe's rows aligned to the sessions and filled over at most `limit` of them, its assembled
    frame with the macro block (date, ...), columns without any value dropped if `drop`, and the warm-up cut off."""
    mine = panel.where(F.col("ticker").isin(universe))
    cleaned = clean.fill(clean.align(mine, sessions), limit=limit).select("date", "ticker", "close", "volume")
    wide = assembled(cleaned, universe, [macro] if macro is not None else None)
    wide = drop_empty(wide) if drop else wide
    return trimmed(wide, [c for c in wide.columns if c != "date"])


def isolation_faults(wide: DataFrame, universe: list[str], others: list[str], keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """(name, n, fault) of columns that must not be in a universe's frame: of a ticker outside of it, or of the future
    (fwd_); n is how many values they hold."""
    wrong = {c: "future" if c.startswith("fwd_") or "_fwd_" in c else "other ticker" for c in wide.columns if c not in keys and ("fwd_" in c or any(c.startswith(f"{t}_") for t in others if t not in universe))}
    counts = wide.agg(F.array(*[F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.lit(w).alias("fault")) for c, w in wrong.items()]).cast("array<struct<name:string,n:bigint,fault:string>>").alias("all"))
    return counts.select(F.inline("all"))


def family(name: Column) -> Column:
    """A column's family by FAMILIES, else other."""
    return F.coalesce(*[F.when(F.contains(name, F.lit(part)), kind) for part, kind in FAMILIES.items()], F.lit("other"))


def families(wide: DataFrame, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """(name, family) of the frame's columns."""
    names = wide.sparkSession.createDataFrame([(c,) for c in wide.columns if c not in keys], "name string")
    return names.select("name", family(F.col("name")).alias("family"))


def melted(wide: DataFrame, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """(keys, name, value)."""
    return wide.unpivot(list(keys), [c for c in wide.columns if c not in keys], "name", "value")


def fit_statistics(rows: DataFrame, start: str, end: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """rows (date, name, value) -> (name, n, low, high, centre, scale, fit_start, fit_end, digest): quantiles, then mean
    and population deviation of the clipped values, over the dates from start to end alone; names without values there
    drop out. The digest is of the row itself, doubles to 6 places, so that a changed artifact shows."""
    inside = rows.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("value").isNotNull())
    edges = inside.groupBy("name").agg(F.percentile("value", F.array(F.lit(low), F.lit(high))).alias("q"))
    clipped = inside.join(edges, "name").select("name", "date", F.least(F.greatest("value", F.col("q")[0]), F.col("q")[1]).alias("x"), "q")
    sd = F.stddev_pop("x")
    one = clipped.groupBy("name").agg(F.count("x").alias("n"), F.first("q").alias("q"), F.avg("x").alias("centre"), F.when(sd > 0, sd).otherwise(1.0).alias("scale"), F.min("date").alias("fit_start"), F.max("date").alias("fit_end"))
    out = one.select("name", "n", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "centre", "scale", "fit_start", "fit_end")
    places = [F.format_string("%.6f", F.round(c, 6) + 0.0) for c in ("low", "high", "centre", "scale")]
    return out.withColumn("digest", F.sha2(F.concat_ws("|", "name", F.col("n").cast("string"), *places, F.col("fit_start").cast("string"), F.col("fit_end").cast("string")), 256))


def transformed(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """rows (date, name, value) clipped and scaled by what was fitted; names that were not fitted drop out."""
    x = F.when(F.col("value").isNotNull(), F.least(F.greatest("value", "low"), F.col("high")))
    both = rows.join(fitted.select("name", "low", "high", "centre", "scale"), "name")
    return both.select("date", "name", ((x - F.col("centre")) / F.col("scale")).alias("value"))


def tampered(fitted: DataFrame, record: DataFrame) -> DataFrame:
    """(name): rows of an artifact whose digest is not the record's (name, digest), or that one of the two lacks."""
    both = fitted.select("name", F.col("digest").alias("__a")).join(record.select("name", F.col("digest").alias("__b")), "name", "full")
    return both.where(~F.col("__a").eqNullSafe(F.col("__b"))).select("name")


def permuted(rows: DataFrame, keys: list[str], seed: int, order: list[str]) -> DataFrame:
    """Adds place, from 0: the row's place in a permutation of its group that depends on the seed and the order columns
    alone, whatever the partitions; rows that are equal in these are tied by no rule."""
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in order]))
    w = by(*keys, order="__mixed")
    return rows.withColumn("__mixed", F.concat(mixed, F.concat_ws("|", *[F.col(c).cast("string") for c in order]))).withColumn("place", F.row_number().over(w) - 1).drop("__mixed")
