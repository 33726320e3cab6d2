"""Fitted artifacts as stored tables: fitted once, read back only if unchanged, and used only on what they were fitted for.

An artifact is what `build.fit_statistics` gives, a row a name with the dates it was fitted on, kept as a snapshot: a
Parquet table root/scope/name and a manifest with digests that is committed last. A scope is a split or a fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.operators import build
from chronopanel.sources import snapshot


class ArtifactError(ValueError):
    """An artifact that isn't fitted, is fitted already, reaches beyond its window, or is of other columns."""


def _beyond(fitted: DataFrame, start: str, end: str) -> list[str]:
    first, last = (F.lit(d).cast("date") for d in (start, end))
    out = fitted.where((F.col("fit_start") < first) | (F.col("fit_end") > last) | F.col("fit_start").isNull() | F.col("fit_end").isNull())
    return sorted(r["name"] for r in out.select("name").collect())  # at most a row a column


def fit_once(rows: DataFrame, start: str, end: str, root: str, scope: str, name: str, refit: bool = False) -> DataFrame:
    """Fits rows (date, name, value) on the dates from start to end, stores the statistics and gives them as stored. What
    is there already stays and is an error, but with refit it is replaced."""
    try:
        snapshot.create(build.fit_statistics(rows, start, end), root, scope, name, "fit_end", force=refit, may_overwrite=refit)
    except snapshot.SnapshotError as e:
        raise ArtifactError(f"{scope}/{name} is fitted already: another scope, or refit") from e
    return fitted(rows.sparkSession, root, scope, name, start, end)


def fitted(spark: SparkSession, root: str, scope: str, name: str, start: str, end: str) -> DataFrame:
    """The stored statistics, if their files are as written and no row was fitted on a date before start or after end."""
    try:
        table = snapshot.load(spark, root, scope, name)
    except snapshot.SnapshotError as e:
        raise ArtifactError(f"{scope}/{name}: {e}") from e
    if bad := _beyond(table, start, end):
        raise ArtifactError(f"{scope}/{name} was fitted beyond {start} to {end}: {bad[:8]}")
    return table


def transform(rows: DataFrame, statistics: DataFrame) -> DataFrame:
    """rows (date, name, value) by the statistics, which stay as they are. Names must be the same on both sides: those of
    another universe are an error, not rows that vanish."""
    mine = rows.select("name").distinct().withColumn("__rows", F.lit(True))
    both = mine.join(statistics.select("name", F.lit(True).alias("__fit")), "name", "full")
    odd = both.where(F.col("__rows").isNull() | F.col("__fit").isNull()).select("name", F.col("__fit").isNull().alias("new")).limit(8).collect()
    if odd:
        raise ArtifactError("columns differ from those fitted: " + ", ".join(f"{r['name']} ({'not fitted' if r['new'] else 'absent'})" for r in odd))
    return build.transformed(rows, statistics)


def log(spark: SparkSession, root: str, scope: str, name: str) -> DataFrame:
    """(scope, artifact, n_names, fit_start, fit_end, digest): what an artifact has seen, in one row. The digest is of all
    rows' own digests in the order of names."""
    table = spark.read.parquet(snapshot.table_path(root, scope, name))
    each = F.array_sort(F.collect_list(F.struct("name", "digest")))  # a row a column of the frame
    return table.agg(F.count(F.lit(1)).alias("n_names"), F.min("fit_start").alias("fit_start"), F.max("fit_end").alias("fit_end"), F.sha2(F.array_join(F.transform(each, lambda r: r["digest"]), "|"), 256).alias("digest")).select(F.lit(scope).alias("scope"), F.lit(name).alias("artifact"), "*")
