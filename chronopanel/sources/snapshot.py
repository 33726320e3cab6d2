"""Snapshots: panels stored once, with a manifest that is committed last and checked at every read, and a range of dates
that is locked until a reader says why it opens it.

A snapshot is a folder root/asof with a Parquet table for each name and a manifest of it, a row a column. A table without
a manifest was not finished and isn't read. Nothing is overwritten unless both the caller and the configuration say so.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


class SnapshotError(ValueError):
    """A snapshot that is missing, unfinished, changed or already there."""


class LockedRangeError(PermissionError):
    """Rows of the locked range were asked for without leave."""


def table_path(root: str, asof: str, name: str) -> str:
    return f"{root.rstrip('/')}/{asof}/{name}"


def _manifest_path(root: str, asof: str, name: str) -> str:
    return f"{table_path(root, asof, '_manifest')}/{name}"


def summary(table: DataFrame, date_col: str = "date") -> DataFrame:
    """(column, kind, rows, nulls, first_date, last_date, digest), a row a column, in one pass. A column's digest sums and
    folds the hashes of its values together with their row's date, so that it doesn't depend on the order of rows."""
    marks = lambda c: F.xxhash64(F.col(date_col), F.col(c), F.col(c).isNull())
    parts = [
        F.struct(
            F.lit(c).alias("column"), F.lit(k).alias("kind"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"),
            F.min(date_col).cast("date").alias("first_date"), F.max(date_col).cast("date").alias("last_date"),
            F.sha2(F.concat_ws(":", F.lit(c), F.lit(k), F.sum(marks(c).cast("decimal(20,0)")).cast("string"), F.bit_xor(marks(c)).cast("string")), 256).alias("digest"),
        )
        for c, k in table.dtypes
    ]
    return table.agg(F.array(*parts).alias("all")).select(F.inline("all"))


def create(table: DataFrame, root: str, asof: str, name: str, date_col: str = "date", force: bool = False, may_overwrite: bool = False) -> DataFrame:
    """Stores the table, then its manifest, and gives the manifest. force and may_overwrite together replace what is there;
    one alone is an error like none."""
    spark, path = table.sparkSession, table_path(root, asof, name)
    mode = "overwrite" if force and may_overwrite else "errorifexists"
    try:
        table.write.mode(mode).parquet(path)
    except AnalysisException as e:
        raise SnapshotError(f"{path} is there and is written once") from e
    summary(spark.read.parquet(path), date_col).withColumn("date_col", F.lit(date_col)).coalesce(1).write.mode(mode).json(_manifest_path(root, asof, name))
    return manifest(spark, root, asof, name)


_MANIFEST = "column string, kind string, rows long, nulls long, first_date date, last_date date, digest string, date_col string"


def manifest(spark: SparkSession, root: str, asof: str, name: str) -> DataFrame:
    try:
        found = spark.read.schema(_MANIFEST).json(_manifest_path(root, asof, name))
    except AnalysisException as e:
        raise SnapshotError(f"no finished snapshot {table_path(root, asof, name)}") from e
    return found


def changes(table: DataFrame, recorded: DataFrame) -> DataFrame:
    """(column): columns whose summary isn't the recorded one, or that one of the two lacks."""
    date_col = recorded.select("date_col").first()[0]
    now = summary(table, date_col).select("column", F.struct("kind", "rows", "nulls", "first_date", "last_date", "digest").alias("__now"))
    then = recorded.select("column", F.struct("kind", "rows", "nulls", "first_date", "last_date", "digest").alias("__then"))
    return now.join(then, "column", "full").where(~F.col("__now").eqNullSafe(F.col("__then"))).select("column")


def load(spark: SparkSession, root: str, asof: str, name: str, verify: bool = True) -> DataFrame:
    """The stored table; verify reads it once to compare it with its manifest, and an error names what has changed."""
    recorded = manifest(spark, root, asof, name)
    table = spark.read.parquet(table_path(root, asof, name))
    if verify and (bad := [r["column"] for r in changes(table, recorded).collect()]):  # at most all columns
        raise SnapshotError(f"{table_path(root, asof, name)} has changed: {sorted(bad)}")
    return table


def pick(panel: DataFrame, tickers: list[str]) -> DataFrame:
    """The rows of these tickers; one that the panel lacks is an error."""
    mine = panel.where(F.col("ticker").isin(tickers))
    there = {r["ticker"] for r in mine.select("ticker").distinct().collect()}  # at most those asked for
    if missing := sorted(set(tickers) - there):
        raise SnapshotError(f"no rows of {missing}")
    return mine


def readable(table: DataFrame, locked: tuple[str, str], date_col: str = "date") -> DataFrame:
    """The rows outside of the locked range (both ends belong to it); the filter reaches the scan."""
    first, last = (F.lit(d).cast("date") for d in locked)
    return table.where((F.col(date_col) < first) | (F.col(date_col) > last))


def opened(table: DataFrame, locked: tuple[str, str], log: str, final: bool = False, allowed: bool = False, reason: str = "", date_col: str = "date") -> DataFrame:
    """The rows of the locked range, if the caller says that this is final, the configuration allows it and a reason is
    given; each time is a row (at, first, last, reason) in the JSON table log, written before anything is read."""
    if not (final and allowed and reason.strip()):
        raise LockedRangeError(f"{locked[0]} to {locked[1]} is locked: it takes final, allowed and a reason")
    spark = table.sparkSession
    spark.createDataFrame([(datetime.now(UTC).isoformat(), *locked, reason.strip())], "at string, first string, last string, reason string").coalesce(1).write.mode("append").json(log)
    first, last = (F.lit(d).cast("date") for d in locked)
    return table.where(F.col(date_col).between(first, last))


def accesses(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema("at string, first string, last string, reason string").json(log).orderBy("at")
