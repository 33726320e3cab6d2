"""Results of runs as files: a JSON file a run in folders by stage, configuration and seed, read again by a pattern; tables
as CSV and as partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["stage", "config", "seed"]


def write_results(results: DataFrame, root: str) -> None:
    """Adds results (stage, config, seed, values ...) as JSON under root/stage=/config=/seed=. Rows of one run come to one
    task, so that a run is one file; a stage, configuration and seed written twice are there twice."""
    results.repartition(*KEYS).write.mode("append").partitionBy(*KEYS).json(root)


def read_results(spark: SparkSession, root: str, values: str, stage: str = "*", config: str = "*", seed: str = "*") -> DataFrame:
    """The results whose folders fit the patterns, keys as text, values by the schema `values`, and file, the name of the
    file. Only these folders are listed. What isn't JSON or of another type is an error, a value that a run lacks NULL."""
    schema = values + ", stage string, config string, seed string"
    # What the writer escapes in folder names is read back by Spark; patterns see the escaped form.
    found = spark.read.schema(schema).option("basePath", root).option("mode", "FAILFAST").json(f"{root}/stage={stage}/config={config}/seed={seed}")
    return found.withColumn("file", F.input_file_name())


def write_table(table: DataFrame, path: str, by: list[str] | None = None, kind: str = "parquet") -> None:
    """A result table in place of what is there: Parquet or CSV with a header line, in folders by the columns `by`."""
    writer = table.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError("a table is written as parquet or csv")
