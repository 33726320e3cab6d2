"""A hidden Markov filter that carries its state from batch to batch.

Each batch is filtered by the prefix scan of operators/markov.py, entered with what the batches before it left: the state's
chances before each series' next row, and the last date that it has seen. The state is a row a series, in a folder of its
own for each batch, so a batch that is repeated after a failure starts from the same state and replaces its own output.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.operators import markov


def moved(chances: Column, move: Column) -> Column:
    """Chances of the next row's states: a row vector times the k x k matrix move, which is flat."""
    k = F.size(chances)
    part = lambda j: F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0.0), lambda s, i: s + F.get(chances, i) * F.get(move, i * k + j))
    return F.transform(F.sequence(F.lit(0), k - 1), part)


def enter(models: DataFrame, state: DataFrame | None, keys: list[str]) -> DataFrame:
    """models with `start` out of the state where a series has one, and __seen, the last date behind it, else NULL."""
    if state is None:
        return models.withColumn("__seen", F.lit(None).cast("date"))
    held = state.select(*keys, F.col("next").alias("__next"), F.col("seen").alias("__seen"))
    return models.join(held, keys, "left").withColumn("start", F.coalesce("__next", "start")).drop("__next")


def step(batch: DataFrame, models: DataFrame, state: DataFrame | None, keys: list[str], value: str, period: str = "year") -> DataFrame:
    """(keys, date, filtered array, loglik) of a batch's rows (keys, date, value) after the state. Rows at or before the
    last date that their series has seen come too late and have no result; so have rows without a value and series without
    a model. Dates are distinct within a series."""
    entered = enter(models, state, keys)
    fresh = batch.join(entered.select(*keys, "__seen"), keys).where(F.col("__seen").isNull() | (F.col("date") > F.col("__seen"))).drop("__seen")
    return markov.posteriors(fresh, entered.drop("__seen"), keys, value, period).drop("smoothed")


def after(result: DataFrame, models: DataFrame, state: DataFrame | None, keys: list[str]) -> DataFrame:
    """(keys, next array, seen) once a batch's result is there: of its series the new state, of all others the old one."""
    last = result.groupBy(*keys).agg(F.max_by("filtered", "date").alias("a"), F.max("date").alias("seen"))
    new = last.join(models.select(*keys, "move"), keys).select(*keys, moved(F.col("a"), F.col("move")).alias("next"), "seen")
    return new if state is None else new.unionByName(state.join(new.select(*keys), keys, "left_anti"))


def filter_in_parts(parts: Iterable[DataFrame], models: DataFrame, keys: list[str], value: str, work: str, period: str = "year") -> DataFrame:
    """step() over rows that arrive in parts, one batch each, run by one checkpoint to the end of each part; adds run, the
    number of the batch. Equal to the filter over all rows at once if no row comes late. Without parts there is an error."""
    path = f"{work}/stream-{uuid.uuid4().hex}"
    spark = models.sparkSession
    models.write.parquet(f"{path}/models")  # a model a series, read again by every batch
    fixed = spark.read.parquet(f"{path}/models")

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        state = session.read.parquet(f"{path}/carried/batch-{number - 1}") if number else None
        step(batch, fixed, state, keys, value, period).withColumn("run", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/out/batch-{number}")
        done = session.read.parquet(f"{path}/out/batch-{number}").drop("run")
        after(done, fixed, state, keys).write.mode("overwrite").parquet(f"{path}/carried/batch-{number}")

    ran = False
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{path}/in")
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
        ran = True
    if not ran:
        raise ValueError("a stream takes at least one part")
    return spark.read.parquet(f"{path}/out/*")
