"""Structured Streaming programs over the events table, each with a batch twin of the same result.

Streams read a folder of files that holds the table; a table that is one file is read with its folder and a name filter.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronopanel.sources.panels import table


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream with event time ts, ten minutes late at most."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if table(spark, sf_dir, "events").inputFiles()[0].endswith("/events.parquet") else "*.parquet")
    one = table(spark, sf_dir, "events").inputFiles()[0].endswith("/events.parquet")
    return raw.parquet(sf_dir if one else f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")


def run_now(stream: DataFrame, mode: str, work: str) -> DataFrame:
    """All that the stream has now, by one availableNow run: batches are written as Parquet in the shared folder, so that
    no result passes through the driver. With mode complete the last batch stands, else all of them."""
    path = f"{work}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/{'last' if mode == 'complete' else f'batch-{number}'}")

    # Without any row no batch runs; an empty one keeps the folder readable.
    stream.sparkSession.createDataFrame([], stream.schema).write.parquet(f"{path}/out/none")
    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out/*")


def run_in_parts(parts: Iterable[DataFrame], program: Callable[[DataFrame], DataFrame], mode: str, work: str) -> DataFrame:
    """What a streaming program gives in all, if the parts arrive one after the other and it runs to the end of each, as a
    job on a schedule does. Its state and watermark are carried from run to run by one checkpoint; a part is one batch, of
    as many files as its writer made, and a batch without rows follows it and closes what the new watermark has passed.
    Adds run, the number of the batch. Batches are written under their number, so one that is repeated after a failure
    replaces itself."""
    path = f"{work}/stream-{uuid.uuid4().hex}"
    spark, schema = None, None

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("run", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/out/batch-{number}")

    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        spark = part.sparkSession
        out = program(spark.readStream.schema(part.schema).parquet(f"{path}/in"))
        if schema is None:
            schema = out.withColumn("run", F.lit(0).cast("long")).schema
            spark.createDataFrame([], schema).write.parquet(f"{path}/out/none")
        out.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    if spark is None:
        raise ValueError("a stream takes at least one part")
    return spark.read.schema(schema).parquet(f"{path}/out/*")


def by_arrival(events: DataFrame, late: Column, days: int) -> list[DataFrame]:
    """events in parts of so many days of arrival, the first of which begins with the first event's day; an event arrives
    `late` (an interval) after its time. Parts without events are left out. Without any event there is one empty part."""
    day = F.date_diff(F.to_date(F.col("ts") + late), F.to_date(F.lit("1970-01-01"))).cast("long")
    marked = events.withColumn("__day", day)
    low, high, first = marked.agg(F.min("__day"), F.max("__day"), F.min(F.date_diff(F.to_date("ts"), F.lit("1970-01-01").cast("date")))).first()
    if first is None:
        return [events.limit(0)]
    numbers = range((low - first) // days, (high - first) // days + 1)
    return [marked.where(F.col("__day").between(first + k * days, first + (k + 1) * days - 1)).drop("__day") for k in numbers]


def closed_windows(events: DataFrame, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """(event_type, w, n, total) of event-time windows, each given once (mode append): when the latest time seen in earlier
    batches, less the delay, has reached its end. Rows that come after that are late and dropped."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return stamped.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def closed_windows_batch(parts: list[DataFrame], delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """The batch twin: a row is late if its window ends at or before the latest time of all earlier parts less the delay;
    windows that end at or before the latest time of all less the delay are closed."""
    w = F.window(F.col("ts").cast("timestamp"), width)
    pause = F.expr(f"INTERVAL {delay}")
    kept, top = [], None
    for part in parts:
        rows = part.select("event_type", w.alias("w"), "value")
        kept.append(rows if top is None else rows.where(F.col("w.end") > F.lit(top) - pause))
        seen = part.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
        top = max((t for t in (top, seen) if t is not None), default=None)
    every = kept[0]
    for k in kept[1:]:
        every = every.unionByName(k)
    last = F.lit(top).cast("timestamp") - pause
    return every.where(F.col("w.end") <= last).groupBy("event_type", "w").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def merged_moments(a: tuple, b: tuple) -> tuple:
    """Count, mean and sums of the second, third and fourth power about the mean, of two sets taken together."""
    (n, m, s2, s3, s4), (k, o, t2, t3, t4) = a, b
    if not n or not k:
        return a if n else b
    both, d = n + k, o - m
    mean = m + d * k / both
    second = s2 + t2 + d**2 * n * k / both
    third = s3 + t3 + d**3 * n * k * (n - k) / both**2 + 3 * d * (n * t2 - k * s2) / both
    fourth = s4 + t4 + d**4 * n * k * (n * n - n * k + k * k) / both**3 + 6 * d**2 * (n * n * t2 + k * k * s2) / both**2 + 4 * d * (n * t3 - k * s3) / both
    return both, mean, second, third, fourth


def carried_moments(events: DataFrame, shards: int = 16) -> DataFrame:
    """(event_type, shard, n, mean, s2, s3, s4): moments of the values so far, of each type and shard of event_id, as
    state that merges: order doesn't matter, a type's rows are dealt over shards, and a task holds one slice of them."""

    def step(key: tuple, slices, state: GroupState):  # noqa: ANN001, ANN202
        now = tuple(state.get) if state.exists else (0, 0.0, 0.0, 0.0, 0.0)
        for rows in slices:
            x = rows["value"].to_numpy(float)
            d = x - x.mean() if len(x) else x
            now = merged_moments(now, (len(x), float(x.mean()) if len(x) else 0.0, *(float(np.sum(d**p)) for p in (2, 3, 4))))
        state.update(now)
        yield pd.DataFrame([(*key, *now)], columns=["event_type", "shard", "n", "mean", "s2", "s3", "s4"])

    kind = "n long, mean double, s2 double, s3 double, s4 double"
    chosen = events.where("value is not null").select("event_type", F.pmod(F.hash("event_id"), F.lit(shards)).alias("shard"), "value")
    return chosen.groupBy("event_type", "shard").applyInPandasWithState(step, "event_type string, shard int, " + kind, kind, "update", GroupStateTimeout.NoTimeout)


def moments(carried: DataFrame) -> DataFrame:
    """(event_type, n, mean, sd, skew, kurt): the last state of each shard, merged about the type's own mean: sample
    deviation, and the population's skewness and excess kurtosis."""
    last = carried.groupBy("event_type", "shard").agg(F.max_by(F.struct("n", "mean", "s2", "s3", "s4"), "n").alias("s")).select("event_type", "s.*")
    centre = last.groupBy(F.col("event_type").alias("__type")).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("centre"))
    d, n = F.col("mean") - F.col("centre"), F.col("n")
    parts = {
        "m2": F.col("s2") + n * d**2,
        "m3": F.col("s3") + 3 * d * F.col("s2") + n * d**3,
        "m4": F.col("s4") + 4 * d * F.col("s3") + 6 * d**2 * F.col("s2") + n * d**4,
    }
    whole = last.join(centre, F.col("event_type").eqNullSafe(F.col("__type"))).groupBy("event_type", "centre").agg(F.sum("n").alias("n"), *[F.sum(e).alias(k) for k, e in parts.items()])
    var = F.col("m2") / F.col("n")
    return whole.select("event_type", "n", F.col("centre").alias("mean"), F.sqrt(F.try_divide("m2", F.col("n") - 1)).alias("sd"), F.try_divide(F.col("m3") / F.col("n"), F.pow(var, 1.5)).alias("skew"), (F.try_divide(F.col("m4") / F.col("n"), var**2) - 3).alias("kurt"))


def tumbling(events: DataFrame) -> DataFrame:
    """Sum and count of values by type and week from Monday (windows count from a Thursday)."""
    w = F.window(F.col("ts").cast("timestamp"), "7 days", startTime="4 days")
    return events.groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    """Events of a user without a pause of the gap."""
    w = F.session_window(F.col("ts").cast("timestamp"), gap)
    return events.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"))


ALPHA = 0.1


def carried_mean(events: DataFrame) -> DataFrame:
    """(event_type, n, ema): an exponential mean of values in order of (ts, event_id), its state carried over batches.
    Order within a batch is restored; across batches the stream's order stands."""

    def step(key: tuple, batches, state: GroupState):  # noqa: ANN001, ANN202
        n, ema = state.get if state.exists else (0, 0.0)
        for x in pd.concat(list(batches)).sort_values(["ts", "event_id"])["value"]:
            ema = x if n == 0 else (1 - ALPHA) * ema + ALPHA * x
            n += 1
        state.update((n, float(ema)))
        yield pd.DataFrame([{"event_type": key[0], "n": n, "ema": float(ema)}])

    chosen = events.where("value is not null").select("event_type", "ts", "event_id", "value")
    return chosen.groupBy("event_type").applyInPandasWithState(step, "event_type string, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)


def carried_mean_batch(events: DataFrame) -> DataFrame:
    """The batch twin: one fold over each type's values in order."""
    rows = events.where("value is not null").groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("x"))
    ema = F.aggregate("x", F.lit(None).cast("double"), lambda e, x: F.when(e.isNull(), x["value"]).otherwise((1 - ALPHA) * e + ALPHA * x["value"]))
    return rows.select("event_type", F.size("x").cast("long").alias("n"), ema.alias("ema"))
