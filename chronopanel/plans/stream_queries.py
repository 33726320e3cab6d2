"""Streaming programs run to the end of what is there, with SQL of their batch twins."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.plans import regime_queries as rq
from chronopanel.sources.panels import table
from chronopanel.streaming import online, streams


def _work(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of its own only for a local session, as in tests."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="chronopanel-stream-")


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_now(streams.tumbling(streams.event_stream(spark, sf_dir)), "complete", _work(spark))
    return out.select("event_type", F.to_date("w.start").alias("week"), "n", F.round("total", 4).alias("total"))


def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_now(streams.sessions(streams.event_stream(spark, sf_dir)), "complete", _work(spark))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_now(streams.carried_mean(streams.event_stream(spark, sf_dir)), "update", _work(spark))
    return out.groupBy("event_type").agg(F.max_by(F.struct("n", "ema"), "n").alias("s")).select("event_type", "s.n", F.round("s.ema", 6).alias("ema"))


#: Every tenth event arrives nine days after its time; the job runs once for each eight days of arrivals.
_LATE, _DAYS = "INTERVAL 9 DAYS", 8


def _parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value")
    return streams.by_arrival(events, F.when(F.col("event_id") % 10 == 0, F.expr(_LATE)).otherwise(F.expr("INTERVAL 0 DAYS")), _DAYS)


def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_in_parts(_parts(spark, sf_dir), streams.closed_windows, "append", _work(spark))
    return out.select("event_type", F.to_date("w.start").alias("day"), "n", F.round("total", 4).alias("total"))


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.moments(streams.run_in_parts(_parts(spark, sf_dir), streams.carried_moments, "update", _work(spark)))
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "skew", "kurt")])


def online_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed model's filter over weekly returns that arrive in three parts; the state is carried between them."""
    rows = rq._returns(spark, sf_dir).select("ticker", "date", "ret")
    ends = [None, "1994-06-30", "1996-06-30", None]
    parts = [rows.where((F.lit(a is None) | (F.col("date") > F.lit(a).cast("date"))) & (F.lit(b is None) | (F.col("date") <= F.lit(b).cast("date")))) for a, b in zip(ends, ends[1:])]
    out = online.filter_in_parts(parts, rq.fixed_models(rows), ["ticker"], "ret", _work(spark))
    return out.select("date", "ticker", *[F.round(F.col("filtered")[j], 6).alias(f"p_{j}") for j in range(2)], F.round("loglik", 6).alias("loglik"))


QUERIES = {
    "stream_online_filter": (online_filter, rq._FILTER + " SELECT date, ticker, round(p_0, 6) AS p_0, round(p_1, 6) AS p_1, round(loglik, 6) AS loglik FROM po"),
    "stream_tumbling": (tumbling, "SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "stream_session": (session, """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS f FROM events),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, g"""),
    "stream_carried_filter": (carried, f"""WITH RECURSIVE o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events WHERE value IS NOT NULL),
f(event_type, k, ema) AS (SELECT event_type, k, value FROM o WHERE k = 1 UNION ALL SELECT o.event_type, o.k, (1 - {streams.ALPHA}) * f.ema + {streams.ALPHA} * o.value FROM f JOIN o ON o.event_type = f.event_type AND o.k = f.k + 1)
SELECT event_type, max(k) AS n, round(arg_max(ema, k), 6) AS ema FROM f GROUP BY event_type"""),
    "stream_late_rows": (late_rows, f"""WITH e AS (SELECT event_type, value, ts, date_trunc('day', ts) AS day, date_diff('day', date_trunc('day', min(ts) OVER ()), date_trunc('day', ts + CASE WHEN event_id % 10 = 0 THEN INTERVAL 9 DAY ELSE INTERVAL 0 DAY END)) // {_DAYS} AS run FROM events),
m AS (SELECT run, max(ts) AS top FROM e GROUP BY run), w AS (SELECT run, max(top) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS mark FROM m)
SELECT event_type, CAST(day AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM e JOIN w USING (run) WHERE (mark IS NULL OR day + INTERVAL 1 DAY > mark) AND day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM e) GROUP BY event_type, day"""),
    "stream_moments": (moments, """WITH c AS (SELECT event_type, value, value - avg(value) OVER (PARTITION BY event_type) AS d FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(avg(pow(d, 3)) / pow(avg(d * d), 1.5), 6) AS skew, round(avg(pow(d, 4)) / pow(avg(d * d), 2) - 3, 6) AS kurt FROM c GROUP BY event_type"""),
}
