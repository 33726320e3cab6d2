"""Queries of checks, labels and comparisons, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.operators import calendar as cal
from chronopanel.operators import checks, features
from chronopanel.plans.feature_queries import RET
from chronopanel.plans.session_queries import EMBARGO, FIRST_APPLY, FIT_END, QUERIES as SESSIONS, SPLITS
from chronopanel.sources.panels import DAILY, WEEKLY, daily, table, weekly

_FIT = f"date <= DATE '{FIT_END}'"


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.observed(daily(spark, sf_dir))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.split_plan(_sessions(spark, sf_dir), SPLITS, EMBARGO)


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.expanding_folds(_sessions(spark, sf_dir), FIRST_APPLY, "quarter", EMBARGO)


def monotonic_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    return checks.monotonic(events, ("event_type",), "event_id", "ts")


def index_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.coverage_against(daily(spark, sf_dir), "N")


def feature_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.realised_vol(weekly(spark, sf_dir), (20,)).withColumn("flat", F.lit(1.0))
    return checks.feature_faults(rows, ["ret", "vol_20", "flat"], warm_up=10)


def top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.top_counts(table(spark, sf_dir, "events"), ["event_type"])


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checks.in_split(daily(spark, sf_dir), _plan(spark, sf_dir))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))


def holdout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.outside(daily(spark, sf_dir).where(_FIT), _plan(spark, sf_dir), "holdout")


def split_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.plan_faults(_plan(spark, sf_dir), _sessions(spark, sf_dir), EMBARGO + 1)


def fold_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.fold_faults(_folds(spark, sf_dir), _sessions(spark, sf_dir), EMBARGO)


def fold_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.tiling(_folds(spark, sf_dir).where("fold <> 3"), _sessions(spark, sf_dir))


def inner_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.inner_split(weekly(spark, sf_dir).select("date", "ticker").where(_FIT), context=9).groupBy("ticker", "part").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = weekly(spark, sf_dir).select(F.col("date").alias("decision"), F.col("ticker").alias("line"), "volume")
    total = lambda x: x / F.sum(x).over(Window.partitionBy("decision"))
    kinds = F.array(F.struct(F.lit("equal").alias("strategy"), total(F.lit(1.0)).alias("weight")), F.struct(F.lit("volume").alias("strategy"), total(F.col("volume").cast("double")).alias("weight")))
    return v.select("decision", "line", kinds.alias("k")).select("decision", "line", F.inline("k"))


def weight_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.weight_distances(_weights(spark, sf_dir)).select("a", "b", F.round("distance", 6).alias("distance"))


def weight_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.weight_faults(_weights(spark, sf_dir), 0.35).select("strategy", "decision", F.round("total", 6).alias("total"), "n_negative", "n_over")


def table_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = weekly(spark, sf_dir)
    other = p.where("date >= date '1993-01-01'").withColumn("close", F.col("close") + F.when(F.col("volume") > 10, 0.5).otherwise(0.0))
    return checks.differences(p, other, ["date", "ticker"], ["close", "volume"]).select("name", "only_left", "only_right", F.round("worst", 6).alias("worst"))


def parameter_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", checks.digest(F.col("n_name"), F.col("n_regionkey").cast("int").alias("region")).alias("digest"))


def _next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.log_returns(weekly(spark, sf_dir)).withColumn("y", F.lead("ret").over(Window.partitionBy("ticker").orderBy("date"))).dropna(subset=["ret", "y"])


def naive_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.reconstruction_error(_next(spark, sf_dir).withColumn("guess", -F.col("ret") / 2), ["ticker"], "y", "guess").select("ticker", "n", F.round("mse", 6).alias("mse"))


def paired_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _next(spark, sf_dir).withColumns({"guess": -F.col("ret") / 2, "zero": F.lit(0.0)})
    return checks.paired_losses(rows, ["ticker"], "guess", "zero").select("ticker", "n", F.round("mean_d", 6).alias("mean_d"), F.round("t", 4).alias("t"))


def quantile_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.log_returns(weekly(spark, sf_dir)).where("ret is not null")
    return checks.quantile_label(rows, "ret", F.expr(_FIT), 0.8).groupBy("ticker").agg(F.count_if("label").alias("n_above"), F.count(F.lit(1)).alias("n"))


def term_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segments stand for a volatility index and its three-month form: the difference of their logs."""
    levels = weekly(spark, sf_dir).groupBy("date").agg(F.max(F.when(F.col("ticker") == "AUTOMOBILE", F.col("close"))).alias("near"), F.max(F.when(F.col("ticker") == "BUILDING", F.col("close"))).alias("far"))
    return levels.select("date", F.round(F.ln("near") - F.ln("far"), 6).alias("term_structure"))


_SP = SESSIONS["split_plan"][1]
_FO = SESSIONS["expanding_folds"][1]
_NX = RET + ", x AS (SELECT date, ticker, ret, lead(ret) OVER (PARTITION BY ticker ORDER BY date) AS y FROM r), ok AS (SELECT * FROM x WHERE ret IS NOT NULL AND y IS NOT NULL)"
_S = f"WITH s AS (SELECT DISTINCT date FROM ({DAILY})), p AS ({_SP}), f AS ({_FO})"
_W = f"""WITH k AS (SELECT date AS decision, ticker AS line, 1.0 / count(*) OVER (PARTITION BY date) AS e, volume / sum(volume) OVER (PARTITION BY date) AS v FROM ({WEEKLY})),
w AS (SELECT decision, line, 'equal' AS strategy, CAST(e AS DOUBLE) AS weight FROM k UNION ALL SELECT decision, line, 'volume', CAST(v AS DOUBLE) FROM k)"""

QUERIES = {
    "monotonic_index": (monotonic_index, "WITH x AS (SELECT event_type, ts < lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS b FROM events) SELECT event_type, count(*) FILTER (b) AS n_affected FROM x GROUP BY event_type"),
    "index_coverage": (index_coverage, f"""WITH p AS ({DAILY}), f AS (SELECT ticker, min(date) AS first FROM p WHERE ticker <> 'N' GROUP BY ticker),
d AS (SELECT n.date, f.ticker FROM p n JOIN f ON n.date >= first WHERE n.ticker = 'N') SELECT ticker, count(*) AS missing FROM d ANTI JOIN p USING (date, ticker) GROUP BY ticker HAVING count(*) > 1"""),
    "feature_faults": (feature_faults, RET + """, v AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END AS vol FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
l AS (SELECT ticker, 'ret' AS name, ret AS x FROM v WHERE n > 10 UNION ALL SELECT ticker, 'vol_20', vol FROM v WHERE n > 10 UNION ALL SELECT ticker, 'flat', 1.0 FROM v WHERE n > 10)
SELECT ticker, name, count(*) - count(x) AS n_unsound, coalesce(stddev_samp(x) = 0, false) AS "constant" FROM l GROUP BY ticker, name"""),
    "top_counts": (top_counts, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 8"),
    "split_rows": (split_rows, _S + f" SELECT name AS split, count(*) AS n, min(date) AS a, max(date) AS b FROM ({DAILY}) d LEFT JOIN p ON d.date BETWEEN p.start AND p.\"end\" GROUP BY name"),
    "holdout_rows": (holdout_rows, _S + f" SELECT count(*) AS n FROM ({DAILY}) d JOIN p ON name = 'holdout' AND d.date BETWEEN p.start AND p.\"end\" WHERE d.date <= DATE '{FIT_END}'"),
    "split_faults": (split_faults, _S + f""", q AS (SELECT *, lag("end") OVER (ORDER BY start) AS before FROM p), g AS (SELECT name, n_sessions, start, "end", CASE WHEN before IS NOT NULL THEN (SELECT count(*) FROM s WHERE date > before AND date < start) END AS gap FROM q)
SELECT name, n_sessions = 0 AS empty, "end" < start AS unordered, gap, coalesce(gap < {EMBARGO + 1}, false) AS short FROM g"""),
    "fold_faults": (fold_faults, _S + f""", g AS (SELECT fold, fit_start <= fit_end AND fit_end < apply_start AND apply_start <= apply_end AS ordered, (SELECT count(*) FROM s WHERE date > fit_end AND date < apply_start) AS gap FROM f)
SELECT *, ordered AND gap >= {EMBARGO} AS ok FROM g"""),
    "fold_tiling": (fold_tiling, _S + ", g AS (SELECT * FROM f WHERE fold <> 3) SELECT date, count(apply_start) AS n FROM s LEFT JOIN g ON date BETWEEN apply_start AND apply_end WHERE date >= (SELECT min(apply_start) FROM g) GROUP BY date HAVING count(apply_start) <> 1"),
    "inner_split": (inner_split, f"""WITH x AS (SELECT date, ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n, CAST(floor(count(*) OVER (PARTITION BY ticker) * CAST(0.85 AS DOUBLE)) AS BIGINT) AS cut FROM ({WEEKLY}) WHERE date <= DATE '{FIT_END}'),
y AS (SELECT *, CASE WHEN n > cut THEN 'val' ELSE 'train' END AS part FROM x UNION ALL SELECT *, 'context' FROM x WHERE n <= cut AND n > cut - 9) SELECT ticker, part, count(*) AS n, min(date) AS a, max(date) AS b FROM y GROUP BY ALL"""),
    "weight_distances": (weight_distances, _W + ", d AS (SELECT decision, sum(abs(e - v)) / 2 AS d FROM k GROUP BY decision) SELECT 'equal' AS a, 'volume' AS b, round(avg(d), 6) AS distance FROM d"),
    "weight_faults": (weight_faults, _W + ", o AS (SELECT strategy, decision, sum(weight) AS total, count(*) FILTER (weight < -1e-9) AS n_negative, count(*) FILTER (weight > 0.35 + 1e-9) AS n_over FROM w GROUP BY ALL) SELECT strategy, decision, round(total, 6) AS total, n_negative, n_over FROM o WHERE abs(total - 1) > 1e-9 OR n_negative > 0 OR n_over > 0"),
    "table_differences": (table_differences, f"""WITH p AS ({WEEKLY}), o AS (SELECT date, ticker, close + CASE WHEN volume > 10 THEN 0.5 ELSE 0 END AS close, volume FROM p WHERE date >= DATE '1993-01-01')
SELECT name, count(*) FILTER (o.date IS NULL) AS only_left, count(*) FILTER (p.date IS NULL) AS only_right, round(max(CAST(CASE name WHEN 'close' THEN abs(p.close - o.close) ELSE abs(p.volume - o.volume) END AS DOUBLE)), 6) AS worst
FROM p FULL JOIN o ON p.date = o.date AND p.ticker = o.ticker, (VALUES ('close'), ('volume')) n(name) GROUP BY name"""),
    "parameter_digest": (parameter_digest, """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","region":' || n_regionkey || '}') AS digest FROM nation"""),
    "naive_error": (naive_error, _NX + " SELECT ticker, count(*) AS n, round(avg(pow(y + ret / 2, 2)), 6) AS mse FROM ok GROUP BY ticker"),
    "paired_losses": (paired_losses, _NX + ", d AS (SELECT ticker, pow(y + ret / 2, 2) - pow(y, 2) AS d FROM ok) SELECT ticker, count(*) AS n, round(avg(d), 6) AS mean_d, round(avg(d) * sqrt(count(*)) / stddev_samp(d), 4) AS t FROM d GROUP BY ticker"),
    "quantile_label": (quantile_label, RET + f", x AS (SELECT * FROM r WHERE ret IS NOT NULL), e AS (SELECT ticker, quantile_cont(ret, 0.8) AS edge FROM x WHERE date <= DATE '{FIT_END}' GROUP BY ticker) SELECT ticker, count(*) FILTER (ret > edge) AS n_above, count(*) AS n FROM x JOIN e USING (ticker) GROUP BY ticker"),
    "term_structure": (term_structure, f"SELECT date, round(ln(max(close) FILTER (ticker = 'AUTOMOBILE')) - ln(max(close) FILTER (ticker = 'BUILDING')), 6) AS term_structure FROM ({WEEKLY}) GROUP BY date"),
}
