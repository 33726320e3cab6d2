"""Regime, episode and encoder queries, with SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.operators import calendar as cal
from chronopanel.operators import features, markov, regime, stats
from chronopanel.plans.feature_queries import RET, rounded
from chronopanel.sources.panels import WEEKLY, table, weekly

#: Fixed parameters of the filter query: two states, calm and wild weeks.
START, MOVES, MEANS, STDS = [0.5, 0.5], [[0.95, 0.05], [0.10, 0.90]], [0.0, 0.0], [0.05, 0.15]
FIRST_APPLY = "1997-01-15"


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.log_returns(weekly(spark, sf_dir)).where("ret is not null")


def _folds(panel: DataFrame) -> DataFrame:
    return cal.expanding_folds(cal.observed(panel), FIRST_APPLY, "year", 5)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-sample thirds of each ticker's returns."""
    from pyspark.sql import Window

    return _returns(spark, sf_dir).withColumn("state", (F.ntile(3).over(Window.partitionBy("ticker").orderBy("ret", "date")) - 1).cast("int")).select("date", "ticker", "state", "ret")


def threshold_walkforward(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = weekly(spark, sf_dir)
    return regime.threshold_walkforward(features.log_returns(panel), _folds(panel), "ret")


def state_characterisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _states(spark, sf_dir)
    return rounded(regime.state_statistics(s.drop("state"), s.drop("ret")), "n", "share", "ann_mean", "ann_vol", "mean_dd", "worst_dd", "mean_run", keys=("ticker", "state"))


def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regime.transitions(_states(spark, sf_dir)).select("ticker", "a", "b", "n", F.round("p", 6).alias("p"))


def dwell_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.percentile("length", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return regime.dwell(_states(spark, sf_dir)).groupBy("ticker", "state").agg(F.count(F.lit(1)).alias("runs"), q.alias("q")).select("ticker", "state", "runs", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)])


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed model's posteriors of every ticker's returns, in blocks of a year."""
    rows = _returns(spark, sf_dir)
    return markov.posteriors(rows, fixed_models(rows), ["ticker"], "ret")


def fixed_models(rows: DataFrame) -> DataFrame:
    """The fixed model of every ticker."""
    given = {"k": F.lit(2), "start": F.lit(START), "move": F.lit([x for r in MOVES for x in r]), "mean": F.lit(MEANS), "std": F.lit(STDS)}
    return rows.select("ticker").distinct().withColumns(given)


def _posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir).select("date", "ticker", *[F.col("filtered")[j].alias(f"p_{j}") for j in range(2)], "loglik")


def hmm_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_posteriors(spark, sf_dir), "p_0", "p_1", "loglik")


def posterior_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regime.posterior_quality(_posteriors(spark, sf_dir), 2), "entropy", "median_top", "flip_rate", keys=("ticker",))


def bear_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regime.bear_episodes(weekly(spark, sf_dir))


def drawdown_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regime.drawdown_episodes(weekly(spark, sf_dir)), "depth", keys=("ticker", "peak", "trough", "recovery"))


def episode_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log return of the decline and of the recovery of each drawdown episode."""
    panel = features.log_returns(weekly(spark, sf_dir))
    e = regime.drawdown_episodes(weekly(spark, sf_dir)).alias("e")
    p = panel.alias("p")
    last = F.expr("coalesce(e.recovery, date '9999-12-31')")
    j = e.join(p, (F.col("e.ticker") == F.col("p.ticker")) & (F.col("p.date") > F.col("e.peak")) & (F.col("p.date") <= last))
    out = j.groupBy("e.ticker", "e.peak").agg(F.sum(F.when(F.expr("p.date <= e.trough"), F.col("p.ret"))).alias("decline"), F.sum(F.when(F.expr("p.date > e.trough"), F.col("p.ret"))).alias("recovery"))
    return rounded(out, "decline", "recovery", keys=("ticker", "peak"))


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the last 8 weeks with a negative return, as an alarm signal."""
    from chronopanel.functions.windows import full, trailing

    return _returns(spark, sf_dir).withColumn("neg", (F.col("ret") < 0).cast("double")).withColumn("p", full(F.avg, "neg", trailing(8), 8)).where("p is not null").select("date", "ticker", "p")


def episode_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = weekly(spark, sf_dir)
    return regime.detection(regime.bear_episodes(panel), _signal(spark, sf_dir), cal.numbered(cal.observed(panel)), 0.6, 20)


def detection_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alarm signal at two thresholds."""
    panel = weekly(spark, sf_dir)
    episodes, sessions = regime.bear_episodes(panel), cal.numbered(cal.observed(panel))
    found = [regime.detection(episodes, _signal(spark, sf_dir), sessions, t, 20) for t in (0.45, 0.6)]
    return rounded(regime.compare_detection(*found), "lag_a", "lag_b", keys=("ticker", "episodes", "missed_a", "missed_b", "a_wins"))


def false_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regime.false_alarms(regime.bear_episodes(weekly(spark, sf_dir)), _signal(spark, sf_dir), 0.6), "rate", keys=("ticker",))


def hmm_em_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regime.fit_hmms(_returns(spark, sf_dir), "ret")


def hmm_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regime.select_fits(regime.fit_hmms(_returns(spark, sf_dir), "ret"), 1.2)


def windows_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.flat_windows(_returns(spark, sf_dir), ["ret"], 4), *[f"ret_t{k}" for k in range(4)])


def rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.rolling_stats(_returns(spark, sf_dir), "ret", 30), "mean", "std", "skew", "kurt")


def dead_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.unit_variance(table(spark, sf_dir, "embeddings"), "embedding").select("unit", F.round("variance", 6).alias("variance"), "dead")


def pca_latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pca_latents(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", 8)


def random_latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.random_projection(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", 8)


def state_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks joined on date and ticker: volatility, state of the walk-forward thresholds, and the next five weeks' return,
    where all are known."""
    panel = weekly(spark, sf_dir)
    vol, target = features.realised_vol(panel, (20,)).select("date", "ticker", "vol_20"), features.forward_vol_and_return(panel, (5,)).select("date", "ticker", "fwd_ret_5")
    state = regime.threshold_walkforward(features.log_returns(panel), _folds(panel), "ret").select("date", "ticker", "state")
    return rounded(vol.join(state, ["date", "ticker"]).join(target, ["date", "ticker"]).dropna(), "state", "vol_20", "fwd_ret_5")


_X = RET + ", x AS (SELECT * FROM r WHERE ret IS NOT NULL)"
_ST = _X + ", st AS (SELECT *, CAST(ntile(3) OVER (PARTITION BY ticker ORDER BY ret, date) - 1 AS INTEGER) AS state FROM x)"
_RUNS = """, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM st), g AS (SELECT *, n - row_number() OVER (PARTITION BY ticker, state ORDER BY n) AS g FROM k),
dw AS (SELECT ticker, state, g, count(*) AS length FROM g GROUP BY ALL)"""
_FOLDS = f""", s AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS ord FROM (SELECT DISTINCT date FROM panel)),
q AS (SELECT DATE '{FIRST_APPLY}' AS a UNION SELECT CAST(y AS DATE) FROM (SELECT unnest(generate_series(date_trunc('year', DATE '{FIRST_APPLY}'), (SELECT max(date) FROM s), INTERVAL 1 YEAR)) AS y) WHERE y > DATE '{FIRST_APPLY}'),
w AS (SELECT a, coalesce(lead(a) OVER (ORDER BY a), (SELECT max(date) + 1 FROM s)) AS b FROM q),
gg AS (SELECT a, min(date) AS apply_start, max(date) AS apply_end, min(ord) AS o FROM w JOIN s ON date >= a AND date < b GROUP BY a),
fo AS (SELECT CAST(row_number() OVER (ORDER BY a) - 1 AS INTEGER) AS fold, s.date AS fit_end, apply_start, apply_end FROM gg JOIN s ON s.ord = o - 6),
ed AS (SELECT fold, ticker, quantile_cont(ret, CAST(1 AS DOUBLE) / 3) AS e1, quantile_cont(ret, CAST(2 AS DOUBLE) / 3) AS e2 FROM fo JOIN r ON date <= fit_end GROUP BY fold, ticker),
tw AS (SELECT r.date, r.ticker, fo.fold, CASE WHEN ret IS NOT NULL THEN CAST(e1 <= ret AS INTEGER) + CAST(e2 <= ret AS INTEGER) END AS state FROM r JOIN fo ON r.date BETWEEN apply_start AND apply_end JOIN ed ON ed.fold = fo.fold AND ed.ticker = r.ticker)"""


def _n(j: int) -> str:
    return f"exp(-0.5 * pow((v - {MEANS[j]}) / {STDS[j]}, 2)) / ({STDS[j]} * sqrt(2 * pi()))"


_FILTER = _X.replace("WITH", "WITH RECURSIVE", 1) + f""", o AS (SELECT ticker, date, CAST(ret AS DOUBLE) AS v, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM x),
b AS (SELECT *, {_n(0)} AS b0, {_n(1)} AS b1 FROM o),
f(ticker, n, date, a0, a1) AS (
  SELECT ticker, n, date, {START[0]} * b0, {START[1]} * b1 FROM b WHERE n = 1
  UNION ALL SELECT b.ticker, b.n, b.date, (f.a0 / (f.a0 + f.a1) * {MOVES[0][0]} + f.a1 / (f.a0 + f.a1) * {MOVES[1][0]}) * b0, (f.a0 / (f.a0 + f.a1) * {MOVES[0][1]} + f.a1 / (f.a0 + f.a1) * {MOVES[1][1]}) * b1
  FROM f JOIN b ON b.ticker = f.ticker AND b.n = f.n + 1),
po AS (SELECT date, ticker, a0 / (a0 + a1) AS p_0, a1 / (a0 + a1) AS p_1, ln(a0 + a1) AS loglik FROM f)"""

_BEAR = f"""WITH panel AS ({WEEKLY}), p AS (SELECT *, max(close) OVER w AS peak, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS nxt FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)),
fr AS (SELECT *, CASE WHEN coalesce(peak > lag(peak) OVER (PARTITION BY ticker ORDER BY date), true) THEN date END AS fresh, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM p),
pd AS (SELECT *, last_value(fresh IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS peak_date FROM fr),
dn AS (SELECT *, n - row_number() OVER (PARTITION BY ticker ORDER BY n) AS g FROM pd WHERE close / peak - 1 <= -0.2),
be AS (SELECT ticker, arg_min(peak_date, date) AS start, coalesce(arg_max(nxt, date), max(date)) AS "end" FROM dn GROUP BY ticker, g)"""
# arg_max skips rows whose value is NULL, so the end is taken again from the last row of a run
_BEAR = _BEAR.replace('coalesce(arg_max(nxt, date), max(date)) AS "end"', 'CASE WHEN max(date) = max(CASE WHEN nxt IS NULL THEN date END) THEN max(date) ELSE max(nxt) END AS "end"')

_DRAW = f"""WITH panel AS ({WEEKLY}), t AS (SELECT *, CASE WHEN coalesce(close >= max(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1 ELSE 0 END AS t FROM panel),
g AS (SELECT *, sum(t) OVER (PARTITION BY ticker ORDER BY date) AS g FROM t),
e AS (SELECT ticker, g, min(date) AS peak, arg_min(close, date) AS high, arg_min(date, row(close, date)) AS trough, min(close) AS low, count(*) AS n FROM g GROUP BY ticker, g),
ep AS (SELECT *, lead(peak) OVER (PARTITION BY ticker ORDER BY g) AS recovery, low / high - 1 AS depth FROM e),
de AS (SELECT ticker, peak, trough, recovery, depth FROM ep WHERE n > 1 AND depth <= -0.1)"""

_SIGNAL = _BEAR + f""", rx AS (SELECT * FROM (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY date) AS ret FROM panel) WHERE ret IS NOT NULL),
ng AS (SELECT *, CASE WHEN ret < 0 THEN 1.0 ELSE 0.0 END AS neg FROM rx),
si AS (SELECT * FROM (SELECT date, ticker, CASE WHEN count(*) OVER w = 8 THEN avg(CAST(neg AS DOUBLE)) OVER w END AS p FROM ng WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) WHERE p IS NOT NULL)"""

QUERIES = {
    "threshold_regime_walkforward": (threshold_walkforward, RET + _FOLDS + " SELECT date, ticker, fold, state FROM tw"),
    "state_characterisation": (state_characterisation, _ST + _RUNS + """, c AS (SELECT *, exp(sum(ret) OVER (PARTITION BY ticker ORDER BY date)) AS cu FROM st),
d AS (SELECT *, cu / greatest(max(cu) OVER (PARTITION BY ticker ORDER BY date), 1.0) - 1 AS dd FROM c),
a AS (SELECT ticker, state, count(*) AS n, avg(ret) * 252 AS m, stddev_samp(ret) * sqrt(252) AS v, avg(dd) AS md, min(dd) AS wd FROM d GROUP BY ticker, state)
SELECT ticker, state, n, round(n / sum(n) OVER (PARTITION BY ticker), 6) AS share, round(m, 6) AS ann_mean, round(v, 6) AS ann_vol, round(md, 6) AS mean_dd, round(wd, 6) AS worst_dd, round(l, 6) AS mean_run
FROM a JOIN (SELECT ticker, state, avg(length) AS l FROM dw GROUP BY ALL) USING (ticker, state)"""),
    "transition_matrix": (transition_matrix, _ST + """, m AS (SELECT ticker, state AS a, lead(state) OVER (PARTITION BY ticker ORDER BY date) AS b FROM st), c AS (SELECT ticker, a, b, count(*) AS n FROM m WHERE b IS NOT NULL GROUP BY ALL)
SELECT ticker, a, b, n, round(n / sum(n) OVER (PARTITION BY ticker, a), 6) AS p FROM c"""),
    "dwell_quartiles": (dwell_quartiles, _ST + _RUNS + " SELECT ticker, state, count(*) AS runs, CAST(quantile_cont(length, 0.25) AS DOUBLE) AS q1, CAST(quantile_cont(length, 0.5) AS DOUBLE) AS q2, CAST(quantile_cont(length, 0.75) AS DOUBLE) AS q3 FROM dw GROUP BY ticker, state"),
    "hmm_filter_fixed_params": (hmm_filter, _FILTER + " SELECT date, ticker, round(p_0, 6) AS p_0, round(p_1, 6) AS p_1, round(loglik, 6) AS loglik FROM po"),
    "posterior_quality": (posterior_quality, _FILTER + """, z AS (SELECT *, CASE WHEN p_0 >= p_1 THEN 0 ELSE 1 END AS st FROM po), y AS (SELECT *, st <> lag(st) OVER (PARTITION BY ticker ORDER BY date) AS fl FROM z)
SELECT ticker, round(avg(-(CASE WHEN p_0 > 0 THEN p_0 * ln(p_0) ELSE 0 END) - (CASE WHEN p_1 > 0 THEN p_1 * ln(p_1) ELSE 0 END)), 6) AS entropy, round(median(greatest(p_0, p_1)), 6) AS median_top, round(avg(CASE WHEN fl THEN 1.0 WHEN NOT fl THEN 0.0 END), 6) AS flip_rate FROM y GROUP BY ticker"""),
    "bear_episodes": (bear_episodes, _BEAR + ' SELECT ticker, start, "end" FROM be'),
    "drawdown_episodes": (drawdown_episodes, _DRAW + " SELECT ticker, peak, trough, recovery, round(depth, 6) AS depth FROM de"),
    "episode_performance": (episode_performance, _DRAW + """, rt AS (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY date) AS ret FROM panel)
SELECT de.ticker, de.peak, round(sum(ret) FILTER (rt.date <= trough), 6) AS decline, round(sum(ret) FILTER (rt.date > trough), 6) AS recovery FROM de JOIN rt ON rt.ticker = de.ticker AND rt.date > de.peak AND (de.recovery IS NULL OR rt.date <= de.recovery) GROUP BY de.ticker, de.peak"""),
    "episode_detection": (episode_detection, _SIGNAL + """, s AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS ord FROM (SELECT DISTINCT date FROM panel)),
e AS (SELECT be.*, a.ord AS ao, b.ord AS bo FROM be JOIN s a ON a.date = be.start JOIN s b ON b.date = be."end"), h AS (SELECT ticker, ord FROM si JOIN s USING (date) WHERE p > 0.6)
SELECT e.ticker, e.start, e."end", min(h.ord) - e.ao AS lag FROM e LEFT JOIN h ON h.ticker = e.ticker AND h.ord BETWEEN ao - 20 AND bo GROUP BY e.ticker, e.start, e."end", e.ao"""),
    "detection_comparison": (detection_comparison, _SIGNAL + """, s AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS ord FROM (SELECT DISTINCT date FROM panel)),
e AS (SELECT be.*, a.ord AS ao, b.ord AS bo FROM be JOIN s a ON a.date = be.start JOIN s b ON b.date = be."end"), h AS (SELECT ticker, ord, p FROM si JOIN s USING (date)),
l AS (SELECT e.ticker, e.start, min(h.ord) FILTER (p > 0.45) - e.ao AS la, min(h.ord) FILTER (p > 0.6) - e.ao AS lb FROM e LEFT JOIN h ON h.ticker = e.ticker AND h.ord BETWEEN ao - 20 AND bo GROUP BY e.ticker, e.start, e."end", e.ao),
t AS (SELECT ticker, count(*) AS episodes, count(*) - count(la) AS missed_a, count(*) - count(lb) AS missed_b, avg(la) AS lag_a, avg(lb) AS lag_b FROM l GROUP BY ticker)
SELECT ticker, episodes, missed_a, missed_b, missed_a = 0 AND (missed_b > 0 OR coalesce(lag_a < lag_b, false)) AS a_wins, round(lag_a, 6) AS lag_a, round(lag_b, 6) AS lag_b FROM t"""),
    "false_alarm": (false_alarm, _SIGNAL + ' SELECT ticker, round(avg(CASE WHEN p > 0.6 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM si WHERE NOT EXISTS (SELECT 1 FROM be WHERE be.ticker = si.ticker AND si.date BETWEEN be.start AND be."end") GROUP BY ticker'),
    "hmm_em_fit": (hmm_em_fit, None),
    "hmm_selected": (hmm_selected, None),
    "windows_flatten": (windows_flatten, _X + " SELECT * FROM (SELECT date, ticker, " + ", ".join(f"round(lag(ret, {k}) OVER w, 6) AS ret_t{k}" for k in range(4)) + " FROM x WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE ret_t3 IS NOT NULL"),
    "rolling_stats_encode": (rolling_stats, _X + """, c AS (SELECT *, count(*) OVER w AS n, avg(ret) OVER w AS mean, stddev_samp(ret) OVER w AS sd, skewness(ret) OVER w AS sk, kurtosis(ret) OVER w AS ku FROM x WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT date, ticker, round(mean, 6) AS mean, round(sd, 6) AS std, round(coalesce(sk, 0), 6) AS skew, round(coalesce(ku, 0), 6) AS kurt FROM c WHERE n = 30"""),
    "dead_units": (dead_units, "WITH u AS (SELECT CAST(unnest(range(len(embedding))) AS INTEGER) AS unit, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT unit, round(var_samp(x), 6) AS variance, var_samp(x) < 0.0001 AS dead FROM u GROUP BY unit"),
    "pca_latents": (pca_latents, None),
    "random_encoder_latents": (random_latents, None),
    "state_assembly": (state_assembly, RET + _FOLDS + """, v AS (SELECT date, ticker, CASE WHEN count(ret) OVER b = 20 THEN stddev_samp(ret) OVER b * sqrt(252) END AS vol_20, CASE WHEN count(ret) OVER f = 5 THEN sum(ret) OVER f END AS fwd_ret_5 FROM r
  WINDOW b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
SELECT date, ticker, state, round(vol_20, 6) AS vol_20, round(fwd_ret_5, 6) AS fwd_ret_5 FROM v JOIN tw USING (date, ticker) WHERE state IS NOT NULL AND vol_20 IS NOT NULL AND fwd_ret_5 IS NOT NULL"""),
}
