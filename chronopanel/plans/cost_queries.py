"""Costs, exposures by regime, control states, seeds and stored results of runs on the weekly panel, with SQL for each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.operators import costs, features, regime, stats
from chronopanel.operators import portfolio as pf
from chronopanel.plans import model_queries as mq
from chronopanel.plans import portfolio_queries as pq
from chronopanel.plans import regime_queries as rq
from chronopanel.plans.feature_queries import RET, rounded
from chronopanel.plans.stream_queries import _work
from chronopanel.sources import results
from chronopanel.sources.panels import WEEKLY, weekly

BPS, COEFFICIENT, FACTORS, CASH = 5.0, 0.001, (0.0, 1.0, 2.0), "HOUSEHOLD"
CALM, STRESS, FLOOR = 1.2, 0.6, 0.05
MASTER = 7


def trade_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal and inverse-volatility weights, and a mix that leaves lines out in turn, so that some are sold whole."""
    decided, _ = pq._schedule(spark, sf_dir)
    vols = pf.trailing_vol(pq._prices(spark, sf_dir)).join(decided, "date").where("vol is not null").select(F.col("date").alias("decision"), "line", "vol")
    turns = vols.where(F.pmod(F.month("decision") + F.length("line"), F.lit(3)) > 0).select("decision", "line")
    weights = pf.inverse_vol_weights(vols).withColumn("strategy", F.lit("inverse_vol"))
    weights = weights.unionByName(pf.equal_weights(vols.select("decision", "line")).withColumn("strategy", F.lit("equal"))).unionByName(pf.equal_weights(turns).withColumn("strategy", F.lit("in_turn")))
    return rounded(costs.trade_costs(weights, vols, BPS, COEFFICIENT, FACTORS, CASH), "turnover", "cost", keys=("strategy", "decision", "factor"))


def regime_vol_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure of each ticker at a volatility target that falls with the filtered chance of the second state."""
    p = rq._posteriors(spark, sf_dir).select("date", "ticker", "p_1")
    vol = pf.trailing_vol(pq._prices(spark, sf_dir)).select("date", F.col("line").alias("ticker"), "vol")
    both = p.join(vol, ["date", "ticker"])
    return rounded(both.withColumn("exposure", costs.regime_exposure(F.col("p_1"), F.col("vol"), CALM, STRESS, FLOOR)), "exposure")


def metric_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundredth of the paths' gross returns, as in cost_sensitivity, before and after costs."""
    row = costs.metric_row(pq._drift(spark, sf_dir).withColumn("gross", F.col("gross") / 100), BPS)
    return rounded(row, *[c for c in row.columns if c not in ("strategy", "n")], keys=("strategy", "n"))


def derived_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seed for each ticker and year of the panel."""
    runs = weekly(spark, sf_dir).select("ticker", F.year("date").alias("year")).distinct()
    return runs.withColumn("seed", costs.derived_seed(MASTER, F.col("ticker"), F.col("year")))


def control_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State rows of two controls: the walk-forward threshold state as one-hot columns, and the posteriors smoothed over
    the whole series, which see the future and only serve as an upper bound."""
    panel = weekly(spark, sf_dir)
    held = regime.threshold_walkforward(features.log_returns(panel), rq._folds(panel), "ret").select("date", "ticker", "fold", *costs.one_hot(F.col("state"), 3, "state"))
    oracle = rq.scanned(spark, sf_dir).select("date", "ticker", *[F.round(F.col("smoothed")[j], 6).alias(f"oracle_{j}") for j in range(2)])
    return held.join(oracle, ["date", "ticker"])


def windows_with_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four returns with the next five weeks' return and volatility; windows at a series' end have no target
    and drop out."""
    panel = weekly(spark, sf_dir)
    x = stats.flat_windows(rq._returns(spark, sf_dir), ["ret"], 4)
    y = features.forward_vol_and_return(panel, (5,)).select("date", "ticker", "fwd_ret_5", "fwd_vol_5").where("fwd_ret_5 is not null")
    return rounded(x.join(y, ["date", "ticker"]), *[f"ret_t{k}" for k in range(4)], "fwd_ret_5", "fwd_vol_5")


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-years as runs: a ticker is a configuration, a year a seed."""
    half = F.ceil(F.month("date") / 6)
    one = pq._paths(spark, sf_dir).groupBy("strategy", F.year("date").alias("seed"), half.alias("half"))
    return one.agg(F.avg("net").alias("mean_net"), F.min("net").alias("worst")).select(F.lit("evaluate").alias("stage"), F.col("strategy").alias("config"), "seed", "mean_net", "worst")


def stored_seed_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs written as JSON in folders by stage, configuration and seed, those of the nineties read again by a pattern, and
    the bands of each configuration over them."""
    root = f"{_work(spark)}/results-{uuid.uuid4().hex}"
    results.write_results(_yearly(spark, sf_dir), root)
    # An empty table leaves no folder that a pattern could fit.
    found = results.read_results(spark, root, "mean_net double, worst double", "evaluate", "*", "199*")
    return rounded(costs.seed_bands(found, "config", ["mean_net", "worst"]), "mean", "sd", "low", "high", keys=("config", "metric", "n"))


_COSTS = pq._W + f""", al AS (SELECT strategy, decision, line, CAST(weight AS DOUBLE) AS weight FROM we
  UNION ALL SELECT 'in_turn', decision, line, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY decision) FROM dv WHERE (month(decision) + length(line)) % 3 > 0),
ca AS (SELECT strategy, decision, lag(decision) OVER (PARTITION BY strategy ORDER BY decision) AS prev FROM (SELECT DISTINCT strategy, decision FROM al)),
ln AS (SELECT ca.*, line FROM ca, (SELECT DISTINCT line FROM al)),
tr AS (SELECT ln.strategy, ln.decision, ln.line, coalesce(u.weight, 0) - coalesce(v.weight, 0) AS t FROM ln LEFT JOIN al u ON u.strategy = ln.strategy AND u.decision = ln.decision AND u.line = ln.line
  LEFT JOIN al v ON v.strategy = ln.strategy AND v.decision = ln.prev AND v.line = ln.line)
SELECT strategy, decision, factor, round(sum(abs(t)) / 2, 6) AS turnover, round(sum(CASE WHEN line = '{CASH}' THEN 0 ELSE abs(t) * ({BPS} / CAST(10000 AS DOUBLE) + {COEFFICIENT} * coalesce(vol, 0)) * factor END), 6) AS cost
FROM tr LEFT JOIN dv USING (decision, line), (SELECT CAST(unnest([0.0, 1.0, 2.0]) AS DOUBLE) AS factor) WHERE t <> 0 GROUP BY ALL"""

QUERIES = {
    "trade_costs": (trade_costs, _COSTS),
    "regime_vol_target": (regime_vol_target, rq._FILTER + f""", pr AS (SELECT date, ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS q FROM panel),
vo AS (SELECT date, ticker, CASE WHEN count(q) OVER w = 20 THEN stddev_samp(q) OVER w * sqrt(252) END AS vol FROM pr WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT date, ticker, round(CASE WHEN vol IS NOT NULL THEN least(1.0, greatest(0.0, ((1 - p_1) * {CALM} + p_1 * {STRESS}) / greatest(vol, {FLOOR}))) END, 6) AS exposure FROM po JOIN vo USING (date, ticker)"""),
    "metric_row_with_costs": (metric_row, pq._D + f""", ne AS (SELECT strategy, gross / 100 AS gross, gross / 100 - {BPS} / CAST(10000 AS DOUBLE) * turnover AS net, turnover FROM dr),
o AS (SELECT strategy, count(*) AS n, product(1 + gross) AS g, product(1 + net) AS k, avg(net) AS m, stddev_samp(net) AS s, avg(turnover) AS t FROM ne GROUP BY strategy),
gw AS (SELECT *, CASE WHEN g <= 0 THEN -1 ELSE pow(g, 252.0 / n) - 1 END AS gg, CASE WHEN k <= 0 THEN -1 ELSE pow(k, 252.0 / n) - 1 END AS kk FROM o)
SELECT strategy, n, round(gg, 6) AS gross_return, round(kk, 6) AS net_return, round(gg - kk, 6) AS cost_drag, round(s * sqrt(252), 6) AS net_vol, round(m * sqrt(252) / nullif(s, 0), 6) AS net_sharpe, round(t * 252, 6) AS turnover FROM gw"""),
    "derived_seeds": (derived_seeds, f"""SELECT ticker, CAST(y AS INTEGER) AS year, CAST('0x' || substr(sha256('{MASTER}|' || ticker || '|' || CAST(y AS VARCHAR)), 1, 8) AS BIGINT) AS seed
FROM (SELECT DISTINCT ticker, year(date) AS y FROM ({WEEKLY}) panel)"""),
    "control_states": (control_states, mq._SMOOTH.rsplit("\nSELECT", 1)[0] + rq._FOLDS + """ SELECT tw.date, tw.ticker, fold, CAST(state = 0 AS DOUBLE) AS state_0, CAST(state = 1 AS DOUBLE) AS state_1, CAST(state = 2 AS DOUBLE) AS state_2,
  round(a0 * v0 / (a0 * v0 + a1 * v1), 6) AS oracle_0, round(a1 * v1 / (a0 * v0 + a1 * v1), 6) AS oracle_1 FROM tw JOIN f ON f.ticker = tw.ticker AND f.date = tw.date JOIN z ON z.ticker = f.ticker AND z.n = f.n"""),
    "windows_with_targets": (windows_with_targets, RET + """, x AS (SELECT * FROM r WHERE ret IS NOT NULL), l AS (SELECT date, ticker, lag(ret, 3) OVER w AS r3, lag(ret, 2) OVER w AS r2, lag(ret, 1) OVER w AS r1, ret AS r0 FROM x WINDOW w AS (PARTITION BY ticker ORDER BY date)),
y AS (SELECT date, ticker, CASE WHEN count(ret) OVER f = 5 THEN sum(ret) OVER f END AS t, CASE WHEN count(ret) OVER f = 5 THEN stddev_samp(ret) OVER f * sqrt(252) END AS v FROM r WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
SELECT date, ticker, round(r0, 6) AS ret_t0, round(r1, 6) AS ret_t1, round(r2, 6) AS ret_t2, round(r3, 6) AS ret_t3, round(t, 6) AS fwd_ret_5, round(v, 6) AS fwd_vol_5 FROM l JOIN y USING (date, ticker) WHERE r3 IS NOT NULL AND t IS NOT NULL"""),
    "stored_seed_bands": (stored_seed_bands, pq._P + """, h AS (SELECT strategy AS config, year(date) AS seed, ceil(month(date) / 6) AS half, avg(net) AS mean_net, min(net) AS worst FROM pa WHERE year(date) BETWEEN 1990 AND 1999 GROUP BY ALL),
e AS (UNPIVOT h ON mean_net, worst INTO NAME metric VALUE value), m AS (SELECT config, metric, seed, avg(value) AS v FROM e GROUP BY ALL)
SELECT config, metric, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS low, round(max(v), 6) AS high FROM m GROUP BY ALL"""),
}
