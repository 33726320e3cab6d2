"""Portfolio, performance, resampling and probe queries on the weekly panel, with SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.functions.windows import full, trailing
from chronopanel.operators import calendar as cal
from chronopanel.operators import covariance, features, stats
from chronopanel.operators import portfolio as pf
from chronopanel.plans.feature_queries import RET, TICKERS, rounded
from chronopanel.plans.regime_queries import _folds
from chronopanel.sources.panels import WEEKLY, weekly

#: The largest weight of a line where weights are capped.
CAP = 0.35


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly(spark, sf_dir).select("date", F.col("ticker").alias("line"), "close")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ticker as a strategy: a hundredth of its simple returns, to keep the synthetic prices' moves in bounds."""
    return pf.simple_returns(_prices(spark, sf_dir)).where("r is not null").select(F.col("line").alias("strategy"), "date", (F.col("r") / 100).alias("net"))


def _schedule(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Decisions every fourth ISO week, and their holding periods."""
    sessions = cal.observed(weekly(spark, sf_dir))
    decided = cal.decisions(sessions).where("iso_week % 4 = 0").select("date")
    return decided, cal.holding_periods(sessions, decided=decided)


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(strategy, decision, line, weight): equal weights and inverse volatility at each decision."""
    decided, _ = _schedule(spark, sf_dir)
    vols = pf.trailing_vol(_prices(spark, sf_dir)).join(decided, "date").where("vol is not null").select(F.col("date").alias("decision"), "line", "vol")
    equal = pf.equal_weights(vols.select("decision", "line")).withColumn("strategy", F.lit("equal"))
    return pf.inverse_vol_weights(vols).withColumn("strategy", F.lit("inverse_vol")).unionByName(equal)


def equity_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pf.equity(_paths(spark, sf_dir)), "equity", "drawdown", keys=("strategy", "date"))


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pf.performance(_paths(spark, sf_dir))
    return rounded(p, *[c for c in p.columns if c not in ("strategy", "n", "dd_length")], keys=("strategy", "n", "dd_length"))


def calendar_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).groupBy("strategy", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.round(F.product(1 + F.col("net")) - 1, 6).alias("ret"), F.round(F.stddev_samp("net"), 6).alias("sd"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_weights(spark, sf_dir), "weight", keys=("strategy", "decision", "line"))


def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pf.turnover(_weights(spark, sf_dir)), "turnover", keys=("strategy", "decision"))


def vol_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pf.vol_target(pf.trailing_vol(_prices(spark, sf_dir)), target=1.0), "exposure", keys=("date", "line"))


def period_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pf.period_returns(_weights(spark, sf_dir), _schedule(spark, sf_dir)[1], _prices(spark, sf_dir), 0.0005), "ret", keys=("strategy", "decision"))


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _prices(spark, sf_dir)
    sessions = prices.select("date").distinct()
    dense = sessions.crossJoin(prices.select("line").distinct()).join(pf.simple_returns(prices).select("date", "line", "r"), ["date", "line"], "left")
    return pf.drift(_weights(spark, sf_dir), _schedule(spark, sf_dir)[1], dense)


def drift_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pf.net(_drift(spark, sf_dir), 10.0), "gross", "turnover", "net", keys=("strategy", "date"))


def cost_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _drift(spark, sf_dir).withColumn("gross", F.col("gross") / 100)
    return rounded(pf.cost_sensitivity(p), "nav", keys=("strategy", "bps"))


def capped_simplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's mean return of twenty weeks as a raw weight, brought to the nearest weights of at most CAP."""
    scores = pf.simple_returns(_prices(spark, sf_dir)).withColumn("score", full(F.avg, "r", trailing(20, ("line",)), 20))
    return rounded(covariance.simplex_rows(scores, F.lit(CAP), ["date"]), "weight", keys=("date", "line"))


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covariance.pair_moments(features.log_returns(weekly(spark, sf_dir)), TICKERS)


def shrunk_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(covariance.shrunk(_moments(spark, sf_dir), TICKERS), "cov", "intensity", keys=("date", "a", "b"))


def eigenvalue_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(covariance.first_eigenvalue_share(_moments(spark, sf_dir)), "share", keys=("date",))


def optimal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(covariance.optimal_weights(_moments(spark, sf_dir), TICKERS), "mv_weight", "min_var_weight", keys=("date", "line"))


def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.deflated_sharpe(_paths(spark, sf_dir)), "sharpe", "benchmark", "z", keys=("strategy",))


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of each ticker to the average, by year, with a normal interval: gates over the years."""
    p = _paths(spark, sf_dir)
    d = p.join(p.groupBy("date").agg(F.avg("net").alias("m")), "date").groupBy(F.col("strategy").alias("name"), F.year("date").alias("target"))
    half = 1.96 * F.stddev_samp(F.col("net") - F.col("m")) / F.sqrt(F.count(F.lit(1)))
    mean = F.avg(F.col("net") - F.col("m"))
    return stats.gates(d.agg((mean - half).alias("low"), (mean + half).alias("high")), lower_is_better=False, needed=1)


def _design(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    panel = weekly(spark, sf_dir)
    both = features.forward_vol_and_return(panel, (5,)).select("date", "ticker", "fwd_ret_5").join(features.realised_vol(panel, (20,)).select("date", "ticker", "ret", "vol_20"), ["date", "ticker"])
    return both, _folds(panel)


def oos_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last return, reversed, as a naive forecast of the next one, against the mean up to 1999."""
    rows = features.log_returns(weekly(spark, sf_dir)).withColumn("y", F.lead("ret").over(Window.partitionBy("ticker").orderBy("date"))).dropna(subset=["ret", "y"])
    base = rows.where("date <= date '1999-12-31'").groupBy("ticker").agg(F.avg("y").alias("base"))
    test = rows.where("date > date '1999-12-31'").join(base, "ticker").withColumn("pred", -F.col("ret") / 2)
    return rounded(stats.oos_r2(test, ["ticker"]), "r2", keys=("ticker",))


def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the last return tells falls from rises of the next."""
    rows = features.log_returns(weekly(spark, sf_dir)).withColumn("y", F.lead("ret").over(Window.partitionBy("ticker").orderBy("date"))).dropna(subset=["ret", "y"])
    return rounded(stats.auc(rows.select("ticker", F.round("ret", 2).alias("score"), (F.col("y") < 0).cast("long").alias("label")), ["ticker"]), "auc", keys=("ticker",))


def tuning_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years as configurations: mean Sharpe over tickers, the best first, the earliest of equals."""
    one = _paths(spark, sf_dir).groupBy("strategy", F.year("date").alias("config")).agg((F.avg("net") / F.stddev_samp("net")).alias("s"))
    table = one.groupBy("config").agg(F.round(F.avg("s"), 6).alias("score"), F.count(F.lit(1)).alias("seeds"))
    return table.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "config")))


_P = f"""WITH panel AS ({WEEKLY}), pr AS (SELECT date, ticker AS line, close, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM panel),
pa AS (SELECT line AS strategy, date, r / 100 AS net FROM pr WHERE r IS NOT NULL)"""
_EQ = _P + """, e AS (SELECT *, product(1 + net) OVER (PARTITION BY strategy ORDER BY date) AS equity FROM pa), dd AS (SELECT *, equity / greatest(max(equity) OVER (PARTITION BY strategy ORDER BY date), 1.0) - 1 AS drawdown FROM e)"""
_V = _P + """, vo AS (SELECT date, line, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w * sqrt(252) END AS vol FROM pr WINDOW w AS (PARTITION BY line ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
_W = _V + """, s AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS ord FROM (SELECT DISTINCT date FROM panel)),
de AS (SELECT max(date) AS date FROM s WHERE isodow(date) <= 5 GROUP BY isoyear(date), week(date) HAVING week(max(date)) % 4 = 0),
dv AS (SELECT date AS decision, line, vol FROM vo JOIN de USING (date) WHERE vol IS NOT NULL),
we AS (SELECT 'inverse_vol' AS strategy, decision, line, coalesce(CASE WHEN vol > 0 THEN 1 / vol END / sum(CASE WHEN vol > 0 THEN 1 / vol END) OVER (PARTITION BY decision), 0) AS weight FROM dv
  UNION ALL SELECT 'equal', decision, line, 1.0 / count(*) OVER (PARTITION BY decision) FROM dv),
ex AS (SELECT de.date AS decision, ord + 1 AS a FROM de JOIN s USING (date) WHERE ord + 1 <= (SELECT max(ord) FROM s)),
hp AS (SELECT decision, x.date AS start, y.date AS "end" FROM (SELECT decision, a, coalesce(lead(a) OVER (ORDER BY a), (SELECT max(ord) FROM s)) AS b FROM ex) p JOIN s x ON x.ord = a JOIN s y ON y.ord = b WHERE b > a)"""
_D = _W + """, dense AS (SELECT s.date, l.line, pr.r FROM s CROSS JOIN (SELECT DISTINCT line FROM pr) l LEFT JOIN pr ON pr.date = s.date AND pr.line = l.line),
dy AS (SELECT strategy, we.decision, start, "end", we.line, d.date, weight * product(1 + coalesce(r, 0)) OVER (PARTITION BY strategy, we.line, we.decision ORDER BY d.date) AS value
  FROM we JOIN hp USING (decision) JOIN dense d ON d.line = we.line AND d.date > start AND d.date <= "end"),
tt AS (SELECT strategy, decision, date, sum(value) AS total FROM dy GROUP BY ALL),
gr AS (SELECT strategy, date, total / coalesce(lag(total) OVER (PARTITION BY strategy, decision ORDER BY date), 1) - 1 AS gross FROM tt),
en AS (SELECT dy.strategy, line, dy.date AS start, value / total AS old FROM dy JOIN tt USING (strategy, decision, date) WHERE dy.date = dy."end"),
sg AS (SELECT strategy, line, weight, decision, start FROM we JOIN hp USING (decision)),
mo AS (SELECT coalesce(sg.strategy, en.strategy) AS strategy, coalesce(sg.start, en.start) AS date, count(decision) AS k, sum(abs(coalesce(weight, 0) - coalesce(old, 0))) / 2 AS turnover
  FROM sg FULL JOIN en ON sg.strategy = en.strategy AND sg.line = en.line AND sg.start = en.start GROUP BY 1, 2),
dr AS (SELECT strategy, date, coalesce(gross, 0) AS gross, coalesce(turnover, 0) AS turnover FROM gr FULL JOIN (SELECT * FROM mo WHERE k > 0) m USING (strategy, date))"""
_NEXT = RET + ", nx AS (SELECT *, lead(ret) OVER (PARTITION BY ticker ORDER BY date) AS y FROM r), ok AS (SELECT * FROM nx WHERE ret IS NOT NULL AND y IS NOT NULL)"

#: The shift is linear between the points at which a weight leaves 0 or reaches its cap.
_SIMPLEX = _P + f""", sc AS (SELECT * FROM (SELECT date, line, CASE WHEN count(r) OVER w = 20 THEN avg(r) OVER w END AS x FROM pr WINDOW w AS (PARTITION BY line ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE x IS NOT NULL),
bp AS (SELECT DISTINCT date, t FROM (SELECT date, x AS t FROM sc UNION ALL SELECT date, x - {CAP} FROM sc)),
ft AS (SELECT bp.date, t, sum(least(greatest(x - t, 0), {CAP})) AS f FROM bp JOIN sc USING (date) GROUP BY bp.date, t HAVING count(*) * {CAP} >= 1),
nx AS (SELECT *, lead(t) OVER w AS t1, lead(f) OVER w AS f1 FROM ft WINDOW w AS (PARTITION BY date ORDER BY t)),
sh AS (SELECT date, max(CASE WHEN f1 IS NULL OR f = f1 THEN t ELSE t + (f - 1) / (f - f1) * (t1 - t) END) AS t FROM nx WHERE f >= 1 AND coalesce(f1, 0) < 1 GROUP BY date)
SELECT date, line, round(least(greatest(x - t, 0), CAST({CAP} AS DOUBLE)), 6) AS weight FROM sc JOIN sh USING (date)"""
_PAIRS = RET + f""", hl AS (SELECT date, ticker, ret FROM r WHERE ret IS NOT NULL QUALIFY count(*) OVER (PARTITION BY date) = {len(TICKERS)}),
pq AS (SELECT u.date, u.ticker AS a, v.ticker AS b, u.ret AS x, v.ret AS y FROM hl u JOIN hl v ON u.date = v.date AND u.ticker <= v.ticker),
wl AS (SELECT date, a, b, list(x) OVER w AS xs, list(y) OVER w AS ys FROM pq WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
dv AS (SELECT date, a, b, list_transform(list_zip(xs, ys), lambda z: (z[1] - list_avg(xs)) * (z[2] - list_avg(ys))) AS d FROM wl WHERE len(xs) = 60),
pm AS (SELECT date, a, b, list_avg(d) AS cov, list_avg(list_transform(d, lambda z: z * z)) AS q FROM dv)"""
_SHRUNK = _PAIRS + f""", dt AS (SELECT date, sum(cov) FILTER (a = b) / {len(TICKERS)} AS m, sum(cov * cov * CASE WHEN a = b THEN 1 ELSE 2 END) AS s, sum(q * CASE WHEN a = b THEN 1 ELSE 2 END) AS q FROM pm GROUP BY date),
sk AS (SELECT date, a, b, cov, m, least((dt.q - s) / (60 * {len(TICKERS)}), (s - {len(TICKERS)} * m * m) / {len(TICKERS)}) / ((s - {len(TICKERS)} * m * m) / {len(TICKERS)}) AS rho FROM pm JOIN dt USING (date))"""
#: The matrix squared 24 times, its trace brought back to 1 each time, leaves the first axis alone.
_EIGEN = _PAIRS + """, cr AS (SELECT pm.date, pm.a, pm.b, pm.cov / sqrt(u.cov * v.cov) AS c FROM pm JOIN pm u ON u.date = pm.date AND u.a = pm.a AND u.b = pm.a JOIN pm v ON v.date = pm.date AND v.a = pm.b AND v.b = pm.b),
m0 AS MATERIALIZED (SELECT date, a AS i, b AS j, c FROM cr UNION ALL SELECT date, b, a, c FROM cr WHERE a < b)""" + "".join(
    f""", s{k} AS MATERIALIZED (SELECT u.date, u.i, v.j, sum(u.c * v.c) AS c FROM m{k - 1} u JOIN m{k - 1} v ON u.date = v.date AND u.j = v.i GROUP BY ALL),
m{k} AS MATERIALIZED (SELECT date, i, j, c / sum(CASE WHEN i = j THEN c END) OVER (PARTITION BY date) AS c FROM s{k})""" for k in range(1, 25)
) + f" SELECT u.date, round(sum(u.c * v.c) / {len(TICKERS)}, 6) AS share FROM m0 u JOIN m24 v ON u.date = v.date AND u.j = v.i AND u.i = v.j GROUP BY u.date"

QUERIES = {
    "equity_drawdown": (equity_drawdown, _EQ + " SELECT strategy, date, round(equity, 6) AS equity, round(drawdown, 6) AS drawdown FROM dd"),
    "performance_metrics": (performance, _EQ + """, k AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY date) AS n FROM dd), g AS (SELECT strategy, n - row_number() OVER (PARTITION BY strategy ORDER BY n) AS g FROM k WHERE drawdown < 0),
lg AS (SELECT strategy, max(c) AS l FROM (SELECT strategy, g, count(*) AS c FROM g GROUP BY ALL) GROUP BY strategy),
o AS (SELECT strategy, count(*) AS n, product(1 + net) AS total, stddev_samp(net) AS sd, avg(net) AS ex, sqrt(avg(pow(least(net, 0), 2))) AS dn, min(drawdown) AS mdd, quantile_cont(net, 0.05) AS q05, quantile_cont(net, 0.95) AS q95,
  avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS hit FROM dd GROUP BY strategy),
b AS (SELECT strategy, avg(net) AS cvar FROM pa JOIN o USING (strategy) WHERE net <= q05 GROUP BY strategy), f AS (SELECT *, CASE WHEN total <= 0 THEN -1 ELSE pow(total, 252.0 / n) - 1 END AS ann FROM o)
SELECT strategy, n, round(ann, 6) AS ann_return, round(sd * sqrt(252), 6) AS ann_vol, round(ex * sqrt(252) / nullif(sd, 0), 6) AS sharpe, round(ex * sqrt(252) / nullif(dn, 0), 6) AS sortino, round(ann / nullif(abs(mdd), 0), 6) AS calmar,
  round(mdd, 6) AS max_dd, coalesce(l, 0) AS dd_length, round(q05, 6) AS var, round(cvar, 6) AS cvar, round(hit, 6) AS hit_rate, round(abs(q95) / nullif(abs(q05), 0), 6) AS tail_ratio FROM f LEFT JOIN lg USING (strategy) JOIN b USING (strategy)"""),
    "calendar_year_table": (calendar_years, _P + " SELECT strategy, CAST(year(date) AS INTEGER) AS year, count(*) AS n, round(product(1 + net) - 1, 6) AS ret, round(stddev_samp(net), 6) AS sd FROM pa GROUP BY strategy, year(date)"),
    "benchmark_weights": (weights, _W + " SELECT strategy, decision, line, round(CAST(weight AS DOUBLE), 6) AS weight FROM we"),
    "turnover": (turnover, _W + ", m AS (SELECT strategy, decision, abs(weight - coalesce(lag(weight) OVER (PARTITION BY strategy, line ORDER BY decision), 0)) AS m FROM we) SELECT strategy, decision, round(sum(m) / 2, 6) AS turnover FROM m GROUP BY ALL"),
    "vol_target_weights": (vol_target, _V + " SELECT date, line, round(CASE WHEN vol IS NOT NULL THEN least(1.0, greatest(0.0, 1.0 / greatest(vol, 0.05))) END, 6) AS exposure FROM vo"),
    "portfolio_period_returns": (period_returns, _W + """, h AS (SELECT strategy, decision, weight, weight * b.close / nullif(a.close, 0) AS g FROM we JOIN hp USING (decision) LEFT JOIN pr a ON a.date = hp.start AND a.line = we.line LEFT JOIN pr b ON b.date = hp."end" AND b.line = we.line)
SELECT strategy, decision, round(coalesce(sum(g), 0) + (1 - coalesce(sum(CASE WHEN g IS NOT NULL THEN weight END), 0)) * 1.0005 - 1, 6) AS ret FROM h GROUP BY ALL"""),
    "drift_simulation": (drift_simulation, _D + " SELECT strategy, date, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(gross - 0.001 * turnover, 6) AS net FROM dr"),
    "cost_sensitivity": (cost_sensitivity, _D + " SELECT strategy, CAST(bps AS DOUBLE) AS bps, round(product(1 + gross / 100 - bps / CAST(10000 AS DOUBLE) * turnover), 6) AS nav FROM dr, (VALUES (0.0), (5.0), (10.0), (20.0)) c(bps) GROUP BY ALL"),
    "capped_simplex_projection": (capped_simplex, _SIMPLEX),
    "shrunk_covariance": (shrunk_covariance, _SHRUNK + " SELECT date, a, b, round((1 - rho) * cov + CASE WHEN a = b THEN rho * m ELSE 0 END, 6) AS cov, round(rho, 6) AS intensity FROM sk"),
    "first_eigenvalue_share": (eigenvalue_share, _EIGEN),
    "optimal_weights": (optimal_weights, None),
    "deflated_sharpe": (deflated_sharpe, _P + f""", o AS (SELECT strategy, count(*) AS t, avg(net) / stddev_samp(net) AS sharpe, avg(net) AS m, stddev_pop(net) AS s FROM pa GROUP BY strategy),
k AS (SELECT strategy, avg(pow((net - m) / s, 3)) AS skew, avg(pow((net - m) / s, 4)) AS kurt FROM pa JOIN o USING (strategy) GROUP BY strategy), b AS (SELECT stddev_samp(sharpe) * {stats.expected_max_z(len(TICKERS))!r} AS benchmark FROM o)
SELECT strategy, round(sharpe, 6) AS sharpe, round(benchmark, 6) AS benchmark, round((sharpe - benchmark) * sqrt(t - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe), 6) AS z FROM o JOIN k USING (strategy), b"""),
    "gates": (gates, _P + """, d AS (SELECT strategy AS name, year(date) AS target, net - avg(net) OVER (PARTITION BY date) AS d FROM pa), i AS (SELECT name, target, avg(d) AS m, 1.96 * stddev_samp(d) / sqrt(count(*)) AS h FROM d GROUP BY ALL)
SELECT name, count(*) FILTER (m - h > 0) AS favourable, count(*) FILTER (m + h < 0 AND NOT coalesce(m - h > 0, false)) AS adverse, count(*) FILTER (m - h > 0) >= 1 AND count(*) FILTER (m + h < 0) = 0 AS passed FROM i GROUP BY name"""),
    "oos_r2": (oos_r2, _NEXT + """, b AS (SELECT ticker, avg(y) AS base FROM ok WHERE date <= DATE '1999-12-31' GROUP BY ticker)
SELECT ticker, round(1 - sum(pow(y + ret / 2, 2)) / nullif(sum(pow(y - base, 2)), 0), 6) AS r2 FROM ok JOIN b USING (ticker) WHERE date > DATE '1999-12-31' GROUP BY ticker"""),
    "logistic_auc": (auc, _NEXT + """, s AS (SELECT ticker, round(ret, 2) AS s, y < 0 AS l FROM ok)
SELECT a.ticker, round(sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) / count(*), 6) AS auc FROM s a JOIN s b ON a.ticker = b.ticker AND a.l AND NOT b.l GROUP BY a.ticker"""),
    "tuning_selection": (tuning_selection, _P + """, o AS (SELECT strategy, year(date) AS config, avg(net) / stddev_samp(net) AS s FROM pa GROUP BY ALL), t AS (SELECT config, round(avg(s), 6) AS score, count(*) AS seeds FROM o GROUP BY config)
SELECT CAST(config AS INTEGER) AS config, score, seeds, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, config) AS INTEGER) AS place FROM t"""),
}
