"""Queries of hidden Markov models, regressions from sums, replicates, benchmarks and snapshots, with SQL where it can
express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.operators import benchmarks, features, gram, markov, replicates, stats
from chronopanel.operators import portfolio as pf
from chronopanel.plans import portfolio_queries as pq
from chronopanel.plans import regime_queries as rq
from chronopanel.plans.feature_queries import RET, rounded
from chronopanel.plans.stream_queries import _work
from chronopanel.sources import snapshot
from chronopanel.sources.panels import WEEKLY, weekly

FIT_END, VAL_END = "1999-06-30", "2000-06-30"
COUNT, BLOCK, SEED = 40, 8, 7
MIX, LEG, TARGET, CAP = {"BUILDING": 0.6, "MACHINERY": 0.4}, "BUILDING", 1.0, 0.35
LOCKED = ("1999-01-01", "1999-12-31")
ALPHAS = (0.1, 10.0, 1000.0)


def hmm_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rq.scanned(spark, sf_dir)
    return out.select("date", "ticker", *[F.round(F.col("smoothed")[j], 6).alias(f"p_{j}") for j in range(2)])


def hmm_walkforward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly folds of each ticker's weekly returns, two states, three restarts."""
    out = markov.walkforward(rq._returns(spark, sf_dir), rq._folds(weekly(spark, sf_dir)), "ret", duration=1.2)
    both = [F.round(F.col(c)[j], 6).alias(f"{c}_{j}") for c in ("filtered", "smoothed") for j in range(2)]
    return out.select("fold", "ticker", "date", *both, F.round("loglik", 6).alias("loglik"), "degenerate")


def hmm_model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = markov.model_choice(rq._returns(spark, sf_dir), ["ticker"], "ret", FIT_END, VAL_END, duration=1.2)
    return rounded(out, "loglik", "val_loglik", "bic", "aic", keys=("ticker", "k", "n_params", "degenerate", "selected", "reason"))


def ridge_walkforward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, folds = pq._design(spark, sf_dir)
    return rounded(gram.ridge_walkforward(rows, folds, ["ret", "vol_20"], "fwd_ret_5", ALPHAS), "y", "pred", "base", keys=("fold", "alpha", "date", "ticker"))


def ridge_alpha_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold's alpha, chosen within its fit window, and the error of it where the fold applies."""
    rows, folds = pq._design(spark, sf_dir)
    run = lambda f: gram.ridge_walkforward(rows, f, ["ret", "vol_20"], "fwd_ret_5", ALPHAS)
    chosen = stats.select_alphas(run(stats.inner_folds(folds))).select("fold", "alpha", F.col("mse").alias("val_mse"))
    scored = run(folds).groupBy("fold", "alpha").agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("y") - F.col("pred"), 2)).alias("mse"))
    return rounded(chosen.join(scored, ["fold", "alpha"]), "val_mse", "mse", keys=("fold", "alpha", "n"))


def _split():  # noqa: ANN202
    return F.when(F.col("date") <= F.lit(FIT_END).cast("date"), "train").when(F.col("date") <= F.lit(VAL_END).cast("date"), "val").otherwise("test")


def ridge_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = pq._design(spark, sf_dir)
    return rounded(gram.ridge_probe(rows, _split(), ["ticker"], ["ret", "vol_20"], "fwd_ret_5", ALPHAS), "val_mse", "test_r2", keys=("ticker", "alpha", "n_test"))


def logistic_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the next five weeks' return is below the mean, told from the last return and the volatility."""
    rows, _ = pq._design(spark, sf_dir)
    labelled = rows.withColumn("down", (F.col("fwd_ret_5") < 0).cast("int"))
    chosen, scores = gram.logistic_probe(labelled, _split(), ["ticker"], ["ret", "vol_20"], "down", ALPHAS)
    return rounded(chosen.join(stats.auc(scores, ["ticker"]), "ticker", "left"), "val_loss", "auc", keys=("ticker", "alpha"))


def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = replicates.path_statistics(pq._paths(spark, sf_dir), COUNT, BLOCK, SEED)
    return rounded(replicates.intervals(values, ["strategy"]), "point", "low", "high", keys=("strategy", "name", "n"))


def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and Sharpe ratio of each path with their intervals, a row a path."""
    named = {"mean": F.avg("net"), "sharpe": F.try_divide(F.avg("net") * 252**0.5, F.stddev_samp("net"))}
    table = replicates.intervals(replicates.statistics(pq._paths(spark, sf_dir), ["strategy"], named, COUNT, BLOCK, SEED), ["strategy"])
    of = lambda name, column: F.round(F.max(F.when(F.col("name") == name, F.col(column))), 6)
    each = {"mean": ("mean", "point"), "low": ("mean", "low"), "high": ("mean", "high"), "sharpe": ("sharpe", "point"), "sharpe_low": ("sharpe", "low"), "sharpe_high": ("sharpe", "high")}
    return table.groupBy("strategy").agg(*[of(*v).alias(k) for k, v in each.items()])


def bootstrap_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = replicates.path_statistics(pq._paths(spark, sf_dir), COUNT, BLOCK, SEED)
    return rounded(replicates.paired(values, "strategy", "BUILDING"), "point", "low", "high", keys=("strategy", "name", "n", "verdict"))


def forecast_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 of the reversed last return as a forecast of the next one, and its loss less that of the fit mean."""
    from pyspark.sql import Window

    rows = features.log_returns(weekly(spark, sf_dir)).withColumn("y", F.lead("ret").over(Window.partitionBy("ticker").orderBy("date"))).dropna(subset=["ret", "y"])
    base = rows.where("date <= date '1999-12-31'").groupBy("ticker").agg(F.avg("y").alias("base"))
    test = rows.where("date > date '1999-12-31'").join(base, "ticker").withColumn("pred", -F.col("ret") / 2).select("date", "ticker", "y", "pred", "base")
    named = {**replicates.r2_statistic(), **replicates.loss_difference(["pred", "base"])}
    values = replicates.statistics(test, ["ticker"], named, COUNT, BLOCK, SEED)
    table = replicates.intervals(values, ["ticker"])
    # The loss is better when lower, R2 when higher.
    lower = F.col("name") == "pred_less_base"
    v = F.when(lower, stats.verdict(F.col("low"), F.col("high"), True)).otherwise(stats.verdict(F.col("low"), F.col("high"), False))
    return rounded(table.withColumn("verdict", v), "point", "low", "high", keys=("ticker", "name", "n", "verdict"))


def benchmark_portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided, _ = pq._schedule(spark, sf_dir)
    prices = pq._prices(spark, sf_dir)
    vols = pf.trailing_vol(prices).join(decided, "date").where("vol is not null").select(F.col("date").alias("decision"), "line", "vol")
    lines = vols.select("decision", "line")
    each = {
        "equal": pf.equal_weights(lines), "sixty_forty": benchmarks.fixed_mix(lines, MIX), "risk_parity": benchmarks.capped_inverse_vol(vols, CAP),
        "vol_target": benchmarks.vol_target_leg(vols, LEG, TARGET), "buy_and_hold": benchmarks.buy_and_hold(prices, lines),
    }
    first, *rest = [w.select(F.lit(n).alias("strategy"), "decision", "line", F.round("weight", 6).alias("weight")) for n, w in each.items()]
    for w in rest:
        first = first.unionByName(w)
    return first


def _stored(spark: SparkSession, sf_dir: str) -> str:
    root = f"{_work(spark)}/snapshots-{uuid.uuid4().hex}"
    snapshot.create(weekly(spark, sf_dir), root, "2001-12-31", "weekly")
    return root


def snapshot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snapshot.manifest(spark, _stored(spark, sf_dir), "2001-12-31", "weekly")
    return found.select("column", "kind", "rows", "nulls", "first_date", "last_date")


def snapshot_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of two tickers out of a verified snapshot, the locked year left out."""
    table = snapshot.load(spark, _stored(spark, sf_dir), "2001-12-31", "weekly")
    return rounded(snapshot.readable(snapshot.pick(table, ["BUILDING", "MACHINERY"]), LOCKED), "close", keys=("date", "ticker", "volume"))


_SMOOTH = rq._FILTER + f""", z(ticker, n, v0, v1) AS (
  SELECT ticker, max(n), CAST(1 AS DOUBLE), CAST(1 AS DOUBLE) FROM b GROUP BY ticker
  UNION ALL SELECT z.ticker, z.n - 1, ({rq.MOVES[0][0]} * b0 * v0 + {rq.MOVES[0][1]} * b1 * v1) / (({rq.MOVES[0][0]} + {rq.MOVES[1][0]}) * b0 * v0 + ({rq.MOVES[0][1]} + {rq.MOVES[1][1]}) * b1 * v1),
    ({rq.MOVES[1][0]} * b0 * v0 + {rq.MOVES[1][1]} * b1 * v1) / (({rq.MOVES[0][0]} + {rq.MOVES[1][0]}) * b0 * v0 + ({rq.MOVES[0][1]} + {rq.MOVES[1][1]}) * b1 * v1)
  FROM z JOIN b ON b.ticker = z.ticker AND b.n = z.n WHERE z.n > 1)
SELECT f.date, f.ticker, round(a0 * v0 / (a0 * v0 + a1 * v1), 6) AS p_0, round(a1 * v1 / (a0 * v0 + a1 * v1), 6) AS p_1 FROM f JOIN z USING (ticker, n)"""

_DESIGN = RET + rq._FOLDS + """, dz AS (SELECT * FROM (SELECT date, ticker, ret AS x1, CASE WHEN count(ret) OVER b = 20 THEN stddev_samp(ret) OVER b * sqrt(252) END AS x2, CASE WHEN count(ret) OVER f = 5 THEN sum(ret) OVER f END AS y FROM r
  WINDOW b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND y IS NOT NULL)"""


def _ridge_sql(folds: str, name: str) -> str:
    """Two features: the normal equations in closed form."""
    return f""", st_{name} AS (SELECT fold, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, covar_pop(x1, x2) * count(*) AS c12, covar_pop(x1, y) * count(*) AS r1, covar_pop(x2, y) * count(*) AS r2
  FROM {folds} JOIN dz ON date <= fit_end GROUP BY fold HAVING count(*) >= 4),
ws_{name} AS (SELECT *, n + alpha AS a, c12 / (s1 * s2) AS b, r1 / s1 AS p, r2 / s2 AS q FROM st_{name}, (SELECT CAST(unnest([0.1, 10.0, 1000.0]) AS DOUBLE) AS alpha)),
{name} AS (SELECT fold, alpha, date, ticker, y, my + (a * p - b * q) / (a * a - b * b) * (x1 - m1) / s1 + (a * q - b * p) / (a * a - b * b) * (x2 - m2) / s2 AS pred, my AS base
  FROM ws_{name} JOIN {folds} USING (fold) JOIN dz ON date BETWEEN apply_start AND apply_end)"""


_INNER = """, lo AS (SELECT min(date) AS fit_start FROM s), ct AS (SELECT fold, fit_start, fit_end, fit_start + CAST(trunc(CAST(0.8 AS DOUBLE) * (fit_end - fit_start)) AS INTEGER) AS cut FROM fo, lo),
fi AS (SELECT fold, cut - 35 AS fit_end, cut AS apply_start, fit_end AS apply_end FROM ct WHERE fit_start < cut - 35)"""


def _resampled(source: str) -> str:
    """rp (rep, pos, date): the dates of a table, resampled."""
    u = lambda tag, pos: f"CAST('0x' || substr(md5(concat_ws(':', '{SEED}', '{tag}', rep, {pos})), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE)"
    return f""", dt AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM {source})),
gr AS (SELECT n, rep, unnest(range(n)) AS pos FROM (SELECT DISTINCT n FROM dt), range({COUNT}) t(rep)),
fr AS (SELECT n, rep, pos, lead(pos) OVER (PARTITION BY rep ORDER BY pos) AS nxt FROM gr WHERE pos = 0 OR {u("block", "pos")} < CAST(1 AS DOUBLE) / {BLOCK}),
sp AS (SELECT n, rep, pos AS first, CAST(floor({u("start", "pos")} * n) AS BIGINT) AS b, unnest(range(pos, coalesce(nxt, n))) AS p FROM fr),
rp AS (SELECT rep, p AS pos, date FROM sp JOIN dt ON idx = (b + p - first) % sp.n)"""


_INTERVALS = "max(value) FILTER (rep = -1) AS point, quantile_cont(value, 0.025) FILTER (rep >= 0) AS low, quantile_cont(value, 0.975) FILTER (rep >= 0) AS high, count(value) FILTER (rep >= 0) AS n"
_VALUES = pq._P + _resampled("pa") + """, rw AS (SELECT strategy, rep, pos, net FROM pa JOIN rp USING (date) UNION ALL SELECT strategy, -1, date - DATE '1970-01-01', net FROM pa),
cv AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY strategy, rep ORDER BY pos)) AS c, quantile_cont(net, 0.05) OVER (PARTITION BY strategy, rep) AS q FROM rw),
dn AS (SELECT *, c / greatest(max(c) OVER (PARTITION BY strategy, rep ORDER BY pos), 1.0) - 1 AS d FROM cv),
me AS (SELECT strategy, rep, exp(sum(ln(1 + net)) * 252 / count(*)) - 1 AS ann_return, avg(net) * sqrt(252) / nullif(stddev_samp(net), 0) AS sharpe, min(d) AS max_dd, avg(net) FILTER (net <= q) AS cvar FROM dn GROUP BY ALL),
va AS (UNPIVOT me ON ann_return, sharpe, max_dd, cvar INTO NAME name VALUE value)"""

_FORECAST = RET + """, nx AS (SELECT *, lead(ret) OVER (PARTITION BY ticker ORDER BY date) AS y FROM r), ok AS (SELECT * FROM nx WHERE ret IS NOT NULL AND y IS NOT NULL),
ba AS (SELECT ticker, avg(y) AS base FROM ok WHERE date <= DATE '1999-12-31' GROUP BY ticker), te AS (SELECT date, ticker, y, -ret / 2 AS pred, base FROM ok JOIN ba USING (ticker) WHERE date > DATE '1999-12-31')""" + _resampled("te") + f""",
me AS (SELECT ticker, rep, 1 - sum(pow(y - pred, 2)) / nullif(sum(pow(y - base, 2)), 0) AS r2, avg(pow(y - pred, 2) - pow(y - base, 2)) AS pred_less_base
  FROM (SELECT te.*, rep FROM te JOIN rp USING (date) UNION ALL SELECT *, -1 FROM te) GROUP BY ALL),
va AS (UNPIVOT me ON r2, pred_less_base INTO NAME name VALUE value), iv AS (SELECT ticker, name, {_INTERVALS} FROM va GROUP BY ALL)
SELECT ticker, name, round(point, 6) AS point, round(low, 6) AS low, round(high, 6) AS high, n, CASE WHEN CASE WHEN name = 'r2' THEN low > 0 ELSE high < 0 END THEN 'favourable' WHEN CASE WHEN name = 'r2' THEN high < 0 ELSE low > 0 END THEN 'adverse' ELSE 'inconclusive' END AS verdict FROM iv"""

_BENCHMARKS = pq._W + f""", iv AS (SELECT *, CASE WHEN vol > 0 THEN 1 / vol END AS i FROM dv),
rk AS (SELECT *, row_number() OVER w - 1 AS m, sum(i) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM iv WINDOW w AS (PARTITION BY decision ORDER BY i DESC NULLS LAST, line)),
lv AS (SELECT *, (1 - m * CAST({CAP} AS DOUBLE)) / rest AS lam FROM rk), ft AS (SELECT decision, arg_min(lam, m) AS lam FROM lv WHERE i * lam <= {CAP} AND lam >= 0 GROUP BY decision),
bh AS (SELECT decision, dv.line, close / first_value(close) OVER (PARTITION BY dv.line ORDER BY decision) AS g FROM dv JOIN pr ON pr.date = decision AND pr.line = dv.line),
al AS (SELECT 'equal' AS strategy, decision, line, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY decision) AS weight FROM dv
  UNION ALL SELECT 'sixty_forty', decision, line, CASE line {" ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX.items())} ELSE 0 END FROM dv
  UNION ALL SELECT 'risk_parity', iv.decision, line, CASE WHEN i IS NULL THEN 0 ELSE coalesce(least(CAST({CAP} AS DOUBLE), i * lam), {CAP}) END FROM iv LEFT JOIN ft USING (decision)
  UNION ALL SELECT 'vol_target', decision, line, CASE WHEN line = '{LEG}' THEN least(1.0, greatest(0.0, {TARGET} / greatest(vol, 0.05))) ELSE 0 END FROM dv
  UNION ALL SELECT 'buy_and_hold', decision, line, g / sum(g) OVER (PARTITION BY decision) FROM bh)
SELECT strategy, decision, line, round(CAST(weight AS DOUBLE), 6) AS weight FROM al"""

_MANIFEST = f"WITH p AS ({WEEKLY}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS kind, count(*) AS rows, count(*) - count({c}) AS nulls, min(date) AS first_date, max(date) AS last_date FROM p" for c, k in (("date", "date"), ("ticker", "string"), ("close", "double"), ("volume", "bigint"))
)

QUERIES = {
    "hmm_smoothed": (hmm_smoothed, _SMOOTH),
    "hmm_walkforward": (hmm_walkforward, None),
    "hmm_model_choice": (hmm_model_choice, None),
    "ridge_walkforward": (ridge_walkforward, _DESIGN + _ridge_sql("fo", "rr") + " SELECT fold, alpha, date, ticker, round(y, 6) AS y, round(pred, 6) AS pred, round(base, 6) AS base FROM rr"),
    "ridge_alpha_selection": (ridge_alpha_selection, _DESIGN + _INNER + _ridge_sql("fi", "ri") + _ridge_sql("fo", "rr") + """, mi AS (SELECT fold, alpha, avg(pow(y - pred, 2)) AS mse FROM ri GROUP BY ALL),
ch AS (SELECT fold, alpha, mse FROM mi QUALIFY row_number() OVER (PARTITION BY fold ORDER BY mse, alpha DESC) = 1), sc AS (SELECT fold, alpha, count(*) AS n, avg(pow(y - pred, 2)) AS mse FROM rr GROUP BY ALL)
SELECT fold, alpha, n, round(ch.mse, 6) AS val_mse, round(sc.mse, 6) AS mse FROM ch JOIN sc USING (fold, alpha)"""),
    "ridge_probe": (ridge_probe, None),
    "logistic_probe": (logistic_probe, None),
    "bootstrap_intervals": (bootstrap_intervals, _VALUES + f", iv AS (SELECT strategy, name, {_INTERVALS} FROM va GROUP BY ALL) SELECT strategy, name, round(point, 6) AS point, round(low, 6) AS low, round(high, 6) AS high, n FROM iv"),
    "block_bootstrap_ci": (block_bootstrap, pq._P + _resampled("pa") + """, rw AS (SELECT strategy, rep, net FROM pa JOIN rp USING (date) UNION ALL SELECT strategy, -1, net FROM pa),
me AS (SELECT strategy, rep, avg(net) AS m, avg(net) * sqrt(252) / nullif(stddev_samp(net), 0) AS s FROM rw GROUP BY ALL)
SELECT strategy, round(max(m) FILTER (rep = -1), 6) AS mean, round(quantile_cont(m, 0.025) FILTER (rep >= 0), 6) AS low, round(quantile_cont(m, 0.975) FILTER (rep >= 0), 6) AS high,
  round(max(s) FILTER (rep = -1), 6) AS sharpe, round(quantile_cont(s, 0.025) FILTER (rep >= 0), 6) AS sharpe_low, round(quantile_cont(s, 0.975) FILTER (rep >= 0), 6) AS sharpe_high FROM me GROUP BY strategy"""),
    "bootstrap_paired": (bootstrap_paired, _VALUES + f""", df AS (SELECT a.strategy, a.rep, a.name, a.value - b.value AS value FROM va a JOIN va b ON b.strategy = 'BUILDING' AND a.rep = b.rep AND a.name = b.name AND a.strategy <> 'BUILDING'),
iv AS (SELECT strategy, name, {_INTERVALS} FROM df GROUP BY ALL) SELECT strategy, name, round(point, 6) AS point, round(low, 6) AS low, round(high, 6) AS high, n, CASE WHEN low > 0 THEN 'favourable' WHEN high < 0 THEN 'adverse' ELSE 'inconclusive' END AS verdict FROM iv"""),
    "forecast_intervals": (forecast_intervals, _FORECAST),
    "benchmark_portfolios": (benchmark_portfolios, _BENCHMARKS),
    "snapshot_manifest": (snapshot_manifest, _MANIFEST),
    "snapshot_panel": (snapshot_panel, f"WITH p AS ({WEEKLY}) SELECT date, ticker, volume, round(close, 6) AS close FROM p WHERE ticker IN ('BUILDING', 'MACHINERY') AND NOT date BETWEEN DATE '{LOCKED[0]}' AND DATE '{LOCKED[1]}'"),
}
