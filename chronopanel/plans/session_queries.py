"""Calendar, cleaning, split and scaling queries, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.operators import calendar as cal
from chronopanel.operators import clean, features, fitted
from chronopanel.plans.feature_queries import RET, TICKERS
from chronopanel.sources.panels import DAILY, HOURLY, WEEKLY, daily, hourly, table, weekly

SPLITS = [("train", "1995-01-01"), ("val", "1998-07-01"), ("test", "1999-07-01"), ("holdout", "2000-07-01")]
EMBARGO = 25
FIRST_APPLY = "1998-01-15"
FIT_END = "1999-12-31"

_S = f"WITH panel AS ({DAILY}), s AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS ord FROM (SELECT DISTINCT date FROM panel))"
_CAL = f"""WITH panel AS ({DAILY}), cal AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM panel),
wd AS (SELECT date FROM cal WHERE isodow(date) < 6), spine AS (SELECT * FROM wd, (SELECT DISTINCT ticker FROM panel)),
al AS (SELECT spine.date, spine.ticker, close, volume FROM spine LEFT JOIN panel USING (date, ticker)),
av AS (SELECT *, coalesce(date >= min(CASE WHEN close IS NOT NULL THEN date END) OVER (PARTITION BY ticker), false) AS available FROM al)"""
_DECISIONS = "d AS (SELECT CAST(isoyear(date) AS INTEGER) AS iso_year, CAST(week(date) AS INTEGER) AS iso_week, max(date) AS date FROM s WHERE isodow(date) <= 5 GROUP BY ALL)"


def _aligned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    panel = daily(spark, sf_dir)
    return panel, cal.weekdays(panel)


def calendar_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, sessions = _aligned(spark, sf_dir)
    return clean.available(clean.align(panel, sessions)).select("date", "ticker", F.round("close", 4).alias("close"), "volume", "available")


def capped_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, sessions = _aligned(spark, sf_dir)
    return clean.fill(clean.align(panel, sessions)).select("date", "ticker", F.round("close", 4).alias("close"), "volume", "available", "filled")


def gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = daily(spark, sf_dir)
    return clean.runs(clean.align(panel, cal.observed(panel)), F.col("close").isNull() | (F.col("volume") < 80))


def off_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, sessions = _aligned(spark, sf_dir)
    return clean.off_calendar(panel, sessions).select("date", "ticker", F.round("close", 4).alias("close"))


def qa_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, sessions = _aligned(spark, sf_dir)
    return clean.quality_report(panel, sessions)


def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.stale_runs(hourly(spark, sf_dir), "n", 2, "hour")


def ks_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.log_returns(weekly(spark, sf_dir))
    return clean.ks_drift(rows, "ret", F.col("date") <= F.lit(FIT_END).cast("date"), ("ticker",)).select("ticker", "n_a", "n_b", F.round("d", 9).alias("d"))


def latent_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("unit", "x"))
    return clean.ks_drift(units, "x", F.col("label") < 5, ("unit",)).select("unit", "n_a", "n_b", F.round("d", 9).alias("d"))


def session_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cal.observed(daily(spark, sf_dir))
    both = cal.shift(s, 5).join(cal.shift(s, -5).withColumnRenamed("shifted", "before"), "date")
    return cal.numbered(s).join(both, "date").select("date", "ord", F.col("shifted").alias("after"), "before")


def sessions_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cal.observed(daily(spark, sf_dir))
    spans = cal.decisions(s).where("iso_week % 10 = 0").select(F.col("date").alias("a"), F.date_add("date", 30).alias("b"))
    return cal.between(s, spans)


def weekly_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.decisions(cal.observed(daily(spark, sf_dir)))


def holding_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.holding_periods(cal.observed(daily(spark, sf_dir)))


def split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.split_plan(cal.observed(daily(spark, sf_dir)), SPLITS, EMBARGO)


def expanding_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.expanding_folds(cal.observed(daily(spark, sf_dir)), FIRST_APPLY, "quarter", EMBARGO)


def long_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.log_returns(weekly(spark, sf_dir)).where("ret is not null").select("date", F.col("ticker").alias("name"), F.col("ret").alias("value"))


def _fit():  # noqa: ANN202
    return F.col("date") <= F.lit(FIT_END).cast("date")


def winsorise_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long_returns(spark, sf_dir)
    cut = fitted.winsorise(rows, fitted.fit_winsor(rows, _fit()))
    return fitted.scaled(cut, fitted.fit_scaler(cut, _fit())).select("date", F.col("name").alias("ticker"), F.round("value", 6).alias("z"))


def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long_returns(spark, sf_dir)
    return fitted.scaled(rows, fitted.fit_scaler(rows, _fit(), robust=True)).select("date", F.col("name").alias("ticker"), F.round("value", 6).alias("z"))


def correlation_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = features.wide(features.realised_vol(weekly(spark, sf_dir), (20, 60)), TICKERS, ["ret", "vol_20", "vol_60"])
    return fitted.prune(wide, [c for c in wide.columns if c != "date"], _fit(), 0.5)


def feature_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = features.wide(features.log_returns(weekly(spark, sf_dir)), TICKERS, ["ret"])
    return fitted.correlations(wide, [f"{t}_ret" for t in TICKERS], _fit()).select("a", "b", F.round("rho", 6).alias("rho"))


_NAMED = ", ".join(f"({i}, '{n}', DATE '{d}')" for i, (n, d) in enumerate(SPLITS))
_LONG = RET + f", x AS (SELECT date, ticker, ret FROM r WHERE ret IS NOT NULL), f AS (SELECT * FROM x WHERE date <= DATE '{FIT_END}')"
_KS = """, p AS (SELECT {k}, x, count(*) FILTER (a) AS a, count(*) FILTER (NOT a) AS b FROM v GROUP BY ALL),
c AS (SELECT {k}, sum(a) OVER (PARTITION BY {k} ORDER BY x) AS ca, sum(b) OVER (PARTITION BY {k} ORDER BY x) AS cb, sum(a) OVER (PARTITION BY {k}) AS na, sum(b) OVER (PARTITION BY {k}) AS nb FROM p)
SELECT {k}, CAST(max(na) AS BIGINT) AS n_a, CAST(max(nb) AS BIGINT) AS n_b, round(max(abs(ca / na - cb / nb)), 9) AS d FROM c WHERE na >= 30 AND nb >= 30 GROUP BY {k}"""

QUERIES = {
    "calendar_align": (calendar_align, _CAL + " SELECT date, ticker, round(close, 4) AS close, volume, available FROM av"),
    "capped_ffill": (capped_ffill, _CAL + """, m AS (SELECT *, CASE WHEN available THEN last_value(CASE WHEN available THEN close END IGNORE NULLS) OVER w END AS c,
  CASE WHEN available THEN last_value(CASE WHEN available THEN volume END IGNORE NULLS) OVER w END AS v FROM av WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT date, ticker, round(c, 4) AS close, v AS volume, available, close IS NULL AND available AND c IS NOT NULL AS filled FROM m"""),
    "gap_runs": (gap_runs, _S + """, sp AS (SELECT s.date, t.ticker, p.close, p.volume FROM s CROSS JOIN (SELECT DISTINCT ticker FROM panel) t LEFT JOIN panel p ON p.date = s.date AND p.ticker = t.ticker),
n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM sp), f AS (SELECT *, n - row_number() OVER (PARTITION BY ticker ORDER BY n) AS g FROM n WHERE close IS NULL OR volume < 80)
SELECT ticker, min(date) AS start, max(date) AS "end", count(*) AS length FROM f GROUP BY ticker, g"""),
    "off_calendar_rows": (off_calendar, _CAL + " SELECT date, ticker, round(close, 4) AS close FROM panel ANTI JOIN wd USING (date)"),
    "qa_report": (qa_report, _CAL + """, rr AS (SELECT *, ln(CASE WHEN close > 0 THEN close END) - lag(ln(CASE WHEN close > 0 THEN close END)) OVER (PARTITION BY ticker ORDER BY date) AS ret FROM av),
u AS (SELECT 'duplicate_index' AS "check", 'hard' AS severity, coalesce((SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM panel GROUP BY date, ticker HAVING count(*) > 1)), 0) AS n
UNION ALL SELECT 'missing_sessions', 'hard', (SELECT count(*) FROM wd ANTI JOIN panel USING (date))
UNION ALL SELECT 'nonpositive_prices', 'hard', (SELECT count(*) FROM rr WHERE available AND close <= 0)
UNION ALL SELECT 'price_gaps', 'hard', (SELECT count(*) FROM rr WHERE available AND close IS NULL)
UNION ALL SELECT 'extreme_move_hard', 'hard', (SELECT count(*) FROM rr WHERE abs(ret) > 0.30)
UNION ALL SELECT 'extreme_move_soft', 'soft', (SELECT count(*) FROM rr WHERE abs(ret) > 0.15 AND abs(ret) <= 0.30)
UNION ALL SELECT 'zero_volume', 'soft', (SELECT count(*) FROM rr WHERE available AND volume = 0))
SELECT "check", severity, CAST(n AS BIGINT) AS n_affected, n = 0 AS passed FROM u"""),
    "stale_runs": (stale_runs, f"""WITH h AS ({HOURLY}), v AS (SELECT ticker, hour, n, row_number() OVER w AS k, n = lag(n) OVER w AS same FROM h WINDOW w AS (PARTITION BY ticker ORDER BY hour)),
g AS (SELECT ticker, k - row_number() OVER (PARTITION BY ticker ORDER BY k) AS g FROM v WHERE same), c AS (SELECT ticker, g, count(*) + 1 AS c FROM g GROUP BY ALL)
SELECT ticker, max(c) AS longest FROM c GROUP BY ticker HAVING max(c) >= 2"""),
    "ks_drift": (ks_drift, RET + f", v AS (SELECT ticker, ret AS x, date <= DATE '{FIT_END}' AS a FROM r WHERE ret IS NOT NULL)" + _KS.format(k="ticker")),
    "latent_drift": (latent_drift, "WITH v AS (SELECT label < 5 AS a, CAST(unnest(range(len(embedding))) AS INTEGER) AS unit, unnest(embedding) AS x FROM embeddings)" + _KS.format(k="unit")),
    "session_ordinals_shift": (session_ordinals, _S + " SELECT date, CAST(ord AS INTEGER) AS ord, lead(date, 5) OVER (ORDER BY date) AS after, lag(date, 5) OVER (ORDER BY date) AS before FROM s"),
    "sessions_between": (sessions_between, _S + f", {_DECISIONS}, sp AS (SELECT date AS a, CAST(date + 30 AS DATE) AS b FROM d WHERE iso_week % 10 = 0) SELECT a, b, count(s.date) AS n FROM sp LEFT JOIN s ON s.date > a AND s.date < b GROUP BY a, b"),
    "weekly_decisions": (weekly_decisions, _S + f", {_DECISIONS} SELECT iso_year, iso_week, date FROM d"),
    "holding_periods": (holding_periods, _S + f""", {_DECISIONS}, e AS (SELECT d.date AS decision, ord + 1 AS a FROM d JOIN s USING (date) WHERE ord + 1 <= (SELECT max(ord) FROM s)),
p AS (SELECT decision, a, coalesce(lead(a) OVER (ORDER BY a), (SELECT max(ord) FROM s)) AS b FROM e)
SELECT decision, x.date AS start, y.date AS "end" FROM p JOIN s x ON x.ord = a JOIN s y ON y.ord = b WHERE b > a"""),
    "split_plan": (split_plan, _S + f""", dec(i, name, declared) AS (VALUES {_NAMED}), f AS (SELECT i, name, min(ord) AS a FROM dec JOIN s ON s.date >= declared GROUP BY i, name),
p AS (SELECT name, a, coalesce(lead(a) OVER (ORDER BY i), (SELECT max(ord) + {EMBARGO} + 1 FROM s)) - {EMBARGO} - 1 AS b FROM f)
SELECT name, x.date AS start, y.date AS "end", CAST(b - a + 1 AS INTEGER) AS n_sessions FROM p JOIN s x ON x.ord = a JOIN s y ON y.ord = b"""),
    "expanding_folds": (expanding_folds, _S + f""", q AS (SELECT DATE '{FIRST_APPLY}' AS a UNION SELECT CAST(x AS DATE) FROM (SELECT unnest(generate_series(date_trunc('quarter', DATE '{FIRST_APPLY}'), (SELECT max(date) FROM s), INTERVAL 3 MONTH)) AS x) WHERE x > DATE '{FIRST_APPLY}'),
w AS (SELECT a, coalesce(lead(a) OVER (ORDER BY a), (SELECT max(date) + 1 FROM s)) AS b FROM q),
g AS (SELECT a, min(date) AS apply_start, max(date) AS apply_end, min(ord) AS o FROM w JOIN s ON date >= a AND date < b GROUP BY a)
SELECT CAST(row_number() OVER (ORDER BY a) - 1 AS INTEGER) AS fold, (SELECT min(date) FROM s) AS fit_start, s.date AS fit_end, apply_start, apply_end FROM g JOIN s ON s.ord = o - {EMBARGO} - 1"""),
    "winsorise_scale": (winsorise_scale, _LONG + """, q AS (SELECT ticker, quantile_cont(ret, 0.01) AS lo, quantile_cont(ret, 0.99) AS hi FROM f GROUP BY ticker),
c AS (SELECT date, ticker, least(greatest(ret, lo), hi) AS v FROM x JOIN q USING (ticker)), m AS (SELECT ticker, avg(v) AS m, stddev_pop(v) AS s FROM c WHERE date <= DATE '""" + FIT_END + """' GROUP BY ticker)
SELECT date, ticker, round((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS z FROM c JOIN m USING (ticker)"""),
    "robust_scale": (robust_scale, _LONG + """, q AS (SELECT ticker, quantile_cont(ret, 0.5) AS m, (quantile_cont(ret, 0.75) - quantile_cont(ret, 0.25)) / CAST(1.349 AS DOUBLE) AS s FROM f GROUP BY ticker)
SELECT date, ticker, round((ret - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS z FROM x JOIN q USING (ticker)"""),
    "correlation_prune": (correlation_prune, None),
    "feature_correlations": (feature_correlations, RET + f", w AS (SELECT date, " + ", ".join(f"max(ret) FILTER (ticker = '{t}') AS {t}" for t in TICKERS) + f" FROM r GROUP BY date HAVING date <= DATE '{FIT_END}') " + " UNION ALL ".join(
        f"SELECT '{a}_ret' AS a, '{b}_ret' AS b, round(corr({a}, {b}), 6) AS rho FROM w" for i, a in enumerate(TICKERS) for b in TICKERS[i + 1 :])),
}
