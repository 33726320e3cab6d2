"""Feature and target queries on the weekly panel, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.operators import features as f
from chronopanel.sources.panels import WEEKLY, weekly

#: The market segments of the driver's customers, here the assets.
TICKERS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

RET = f"""WITH panel AS ({WEEKLY}),
r AS (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY date) AS ret FROM panel)"""


def frame(n: int, keys: str = "ticker") -> str:
    return f"(PARTITION BY {keys} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def ahead(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"


def full(agg: str, x: str, n: int, over: str | None = None) -> str:
    over = over or frame(n)
    return f"CASE WHEN count({x}) OVER {over} = {n} THEN {agg}({x}) OVER {over} END"


def rounded(df: DataFrame, *columns: str, keys: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in columns])


def over_weekly(make, *columns: str, keys: tuple[str, ...] = ("date", "ticker")):  # noqa: ANN001, ANN201
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(make(weekly(spark, sf_dir)), *columns, keys=keys)

    return query


MACRO = ["vix_level", "vix_change", "slope_long_short", "slope_long_mid", "curve_change", "credit", "credit_change", "credit_change_20", "dollar_return_20", "oil_vol_20"]


def macro_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments stand for macro series: levels of a volatility index, yields, credit, the dollar and oil."""
    names = dict(zip(TICKERS, ["vix", "long_yield", "mid_yield", "short_yield", "oil"], strict=True))
    levels = weekly(spark, sf_dir).groupBy("date").pivot("ticker", TICKERS).agg(F.first("close"))
    levels = levels.select("date", *[F.col(k).alias(v) for k, v in names.items()]).withColumns({"high_yield": F.col("mid_yield"), "investment": F.col("long_yield"), "dollar": F.col("short_yield")})
    return f.macro(levels).select("date", *MACRO)


def macro_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(macro_block(spark, sf_dir), *MACRO, keys=("date",))


_MACRO = f"""WITH panel AS ({WEEKLY}),
l AS (SELECT date, max(close) FILTER (ticker = 'AUTOMOBILE') AS vix, max(close) FILTER (ticker = 'BUILDING') AS ly, max(close) FILTER (ticker = 'FURNITURE') AS my,
  max(close) FILTER (ticker = 'HOUSEHOLD') AS sy, max(close) FILTER (ticker = 'MACHINERY') AS oil FROM panel GROUP BY date),
e AS (SELECT *, ly - sy AS slope, ln(my) - ln(ly) AS cr, oil / lag(oil) OVER (ORDER BY date) - 1 AS o FROM l)
SELECT date, round(vix, 6) AS vix_level, round(ln(vix) - lag(ln(vix)) OVER (ORDER BY date), 6) AS vix_change, round(slope, 6) AS slope_long_short, round(ly - my, 6) AS slope_long_mid,
  round(slope - lag(slope) OVER (ORDER BY date), 6) AS curve_change, round(cr, 6) AS credit, round(cr - lag(cr) OVER (ORDER BY date), 6) AS credit_change,
  round(cr - lag(cr, 20) OVER (ORDER BY date), 6) AS credit_change_20, round(ln(sy) - lag(ln(sy), 20) OVER (ORDER BY date), 6) AS dollar_return_20,
  round(CASE WHEN count(o) OVER w = 20 THEN stddev_samp(o) OVER w * sqrt(252) END, 6) AS oil_vol_20
FROM e WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""


def wide_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = f.wide(f.asset_features(weekly(spark, sf_dir)), TICKERS, f.ASSET)
    return rounded(w, *[c for c in w.columns if c != "date"], keys=("date",))


_BY = "OVER (PARTITION BY ticker ORDER BY date)"
_ASSET = RET + f""", m AS (SELECT date, avg(close) AS mc FROM panel GROUP BY date), b AS (SELECT date, ln(mc) - lag(ln(mc)) OVER (ORDER BY date) AS mr FROM m),
j AS (SELECT r.*, CASE WHEN mr IS NOT NULL THEN ret END AS y, CASE WHEN ret IS NOT NULL THEN mr END AS x, CASE WHEN ret IS NOT NULL THEN pow(least(ret, 0), 2) END AS neg FROM r JOIN b USING (date)),
v AS (SELECT *, {full('stddev_samp', 'ret', 20)} * sqrt(252) AS vol_20, {full('stddev_samp', 'ret', 60)} * sqrt(252) AS vol_60, sqrt({full('avg', 'neg', 60)}) * sqrt(252) AS down_60,
  lag(ln(close), 5) {_BY} - lag(ln(close), 25) {_BY} AS mom_20, lag(ln(close), 5) {_BY} - lag(ln(close), 65) {_BY} AS mom_60, {full('skewness', 'ret', 60)} AS skew_60, {full('kurtosis', 'ret', 60)} AS kurt_60,
  CASE WHEN count(x) OVER {frame(60)} = 60 AND var_samp(x) OVER {frame(60)} > 0 THEN covar_samp(y, x) OVER {frame(60)} / var_samp(x) OVER {frame(60)} END AS beta_60,
  volume / nullif({full('avg', 'volume', 20)}, 0) AS volume_ratio, close / {full('max', 'close', 252)} - 1 AS dist_high FROM j),
a AS (SELECT *, ln(CASE WHEN vol_20 > 0 THEN vol_20 END) - lag(ln(CASE WHEN vol_20 > 0 THEN vol_20 END)) {_BY} AS dvol FROM v)"""
_WIDE = _ASSET + " SELECT date, " + ", ".join(f"round(max({c}) FILTER (ticker = '{t}'), 6) AS {t}_{c}" for t in TICKERS for c in f.ASSET) + " FROM a GROUP BY date"

_BETA = RET + f""", m AS (SELECT date, avg(close) AS mc FROM panel GROUP BY date), b AS (SELECT date, ln(mc) - lag(ln(mc)) OVER (ORDER BY date) AS mr FROM m),
j AS (SELECT r.date, ticker, CASE WHEN mr IS NOT NULL THEN ret END AS y, CASE WHEN ret IS NOT NULL THEN mr END AS x FROM r JOIN b USING (date))
SELECT date, ticker, round(CASE WHEN count(x) OVER w = 60 AND var_samp(x) OVER w > 0 THEN covar_samp(y, x) OVER w / var_samp(x) OVER w END, 6) AS beta_60 FROM j WINDOW w AS {frame(60)}"""


def _corr(n: int) -> str:
    return RET + f""", p AS (SELECT a.date, a.ticker AS a, b.ticker AS b, CASE WHEN b.ret IS NOT NULL THEN a.ret END AS ra, CASE WHEN a.ret IS NOT NULL THEN b.ret END AS rb
  FROM r a JOIN r b ON a.date = b.date AND a.ticker < b.ticker),
c AS (SELECT date, CASE WHEN count(ra) OVER w = {n} THEN corr(ra, rb) OVER w END AS c FROM p WINDOW w AS {frame(n, "a, b")}),
d AS (SELECT date, CASE WHEN count(*) = count(c) THEN avg(c) END AS avg_corr, CASE WHEN count(*) = count(c) THEN CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(c) END END AS std_corr FROM c GROUP BY date)"""


def correlation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronopanel.functions.windows import change

    c = f.pairwise_correlation(weekly(spark, sf_dir), 60).withColumn("one", F.lit(1))
    return rounded(c.withColumn("corr_change", change(F.col("avg_corr"), keys=("one",))), "avg_corr", "std_corr", "corr_change", keys=("date",))


_SKEW = full("skewness", "ret", 60)
_KURT = full("kurtosis", "ret", 60)

QUERIES = {
    "log_returns": (over_weekly(f.log_returns, "ret"), RET + " SELECT date, ticker, round(ret, 6) AS ret FROM r"),
    "realised_vol": (over_weekly(f.realised_vol, "vol_20", "vol_60"), RET + " SELECT date, ticker, " + ", ".join(f"round({full('stddev_samp', 'ret', n)} * sqrt(252), 6) AS vol_{n}" for n in (20, 60)) + " FROM r"),
    "downside_vol": (over_weekly(f.downside_vol, "down_60"), RET + f", d AS (SELECT *, CASE WHEN ret IS NOT NULL THEN pow(least(ret, 0), 2) END AS x FROM r) SELECT date, ticker, round(sqrt({full('avg', 'x', 60)}) * sqrt(252), 6) AS down_60 FROM d"),
    "dvol": (over_weekly(f.vol_change, "dvol"), RET + f", v AS (SELECT *, {full('stddev_samp', 'ret', 20)} AS v FROM r) SELECT date, ticker, round(ln(CASE WHEN v > 0 THEN v END) - lag(ln(CASE WHEN v > 0 THEN v END)) OVER (PARTITION BY ticker ORDER BY date), 6) AS dvol FROM v"),
    "momentum_skip": (over_weekly(f.momentum, "mom_20", "mom_60"), f"WITH panel AS ({WEEKLY}) SELECT date, ticker, " + ", ".join(f"round(lag(ln(close), 5) OVER w - lag(ln(close), {5 + n}) OVER w, 6) AS mom_{n}" for n in (20, 60)) + " FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)"),
    "rolling_skew_kurt": (over_weekly(f.moments, "skew_60", "kurt_60"), RET + f" SELECT date, ticker, round({_SKEW}, 6) AS skew_60, round({_KURT}, 6) AS kurt_60 FROM r"),
    "volume_ratio": (over_weekly(f.volume_ratio, "volume_ratio"), f"WITH panel AS ({WEEKLY}), v AS (SELECT *, {full('avg', 'volume', 20)} AS m FROM panel) SELECT date, ticker, round(CASE WHEN m > 0 THEN volume / m END, 6) AS volume_ratio FROM v"),
    "rolling_beta": (over_weekly(f.beta, "beta_60"), _BETA),
    "dist_from_high": (over_weekly(f.distance_from_high, "dist_high"), f"WITH panel AS ({WEEKLY}) SELECT date, ticker, round(close / {full('max', 'close', 252)} - 1, 6) AS dist_high FROM panel"),
    "asset_features_wide": (wide_query, _WIDE),
    "pairwise_corr_summary": (correlation_query, _corr(60) + " SELECT date, round(avg_corr, 6) AS avg_corr, round(std_corr, 6) AS std_corr, round(avg_corr - lag(avg_corr) OVER (ORDER BY date), 6) AS corr_change FROM d"),
    "return_dispersion": (over_weekly(f.return_dispersion, "dispersion", keys=("date",)), RET + " SELECT date, round(stddev_samp(ret), 6) AS dispersion FROM r GROUP BY date"),
    "breadth": (over_weekly(f.breadth, "breadth", keys=("date",)), f"WITH panel AS ({WEEKLY}), m AS (SELECT *, {full('avg', 'close', 50)} AS m FROM panel) SELECT date, round(avg(CASE WHEN m IS NOT NULL THEN CASE WHEN close > m THEN 1.0 ELSE 0.0 END END), 6) AS breadth FROM m GROUP BY date"),
    "macro_spreads": (macro_query, _MACRO),
    "fwd_vol_ret": (over_weekly(f.forward_vol_and_return, "fwd_vol_5", "fwd_ret_5", "fwd_vol_20", "fwd_ret_20"), RET + " SELECT date, ticker, " + ", ".join(f"round({full('stddev_samp', 'ret', h, ahead(h))} * sqrt(252), 6) AS fwd_vol_{h}, round({full('sum', 'ret', h, ahead(h))}, 6) AS fwd_ret_{h}" for h in (5, 20)) + " FROM r"),
    "fwd_max_drawdown": (over_weekly(f.forward_drawdown, "fwd_mdd_20"), f"""WITH panel AS ({WEEKLY}), n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM panel),
x AS (SELECT a.ticker, a.date, b.k, b.close / max(b.close) OVER (PARTITION BY a.ticker, a.date ORDER BY b.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd
  FROM n a JOIN n b ON a.ticker = b.ticker AND b.k BETWEEN a.k + 1 AND a.k + 20),
w AS (SELECT ticker, date, min(dd) AS mdd, count(*) AS c FROM x GROUP BY ALL)
SELECT n.date, n.ticker, round(CASE WHEN c = 20 THEN mdd END, 6) AS fwd_mdd_20 FROM n LEFT JOIN w USING (ticker, date)"""),
    "fwd_corr": (over_weekly(f.forward_correlation, "fwd_corr_20", keys=("date",)), _corr(20) + " SELECT date, round(lead(avg_corr, 20) OVER (ORDER BY date), 6) AS fwd_corr_20 FROM d"),
}
