"""Queries of the assembled feature frame and of what is fitted on it, with SQL for each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.operators import build, fitted
from chronopanel.operators import calendar as cal
from chronopanel.operators import features as f
from chronopanel.plans.feature_queries import MACRO, RET, TICKERS, _ASSET, _MACRO, _corr, full, macro_block, rounded
from chronopanel.plans.session_queries import FIT_END
from chronopanel.plans.stream_queries import _work
from chronopanel.sources import artifacts
from chronopanel.sources.panels import WEEKLY, table, weekly

#: The universe of the query: three of the five segments, so that the others must leave no trace.
UNIVERSE = TICKERS[:3]
_START = "1992-01-01"
_IN = "ticker IN (" + ", ".join(f"'{t}'" for t in UNIVERSE) + ")"
_MINE = f"SELECT * FROM ({WEEKLY}) WHERE {_IN}"
CROSS = ["avg_corr", "std_corr", "corr_change", "dispersion", "breadth"]
ALL = [f"{t}_{c}" for t in UNIVERSE for c in f.ASSET] + CROSS


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.assembled(weekly(spark, sf_dir), UNIVERSE)


def build_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_frame(spark, sf_dir), *ALL, keys=("date",))


def feature_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.families(_frame(spark, sf_dir)).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = f.realised_vol(weekly(spark, sf_dir), (20,)).select("date", "ticker", "ret", "vol_20")
    return build.melted(rows, ("date", "ticker")).select("date", F.concat_ws("_", "ticker", "name").alias("name"), "value")


def fit_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = build.fit_statistics(_long(spark, sf_dir), _START, FIT_END)
    return fitted.select("name", "n", *[F.round(c, 6).alias(c) for c in ("low", "high", "centre", "scale")], "fit_start", "fit_end", (F.length("digest") == 64).alias("has_digest"))


def fit_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _long(spark, sf_dir)
    return build.transformed(rows, build.fit_statistics(rows, _START, FIT_END)).select("date", "name", F.round("value", 6).alias("value"))


def permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey")
    return build.permuted(customers, ["c_mktsegment"], 7, ["c_custkey"])


def build_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = weekly(spark, sf_dir)
    out = build.complete(panel, UNIVERSE, cal.observed(panel), macro_block(spark, sf_dir), drop=False)
    return rounded(out, *ALL, *MACRO, keys=("date",))


def artifact_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted once, stored, read back with its digests checked, applied to all rows."""
    root, rows = f"{_work(spark)}/artifacts-{uuid.uuid4().hex}", _long(spark, sf_dir)
    artifacts.fit_once(rows, _START, FIT_END, root, "train", "scaler")
    stored = artifacts.fitted(spark, root, "train", "scaler", _START, FIT_END)
    return artifacts.transform(rows, stored).select("date", "name", F.round("value", 6).alias("value"))


#: Columns of a ticker that measure much the same, in the order in which they are kept.
GROUPS = {"volatility": ["vol_60", "down_60", "vol_20"], "momentum": ["mom_20", "mom_60"], "shape": ["skew_60", "kurt_60"]}
_PRUNE = 0.7


def grouped_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = f.wide(f.asset_features(weekly(spark, sf_dir)), TICKERS, [c for g in GROUPS.values() for c in g])
    groups = {f"{t}|{g}": [f"{t}_{c}" for c in cols] for t in TICKERS for g, cols in GROUPS.items()}
    out = fitted.prune_groups(wide, groups, F.expr(f"date <= DATE '{FIT_END}'"), _PRUNE)
    return out.select("grp", "name", "dropped_for", F.round("abs_corr", 6).alias("abs_corr"))


def _of_universe(sql: str, panel: str | None = None) -> str:
    return sql.replace(f"panel AS ({WEEKLY})", f"panel AS ({panel or _MINE})", 1)


def _blocks(panel: str) -> list[str]:
    """SQL of the asset block and the three parts of the cross block over a panel."""
    wide = _of_universe(_ASSET, panel) + " SELECT date, " + ", ".join(f"max({c}) FILTER (ticker = '{t}') AS {t}_{c}" for t in UNIVERSE for c in f.ASSET) + " FROM a GROUP BY date"
    corr = _of_universe(_corr(60), panel) + " SELECT date, avg_corr, std_corr, avg_corr - lag(avg_corr) OVER (ORDER BY date) AS corr_change FROM d"
    dispersion = _of_universe(RET, panel) + " SELECT date, stddev_samp(ret) AS dispersion FROM r GROUP BY date"
    breadth = f"WITH panel AS ({panel}), m AS (SELECT *, {full('avg', 'close', 50)} AS m FROM panel) SELECT date, avg(CASE WHEN m IS NOT NULL THEN CASE WHEN close > m THEN 1.0 ELSE 0.0 END END) AS breadth FROM m GROUP BY date"
    return [wide, corr, dispersion, breadth]


_FILLED = f"""SELECT date, ticker, last_value(close IGNORE NULLS) OVER f AS close, last_value(volume IGNORE NULLS) OVER f AS volume
FROM (SELECT DISTINCT date FROM ({WEEKLY})) CROSS JOIN (SELECT DISTINCT ticker FROM ({_MINE})) LEFT JOIN ({_MINE}) USING (date, ticker) WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""
_PAIRS = [(t, g, a, b) for t in TICKERS for g, cols in GROUPS.items() for i, a in enumerate(cols) for b in cols[i + 1 :]]


_W, _C, _D, _B = _blocks(_MINE)
_LONG = RET + f""", v AS (SELECT *, {full('stddev_samp', 'ret', 20)} * sqrt(252) AS vol_20 FROM r),
l AS (SELECT date, ticker || '_ret' AS name, ret AS value FROM v UNION ALL SELECT date, ticker || '_vol_20', vol_20 FROM v),
i AS (SELECT * FROM l WHERE date BETWEEN DATE '{_START}' AND DATE '{FIT_END}' AND value IS NOT NULL), q AS (SELECT name, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM i GROUP BY name),
s AS (SELECT name, count(*) AS n, first(low) AS low, first(high) AS high, avg(least(greatest(value, low), high)) AS centre,
  CASE WHEN stddev_pop(least(greatest(value, low), high)) > 0 THEN stddev_pop(least(greatest(value, low), high)) ELSE 1.0 END AS scale, min(date) AS fit_start, max(date) AS fit_end FROM i JOIN q USING (name) GROUP BY name)"""

QUERIES = {
    "build_features": (build_features, "SELECT date, " + ", ".join(f"round({c}, 6) AS {c}" for c in ALL) + f" FROM ({_W}) LEFT JOIN ({_C}) USING (date) LEFT JOIN ({_D}) USING (date) LEFT JOIN ({_B}) USING (date)"),
    "feature_families": (feature_families, "WITH c AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in ALL) + """]) AS name)
SELECT CASE WHEN name LIKE '%vol%' OR name LIKE '%down%' THEN 'volatility' WHEN name LIKE '%mom%' THEN 'momentum' WHEN name LIKE '%ret%' THEN 'return' WHEN name LIKE '%corr%' OR name IN ('dispersion', 'breadth') THEN 'cross'
  WHEN name LIKE '%beta%' THEN 'beta' WHEN name LIKE '%skew%' OR name LIKE '%kurt%' THEN 'shape' WHEN name LIKE '%dist%' THEN 'trend' ELSE 'other' END AS family, count(*) AS n FROM c GROUP BY 1"""),
    "fit_artifact": (fit_artifact, _LONG + " SELECT name, n, round(low, 6) AS low, round(high, 6) AS high, round(centre, 6) AS centre, round(scale, 6) AS scale, fit_start, fit_end, true AS has_digest FROM s"),
    "fit_transform": (fit_transform, _LONG + " SELECT date, name, round(CASE WHEN value IS NOT NULL THEN (least(greatest(value, low), high) - centre) / scale END, 6) AS value FROM l JOIN s USING (name)"),
    "seeded_permutation": (permutation, """SELECT c_mktsegment, c_custkey,
  CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7|' || c_custkey) || CAST(c_custkey AS VARCHAR)) - 1 AS INTEGER) AS place FROM customer"""),
    "build_complete": (build_complete, "WITH w AS (SELECT * FROM ({}) LEFT JOIN ({}) USING (date) LEFT JOIN ({}) USING (date) LEFT JOIN ({}) USING (date) LEFT JOIN ({}) USING (date)) ".format(*_blocks(_FILLED), _MACRO)
      + "SELECT date, " + ", ".join(f"round({c}, 6) AS {c}" for c in ALL + MACRO) + " FROM w WHERE date >= (SELECT min(date) FROM w WHERE " + " AND ".join(f"isfinite({c})" for c in ALL + MACRO) + ")"),
    "artifact_store": (artifact_store, _LONG + " SELECT date, name, round(CASE WHEN value IS NOT NULL THEN (least(greatest(value, low), high) - centre) / scale END, 6) AS value FROM l JOIN s USING (name)"),
    "grouped_prune": (grouped_prune, _ASSET.replace("WITH panel", "WITH RECURSIVE panel", 1) + f""", t AS (SELECT * FROM a WHERE date <= DATE '{FIT_END}'),
rho AS ({" UNION ALL ".join(f"SELECT '{t}|{g}' AS grp, '{t}_{a}' AS a, '{t}_{b}' AS b, abs(corr({a}, {b})) AS r FROM t WHERE ticker = '{t}'" for t, g, a, b in _PAIRS)}),
members AS (SELECT * FROM (VALUES {", ".join(f"('{t}|{g}', {i}, '{t}_{c}')" for t in TICKERS for g, cols in GROUPS.items() for i, c in enumerate(cols))}) m(grp, k, name)),
known AS (SELECT grp, map(list(a || '|' || b), list(CASE WHEN isfinite(r) THEN r END)) AS m FROM rho GROUP BY grp),
g(grp, k, name, kept, dropped_for) AS (SELECT grp, k, name, [name], NULL::VARCHAR FROM members WHERE k = 0
  UNION ALL SELECT grp, k, name, CASE WHEN clash IS NULL THEN list_append(kept, name) ELSE kept END, clash
  FROM (SELECT x.grp, x.k, x.name, g.kept, list_filter(g.kept, lambda s: m[s || '|' || x.name] > {_PRUNE})[1] AS clash FROM g JOIN members x ON x.grp = g.grp AND x.k = g.k + 1 JOIN known ON known.grp = g.grp))
SELECT grp, name, dropped_for, round(CASE WHEN dropped_for IS NOT NULL THEN m[dropped_for || '|' || name] END, 6) AS abs_corr FROM g JOIN known USING (grp)"""),
}
