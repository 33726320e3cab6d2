"""Costs, exposures, seeds, one-hot columns, bands, and stored results, by hand and in their odd cases."""

import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from chronopanel.operators import costs
from chronopanel.sources import results

DAYS = [dt.date(2020, 1, 3), dt.date(2020, 1, 10), dt.date(2020, 1, 17)]
WEIGHTS = "strategy string, decision date, line string, weight double"


def weights(spark):
    """A line that leaves and comes back, one that stays, and another strategy."""
    rows = [("s", DAYS[0], "a", 0.6), ("s", DAYS[0], "b", 0.4), ("s", DAYS[1], "b", 0.4), ("s", DAYS[1], "cash", 0.6), ("s", DAYS[2], "a", 0.5), ("s", DAYS[2], "b", 0.5), ("t", DAYS[1], "a", 1.0)]
    return spark.createDataFrame(rows, WEIGHTS)


def test_trades(spark):
    got = {(r.strategy, r.decision, r.line): round(r.trade, 9) for r in costs.trades(weights(spark)).collect()}
    assert got == {
        ("s", DAYS[0], "a"): 0.6, ("s", DAYS[0], "b"): 0.4, ("s", DAYS[1], "a"): -0.6, ("s", DAYS[1], "cash"): 0.6,
        ("s", DAYS[2], "a"): 0.5, ("s", DAYS[2], "b"): 0.1, ("s", DAYS[2], "cash"): -0.6, ("t", DAYS[1], "a"): 1.0,
    }


def test_trade_costs(spark):
    vols = spark.createDataFrame([(DAYS[0], "a", 0.2), (DAYS[1], "a", 0.3), (DAYS[2], "b", None)], "decision date, line string, vol double")
    got = {(r.strategy, r.decision, r.factor): (round(r.turnover, 9), round(r.cost, 12)) for r in costs.trade_costs(weights(spark), vols, 10.0, 0.01, (1.0, 2.0), "cash").collect()}
    first = 0.6 * (0.001 + 0.002) + 0.4 * 0.001
    assert got["s", DAYS[0], 1.0] == (0.5, pytest.approx(first)) and got["s", DAYS[0], 2.0] == (0.5, pytest.approx(2 * first))
    assert got["s", DAYS[1], 1.0] == (0.6, pytest.approx(0.6 * 0.004))
    assert got["s", DAYS[2], 1.0] == (0.6, pytest.approx(0.6 * 0.001))
    assert got["t", DAYS[1], 1.0] == (0.5, pytest.approx(0.004)) and len(got) == 8
    assert costs.trade_costs(weights(spark).limit(0), vols, 10.0, 0.01).count() == 0


def test_regime_exposure(spark):
    rows = spark.createDataFrame([(0.0, 0.12), (1.0, 0.12), (0.5, 0.01), (0.5, None), (None, 0.2), (0.0, 1.2)], "p double, vol double")
    got = [r.e for r in rows.select(costs.regime_exposure(F.col("p"), F.col("vol")).alias("e")).collect()]
    assert got == [pytest.approx(1.0), pytest.approx(0.5), 1.0, None, None, pytest.approx(0.1)]


def test_metric_row(spark):
    paths = [("s", DAYS[0], 0.01, 1.0), ("s", DAYS[1], -0.02, 0.0), ("s", DAYS[2], 0.03, 0.5), ("lost", DAYS[0], -1.5, 0.0)]
    got = {r.strategy: r for r in costs.metric_row(spark.createDataFrame(paths, "strategy string, date date, gross double, turnover double"), 20.0).collect()}
    net = [0.01 - 0.002, -0.02, 0.03 - 0.001]
    gross = (1.01 * 0.98 * 1.03) ** 84 - 1
    after = math.prod(1 + x for x in net) ** 84 - 1
    mean = sum(net) / 3
    sd = math.sqrt(sum((x - mean) ** 2 for x in net) / 2)
    s = got["s"]
    assert (s.n, s.gross_return, s.net_return, s.cost_drag) == (3, pytest.approx(gross), pytest.approx(after), pytest.approx(gross - after))
    assert (s.net_vol, s.net_sharpe, s.turnover) == (pytest.approx(sd * math.sqrt(252)), pytest.approx(mean / sd * math.sqrt(252)), pytest.approx(126))
    assert (got["lost"].gross_return, got["lost"].net_sharpe) == (-1.0, None)


def test_derived_seed(spark):
    rows = spark.createDataFrame([("encoder", 3), ("encoder", None), ("", 0)], "stage string, fold int")
    got = [r.s for r in rows.select(costs.derived_seed(42, F.col("stage"), F.col("fold")).alias("s")).collect()]
    assert got == [int.from_bytes(hashlib.sha256(x).digest()[:4], "big") for x in (b"42|encoder|3", b"42|encoder", b"42||0")]


def test_one_hot(spark):
    rows = spark.createDataFrame([(0,), (2,), (None,), (7,)], "s int").select(*costs.one_hot(F.col("s"), 3))
    assert [tuple(r) for r in rows.collect()] == [(1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (None, None, None), (0.0, 0.0, 0.0)]


def test_results_by_pattern_and_bands(spark, tmp_path):
    """Two steps: a seed with many rows counts as one seed."""
    rows = [("eval", "a b", 1, 1.0), ("eval", "a b", 1, 3.0), ("eval", "a b", 12, 5.0), ("eval", "c", 1, None), ("eval", "c", 2, 4.0), ("train", "c", 1, 100.0)]
    frame = spark.createDataFrame(rows, "stage string, config string, seed int, score double")
    root = str(tmp_path / "runs")
    results.write_results(frame, root)
    found = results.read_results(spark, root, "score double, missing string", "eval")
    assert {(r.config, r.seed, r.score) for r in found.collect()} == {("a b", "1", 1.0), ("a b", "1", 3.0), ("a b", "12", 5.0), ("c", "1", None), ("c", "2", 4.0)}
    assert {r.missing for r in found.collect()} == {None} and all("/stage=eval/" in r.file for r in found.collect())
    assert results.read_results(spark, root, "score double", "eval", "c", "1*").count() == 1
    got = {r.config: tuple(r)[1:] for r in costs.seed_bands(found.drop("missing"), "config", ["score"]).collect()}
    assert got == {"a b": ("score", 2, 3.5, pytest.approx(math.sqrt(4.5)), 2.0, 5.0), "c": ("score", 1, 4.0, None, 4.0, 4.0)}
    (tmp_path / "runs" / "stage=eval" / "config=c" / "seed=2" / "bad.json").write_text('{"score": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        results.read_results(spark, root, "score double", "eval").collect()


def test_tables(spark, tmp_path):
    frame = spark.createDataFrame([("x", 1, 0.5), ("y", 2, None)], "k string, n int, v double")
    for _ in range(2):  # in place of what is there
        results.write_table(frame, str(tmp_path / "csv"), kind="csv")
        results.write_table(frame, str(tmp_path / "parquet"), ["k"])
    assert {tuple(r) for r in spark.read.schema(frame.schema).option("header", True).csv(str(tmp_path / "csv")).collect()} == {("x", 1, 0.5), ("y", 2, None)}
    assert (tmp_path / "parquet" / "k=x").is_dir() and spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    with pytest.raises(ValueError):
        results.write_table(frame, str(tmp_path / "other"), kind="orc")
