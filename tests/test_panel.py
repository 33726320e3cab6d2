"""Hand-computed cases, causality by truncation, and streams against their batch twins."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.operators import calendar as cal
from chronopanel.operators import clean, features, regime, stats
from chronopanel.operators import portfolio as pf
from chronopanel.sources.panels import table, weekly
from chronopanel.streaming import streams

SF = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


def days(n):
    return [DAY + dt.timedelta(i) for i in range(n)]


@pytest.fixture(scope="module")
def panel(spark):
    return weekly(spark, SF).cache()


CAUSAL = [
    features.log_returns, features.realised_vol, features.downside_vol, features.vol_change, features.momentum, features.moments, features.volume_ratio, features.beta, features.distance_from_high,
    features.return_dispersion, features.breadth, lambda p: features.pairwise_correlation(p, 20), lambda p: clean.fill(clean.align(p, cal.observed(p))).drop("filled"),
]


def truncated(panel, make):
    t = F.lit("1999-06-28").cast("date")
    whole, cut = make(panel).where(F.col("date") <= t), make(panel.where(F.col("date") <= t))
    return whole.exceptAll(cut).count(), cut.exceptAll(whole).count()


@pytest.mark.parametrize("i", range(len(CAUSAL)))
def test_causal(panel, i):
    assert truncated(panel, CAUSAL[i]) == (0, 0)


def test_targets_look_ahead(panel):
    assert truncated(panel, lambda p: features.forward_vol_and_return(p).select("date", "ticker", "fwd_ret_5"))[0] > 0
    w = Window.partitionBy("ticker")
    leaky = lambda p: features.log_returns(p).withColumn("ret", F.col("ret") - F.avg("ret").over(w)).select("date", "ticker", "ret")
    assert truncated(panel, leaky)[0] > 0  # a mean over the whole sample is caught


def test_metrics(spark):
    paths = spark.createDataFrame([("s", d, r) for d, r in zip(days(5), [0.25, -0.4, 0.2, 0.5, 0.1])], "strategy string, date date, net double")
    curve = [r.equity for r in pf.equity(paths).orderBy("date").collect()]
    assert curve == pytest.approx([1.25, 0.75, 0.9, 1.35, 1.485])
    row = pf.performance(paths).first()
    assert row.ann_return == pytest.approx(1.485 ** (252 / 5) - 1) and row.max_dd == pytest.approx(-0.4) and row.dd_length == 2


def test_drift(spark):
    """A quarter in A, which grows to three times its price on day 2; rebalanced at the end of day 3 from one half."""
    w = spark.createDataFrame([("s", d, line, x) for d in (DAY, DAY + dt.timedelta(2)) for line, x in (("A", 0.25), ("CASH", 0.75))], "strategy string, decision date, line string, weight double")
    r = spark.createDataFrame([(d, line, 2.0 if line == "A" and i == 2 else 0.0) for i, d in enumerate(days(6)) for line in ("A", "CASH")], "date date, line string, r double")
    periods = cal.holding_periods(spark.createDataFrame([(d,) for d in days(6)], "date date"), decided=w.select(F.col("decision").alias("date")).distinct())
    got = {x.date: x for x in pf.drift(w, periods, r).collect()}
    assert got[DAY + dt.timedelta(2)].gross == pytest.approx(0.5)
    assert got[DAY + dt.timedelta(3)].turnover == pytest.approx(1 / 4)
    assert got[DAY + dt.timedelta(1)].turnover == pytest.approx(0.5)  # from nothing, half the distance


def test_dwell(spark):
    s = spark.createDataFrame([("t", d, x) for d, x in zip(days(9), [1, 1, 0, 0, 0, 0, 1, 2, 2])], "ticker string, date date, state int")
    assert sorted((r.state, r.length) for r in regime.dwell(s).collect()) == [(0, 4), (1, 1), (1, 2), (2, 2)]
    moved = {(r.a, r.b): r.n for r in regime.transitions(s).collect()}
    assert moved == {(1, 1): 1, (1, 0): 1, (0, 0): 3, (0, 1): 1, (1, 2): 1, (2, 2): 1}


def test_detection_in_pairs(spark):
    """A miss loses, whatever the lags of what was found."""
    make = lambda lags: spark.createDataFrame([(t, DAY + dt.timedelta(i), DAY + dt.timedelta(i + 1), x) for t, xs in lags.items() for i, x in enumerate(xs)], "ticker string, start date, end date, lag int")
    a, b = make({"x": [1, 3], "y": [1, None], "z": [2, 2], "w": [5, 5]}), make({"x": [2, 3], "y": [9, 9], "z": [2, 2], "w": [0, None]})
    got = {r.ticker: (r.missed_a, r.missed_b, r.lag_a, r.a_wins) for r in regime.compare_detection(a, b).collect()}
    assert got == {"x": (0, 0, 2.0, True), "y": (1, 0, 1.0, False), "z": (0, 0, 2.0, False), "w": (0, 1, 5.0, True)}


def test_fill_is_capped(spark):
    p = spark.createDataFrame([("t", d, x, 1.0) for d, x in zip(days(8), [None, 1.0, None, None, None, None, 2.0, None])], "ticker string, date date, close double, volume double")
    got = [r.close for r in clean.fill(p).orderBy("date").collect()]
    assert got == [None, 1.0, 1.0, 1.0, 1.0, None, 2.0, 2.0]


def test_projection(spark):
    x = spark.createDataFrame([([0.9, 0.1, 0.0, 0.0], [0.35] * 4)], "x array<double>, caps array<double>")
    w = x.select(pf.capped_simplex(F.col("x"), F.col("caps")).alias("w")).first().w
    assert sum(w) == pytest.approx(1) and max(w) <= 0.35 + 1e-9 and w[0] == max(w)


def test_gates(spark):
    rows = [("a", i, -2.0, -1.0) for i in range(3)] + [("a", 3, -1.0, 1.0)] + [("b", i, -2.0, -1.0) for i in range(3)] + [("b", 3, 1.0, 2.0)]
    got = {r.name: r.passed for r in stats.gates(spark.createDataFrame(rows, "name string, target int, low double, high double")).collect()}
    assert got == {"a": True, "b": False}


def test_baum_welch_recovers_two_states():
    import numpy as np

    rng = np.random.default_rng(0)
    state = (np.arange(600) // 100) % 2
    fit = regime.baum_welch(rng.normal(0, np.where(state, 2.0, 0.5)), 2, 0)
    assert fit["std"][0] == pytest.approx(0.5, rel=0.15) and fit["std"][1] == pytest.approx(2.0, rel=0.15)


def test_streams_equal_batch(spark, tmp_path):
    events = table(spark, SF, "events")
    stream = streams.run_now(streams.tumbling(streams.event_stream(spark, SF)), "complete", str(tmp_path))
    assert sorted(map(str, stream.collect())) == sorted(map(str, streams.tumbling(events).collect()))
    carried = streams.run_now(streams.carried_mean(streams.event_stream(spark, SF)), "update", str(tmp_path))
    got = {r.event_type: (r.n, round(r.ema, 9)) for r in carried.groupBy("event_type").agg(F.max("n").alias("n"), F.max_by("ema", "n").alias("ema")).collect()}
    assert got == {r.event_type: (r.n, round(r.ema, 9)) for r in streams.carried_mean_batch(events).collect()}
