"""The filter that carries its state against a plain loop over each series, whole and cut into parts."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.streaming import online

START, MOVE, MEAN, STD = [0.7, 0.3], [[0.9, 0.1], [0.2, 0.8]], [0.0, 0.1], [0.5, 1.5]
DAY = dt.date(2020, 1, 1)


def by_hand(x):
    out, p = [], np.array(START)
    for v in x:
        d = np.exp(-0.5 * ((v - np.array(MEAN)) / STD) ** 2) / (np.array(STD) * np.sqrt(2 * np.pi))
        a = p * d
        out.append((*(a / a.sum()), np.log(a.sum())))
        p = a / a.sum() @ np.array(MOVE)
    return out


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(6)
    values = {"u": rng.normal(size=60), "v": rng.normal(0, 2, size=60)}
    rows = [(t, DAY + dt.timedelta(i), float(v)) for t, x in values.items() for i, v in enumerate(x)]
    models = spark.createDataFrame([(t, 2, START, [m for r in MOVE for m in r], MEAN, STD) for t in values], "ticker string, k int, start array<double>, move array<double>, mean array<double>, std array<double>")
    return values, spark.createDataFrame(rows, "ticker string, date date, ret double"), models


def span(rows, a, b):
    return rows.where(F.col("date").between(F.lit(DAY + dt.timedelta(a)), F.lit(DAY + dt.timedelta(b))))


def found(df):
    out = {}
    for r in df.collect():
        out[r.ticker, (r.date - DAY).days] = (*r.filtered, r.loglik)
    return out


def test_parts_equal_the_whole(series, tmp_path):
    values, rows, models = series
    # v has nothing in the second part: its state is carried over that batch
    parts = [span(rows, 0, 19), span(rows, 20, 39).where("ticker = 'u'"), span(rows, 40, 59)]
    got = found(online.filter_in_parts(parts, models, ["ticker"], "ret", str(tmp_path), "month"))
    want = {("u", i): w for i, w in enumerate(by_hand(values["u"]))}
    seen = [i for i in range(60) if not 20 <= i < 40]
    want |= {("v", i): w for i, w in zip(seen, by_hand(values["v"][seen]), strict=True)}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-9)


def test_late_rows_and_gaps_have_no_result(spark, series, tmp_path):
    values, rows, models = series
    held = rows.withColumn("ret", F.when(F.col("date") != F.lit(DAY + dt.timedelta(3)), F.col("ret"))).where("ticker = 'u'")
    other = spark.createDataFrame([("w", DAY, 1.0)], rows.schema)  # a series without a model
    parts = [span(held, 0, 9), span(held, 5, 14).unionByName(other)]
    out = online.filter_in_parts(parts, models, ["ticker"], "ret", str(tmp_path))
    seen = [i for i in range(15) if i != 3]
    want = dict(zip(seen, by_hand(values["u"][seen]), strict=True))
    got = found(out)
    assert {k[1] for k in got} == set(seen) and {k[0] for k in got} == {"u"}
    for i, w in want.items():
        assert got["u", i] == pytest.approx(w, abs=1e-9)
    assert {(r.run, r["count"]) for r in out.groupBy("run").count().collect()} == {(0, 9), (1, 5)}


def test_no_parts(series, tmp_path):
    with pytest.raises(ValueError):
        online.filter_in_parts([], series[2], ["ticker"], "ret", str(tmp_path))
