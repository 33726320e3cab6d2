"""Filters, smoothers, fits and model choice against plain loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import markov

DAY = dt.date(2001, 1, 1)
START, MOVE, MEAN, STD = np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([0.0, 0.5]), np.array([0.5, 2.0])


def loop(x, start, move, mean, std):
    """(filtered, smoothed, loglik of each row) by the recursions as they are written."""
    b = np.exp(-0.5 * ((x[:, None] - mean) / std) ** 2) / (std * np.sqrt(2 * np.pi))
    a, c = [], []
    for t in range(len(x)):
        joint = (start if t == 0 else a[-1] @ move) * b[t]
        c.append(joint.sum())
        a.append(joint / c[-1])
    beta = [np.ones(len(start))]
    for t in range(len(x) - 2, -1, -1):
        v = move @ (b[t + 1] * beta[-1])
        beta.append(v / v.sum())
    both = np.array(a) * np.array(beta[::-1])
    return np.array(a), both / both.sum(1, keepdims=True), np.log(c)


def series(n, seed, period=60):
    rng = np.random.default_rng(seed)
    return rng.normal(0, np.where((np.arange(n) // period) % 2, 2.0, 0.5))


@pytest.fixture(scope="module")
def rows(spark):
    data = [(t, DAY + dt.timedelta(3 * i), float(v)) for t, n in (("a", 400), ("b", 130), ("c", 1)) for i, v in enumerate(series(n, len(t) + n))]
    return spark.createDataFrame([*data, ("a", DAY - dt.timedelta(1), None), ("a", DAY - dt.timedelta(2), float("nan")), ("d", DAY, 1.0)], "ticker string, date date, v double")


@pytest.mark.parametrize("period", ["year", "month", "day"])
def test_scan_equals_the_loop(spark, rows, period):
    models = spark.createDataFrame([(t, 2, START.tolist(), MOVE.ravel().tolist(), MEAN.tolist(), STD.tolist()) for t in "abc"], f"ticker string, {markov.MODEL}")
    got = markov.posteriors(rows, models, ["ticker"], "v", period).orderBy("ticker", "date").collect()
    assert len(got) == 531
    for t in "abc":
        mine = [r for r in got if r["ticker"] == t]
        x = np.array([r["v"] for r in rows.where((F.col("ticker") == t) & F.col("v").isNotNull() & ~F.isnan("v")).orderBy("date").collect()])
        for c, want in zip(("filtered", "smoothed", "loglik"), loop(x, START, MOVE, MEAN, STD), strict=True):
            np.testing.assert_allclose([r[c] for r in mine], want, rtol=1e-9, atol=1e-12)


def test_far_values_do_not_underflow(spark):
    rows = spark.createDataFrame([("a", DAY + dt.timedelta(i), v) for i, v in enumerate([0.0, 500.0, -300.0, 0.1])], "ticker string, date date, v double")
    models = spark.createDataFrame([("a", 2, START.tolist(), MOVE.ravel().tolist(), MEAN.tolist(), STD.tolist())], f"ticker string, {markov.MODEL}")
    for r in markov.posteriors(rows, models, ["ticker"], "v", "day").collect():
        assert sum(r["filtered"]) == pytest.approx(1) and sum(r["smoothed"]) == pytest.approx(1) and np.isfinite(r["loglik"])


def test_restarts_as_an_axis_equal_single_fits():
    x = series(500, 3)
    many = markov.em(x, 2, np.arange(3))
    for i, f in enumerate(many):
        (one,) = markov.em(x, 2, np.array([i]))
        np.testing.assert_allclose(one["mean"], f["mean"])
        assert one["loglik"] == pytest.approx(f["loglik"])
    best = max(many, key=lambda f: f["loglik"])
    assert best["std"] == pytest.approx([0.5, 2.0], rel=0.15) and best["duration"].min() > 20
    # the last round's likelihood is that of the parameters before it: once more from these it cannot be lower
    assert loop(x, best["start"], best["move"].reshape(2, 2), best["mean"], best["std"])[2].sum() >= best["loglik"] - 1e-6
    np.testing.assert_allclose(best["stationary"] @ best["move"].reshape(2, 2), best["stationary"], atol=1e-9)


def test_model_choice(spark, rows):
    fit_end, val_end = str(DAY + dt.timedelta(900)), str(DAY + dt.timedelta(1100))
    got = markov.model_choice(rows.where("ticker = 'a'"), ["ticker"], "v", fit_end, val_end, (2, 3), margin=2.0, period="quarter").collect()
    x = np.array([r["v"] for r in rows.where("ticker = 'a' and v is not null and not isnan(v)").orderBy("date").collect()])
    n, m = 301, 367
    want = {}
    for k in (2, 3):
        fits = markov.em(x[:n], k, np.arange(3))
        bad = [bool((f["duration"] < 5).any() or (f["stationary"] < 0.02).any()) for f in fits]
        i = min(range(3), key=lambda i: (bad[i], -fits[i]["loglik"], i))
        f, p = fits[i], (k - 1) + k * (k - 1) + 2 * k
        val = loop(x[:m], f["start"], f["move"].reshape(k, k), f["mean"], f["std"])[2][n:].sum()
        want[k] = (f["loglik"], val, -2 * f["loglik"] + np.log(n) * p, bad[i])
    for r in got:
        assert (r["loglik"], r["val_loglik"], r["bic"]) == pytest.approx(want[r["k"]][:3], rel=1e-6) and r["degenerate"] == want[r["k"]][3]
    sound = {k: w for k, w in want.items() if not w[3]}
    top = max(w[1] for w in sound.values())
    assert [r["k"] for r in got if r["selected"]] == [min((k for k, w in sound.items() if top - w[1] <= 2), key=lambda k: sound[k][2])]


def test_near_ties_and_degenerate_fits(spark):
    fits = [("t", 2, 0, -10.0, [9.0, 9.0], [0.5, 0.5]), ("t", 2, 1, -9.0, [2.0, 9.0], [0.5, 0.5]), ("t", 3, 0, -8.0, [9.0] * 3, [0.01, 0.5, 0.49])]
    df = spark.createDataFrame(fits, "ticker string, k int, restart int, loglik double, duration array<double>, stationary array<double>")
    assert {(r["k"], r["restart"], r["degenerate"]) for r in markov.best_restarts(df, ["ticker"]).collect()} == {(2, 0, False), (3, 0, True)}


def test_walkforward(spark, rows):
    """Fold by fold in a plain loop: scale, fit, filter through both windows, keep the second."""
    cut = lambda n: DAY + dt.timedelta(n)
    folds = [(0, cut(0), cut(500), cut(540), cut(800)), (1, cut(0), cut(760), cut(801), cut(1300))]
    got = markov.walkforward(rows.where("ticker <> 'c'"), spark.createDataFrame(folds, "fold int, fit_start date, fit_end date, apply_start date, apply_end date"), "v", period="quarter")
    got = {(r["fold"], r["ticker"], r["date"]): r for r in got.collect()}
    dates = {(t, r["date"]): r["v"] for t in "ab" for r in rows.where(f"ticker = '{t}' and v is not null and not isnan(v)").collect()}
    n = 0
    for fold, fs, fe, as_, ae in folds:
        for t in "ab":
            fit = [d for (u, d) in sorted(dates) if u == t and fs <= d <= fe]
            use = [d for (u, d) in sorted(dates) if u == t and as_ <= d <= ae]
            x = np.array([dates[t, d] for d in fit])
            centre, scale = x.mean(), x.std()
            f = min(enumerate(markov.em((x - centre) / scale, 2, np.arange(3))), key=lambda e: (bool((e[1]["duration"] < 5).any() or (e[1]["stationary"] < 0.02).any()), -e[1]["loglik"], e[0]))[1]
            every = (np.array([dates[t, d] for d in fit + use]) - centre) / scale
            a, both, ll = loop(every, f["start"], f["move"].reshape(2, 2), f["mean"], f["std"])
            for d, p, s, v in zip(use, a[len(fit) :], both[len(fit) :], ll[len(fit) :], strict=True):
                r = got[fold, t, d]
                np.testing.assert_allclose([*r["filtered"], *r["smoothed"], r["loglik"]], [*p, *s, v], rtol=1e-6, atol=1e-9)
                n += 1
    assert n == len(got) and len({k[1:] for k in got}) == n  # folds tile


def test_nothing(spark, rows):
    models = spark.createDataFrame([], f"ticker string, {markov.MODEL}")
    assert markov.posteriors(rows, models, ["ticker"], "v").count() == 0
    assert markov.fit_each(rows.where("false"), ["ticker"], "v", (2,)).count() == 0
