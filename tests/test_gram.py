"""Regressions from sums against NumPy on the rows themselves."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import gram, stats

DAY = dt.date(2001, 1, 1)


def cut(n):
    return DAY + dt.timedelta(n)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = rng.normal(3, [1, 5, 0.01], (600, 3))
    y = x @ [1.0, -0.2, 30] + rng.normal(0, 2, 600)
    return [(cut(i // 2), "ab"[i % 2], *map(float, r), float(v), int(v > np.median(y))) for i, (r, v) in enumerate(zip(x, y, strict=True))]


@pytest.fixture(scope="module")
def rows(spark, data):
    odd = [(cut(5), "c", None, 1.0, 1.0, 1.0, 1), (cut(6), "c", 1.0, float("nan"), 1.0, 1.0, 0), (cut(7), "c", 1.0, 1.0, float("inf"), 1.0, 1), (cut(8), "c", 1.0, 1.0, 1.0, None, 1)]
    return spark.createDataFrame([*data, *odd], "date date, ticker string, p double, q double, r double, y double, up int").repartition(3)


def ridge(x, y, alpha):
    centre, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = (x - centre) / scale
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / scale
    return y.mean() - w @ centre, w


def test_walkforward(spark, rows, data):
    folds = [(0, cut(0), cut(99), cut(110), cut(199)), (1, cut(50), cut(199), cut(200), cut(299)), (2, cut(0), cut(0), cut(0), cut(0))]
    got = gram.ridge_walkforward(rows, spark.createDataFrame(folds, "fold int, fit_start date, fit_end date, apply_start date, apply_end date"), ["p", "q", "r"], "y").collect()
    assert len(got) == 3 * (180 + 200)
    have = {(r["fold"], r["alpha"], r["date"], r["ticker"]): r for r in got}
    for f, a, b, c, d in folds[:2]:
        fit = np.array([r[2:6] for r in data if a <= r[0] <= b])
        for alpha in (0.1, 10.0, 1000.0):
            i, w = ridge(fit[:, :3].copy(), fit[:, 3], alpha)
            for r in data:
                if c <= r[0] <= d:
                    g = have[f, alpha, r[0], r[1]]
                    assert (g["pred"], g["y"], g["base"]) == pytest.approx((i + w @ r[2:5], r[5], fit[:, 3].mean()), rel=1e-6)


def test_constant_features_get_nothing(spark):
    rows = spark.createDataFrame([(cut(i), "a", float(i % 7), 4.0, float(i % 7) * 2) for i in range(40)], "date date, ticker string, p double, q double, y double")
    (r,) = gram.coefficients(gram.gram_sums(rows, ["ticker"], ["p", "q"], "y"), ["ticker"], 2, (1e-9,)).collect()
    assert r["coef"] == pytest.approx([2, 0], abs=1e-6) and r["n_fit"] == 40


def split():
    return F.when(F.col("date") <= F.lit(cut(150)), "train").when(F.col("date") <= F.lit(cut(220)), "val").otherwise("test")


def test_probe(rows, data):
    got = {r["ticker"]: r for r in gram.ridge_probe(rows, split(), ["ticker"], ["p", "q", "r"], "y").collect()}
    assert set(got) == {"a", "b"}
    for t, r in got.items():
        part = lambda lo, hi: np.array([x[2:6] for x in data if x[1] == t and cut(lo) <= x[0] <= cut(hi)])  # noqa: B023, E731
        train, val, test = part(0, 150), part(151, 220), part(221, 400)
        mse = {}
        for a in (0.1, 10.0, 1000.0):
            i, w = ridge(train[:, :3].copy(), train[:, 3], a)
            mse[a] = np.mean((val[:, 3] - i - val[:, :3] @ w) ** 2)
        alpha = min(mse, key=lambda a: (mse[a], a))
        both = np.vstack([train, val])
        i, w = ridge(both[:, :3].copy(), both[:, 3], alpha)
        r2 = 1 - ((test[:, 3] - i - test[:, :3] @ w) ** 2).sum() / ((test[:, 3] - test[:, 3].mean()) ** 2).sum()
        assert (r["alpha"], r["n_test"]) == (alpha, len(test)) and (r["val_mse"], r["test_r2"]) == pytest.approx((mse[alpha], r2), rel=1e-6)


def newton(x, y, alpha):
    """The least penalised loss by plain gradient steps from the Newton direction, to the last digit."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w, pen = np.zeros(z.shape[1]), np.append(0, np.full(x.shape[1], alpha))
    f = lambda w: np.logaddexp(0, z @ w).sum() - y @ z @ w + 0.5 * pen @ w**2
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ w))
        g = z.T @ (p - y) + pen * w
        d = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pen), g)
        s = 1.0
        while f(w - s * d) > f(w) + 1e-13 and s > 1e-9:
            s /= 2
        w = w - s * d
    return w, np.abs(z.T @ (1 / (1 + np.exp(-z @ w)) - y) + pen * w).max()


def test_logistic(rows, data):
    got = gram.logistic(rows, ["ticker"], ["p", "q", "r"], "up", (0.1, 10.0)).collect()
    assert {(r["ticker"], r["alpha"]) for r in got if r["ticker"] in "ab"} == {(t, a) for t in "ab" for a in (0.1, 10.0)}
    for r in got:
        if r["ticker"] in "ab":
            mine = [x for x in data if x[1] == r["ticker"]]
            w, rest = newton(np.array([x[2:5] for x in mine]), np.array([x[6] for x in mine]), r["alpha"])
            assert rest < 1e-6 and r["n_fit"] == 300 and r["rounds"] < 50
            np.testing.assert_allclose([r["intercept"], *r["coef"]], w, rtol=1e-5, atol=1e-6)


def test_logistic_probe(rows, data):
    chosen, scores = gram.logistic_probe(rows, split(), ["ticker"], ["p", "q"], "up")
    area = {r["ticker"]: r["auc"] for r in stats.auc(scores, ["ticker"]).collect()}
    for r in chosen.collect():
        if r["ticker"] not in "ab":
            continue
        part = lambda lo, hi: [x for x in data if x[1] == r["ticker"] and cut(lo) <= x[0] <= cut(hi)]  # noqa: B023, E731
        train, val, test = part(0, 150), part(151, 220), part(221, 400)
        xs, ys = (lambda p: np.array([x[2:4] for x in p])), (lambda p: np.array([x[6] for x in p]))
        fits = {a: newton(xs(train), ys(train), a)[0] for a in (0.1, 10.0, 1000.0)}
        z = lambda w, p: w[0] + xs(p) @ w[1:]
        loss = {a: np.mean(np.logaddexp(0, z(w, val)) - ys(val) * z(w, val)) for a, w in fits.items()}
        best = min(loss, key=lambda a: (loss[a], -a))
        s, y = z(fits[best], test), ys(test)
        won = np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])
        assert r["alpha"] == best and r["val_loss"] == pytest.approx(loss[best], rel=1e-6) and area[r["ticker"]] == pytest.approx(won, abs=1e-6)
