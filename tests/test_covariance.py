"""Trailing covariances, shrinkage, eigenvalues and optimal weights against plain NumPy over each window."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import covariance, fitted, stats

NAMES = ["a", "b", "c"]


def returns(spark, x, holes=()):
    day = dt.date(2020, 1, 1)
    rows = [(day + dt.timedelta(i), n, None if (i, n) in holes else float(v)) for i, row in enumerate(x) for n, v in zip(NAMES, row, strict=True)]
    return spark.createDataFrame(rows, "date date, ticker string, ret double")


def shrunk_by_hand(x):
    x = x - x.mean(0)
    n, p = x.shape
    s = x.T @ x / n
    level = np.trace(s) / p
    spread = ((s - level * np.eye(p)) ** 2).sum() / p
    error = sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / p / n**2
    rho = min(error, spread) / spread if spread > 0 else 0.0
    return (1 - rho) * s + rho * level * np.eye(p), rho


def best_by_enumeration(mu, cov, gamma, cap, whole):
    """Every choice of weights at 0, at the cap and in between, with and without the budget; the best feasible one."""
    p, best, value = len(mu), None, -np.inf
    for state in itertools.product((0, 1, 2), repeat=p):
        free = [i for i in range(p) if state[i] == 2]
        w = np.array([cap if s == 1 else 0.0 for s in state])
        for bound in (True,) if whole else (True, False):
            v, k = w.copy(), len(free)
            if k:
                q = gamma * cov[np.ix_(free, free)]
                right = mu[free] - gamma * cov[free] @ w
                if bound:
                    both = np.linalg.lstsq(np.block([[q, np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]]), np.append(right, 1 - w.sum()), rcond=None)[0]
                    v[free] = both[:k]
                else:
                    v[free] = np.linalg.solve(q, right)
            if (v < -1e-9).any() or (v > cap + 1e-9).any() or v.sum() > 1 + 1e-9 or (whole and abs(v.sum() - 1) > 1e-9):
                continue
            if (got := mu @ v - gamma / 2 * v @ cov @ v) > value:
                best, value = v, got
    return best


def test_windows(spark):
    """Dates at which one series has nothing take no part; each window holds the last n of the others."""
    rng = np.random.default_rng(3)
    x = rng.normal(0.01, [0.01, 0.02, 0.05], (30, 3)) + rng.normal(0, 0.01, (30, 1))
    holes = {(7, "b"), (20, "c")}
    whole = np.delete(x, [7, 20], 0)
    moments = covariance.pair_moments(returns(spark, x, holes), NAMES, 10).cache()
    assert moments.select("date").distinct().count() == 19
    got = {}
    for r in covariance.shrunk(moments, NAMES, 10).collect():
        got.setdefault(r.date, {})[r.a, r.b] = (r["cov"], r.intensity)
    shares = {r.date: r.share for r in covariance.first_eigenvalue_share(moments).collect()}
    for k, date in enumerate(sorted(got)):
        window = whole[k : k + 10]
        want, rho = shrunk_by_hand(window)
        for (i, a), (j, b) in itertools.combinations_with_replacement(enumerate(NAMES), 2):
            assert got[date][a, b] == pytest.approx((want[i, j], rho), abs=1e-10)
        assert shares[date] == pytest.approx(np.linalg.eigvalsh(np.corrcoef(window.T))[-1] / 3, abs=1e-10)


def test_still_series(spark):
    x = np.ones((6, 3)) * [0.0, 1.0, 2.0] + np.random.default_rng(0).normal(0, 1, (6, 1)) * [0, 1, 1]
    moments = covariance.pair_moments(returns(spark, x), NAMES, 5)
    assert [r.share for r in covariance.first_eigenvalue_share(moments).collect()] == [None, None]
    none = covariance.pair_moments(returns(spark, x).limit(0), NAMES, 5)
    assert covariance.shrunk(none, NAMES, 5).count() == 0
    assert covariance.first_eigenvalue_share(none).count() == 0
    assert covariance.optimal_weights(none, NAMES, 5).count() == 0


@pytest.mark.parametrize("whole", [True, False])
def test_best_weights(whole):
    rng = np.random.default_rng(11)
    for _ in range(25):
        f = rng.normal(size=(4, 4))
        cov, mu = f @ f.T / 10 + 0.01 * np.eye(4), np.zeros(4) if whole else rng.normal(0, 0.3, 4)
        got = covariance.best_weights(mu, cov, 5.0, 0.4, whole)
        assert got == pytest.approx(best_by_enumeration(mu, cov, 5.0, 0.4, whole), abs=1e-6)


def test_optimal_weights_of_windows(spark):
    x = np.random.default_rng(5).normal(0.002, [0.01, 0.02, 0.05], (14, 3))
    moments = covariance.pair_moments(returns(spark, x), NAMES, 12)
    got = {}
    for r in covariance.optimal_weights(moments, NAMES, 12, cap=0.6).collect():
        got.setdefault(r.date, {})[r.line] = (r.mv_weight, r.min_var_weight)
    for k, date in enumerate(sorted(got)):
        window = x[k : k + 12]
        cov, mu = shrunk_by_hand(window)[0] * 252, window.mean(0) * 126
        want = zip(best_by_enumeration(mu, cov, 5.0, 0.6, False), best_by_enumeration(0 * mu, cov, 5.0, 0.6, True), strict=True)
        for n, w in zip(NAMES, want, strict=True):
            assert got[date][n] == pytest.approx(w, abs=1e-6)


def test_simplex_rows(spark):
    rows = [("x", n, s) for n, s in zip("pqrs", (0.9, 0.1, 0.0, None), strict=True)] + [("y", "p", 5.0)] + [("z", n, 0.25) for n in "pqrs"]
    scores = spark.createDataFrame(rows, "k string, line string, score double")
    got = {(r.k, r.line): r.weight for r in covariance.simplex_rows(scores, F.lit(0.5), ["k"]).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {("x", "p"): 0.5, ("x", "q"): 0.3, ("x", "r"): 0.2, **{("z", n): 0.25 for n in "pqrs"}}


def test_prune_is_greedy(spark):
    """In their order, each column against the survivors before it, in the fit rows alone."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 2))
    x = np.column_stack([base[:, 0], base[:, 0] + 0.1 * base[:, 1], base[:, 1], base[:, 1] * -1, np.ones(40), base.sum(1)])
    x[30:] = rng.normal(size=(10, 6))
    names = [f"f{i}" for i in range(6)]
    wide = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "t int, " + ", ".join(f"{n} double" for n in names))
    with np.errstate(invalid="ignore"):
        rho = np.nan_to_num(np.abs(np.corrcoef(x[:30].T)))
    kept, want = [], {}
    for j, n in enumerate(names):
        mate = next((i for i in kept if rho[i, j] > 0.6), None)
        want[n] = None if mate is None else names[mate]
        kept += [j] if mate is None else []
    assert {r.name: r.dropped_for for r in fitted.prune(wide, names, F.col("t") < 30, 0.6).collect()} == want
    assert len(kept) < 6


def test_latents(spark):
    """Principal axes by NumPy, and the control's projection by its seed."""
    x = np.random.default_rng(8).normal(size=(50, 5)) @ np.diag([5, 3, 2, 1, 0.5])
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    values, axes = np.linalg.eigh(np.cov(x.T))
    axes = axes[:, np.argsort(-values)[:2]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(2)])
    got = {r.vec_id: r.latent for r in stats.pca_latents(vectors, "embedding", "vec_id", 2).collect()}
    assert np.array([got[i] for i in range(50)]) == pytest.approx((x - x.mean(0)) @ axes, abs=1e-8)
    w = np.random.default_rng(4).uniform(-0.1, 0.1, (5, 3))
    got = {r.vec_id: r.latent for r in stats.random_projection(vectors, "embedding", "vec_id", 3, 4).collect()}
    assert np.array([got[i] for i in range(50)]) == pytest.approx(np.tanh(x @ w), abs=1e-12)
