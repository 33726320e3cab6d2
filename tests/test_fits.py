"""Fits of hidden Markov models whose expectations are taken over every path of states, and the choice among fits."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest

from chronopanel.operators import regime


def fit_over_paths(x, k, seed, rounds=50):
    """Expectation-maximisation with the posterior of all k^n paths written out."""
    n, draws = len(x), np.random.default_rng(seed).random(k)
    mean, std, start = np.quantile(x, (np.arange(k) + draws) / k), np.full(k, x.std() + 1e-9), np.full(k, 1 / k)
    move = np.where(np.eye(k, dtype=bool), 0.9, 0.1 / (k - 1))
    paths, last = list(itertools.product(range(k), repeat=n)), -math.inf
    for _ in range(rounds):
        density = lambda t, s: math.exp(-0.5 * ((x[t] - mean[s]) / std[s]) ** 2) / (std[s] * math.sqrt(2 * math.pi))  # noqa: B023, E731
        chance = [start[p[0]] * math.prod(move[i, j] for i, j in itertools.pairwise(p)) * math.prod(density(t, s) for t, s in enumerate(p)) for p in paths]
        whole = sum(chance)
        post, pair = np.zeros((n, k)), np.zeros((k, k))
        for p, c in zip(paths, chance, strict=True):
            for t, s in enumerate(p):
                post[t, s] += c / whole
            for i, j in itertools.pairwise(p):
                pair[i, j] += c / whole
        start, move, weight = post[0], pair / pair.sum(1, keepdims=True), post.sum(0)
        mean = (post * x[:, None]).sum(0) / weight
        std = np.sqrt((post * (x[:, None] - mean) ** 2).sum(0) / weight) + 1e-9
        now = math.log(whole)
        if now - last < 1e-8 * abs(now):
            break
        last = now
    order = np.argsort(std, kind="stable")
    return last, mean[order], std[order], start[order], move[order][:, order].ravel()


@pytest.mark.parametrize(("k", "seed"), [(2, 0), (2, 1), (3, 2)])
def test_fits_equal_those_over_all_paths(spark, k, seed):
    x = np.array([0.1, -0.2, 0.05, 2.0, -1.7, 0.3, -0.1])
    rows = spark.createDataFrame([("u", dt.date(2020, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(x)], "ticker string, date date, v double")
    (got,) = regime.fit_hmms(rows, "v", (k,), (seed,)).collect()
    loglik, mean, std, start, move = fit_over_paths(x, k, seed)
    assert got.loglik == pytest.approx(loglik, abs=1e-4)
    assert got.bic == pytest.approx(-2 * loglik + ((k - 1) + k * (k - 1) + 2 * k) * math.log(len(x)), abs=1e-3)
    for a, b in ((got["mean"], mean), (got["std"], std), (got.start, start), (got.move, move)):
        assert a == pytest.approx(list(b), abs=1e-3)


def test_choice(spark):
    """Degenerate fits go, then the likeliest seed of each k, then the least criterion."""
    stay, leave = [0.9, 0.1, 0.1, 0.9], [0.9, 0.1, 0.6, 0.4]
    rows = [("u", 2, 0, -10.0, 30.0, stay), ("u", 2, 1, -5.0, 20.0, leave), ("u", 2, 2, -9.0, 28.0, stay), ("u", 3, 0, -8.0, 29.0, [0.9, 0.1, 0.0, 0.1, 0.9, 0.0, 0.0, 0.1, 0.9]), ("v", 2, 0, -1.0, 5.0, leave)]
    fits = spark.createDataFrame(rows, "ticker string, k int, seed int, loglik double, bic double, move array<double>")
    assert [(r.ticker, r.k, r.seed) for r in regime.select_fits(fits).collect()] == [("u", 2, 2)]
