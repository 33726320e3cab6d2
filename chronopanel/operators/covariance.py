"""Trailing covariances of many series from pairs: each pair of series is a window partition, so no row holds a window and
no task all dates. Shrinkage needs sums over a date's pairs only. What leaves Spark's expressions is a date's matrix, as
large as the square of the number of series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.windows import trailing


def pair_moments(returns: DataFrame, names: list[str], n: int = 60) -> DataFrame:
    """(date, a, b, mean_a, mean_b, cov, fourth) of returns (date, ticker, ret), a <= b: over the last n dates at which all
    names have a return, the means, the population covariance, and the mean of the product of both squared deviations.
    Dates before the n-th have no row."""
    held = returns.where(F.col("ticker").isin(names) & F.col("ret").isNotNull() & ~F.isnan("ret")).select("date", "ticker", "ret")
    held = held.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("date"))).where(F.col("__n") == len(names)).drop("__n")
    other = held.select("date", F.col("ticker").alias("b"), F.col("ret").alias("y"))
    both = held.select("date", F.col("ticker").alias("a"), F.col("ret").alias("x")).join(other, "date").where("a <= b")
    w, x, y = trailing(n, ("a", "b")), F.col("x"), F.col("y")
    e = {"e10": x, "e01": y, "e11": x * y, "e20": x * x, "e02": y * y, "e21": x * x * y, "e12": x * y * y, "e22": x * x * y * y}
    seen = both.withColumns({**{k: F.avg(v).over(w) for k, v in e.items()}, "cov": F.covar_pop("x", "y").over(w), "__n": F.count(F.lit(1)).over(w)}).where(F.col("__n") == n)
    ma, mb = F.col("e10"), F.col("e01")
    fourth = F.col("e22") - 2 * mb * F.col("e21") - 2 * ma * F.col("e12") + mb**2 * F.col("e20") + ma**2 * F.col("e02") + 4 * ma * mb * F.col("e11") - 3 * ma**2 * mb**2
    return seen.select("date", "a", "b", ma.alias("mean_a"), mb.alias("mean_b"), "cov", fourth.alias("fourth"))


def shrunk(moments: DataFrame, names: list[str], n: int = 60) -> DataFrame:
    """(date, a, b, cov, intensity) of pair_moments(): each date's covariances drawn towards a multiple of the identity, by
    the share that minimises the expected squared error. Equal variances without covariance stay as they are."""
    p, day = len(names), Window.partitionBy("date")
    same = F.col("a") == F.col("b")
    times = F.when(same, 1).otherwise(2)
    total = lambda x: F.sum(x).over(day)
    level = total(F.when(same, F.col("cov"))) / p
    square = total(times * F.col("cov") ** 2)
    out = moments.withColumns({"m": level, "d2": (square - p * level**2) / p, "b2": (total(times * F.col("fourth")) - square) / (n * p)})
    rho = F.when(F.col("d2") > 0, F.least(F.greatest(F.col("b2"), F.lit(0.0)), F.col("d2")) / F.col("d2")).otherwise(0.0)
    return out.withColumn("intensity", rho).select("date", "a", "b", ((1 - F.col("intensity")) * F.col("cov") + F.when(same, F.col("intensity") * F.col("m")).otherwise(0.0)).alias("cov"), "intensity")


def matrices(pairs: DataFrame, *values: str) -> DataFrame:
    """(date, rows): a date's pairs in order of (a, b), as structs with the values; their number is that of the pairs."""
    return pairs.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("a", "b", *values))).alias("rows"))


def _square(rows: list, value: str) -> np.ndarray:
    """Rows in order of (a, b), a <= b, as a symmetric matrix."""
    x = np.array([r[value] for r in rows], float)
    p = int((np.sqrt(8 * len(x) + 1) - 1) / 2)
    out = np.zeros((p, p))
    at = np.triu_indices(p)
    out[at] = x
    return out + np.triu(out, 1).T


def _by_date(found: DataFrame, solve: Callable[[pd.Timestamp, list], list], kind: str) -> DataFrame:
    names = [c.split()[0] for c in kind.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for date, rows in zip(pdf["date"], pdf["rows"], strict=True) for r in solve(date, rows)], columns=names)

    return found.mapInPandas(run, kind)


def first_eigenvalue_share(moments: DataFrame) -> DataFrame:
    """(date, share): the largest eigenvalue of a date's correlations over their number, NULL if a series stands still."""

    def solve(date, rows: list) -> list:  # noqa: ANN001
        c = _square(rows, "cov")
        sd = np.sqrt(np.maximum(np.diag(c), 0))
        return [(date, float(np.linalg.eigvalsh(c / np.outer(sd, sd))[-1] / len(c)) if (sd > 0).all() else None)]

    return _by_date(matrices(moments, "cov"), solve, "date date, share double")


def projected(w: np.ndarray, cap: float) -> np.ndarray:
    """The nearest point with entries in 0 to cap that sum to 1; all at cap if their caps don't sum to 1."""
    lo, hi = w.min() - cap - 1, w.max()
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(w - mid, 0, cap).sum() > 1 else (lo, mid)
    return np.clip(w - lo, 0, cap)


def best_weights(mu: np.ndarray, cov: np.ndarray, gamma: float, cap: float, whole: bool, tol: float = 1e-12, rounds: int = 20000) -> np.ndarray:
    """Maximises mu w - gamma / 2 w cov w with entries in 0 to cap that sum to 1 (whole) or to 1 at most, by projected
    gradients with momentum, started again when it turns against the gradient; done when a step moves no weight by tol."""
    fit = lambda v: np.clip(v, 0, cap) if not whole and np.clip(v, 0, cap).sum() <= 1 else projected(v, cap)
    rate = 1 / max(1e-12, gamma * np.linalg.eigvalsh(cov)[-1])
    w = ahead = fit(np.full(len(mu), 1 / len(mu)))
    speed = 1.0
    for _ in range(rounds):
        new = fit(ahead + rate * (mu - gamma * cov @ ahead))
        step = new - w
        if (ahead - new) @ step > 0:
            speed, ahead = 1.0, w
            new = fit(w + rate * (mu - gamma * cov @ w))
            step = new - w
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        ahead, w, speed = new + (speed - 1) / faster * step, new, faster
        if np.abs(step).max() < tol:
            break
    return w


def optimal_weights(moments: DataFrame, names: list[str], n: int = 60, gamma: float = 5.0, cap: float = 0.35, year: float = 252.0) -> DataFrame:
    """(date, line, mv_weight, min_var_weight): mean-variance with full investment at most, on half the mean return, and
    least variance fully invested, both with weights in 0 to cap and on the shrunk covariances of a year."""
    means = moments.where("a = b").select("date", "a", "b", F.col("mean_a").alias("mean"))
    found = matrices(shrunk(moments, names, n).join(means, ["date", "a", "b"], "left"), "cov", "mean")

    def solve(date, rows: list) -> list:  # noqa: ANN001
        cov, lines = _square(rows, "cov") * year, [r["a"] for r in rows if r["a"] == r["b"]]
        mu = np.array([r["mean"] for r in rows if r["a"] == r["b"]], float) * year / 2
        both = best_weights(mu, cov, gamma, cap, False), best_weights(np.zeros(len(mu)), cov, gamma, cap, True)
        return [(date, line, float(u), float(v)) for line, u, v in zip(lines, *both, strict=True)]

    return _by_date(found, solve, "date date, line string, mv_weight double, min_var_weight double")


def simplex_rows(scores: DataFrame, cap: Column, keys: list[str]) -> DataFrame:
    """(keys, line, weight) of scores (keys, line, score): each group's nearest point with weights in 0 to cap that sum to
    1. Groups without room for that (caps below 1 in sum) and rows without a score have no result; lines are few."""
    from chronopanel.operators.portfolio import capped_simplex

    sets = scores.where("score is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line", F.col("score").cast("double").alias("score"), cap.cast("double").alias("cap")))).alias("s"))
    room = sets.where(F.aggregate("s", F.lit(0.0), lambda t, v: t + v["cap"]) >= 1)
    w = room.withColumn("w", capped_simplex(F.col("s.score"), F.col("s.cap")))
    return w.select(*keys, F.inline(F.zip_with("s", "w", lambda s, v: F.struct(s["line"].alias("line"), v.alias("weight")))))
