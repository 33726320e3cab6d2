"""Gaussian hidden Markov models over long series: filter and smoother as a prefix scan, walk-forward fits, model choice.

With A the moves and B_t the diagonal of the emission densities of row t, the forward recursion multiplies by A B_t at
each row, and the backward one from the other side. A block of rows is then one k x k matrix: its product, rescaled, does
to a vector what the rows would do one by one. So series are cut into blocks of time, blocks are multiplied out side by
side, a series' block matrices (a row a block) are run through in both directions, and each block does its own rows again
from the vectors that enter it. No task sees more of a series than a block of rows, or a row for each of its blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a fitted model's row holds, next to its keys.
MODEL = "k int, start array<double>, move array<double>, mean array<double>, std array<double>"
FITTED = f"{MODEL}, loglik double, stationary array<double>, duration array<double>, restart int, n_fit long"


def _matrix(pdf: pd.DataFrame) -> tuple:
    first = pdf.iloc[0]
    k = int(first["k"])
    return np.array(first["start"], float), np.array(first["move"], float).reshape(k, k), np.array(first["mean"], float), np.array(first["std"], float)


def densities(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(density of each row in each state over the row's largest, log of that largest)."""
    logs = -0.5 * ((x[..., None] - mean) / std) ** 2 - np.log(std * np.sqrt(2 * np.pi))
    top = logs.max(-1)
    return np.exp(logs - top[..., None]), top


def _with_models(rows: DataFrame, models: DataFrame, keys: list[str], value: str, period: str) -> DataFrame:
    """Rows with a value, their block, and their series' model; models has one row a series."""
    found = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, "date", F.col(value).cast("double").alias("x"), F.date_trunc(period, F.col("date").cast("timestamp")).alias("block"))
    return found.join(models.select(*keys, "k", "start", "move", "mean", "std"), keys)


def posteriors(rows: DataFrame, models: DataFrame, keys: list[str], value: str, period: str = "year") -> DataFrame:
    """(keys, date, filtered array, smoothed array, loglik) of rows (keys, date, value): the state's probabilities given the
    rows so far, and given all rows of the series; loglik is the row's own, given those before it.

    Blocks are calendar periods (year, quarter, month, ...). Rows without a value take no part, series without a model
    neither. Dates are distinct within a series.
    """
    names = {f.name: f.dataType.simpleString() for f in rows.select(*keys).schema}
    head = ", ".join(f"{k} {t}" for k, t in names.items())
    cut = _with_models(rows, models, keys, value, period)

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        start, move, mean, std = _matrix(pdf)
        b, top = densities(pdf.sort_values("date")["x"].to_numpy(), mean, std)
        m, scale = np.diag(b[0]), top.sum()
        for row in b[1:]:
            m = (m @ move) * row
            s = m.sum()
            m, scale = m / s, scale + np.log(s)
        one = pdf.iloc[0]
        return pd.DataFrame([{**{c: one[c] for c in keys}, "block": one["block"], "k": len(start), "start": start, "move": move.ravel(), "product": m.ravel(), "scale": scale}])

    blocks = cut.groupBy(*keys, "block").applyInPandas(product, f"{head}, block timestamp, k int, start array<double>, move array<double>, product array<double>, scale double")

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        """The vectors that enter each block: the state's chances before its first row, and what follows its last one."""
        pdf = pdf.sort_values("block")
        k = int(pdf["k"].iloc[0])
        move = np.array(pdf["move"].iloc[0], float).reshape(k, k)
        products = [np.array(p, float).reshape(k, k) for p in pdf["product"]]
        ahead, behind, v = [], [], np.array(pdf["start"].iloc[0], float)
        for p in products:
            ahead.append(v)
            v = v @ p
            v = v / v.sum() @ move
        v = np.ones(k)
        for p in reversed(products):
            behind.append(v)
            v = move @ (p @ v)
            v = v / v.sum()
        return pd.DataFrame({**{c: pdf[c] for c in keys}, "block": pdf["block"], "ahead": ahead, "behind": behind[::-1]})

    ends = blocks.groupBy(*keys).applyInPandas(enter, f"{head}, block timestamp, ahead array<double>, behind array<double>")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        _, move, mean, std = _matrix(pdf)
        b, top = densities(pdf["x"].to_numpy(), mean, std)
        a, ll, prior = np.empty_like(b), np.empty(len(b)), np.array(pdf["ahead"].iloc[0], float)
        for t in range(len(b)):
            joint = prior * b[t]
            s = joint.sum()
            a[t], ll[t] = joint / s, np.log(s) + top[t]
            prior = a[t] @ move
        both, v = np.empty_like(b), np.array(pdf["behind"].iloc[0], float)
        for t in range(len(b) - 1, -1, -1):
            joint = a[t] * v
            both[t] = joint / joint.sum()
            v = move @ (b[t] * v)
            v = v / v.sum()
        return pd.DataFrame({**{c: pdf[c] for c in keys}, "date": pdf["date"], "filtered": list(a), "smoothed": list(both), "loglik": ll})

    kind = rows.schema["date"].dataType.simpleString()
    return cut.join(ends, [*keys, "block"]).groupBy(*keys, "block").applyInPandas(inside, f"{head}, date {kind}, filtered array<double>, smoothed array<double>, loglik double")


def em(x: np.ndarray, k: int, seeds: np.ndarray, rounds: int = 50, tol: float = 1e-8) -> list[dict]:
    """Fits from several random starts at once, an axis of the arrays; states in order of their deviation. A start is
    done when a round adds less than tol of its likelihood."""
    s, n = len(seeds), len(x)
    draws = np.stack([np.random.default_rng(int(i)).random(k) for i in seeds])
    mean = np.quantile(x, (np.arange(k) + draws) / k)
    std, start = np.full((s, k), x.std() + 1e-9), np.full((s, k), 1 / k)
    move = np.tile(np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1)), (s, 1, 1))
    last, open_ = np.full(s, -np.inf), np.ones(s, bool)
    for _ in range(rounds):
        if not open_.any():
            break
        m, d, st, mv = mean[open_], std[open_], start[open_], move[open_]
        b, top = densities(x[:, None].repeat(len(m), 1), m, d)  # rows, starts, states
        a, c, back = np.empty_like(b), np.empty(b.shape[:2]), np.ones_like(b)
        for t in range(n):
            a[t] = (st if t == 0 else np.einsum("si,sij->sj", a[t - 1], mv)) * b[t]
            c[t] = a[t].sum(-1)
            a[t] /= c[t][:, None]
        for t in range(n - 2, -1, -1):
            back[t] = np.einsum("sij,sj->si", mv, b[t + 1] * back[t + 1]) / c[t + 1][:, None]
        post = a * back
        pair = np.einsum("tsi,tsj->sij", a[:-1], b[1:] * back[1:] / c[1:, :, None]) * mv
        weight = np.maximum(post.sum(0), 1e-300)
        mean[open_] = (post * x[:, None, None]).sum(0) / weight
        std[open_] = np.sqrt((post * (x[:, None, None] - mean[open_]) ** 2).sum(0) / weight) + 1e-9
        start[open_], move[open_] = post[0], pair / np.maximum(pair.sum(-1, keepdims=True), 1e-300)
        now, places = (np.log(c) + top).sum(0), np.flatnonzero(open_)
        open_[places[now - last[places] < tol * np.abs(now)]] = False
        last[places] = now
    out = []
    for i in range(s):
        o = np.argsort(std[i], kind="stable")
        mv = move[i][o][:, o]
        out.append({"k": k, "start": start[i][o], "move": mv.ravel(), "mean": mean[i][o], "std": std[i][o], "loglik": float(last[i]), "stationary": stationary(mv), "duration": 1 / np.maximum(1 - np.diag(mv), 1e-12)})
    return out


def stationary(move: np.ndarray) -> np.ndarray:
    """The shares that the moves leave as they are: the least-squares solution of p = p A with sum 1."""
    k = len(move)
    system, want = np.vstack([move.T - np.eye(k), np.ones(k)]), np.append(np.zeros(k), 1.0)
    return np.linalg.lstsq(system, want, rcond=None)[0]


def fit_each(rows: DataFrame, keys: list[str], value: str, states: tuple[int, ...], restarts: int = 3, seed: int = 0) -> DataFrame:
    """A row a series, number of states and restart, of rows (keys, date, value): FITTED. One series' fit is one task, as
    every round needs all its rows; its restarts are an axis of the arrays. Too few rows (10 a state) give no fit."""
    names = {f.name: f.dataType.simpleString() for f in rows.select(*keys).schema}
    grid = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, "date", F.col(value).cast("double").alias("x")).withColumn("k", F.explode(F.array(*map(F.lit, states))))
    columns = [*names, *[c.split(" ")[0] for c in FITTED.split(", ")]]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, k = pdf.sort_values("date")["x"].to_numpy(), int(pdf["k"].iloc[0])
        if len(x) < 10 * k:
            return pd.DataFrame(columns=columns)
        same = {c: pdf[c].iloc[0] for c in names}
        return pd.DataFrame([{**same, **f, "restart": i, "n_fit": len(x)} for i, f in enumerate(em(x, k, seed + np.arange(restarts)))])[columns]

    return grid.groupBy(*keys, "k").applyInPandas(fit, ", ".join(f"{c} {t}" for c, t in names.items()) + f", {FITTED}")


def degenerate(duration: float = 5.0, share: float = 0.02) -> Column:
    """A state is left too soon on average, or holds too small a share in the long run."""
    return F.exists("duration", lambda d: d < duration) | F.exists("stationary", lambda p: p < share)


def best_restarts(fits: DataFrame, keys: list[str], duration: float = 5.0, share: float = 0.02) -> DataFrame:
    """Of each series and number of states the likeliest restart among those that are not degenerate, or among all, if all
    are; column degenerate says so. Ties to the first."""
    order = Window.partitionBy(*keys, "k").orderBy("degenerate", F.desc("loglik"), "restart")
    return fits.withColumn("degenerate", degenerate(duration, share)).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def model_choice(rows: DataFrame, keys: list[str], value: str, fit_end: str, val_end: str, states: tuple[int, ...] = (2, 3), restarts: int = 3, seed: int = 0, margin: float = 2.0, duration: float = 5.0, share: float = 0.02, period: str = "year") -> DataFrame:
    """(keys, k, n_params, loglik, val_loglik, bic, aic, degenerate, selected, reason): fits of each number of states on the
    rows to fit_end, and the likelihood of those after it to val_end by a filter that has run through all rows before.

    Of the numbers whose best fit is not degenerate the one of the highest val_loglik is selected, unless others come
    within margin of it: then that of the lowest BIC among these. A series all of whose fits are degenerate has none.
    """
    until = lambda d: F.col("date") <= F.lit(d).cast("date")
    best = best_restarts(fit_each(rows.where(until(fit_end)), keys, value, states, restarts, seed), keys, duration, share)
    # Each number of states is a series of its own to the filter.
    copies = rows.where(until(val_end)).withColumn("states", F.explode(F.array(*map(F.lit, states))))
    scored = posteriors(copies, best.withColumn("states", F.col("k")), [*keys, "states"], value, period).where(~until(fit_end))
    val = scored.groupBy(*keys, F.col("states").alias("k")).agg(F.sum("loglik").alias("val_loglik"))
    k = F.col("k")
    free = (k - 1) + k * (k - 1) + 2 * k
    table = best.join(val, [*keys, "k"]).withColumn("n_params", free)
    table = table.withColumns({"bic": -2 * F.col("loglik") + F.ln("n_fit") * free, "aic": -2 * F.col("loglik") + 2 * free})
    top = F.max(F.when(~F.col("degenerate"), F.col("val_loglik"))).over(Window.partitionBy(*keys))
    near = (~F.col("degenerate")) & (top - F.col("val_loglik") <= margin)
    table = table.withColumn("near", F.coalesce(near, F.lit(False))).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("near"), "bic", "k")))
    ties = F.count_if("near").over(Window.partitionBy(*keys))
    table = table.withColumn("ties", ties).withColumn("selected", F.col("near") & (F.col("rank") == 1))
    reason = F.when(F.col("degenerate"), "degenerate").when(F.col("selected") & (F.col("ties") > 1), "lowest bic of a near tie").when(F.col("selected"), "highest likelihood").when(F.col("near"), "higher bic of a near tie").otherwise("less likely")
    return table.select(*keys, "k", "n_params", "loglik", "val_loglik", "bic", "aic", "degenerate", "selected", reason.alias("reason"))


def walkforward(rows: DataFrame, folds: DataFrame, value: str, k: int = 2, restarts: int = 3, seed: int = 0, period: str = "year", duration: float = 5.0, share: float = 0.02) -> DataFrame:
    """(fold, ticker, date, filtered, smoothed, loglik, degenerate) of the rows that folds (fold, fit_start, fit_end,
    apply_start, apply_end) apply to, a row a ticker and date: values are centred and scaled by the fold's fit rows, a
    model is fitted on these, and the filter runs from the first fit row through the last one to apply to, so that the
    state is carried from one window to the other; rows between the two windows take no part. smoothed sees all rows of
    its fold and is for diagnosis only. Folds of a ticker without a fit give no rows."""
    small = F.broadcast(folds)  # one row a fold of the calendar
    x = F.col(value)
    known = rows.where(x.isNotNull() & ~F.isnan(value)).select("ticker", "date", x.cast("double").alias("raw"))
    in_fit, in_apply = F.col("date").between(F.col("fit_start"), F.col("fit_end")), F.col("date").between(F.col("apply_start"), F.col("apply_end"))
    both = known.join(small, in_fit | in_apply).select("fold", "ticker", "date", "raw", in_apply.alias("apply"))
    scale = both.where(~F.col("apply")).groupBy("fold", "ticker").agg(F.avg("raw").alias("centre"), F.stddev_pop("raw").alias("scale"))
    scaled = both.join(scale, ["fold", "ticker"]).withColumn("x", (F.col("raw") - F.col("centre")) / F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))
    keys = ["fold", "ticker"]
    best = best_restarts(fit_each(scaled.where(~F.col("apply")), keys, "x", (k,), restarts, seed), keys, duration, share)
    out = posteriors(scaled, best, keys, "x", period).join(scaled.where("apply").select(*keys, "date"), [*keys, "date"], "left_semi")
    return out.join(best.select(*keys, "degenerate"), keys)


def degenerate_folds(out: DataFrame) -> DataFrame:
    """(ticker, folds, degenerate_share) of a walkforward(): more than a tenth is a reason not to use it."""
    each = out.groupBy("ticker", "fold").agg(F.first("degenerate").alias("d"))
    return each.groupBy("ticker").agg(F.count(F.lit(1)).alias("folds"), F.avg(F.col("d").cast("double")).alias("degenerate_share"))
