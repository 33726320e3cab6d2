"""Regimes and episodes: thresholds, state statistics, filters with fixed parameters, drawdown episodes, Gaussian HMMs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.windows import by, running
from chronopanel.operators.clean import runs


def threshold_walkforward(rows: DataFrame, folds: DataFrame, value: str, states: int = 3) -> DataFrame:
    """rows (date, ticker, value): in each fold, edges at equal frequencies of the fit window, then the state of the
    rows to apply to: how many edges are at or below the value. Folds are few and small."""
    cut = F.array(*[F.lit(i / states) for i in range(1, states)])
    small = F.broadcast(folds)  # one row a fold of the calendar
    fit = rows.join(small, F.col("date").between(F.col("fit_start"), F.col("fit_end"))).groupBy("fold", "ticker").agg(F.percentile(value, cut).alias("edges"))
    apply = rows.join(small.select("fold", "apply_start", "apply_end"), F.col("date").between(F.col("apply_start"), F.col("apply_end")))
    state = F.when(F.col(value).isNotNull(), F.size(F.filter("edges", lambda e: e <= F.col(value))))
    return apply.join(fit, ["fold", "ticker"]).select("date", "ticker", "fold", state.alias("state"))


def state_statistics(rows: DataFrame, states: DataFrame) -> DataFrame:
    """rows (date, ticker, ret), states (date, ticker, state): a row a ticker and state with n, share, annualised mean and
    volatility, worst drawdown of the ticker within, and mean run length."""
    both = rows.join(states, ["date", "ticker"]).where("ret is not null and state is not null")
    curve = F.exp(F.sum("ret").over(running()))
    both = both.withColumn("curve", curve)
    both = both.withColumn("dd", F.col("curve") / F.greatest(F.max("curve").over(running()), F.lit(1.0)) - 1)
    stats = both.groupBy("ticker", "state").agg(F.count(F.lit(1)).alias("n"), (F.avg("ret") * 252).alias("ann_mean"), (F.stddev_samp("ret") * math.sqrt(252)).alias("ann_vol"), F.avg("dd").alias("mean_dd"), F.min("dd").alias("worst_dd"))
    stats = stats.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("ticker")))
    return stats.join(dwell(both).groupBy("ticker", "state").agg(F.avg("length").alias("mean_run")), ["ticker", "state"])


def dwell(states: DataFrame) -> DataFrame:
    """(ticker, state, start, end, length) of each unbroken stay in a state."""
    place = F.row_number().over(by("ticker"))
    marked = states.select("ticker", "date", "state", place.alias("n"))
    island = F.col("n") - F.row_number().over(Window.partitionBy("ticker", "state").orderBy("n"))
    return marked.withColumn("island", island).groupBy("ticker", "state", "island").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("length")).drop("island")


def transitions(states: DataFrame) -> DataFrame:
    """(ticker, a, b, n, p): counts of moves from one row's state to the next one's, and their shares by a."""
    moved = states.withColumn("next", F.lead("state").over(by("ticker"))).where("next is not null and state is not null")
    n = moved.groupBy("ticker", F.col("state").alias("a"), F.col("next").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("ticker", "a")))


def posterior_quality(posteriors: DataFrame, k: int) -> DataFrame:
    """(ticker, entropy, median_top, flip_rate): mean entropy, median of the largest posterior, share of rows whose likeliest
    state is another than the row's before."""
    p = [F.col(f"p_{j}") for j in range(k)]
    top = F.greatest(*p)
    state = F.coalesce(*[F.when(c == top, j) for j, c in enumerate(p)])
    entropy = -sum((F.when(c > 0, c * F.ln(c)).otherwise(0.0) for c in p), F.lit(0.0))
    rows = posteriors.withColumns({"top": top, "state": state, "entropy": entropy}).withColumn("flip", (F.col("state") != F.lag("state").over(by("ticker"))).cast("double"))
    return rows.groupBy("ticker").agg(F.avg("entropy").alias("entropy"), F.median("top").alias("median_top"), F.avg("flip").alias("flip_rate"))


def bear_episodes(panel: DataFrame, threshold: float = 0.20) -> DataFrame:
    """(ticker, start, end): from the first date of the running peak to the first close back above the threshold's fall;
    an open episode ends with the series."""
    peak = F.max("close").over(running())
    rows = panel.withColumn("peak", peak).withColumn("fresh", F.coalesce(F.col("peak") > F.lag("peak").over(by("ticker")), F.lit(True)))
    rows = rows.withColumn("peak_date", F.last(F.when(F.col("fresh"), F.col("date")), ignorenulls=True).over(running())).withColumn("down", F.col("close") / F.col("peak") - 1 <= -threshold)
    rows = rows.withColumn("next", F.lead("date").over(by("ticker")))
    spells = runs(rows, F.col("down"))
    named = spells.join(rows.select("ticker", F.col("date").alias("start"), "peak_date"), ["ticker", "start"]).join(rows.select("ticker", F.col("date").alias("end"), "next"), ["ticker", "end"])
    return named.select("ticker", F.col("peak_date").alias("start"), F.coalesce("next", "end").alias("end"))


def drawdown_episodes(panel: DataFrame, threshold: float = 0.10) -> DataFrame:
    """(ticker, peak, trough, recovery, depth): a close at or above the old peak closes an episode and moves the peak;
    recovery is NULL for an open one. Episodes shallower than the threshold drop out."""
    before = F.max("close").over(by("ticker").rowsBetween(Window.unboundedPreceding, -1))
    rows = panel.withColumn("__top", F.coalesce(F.col("close") >= before, F.lit(True)).cast("int")).withColumn("__group", F.sum("__top").over(running()))
    found = rows.groupBy("ticker", "__group").agg(F.min("date").alias("peak"), F.min_by("close", "date").alias("high"), F.min_by("date", F.struct("close", "date")).alias("trough"), F.min("close").alias("low"), F.count(F.lit(1)).alias("n"))
    found = found.withColumn("recovery", F.lead("peak").over(Window.partitionBy("ticker").orderBy("__group"))).withColumn("depth", F.col("low") / F.col("high") - 1)
    return found.where((F.col("n") > 1) & (F.col("depth") <= -threshold)).select("ticker", "peak", "trough", "recovery", "depth")


def detection(episodes: DataFrame, signal: DataFrame, sessions: DataFrame, threshold: float, before: int = 60) -> DataFrame:
    """episodes (ticker, start, end), signal (ticker, date, p), sessions (date, ord): first date with p above the threshold
    from `before` sessions ahead of the start to the end, and its lag in sessions; NULL if missed."""
    o = lambda c: sessions.select(F.col("date").alias(c), F.col("ord").alias(f"{c}_ord"))
    e = episodes.join(o("start"), "start").join(o("end"), "end")
    s = signal.join(sessions, "date").where(F.col("p") > threshold).select("ticker", "ord")
    hit = e.alias("e").join(s.alias("s"), F.expr(f"e.ticker = s.ticker and s.ord between e.start_ord - {before} and e.end_ord"), "left").select("e.*", "s.ord")
    return hit.groupBy("ticker", "start", "end", "start_ord").agg(F.min("ord").alias("first")).select("ticker", "start", "end", (F.col("first") - F.col("start_ord")).alias("lag"))


def compare_detection(a: DataFrame, b: DataFrame) -> DataFrame:
    """a and b (ticker, start, end, lag) as of detection(), of the same episodes -> (ticker, episodes, missed_a, missed_b,
    lag_a, lag_b, a_wins): mean lags over what each found; a wins if it misses none and b misses some or is later on
    average."""
    of = lambda d, n: d.select("ticker", "start", "end", F.col("lag").alias(n))
    both = of(a, "__a").join(of(b, "__b"), ["ticker", "start", "end"])
    miss = lambda c: F.count_if(F.col(c).isNull())
    out = both.groupBy("ticker").agg(F.count(F.lit(1)).alias("episodes"), miss("__a").alias("missed_a"), miss("__b").alias("missed_b"), F.avg("__a").alias("lag_a"), F.avg("__b").alias("lag_b"))
    return out.withColumn("a_wins", (F.col("missed_a") == 0) & ((F.col("missed_b") > 0) | F.coalesce(F.col("lag_a") < F.col("lag_b"), F.lit(False))))


def false_alarms(episodes: DataFrame, signal: DataFrame, threshold: float) -> DataFrame:
    """(ticker, rate): share of the sessions outside of all episodes whose p is above the threshold."""
    outside = signal.alias("s").join(episodes.alias("e"), F.expr("s.ticker = e.ticker and s.date between e.start and e.end"), "left_anti")
    return outside.groupBy("ticker").agg(F.avg((F.col("p") > threshold).cast("double")).alias("rate"))


def baum_welch(x: np.ndarray, k: int, seed: int, rounds: int = 50) -> dict:
    """A univariate Gaussian hidden Markov model by expectation-maximisation, states in order of their deviation."""
    rng = np.random.default_rng(seed)
    mean, std = np.quantile(x, (np.arange(k) + rng.random(k)) / k), np.full(k, x.std() + 1e-9)
    start, move, last = np.full(k, 1 / k), np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1)), -np.inf
    for _ in range(rounds):
        b = np.exp(-0.5 * ((x[:, None] - mean) / std) ** 2) / (std * np.sqrt(2 * np.pi)) + 1e-300
        a, c = np.empty_like(b), np.empty(len(x))
        for t in range(len(x)):
            a[t] = (start if t == 0 else a[t - 1] @ move) * b[t]
            c[t] = a[t].sum()
            a[t] /= c[t]
        back = np.ones_like(b)
        for t in range(len(x) - 2, -1, -1):
            back[t] = move @ (b[t + 1] * back[t + 1]) / c[t + 1]
        post = a * back
        pair = (a[:-1, :, None] * move * (b[1:] * back[1:])[:, None, :] / c[1:, None, None]).sum(0)
        start, move = post[0], pair / np.maximum(pair.sum(1, keepdims=True), 1e-300)
        weight = post.sum(0)
        mean = (post * x[:, None]).sum(0) / weight
        std = np.sqrt((post * (x[:, None] - mean) ** 2).sum(0) / weight) + 1e-9
        if (now := np.log(c).sum()) - last < 1e-8 * abs(now):
            break
        last = now
    o = np.argsort(std, kind="stable")
    free = (k - 1) + k * (k - 1) + 2 * k
    return {"loglik": float(last), "bic": float(-2 * last + free * np.log(len(x))), "mean": mean[o].tolist(), "std": std[o].tolist(), "start": start[o].tolist(), "move": move[o][:, o].ravel().tolist()}


def fit_hmms(rows: DataFrame, value: str, states: tuple[int, ...] = (2, 3), seeds: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """One fit a ticker, number of states and seed, each a task of its own."""
    grid = rows.where(F.col(value).isNotNull()).select("ticker", "date", F.col(value).alias("x")).withColumn("k", F.explode(F.array(*map(F.lit, states)))).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        k, seed = int(pdf["k"].iloc[0]), int(pdf["seed"].iloc[0])
        return pd.DataFrame([{"ticker": pdf["ticker"].iloc[0], "k": k, "seed": seed} | baum_welch(pdf.sort_values("date")["x"].to_numpy(), k, seed)])

    return grid.groupBy("ticker", "k", "seed").applyInPandas(fit, "ticker string, k int, seed int, loglik double, bic double, mean array<double>, std array<double>, start array<double>, move array<double>")


def degenerate(duration: float = 5.0) -> Column:
    """A state that lasts under that many rows on average, by its chance to stay."""
    return F.exists(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.element_at("move", i * F.col("k") + i + 1) < 1 - 1 / duration)


def select_fits(fits: DataFrame, duration: float = 5.0) -> DataFrame:
    """Best seed by likelihood among fits that are not degenerate, then the number of states by BIC."""
    sound = fits.withColumn("bad", degenerate(duration)).where("not bad").drop("bad")
    best = sound.withColumn("r", F.row_number().over(Window.partitionBy("ticker", "k").orderBy(F.desc("loglik"), "seed"))).where("r = 1")
    return best.withColumn("r", F.row_number().over(Window.partitionBy("ticker").orderBy("bic", "k"))).where("r = 1").drop("r")
