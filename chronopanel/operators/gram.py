"""Regressions from sums: ridge fits of many windows from running Gram sums, ridge probes over splits, logistic fits.

A ridge fit needs of its rows only their number and the sums of x, y, xx, xy and yy. These are made once a date, partial
sums before the shuffle; a window's are the difference of two running sums, so that no row is copied for the windows it
belongs to, and windows are joined by adding. Solving is a small matrix a window. Logistic fits sum gradients and
curvatures over the rows, a job a round, for all groups and penalties at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _terms(features: list[str], target: str) -> list[Column]:
    """1, x, xx (upper triangle, row by row), y, xy, yy."""
    x, y = [F.col(f).cast("double") for f in features], F.col(target).cast("double")
    return [F.lit(1.0), *x, *[x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))], y, *[c * y for c in x], y * y]


def complete(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a finite number in each of the columns."""
    sound = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    return rows.where(reduce(lambda a, b: a & b, map(sound, columns)))


def gram_sums(rows: DataFrame, keys: list[str], features: list[str], target: str) -> DataFrame:
    """(keys, sums array) of the complete rows."""
    terms = _terms(features, target)
    sums = complete(rows, [*features, target]).groupBy(*keys).agg(*[F.sum(t).alias(f"s{i}") for i, t in enumerate(terms)])
    return sums.select(*keys, F.array(*[f"s{i}" for i in range(len(terms))]).alias("sums"))


def window_sums(by_date: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, sums) of each fold's rows from fit_start to fit_end, by_date: (date, sums). One row a date of the calendar
    and one a fold, however many rows the panel has."""
    n = F.size("sums")
    each = by_date.select("date", F.posexplode("sums").alias("i", "v"))
    run = Window.partitionBy("i").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    running = each.withColumn("v", F.sum("v").over(run)).groupBy("date").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("a"))  # one entry a sum
    running = running.select("date", F.transform("a", lambda e: e["v"]).alias("sums")).where(n > 0)
    upto = lambda c, strict: folds.join(running, (F.col("date") < F.col(c)) if strict else (F.col("date") <= F.col(c))).groupBy("fold").agg(F.max_by("sums", "date").alias("sums"))
    last, before = upto("fit_end", False), upto("fit_start", True).withColumnRenamed("sums", "less")
    less = F.when(F.col("less").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "less", lambda a, b: a - b))
    return last.join(before, "fold", "left").select("fold", less.alias("sums"))


def solve(sums: np.ndarray, p: int, alphas: tuple[float, ...]) -> list[tuple[float, int, float, list[float]]]:
    """(alpha, n, intercept, coefficients) of ridge fits on features that are centred and scaled by their population
    deviation (1, where it is 0); coefficients are for the features as they came."""
    n, x, y = sums[0], sums[1 : p + 1], sums[1 + p + p * (p + 1) // 2]
    xx, at = np.empty((p, p)), 1 + p
    for i in range(p):
        for j in range(i, p):
            xx[i, j] = xx[j, i] = sums[at]
            at += 1
    xy = sums[at + 1 : at + 1 + p]
    mean, top = x / n, y / n
    cov = xx - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov) / n, 0))
    scale[scale <= 1e-12 * np.maximum(1, np.abs(mean))] = 1
    s, r = cov / np.outer(scale, scale), (xy - n * mean * top) / scale
    out = []
    for a in alphas:
        w = np.linalg.solve(s + a * np.eye(p), r) / scale
        out.append((float(a), int(n), float(top - w @ mean), w.tolist()))
    return out


COEFFICIENTS = "alpha double, n_fit long, intercept double, coef array<double>"


def coefficients(sums: DataFrame, keys: list[str], p: int, alphas: tuple[float, ...]) -> DataFrame:
    """(keys, alpha, n_fit, intercept, coef) of each row of sums with at least p + 2 rows behind it."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.select(*keys).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(*k, *fit) for *k, s in pdf[[*keys, "sums"]].itertuples(index=False) if s[0] >= p + 2 for fit in solve(np.asarray(s, float), p, alphas)]
            yield pd.DataFrame(out, columns=[*keys, "alpha", "n_fit", "intercept", "coef"])

    return sums.select(*keys, "sums").mapInPandas(run, f"{kinds}, {COEFFICIENTS}")


def linear(features: list[str], intercept: Column, coef: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f).cast("double") * coef[i] for i, f in enumerate(features)], intercept)


def ridge_walkforward(rows: DataFrame, folds: DataFrame, features: list[str], target: str, alphas: tuple[float, ...] = (0.1, 10.0, 1000.0)) -> DataFrame:
    """(fold, alpha, date, ticker, y, pred, base): each fold's fits on its fit rows, used on the rows it applies to; base is
    the mean of y over the fit rows. Folds whose fit rows are fewer than the features and two give nothing."""
    small = F.broadcast(folds)  # one row a fold of the calendar
    fitted = window_sums(gram_sums(rows, ["date"], features, target), folds)
    y = 1 + len(features) + len(features) * (len(features) + 1) // 2
    base = fitted.select("fold", (F.col("sums")[y] / F.col("sums")[0]).alias("base"))
    models = coefficients(fitted, ["fold"], len(features), alphas).join(base, "fold")
    use = complete(rows, [*features, target]).join(small, F.col("date").between(F.col("apply_start"), F.col("apply_end")))
    both = use.select("fold", "date", "ticker", *features, F.col(target).cast("double").alias("y")).join(F.broadcast(models), "fold")  # a row a fold and alpha
    return both.select("fold", "alpha", "date", "ticker", "y", linear(features, F.col("intercept"), F.col("coef")).alias("pred"), "base")


def ridge_probe(rows: DataFrame, split: Column, keys: list[str], features: list[str], target: str, alphas: tuple[float, ...] = (0.1, 10.0, 1000.0)) -> DataFrame:
    """(keys, alpha, val_mse, n_test, test_r2): fits on the rows whose split is train, the alpha of the least squared error
    on those of val (of equal ones the smaller), a fit with it on both by adding their sums, and its R2 on those of test
    against their own mean."""
    parts = rows.withColumn("__split", split)
    sums = gram_sums(parts.where("__split in ('train', 'val')"), [*keys, "__split"], features, target)
    train = sums.where("__split = 'train'").drop("__split")
    fits = F.broadcast(coefficients(train, keys, len(features), alphas))  # a row a key and alpha
    sound = complete(parts, [*features, target])
    error = F.pow(F.col(target) - linear(features, F.col("intercept"), F.col("coef")), 2)
    val = sound.where("__split = 'val'").join(fits, keys).groupBy(*keys, "alpha").agg(F.avg(error).alias("val_mse"))
    chosen = val.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("val_mse", "alpha"))).where("r = 1").drop("r")
    n = 2 + 2 * len(features) + len(features) * (len(features) + 1) // 2 + 1
    whole = sums.groupBy(*keys).agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(n)]).alias("sums"))
    again = coefficients(whole, keys, len(features), alphas).join(chosen, [*keys, "alpha"])
    test = sound.where("__split = 'test'").join(F.broadcast(again), keys)
    own = F.regr_syy(F.col(target), F.lit(1.0))
    out = test.groupBy(*keys, "alpha", "val_mse").agg(F.count(F.lit(1)).alias("n_test"), F.sum(error).alias("e"), own.alias("v"))
    return out.select(*keys, "alpha", "val_mse", "n_test", (1 - F.try_divide("e", "v")).alias("test_r2"))


def logistic(rows: DataFrame, keys: list[str], features: list[str], label: str, alphas: tuple[float, ...] = (1.0,), rounds: int = 50, tol: float = 1e-9) -> DataFrame:
    """(keys, alpha, n_fit, intercept, coef, rounds) of each group's logistic fit: the sum of log losses plus alpha / 2 times
    the squared coefficients, intercept free, at its least. label is 0 or 1.

    Newton's method: a round sums gradient and curvature over all rows of all groups, then each group takes its step,
    halved while its loss would rise; a group is done when no entry moves by more than tol. Groups are few (names, folds):
    their coefficients go through the driver, rows do not. Groups of one label only still have a least loss, the penalty
    and an intercept that keeps growing; they stop at `rounds`.
    """
    p = len(features)
    sound = complete(rows, [*features, label]).select(*keys, *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("__y"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sound.select(*keys).schema) + ", alpha double, n_fit long, intercept double, coef array<double>, rounds int"
    spark = rows.sparkSession
    x = [F.lit(1.0), *[F.col(f) for f in features]]
    z = linear(features, F.col("intercept"), F.col("coef"))
    one = 1 / (1 + F.exp(-z))
    # log(1 + exp(z)) - y z without overflow
    loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("__y") * z
    sums = [F.sum((one - F.col("__y")) * c) for c in x] + [F.sum(one * (1 - one) * x[i] * x[j]) for i in range(p + 1) for j in range(i, p + 1)]
    at: dict[tuple, np.ndarray] = {}
    old: dict[tuple, tuple[np.ndarray, float, np.ndarray]] = {}  # where a group came from, its loss there, its step
    done: dict[tuple, tuple] = {}
    sizes = {tuple(r[k] for k in keys): r["n"] for r in sound.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()}
    for key in sizes:
        for a in alphas:
            at[*key, float(a)] = np.zeros(p + 1)
    for i in range(1, rounds + 1):
        if not at:
            break
        now = spark.createDataFrame([(*k, sizes[k[:-1]], float(w[0]), w[1:].tolist(), i) for k, w in at.items()], schema)
        made = sound.join(F.broadcast(now), keys).groupBy(*keys, "alpha").agg(F.sum(loss).alias("__loss"), F.array(*sums).alias("__sums")).collect()
        for r in made:
            key, s = (*[r[k] for k in keys], r["alpha"]), np.array(r["__sums"])
            w, penalty = at[key], np.append(0.0, np.full(p, r["alpha"]))
            total = r["__loss"] + 0.5 * penalty @ w**2
            if key in old and total > old[key][1] + 1e-12 * abs(old[key][1]):  # too far: half the step, from where it came
                w0, l0, step = old[key]
                old[key] = (w0, l0, step / 2)
            else:
                h, k = np.empty((p + 1, p + 1)), p + 1
                for a in range(p + 1):
                    for b in range(a, p + 1):
                        h[a, b] = h[b, a] = s[k]
                        k += 1
                step = -np.linalg.lstsq(h + np.diag(penalty), s[: p + 1] + penalty * w, rcond=None)[0]
                old[key] = (w, total, step)
            w0, _, step = old[key]
            at[key] = w0 + step
            if np.abs(step).max() <= tol * max(1.0, np.abs(w0).max()) or i == rounds:
                done[key] = (sizes[key[:-1]], float(at[key][0]), at.pop(key)[1:].tolist(), i)
    return spark.createDataFrame([(*k, *v) for k, v in done.items()], schema)


def logistic_probe(rows: DataFrame, split: Column, keys: list[str], features: list[str], label: str, alphas: tuple[float, ...] = (0.1, 10.0, 1000.0)) -> tuple[DataFrame, DataFrame]:
    """((keys, alpha, val_loss), (keys, score, label)): of the fits on the train rows the alpha of the least mean log loss
    on val (of equal ones the larger), and the test rows' chances under it, for an area under the curve."""
    parts = complete(rows, [*features, label]).withColumn("__split", split)
    fits = F.broadcast(logistic(parts.where("__split = 'train'"), keys, features, label, alphas))  # a row a key and alpha
    z = linear(features, F.col("intercept"), F.col("coef"))
    loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col(label) * z
    val = parts.where("__split = 'val'").join(fits, keys).groupBy(*keys, "alpha").agg(F.avg(loss).alias("val_loss"))
    chosen = val.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("val_loss", F.desc("alpha")))).where("r = 1").drop("r")
    scores = parts.where("__split = 'test'").join(fits.join(chosen.select(*keys, "alpha"), [*keys, "alpha"]), keys)
    return chosen, scores.select(*keys, (1 / (1 + F.exp(-z))).alias("score"), F.col(label).cast("long").alias("label"))
