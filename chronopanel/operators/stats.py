"""Gates, deflated Sharpe ratios, probes, encoders."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.windows import by, full, kurt_of, skew_of, trailing


def expected_max_z(trials: int) -> float:
    """Expected maximum of that many standard normal values, by the usual approximation."""
    z, euler = NormalDist().inv_cdf, 0.5772156649015329
    return (1 - euler) * z(1 - 1 / trials) + euler * z(1 - 1 / (trials * math.e))


def deflated_sharpe(paths: DataFrame) -> DataFrame:
    """(strategy, sharpe, benchmark, z): per-period Sharpe ratio, what the best of all strategies would show by chance, and
    the distance in standard errors, allowing for skew and kurtosis."""
    one = paths.groupBy("strategy").agg(F.count(F.lit(1)).alias("t"), (F.avg("net") / F.stddev_samp("net")).alias("sharpe"), F.skewness("net").alias("skew"), (F.kurtosis("net") + 3).alias("kurt"))
    trials = one.agg(F.count(F.lit(1)).alias("trials"), F.stddev_samp("sharpe").alias("spread"))
    n = paths.select("strategy").distinct().count()
    every = one.crossJoin(F.broadcast(trials)).withColumn("benchmark", F.col("spread") * expected_max_z(max(2, n)))  # one row
    sd = F.sqrt(1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.pow("sharpe", 2))
    return every.select("strategy", "sharpe", "benchmark", ((F.col("sharpe") - F.col("benchmark")) * F.sqrt(F.col("t") - 1) / sd).alias("z"))


def verdict(low: Column, high: Column, lower_is_better: bool) -> Column:
    good, bad = (high < 0, low > 0) if lower_is_better else (low > 0, high < 0)
    return F.when(good, "favourable").when(bad, "adverse").otherwise("inconclusive")


def gates(intervals: DataFrame, lower_is_better: bool = True, needed: int = 3) -> DataFrame:
    """intervals (name, target, low, high) -> (name, favourable, adverse, passed): at least `needed` favourable targets and
    no adverse one."""
    v = intervals.withColumn("v", verdict(F.col("low"), F.col("high"), lower_is_better))
    counts = v.groupBy("name").agg(F.count_if(F.col("v") == "favourable").alias("favourable"), F.count_if(F.col("v") == "adverse").alias("adverse"))
    return counts.withColumn("passed", (F.col("favourable") >= needed) & (F.col("adverse") == 0))


# Probes


def select_alpha(predictions: DataFrame) -> DataFrame:
    """The alpha of least pooled squared error; of equal ones the larger."""
    mse = predictions.groupBy("alpha").agg(F.avg(F.pow(F.col("y") - F.col("pred"), 2)).alias("mse"))
    return mse.orderBy("mse", F.desc("alpha")).limit(1)


def inner_folds(folds: DataFrame, share: float = 0.2, embargo_days: int = 35) -> DataFrame:
    """Each fold's fit window cut in two, so that a choice sees none of the rows that the fold applies to: its last share
    of days is what the inner fold applies to, and embargo_days before these are left out of the fit."""
    cut = F.date_add("fit_start", ((1 - share) * F.date_diff("fit_end", "fit_start")).cast("int"))
    inner = folds.select("fold", "fit_start", F.date_sub(cut, embargo_days).alias("__end"), cut.alias("apply_start"), F.col("fit_end").alias("apply_end"))
    return inner.withColumnRenamed("__end", "fit_end").where("fit_start < fit_end")


def select_alphas(predictions: DataFrame) -> DataFrame:
    """(fold, alpha, mse): each fold's alpha of least squared error; of equal ones the larger."""
    mse = predictions.groupBy("fold", "alpha").agg(F.avg(F.pow(F.col("y") - F.col("pred"), 2)).alias("mse"))
    return mse.withColumn("r", F.row_number().over(Window.partitionBy("fold").orderBy("mse", F.desc("alpha")))).where("r = 1").drop("r")


def oos_r2(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """predictions (keys, y, pred, base) -> 1 - squared error over that of base, the fit mean of each fold."""
    e, b = F.sum(F.pow(F.col("y") - F.col("pred"), 2)), F.sum(F.pow(F.col("y") - F.col("base"), 2))
    return predictions.groupBy(*keys).agg((1 - F.try_divide(e, b)).alias("r2"))


def auc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """scores (keys, score, label 0 or 1) -> area under the ROC curve from rank sums, ties at their mean rank."""
    points = scores.groupBy(*keys, "score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    below = F.sum("neg").over(Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)) - F.col("neg") / 2
    won = points.withColumn("won", F.col("pos") * below).groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return won.select(*keys, F.try_divide("won", F.col("p") * F.col("n")).alias("auc"))


# Encoders


def flat_windows(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Adds <column>_t<lag> for lags n-1 to 0; rows without a whole window drop out. Labelled by the window's last row."""
    lags = {f"{c}_t{k}": F.lag(c, k).over(by("ticker")) for k in range(n - 1, -1, -1) for c in columns}
    return rows.select("date", "ticker", *[v.alias(k) for k, v in lags.items()]).dropna()


def rolling_stats(rows: DataFrame, column: str, n: int) -> DataFrame:
    """mean, deviation, skew and kurtosis (both adjusted) of each whole window; what is undefined is 0."""
    w, x = trailing(n), F.col(column)
    stats = {"mean": full(F.avg, x, w, n), "std": full(F.stddev_samp, x, w, n), "skew": skew_of(x, w, n), "kurt": kurt_of(x, w, n)}
    whole = rows.withColumns({**stats, "__n": F.count(x).over(w)}).where(F.col("__n") == n)
    return whole.select("date", "ticker", *[F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c) for c in stats])


def unit_variance(vectors: DataFrame, column: str) -> DataFrame:
    """(unit, variance, dead): sample variance of each component; under 1e-4 a unit is dead."""
    units = vectors.select(F.posexplode(column).alias("unit", "x")).groupBy("unit").agg(F.var_samp(F.col("x").cast("double")).alias("variance"))
    return units.withColumn("dead", F.col("variance") < 1e-4)


def pca_latents(vectors: DataFrame, column: str, id_col: str, k: int) -> DataFrame:
    """(id, latent array): projection on the k first principal axes, each signed so that its largest entry is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(id_col, F.transform(column, lambda x: x.cast("double")).alias("x"))
    if (one := rows.select(F.size("x")).first()) is None:  # no vectors, no axes
        return rows.select(id_col, F.col("x").alias("latent"))
    size = one[0]
    mean = rows.agg(*[F.avg(F.col("x")[i]) for i in range(size)]).first()
    centred = rows.select(id_col, F.zip_with("x", F.array(*[F.lit(float(m)) for m in mean]), lambda a, m: a - m).alias("x")).withColumn("v", array_to_vector("x"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(centred)
    axes = model.pc.toArray()
    sign = np.sign(axes[np.abs(axes).argmax(0), np.arange(k)]).tolist()
    return model.transform(centred).select(id_col, F.zip_with(vector_to_array("p"), F.array(*map(F.lit, sign)), lambda a, s: a * s).alias("latent"))


def random_projection(vectors: DataFrame, column: str, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """(id, latent array): tanh of a fixed random projection; the control that learns nothing."""

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            x = np.array([list(v) for v in pdf[column]], float).reshape(len(pdf), -1)
            w = np.random.default_rng(seed).uniform(-0.1, 0.1, (x.shape[1], k))
            yield pd.DataFrame({id_col: pdf[id_col], "latent": list(np.tanh(x @ w))})

    return vectors.select(id_col, column).mapInPandas(run, f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, latent array<double>")
