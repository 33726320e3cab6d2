"""Features of a panel: per ticker, across tickers, of macro series, and forward targets.

All features look back only. Targets look ahead on purpose and are named fwd_*.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.windows import YEAR, by, change, forward, full, kurt_of, log_of, skew_of, trailing
from chronopanel.sources.panels import market

ANNUAL = YEAR**0.5


def log_returns(panel: DataFrame) -> DataFrame:
    """Adds ret, the change of the log close."""
    return panel.withColumn("ret", change(log_of("close")))


def realised_vol(panel: DataFrame, windows: tuple[int, ...] = (20, 60)) -> DataFrame:
    """Adds vol_<n>: annualised sample deviation of n returns."""
    return log_returns(panel).withColumns({f"vol_{n}": full(F.stddev_samp, "ret", trailing(n), n) * ANNUAL for n in windows})


def downside_vol(panel: DataFrame, n: int = 60) -> DataFrame:
    """Adds down_<n>: annualised root mean square of the negative returns, positive ones as zero."""
    below = F.when(F.col("ret").isNotNull(), F.pow(F.least(F.col("ret"), F.lit(0.0)), 2))
    return log_returns(panel).withColumn(f"down_{n}", F.sqrt(full(F.avg, below, trailing(n), n)) * ANNUAL)


def vol_change(panel: DataFrame, n: int = 20) -> DataFrame:
    """Adds dvol: change of the log of vol_<n>."""
    return realised_vol(panel, (n,)).withColumn("dvol", change(log_of(f"vol_{n}")))


def momentum(panel: DataFrame, windows: tuple[int, ...] = (20, 60), skip: int = 5) -> DataFrame:
    """Adds mom_<n>: log change over n rows that ends skip rows ago."""
    at = lambda k: F.lag(log_of("close"), k).over(by("ticker"))
    return panel.withColumns({f"mom_{n}": at(skip) - at(skip + n) for n in windows})


def moments(panel: DataFrame, n: int = 60) -> DataFrame:
    """Adds skew_<n> and kurt_<n> of the returns, both adjusted for bias."""
    return log_returns(panel).withColumns({f"skew_{n}": skew_of(F.col("ret"), trailing(n), n), f"kurt_{n}": kurt_of(F.col("ret"), trailing(n), n)})


def volume_ratio(panel: DataFrame, n: int = 20) -> DataFrame:
    mean = full(F.avg, "volume", trailing(n), n)
    return panel.withColumn("volume_ratio", F.when(mean > 0, F.col("volume") / mean))


def beta(panel: DataFrame, n: int = 60) -> DataFrame:
    """Adds beta_<n>: covariance with the market's returns over their variance."""
    bench = market(panel).withColumn("one", F.lit(1)).withColumn("m_ret", change(log_of("m_close"), keys=("one",))).select("date", "m_ret")
    both = log_returns(panel).join(bench, "date")
    pair, w = F.col("ret").isNotNull() & F.col("m_ret").isNotNull(), trailing(n)
    x, y = F.when(pair, F.col("m_ret")), F.when(pair, F.col("ret"))
    var = full(F.var_samp, x, w, n)
    return both.withColumn(f"beta_{n}", F.when(var > 0, F.covar_samp(x, y).over(w) / var))


def distance_from_high(panel: DataFrame, n: int = 252) -> DataFrame:
    return panel.withColumn("dist_high", F.col("close") / full(F.max, "close", trailing(n), n) - 1)


def wide(panel: DataFrame, tickers: list[str], columns: list[str]) -> DataFrame:
    """One row a date, a column <ticker>_<feature> each; the tickers are given, so the plan needs no pass to find them."""
    cells = [F.max(F.when(F.col("ticker") == t, F.col(c))).alias(f"{t}_{c}") for t in tickers for c in columns]
    return panel.groupBy("date").agg(*cells)


#: The twelve features of a ticker, in the order of asset_features.
ASSET = ["ret", "vol_20", "vol_60", "down_60", "dvol", "mom_20", "mom_60", "skew_60", "kurt_60", "beta_60", "volume_ratio", "dist_high"]


def asset_features(panel: DataFrame) -> DataFrame:
    """Adds all of ASSET."""
    rows = panel
    for add in (beta, realised_vol, downside_vol, vol_change, momentum, moments, volume_ratio, distance_from_high):
        rows = add(rows)
    return rows


# Across tickers


def pairs(panel: DataFrame) -> DataFrame:
    """(date, a, b, ra, rb) for each pair of tickers a < b with both returns."""
    r = log_returns(panel).select("date", "ticker", "ret")
    left, right = r.select("date", F.col("ticker").alias("a"), F.col("ret").alias("ra")), r.select("date", F.col("ticker").alias("b"), F.col("ret").alias("rb"))
    return left.join(right, "date").where("a < b")


def pairwise_correlation(panel: DataFrame, n: int) -> DataFrame:
    """(date, avg_corr, std_corr): mean and deviation of the correlations of all pairs over n rows; NULL unless every
    pair has its n rows, in which neither stands still; the deviation of a single pair is 0."""
    w = trailing(n, ("a", "b"))
    ok = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    x, y = F.when(ok, F.col("ra")), F.when(ok, F.col("rb"))
    # F.corr is an error, not NULL, for a series that stands still, as filled prices may.
    rho = F.try_divide(F.covar_pop(x, y).over(w), F.sqrt(F.var_pop(x).over(w) * F.var_pop(y).over(w)))
    c = F.when(F.count(x).over(w) == n, rho)
    daily = pairs(panel).select("date", "a", "b", c.alias("c")).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.count("c").alias("m"), F.avg("c").alias("mean"), F.stddev_samp("c").alias("std"))
    whole = F.col("n") == F.col("m")
    return daily.select("date", F.when(whole, F.col("mean")).alias("avg_corr"), F.when(whole, F.when(F.col("n") == 1, 0.0).otherwise(F.col("std"))).alias("std_corr"))


def return_dispersion(panel: DataFrame) -> DataFrame:
    return log_returns(panel).groupBy("date").agg(F.stddev_samp("ret").alias("dispersion"))


def breadth(panel: DataFrame, n: int = 50) -> DataFrame:
    """Share of the tickers with an n-row average whose close stands above it."""
    mean = full(F.avg, "close", trailing(n), n)
    above = panel.select("date", F.when(mean.isNotNull(), (F.col("close") > mean).cast("double")).alias("above"))
    return above.groupBy("date").agg(F.avg("above").alias("breadth"))


# Macro series: tickers of the panel that are levels, in one row a date


def macro(levels: DataFrame) -> DataFrame:
    """levels: (date, vix, long_yield, mid_yield, short_yield, high_yield, investment, dollar, oil). Yields are
    differenced, never logged; oil uses simple returns, so a negative level does no harm."""
    one = levels.withColumn("one", F.lit("all"))
    k = ("one",)
    credit = log_of("high_yield") - log_of("investment")
    slope = F.col("long_yield") - F.col("short_yield")
    oil = F.try_divide(F.col("oil"), F.lag("oil").over(by("one"))) - 1
    out = one.withColumns({
        "vix_level": F.col("vix"), "vix_change": change(log_of("vix"), keys=k), "slope_long_short": slope, "slope_long_mid": F.col("long_yield") - F.col("mid_yield"),
        "curve_change": change(slope, keys=k), "credit": credit, "credit_change": change(credit, keys=k), "credit_change_20": change(credit, 20, k),
        "dollar_return_20": change(log_of("dollar"), 20, k), "oil_ret": oil,
    })
    return out.withColumn("oil_vol_20", full(F.stddev_samp, "oil_ret", trailing(20, k), 20) * ANNUAL).drop("one", "oil_ret")


# Forward targets


def forward_vol_and_return(panel: DataFrame, horizons: tuple[int, ...] = (5, 20)) -> DataFrame:
    targets: dict[str, Column] = {}
    for h in horizons:
        targets[f"fwd_vol_{h}"] = full(F.stddev_samp, "ret", forward(h), h) * ANNUAL
        targets[f"fwd_ret_{h}"] = full(F.sum, "ret", forward(h), h)
    return log_returns(panel).withColumns(targets)


def forward_drawdown(panel: DataFrame, h: int = 20) -> DataFrame:
    """Adds fwd_mdd_<h>: the deepest fall from a running peak within the next h closes."""
    ahead = F.collect_list("close").over(forward(h))
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))
    step = lambda s, x: F.struct(F.greatest(s["peak"], x).alias("peak"), F.least(s["worst"], x / F.greatest(s["peak"], x) - 1).alias("worst"))
    return panel.withColumn(f"fwd_mdd_{h}", F.when(F.size(ahead) == h, F.aggregate(ahead, start, step)["worst"]))


def forward_correlation(panel: DataFrame, h: int = 20) -> DataFrame:
    """(date, fwd_corr_<h>): the average pairwise correlation as it will stand h dates later."""
    ahead = pairwise_correlation(panel, h).withColumn("one", F.lit(1))
    return ahead.select("date", F.lead("avg_corr", h).over(by("one")).alias(f"fwd_corr_{h}"))
