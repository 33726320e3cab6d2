"""Cleaning and checking a panel: calendar alignment, capped forward fill, runs, quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.windows import by


def align(panel: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each session for each ticker: missing rows inserted as NULL, rows off the calendar dropped."""
    spine = sessions.select("date").crossJoin(panel.select("ticker").distinct())
    return spine.join(panel, ["date", "ticker"], "left")


def off_calendar(panel: DataFrame, sessions: DataFrame) -> DataFrame:
    return panel.join(sessions, "date", "left_anti")


def available(aligned: DataFrame, inception: DataFrame | None = None) -> DataFrame:
    """Adds available: at or after the ticker's first close, and its declared inception (ticker, inception) if given."""
    first = F.min(F.when(F.col("close").isNotNull(), F.col("date"))).over(Window.partitionBy("ticker"))
    if inception is None:
        return aligned.withColumn("available", F.coalesce(F.col("date") >= first, F.lit(False)))
    both = aligned.join(F.broadcast(inception), "ticker", "left")  # one row a ticker
    return both.withColumn("available", F.coalesce(F.col("date") >= F.greatest(first, F.coalesce("inception", first)), F.lit(False))).drop("inception")


def fill(aligned: DataFrame, columns: tuple[str, ...] = ("close", "volume"), limit: int = 3) -> DataFrame:
    """Forward fill over at most limit sessions within availability, never backward. Adds filled: the close was missing
    and is no more."""
    seen = available(aligned)
    reach = by("ticker").rowsBetween(-limit, 0)
    kept = {c: F.when(F.col("available"), F.last(F.when(F.col("available"), F.col(c)), ignorenulls=True).over(reach)) for c in columns}
    gone = F.col("close").isNull() & F.col("available") & kept["close"].isNotNull()
    return seen.withColumns({"filled": gone, **{f"__{c}": v for c, v in kept.items()}}).drop(*columns).withColumnsRenamed({f"__{c}": c for c in columns})


def runs(rows: DataFrame, flag: Column, keys: tuple[str, ...] = ("ticker",), order: str = "date") -> DataFrame:
    """(keys, start, end, length) of each unbroken run of rows where flag holds."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    marked = rows.select(*keys, order, place.alias("__n"), F.coalesce(flag, F.lit(False)).alias("__flag")).where("__flag")
    island = F.col("__n") - F.row_number().over(Window.partitionBy(*keys).orderBy("__n"))
    grouped = marked.withColumn("__island", island).groupBy(*keys, "__island")
    return grouped.agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("length")).drop("__island")


def stale_runs(panel: DataFrame, value: str = "close", least: int = 3, order: str = "date") -> DataFrame:
    """Longest run of equal values a ticker (counted in values), where it has at least `least`."""
    valid = panel.where(F.col(value).isNotNull())
    same = valid.withColumn("__same", F.col(value) == F.lag(value).over(Window.partitionBy("ticker").orderBy(order)))
    longest = runs(same, F.col("__same"), order=order).groupBy("ticker").agg((F.max("length") + 1).alias("longest"))
    return longest.where(F.col("longest") >= least)


def quality_report(panel: DataFrame, sessions: DataFrame) -> DataFrame:
    """(check, severity, passed, n_affected): one row a check; any failed hard check means the panel is unfit."""
    aligned = available(align(panel, sessions)).withColumn("ret", F.ln(F.when(F.col("close") > 0, F.col("close"))) - F.lag(F.ln(F.when(F.col("close") > 0, F.col("close")))).over(by("ticker")))
    size = F.abs("ret")
    inside = F.col("available")
    one = aligned.agg(
        F.count_if(inside & (F.col("close") <= 0)).alias("nonpositive_prices"), F.count_if(inside & F.col("close").isNull()).alias("price_gaps"),
        F.count_if(size > 0.30).alias("extreme_move_hard"), F.count_if((size > 0.15) & (size <= 0.30)).alias("extreme_move_soft"), F.count_if(inside & (F.col("volume") == 0)).alias("zero_volume"),
    )
    duplicates = panel.groupBy("date", "ticker").count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_index"))
    missing = sessions.join(panel, "date", "left_anti").agg(F.count(F.lit(1)).alias("missing_sessions"))
    counts = one.crossJoin(duplicates).crossJoin(missing)  # one row each
    kinds = {"duplicate_index": "hard", "missing_sessions": "hard", "nonpositive_prices": "hard", "price_gaps": "hard", "extreme_move_hard": "hard", "extreme_move_soft": "soft", "zero_volume": "soft"}
    found = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.lit(v).alias("severity"), F.col(k).cast("long").alias("n_affected")) for k, v in kinds.items()])).alias("x")).select("x.*")
    return found.withColumn("passed", F.col("n_affected") == 0)


def ks_drift(samples: DataFrame, value: str, early: Column, keys: tuple[str, ...], least: int = 30) -> DataFrame:
    """(keys, n_a, n_b, d, p): two-sample Kolmogorov-Smirnov between rows where early holds and the others, with the
    asymptotic p-value; keys with fewer than `least` values on a side drop out."""
    x = samples.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("x"), early.cast("int").alias("a"))
    points = x.groupBy(*keys, "x").agg(F.sum("a").alias("a"), F.sum(1 - F.col("a")).alias("b"))
    upto, whole = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    gap = points.select(*keys, F.sum("a").over(upto).alias("ca"), F.sum("b").over(upto).alias("cb"), F.sum("a").over(whole).alias("n_a"), F.sum("b").over(whole).alias("n_b"))
    gap = gap.where((F.col("n_a") >= least) & (F.col("n_b") >= least))
    d = gap.groupBy(*keys).agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.max(F.abs(F.col("ca") / F.col("n_a") - F.col("cb") / F.col("n_b"))).alias("d"))
    lam = F.col("d") * F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    term = lambda k: F.pow(F.lit(-1.0), k - 1) * F.exp(-2 * k * k * lam * lam)
    return d.withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + term(k.cast("double"))))))
