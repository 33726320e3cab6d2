"""Checks of panels, features, splits, folds and weights. Each gives rows that say what was found; none aborts by itself:
require() does, for a table of checks with severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def monotonic(rows: DataFrame, keys: tuple[str, ...], place: str, value: str) -> DataFrame:
    """(keys, n_affected): rows whose value lies below the one before it in the order of place."""
    back = F.col(value) < F.lag(value).over(Window.partitionBy(*keys).orderBy(place))
    return rows.select(*keys, back.cast("int").alias("b")).groupBy(*keys).agg(F.coalesce(F.sum("b"), F.lit(0)).alias("n_affected"))


def coverage_against(panel: DataFrame, benchmark: str) -> DataFrame:
    """(ticker, missing): sessions of the benchmark from the ticker's first on that the ticker lacks, where there are two
    or more."""
    there = panel.where("close is not null").select("date", "ticker")
    first = there.groupBy("ticker").agg(F.min("date").alias("first")).where(F.col("ticker") != benchmark)
    due = there.where(F.col("ticker") == benchmark).select("date").join(first, F.col("date") >= F.col("first"))
    return due.join(there, ["date", "ticker"], "left_anti").groupBy("ticker").agg(F.count(F.lit(1)).alias("missing")).where("missing > 1")


def feature_faults(rows: DataFrame, columns: list[str], keys: tuple[str, ...] = ("ticker",), order: str = "date", warm_up: int = 0) -> DataFrame:
    """(keys, name, n_unsound, constant): of each column after its first warm_up rows a key, null, NaN and infinite values,
    and whether the sound ones have no deviation."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    long = rows.withColumn("__n", place).where(F.col("__n") > warm_up).select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])))
    unsound = F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf"))
    return long.groupBy(*keys, "name").agg(F.count_if(unsound).alias("n_unsound"), F.coalesce(F.stddev_samp(F.when(~unsound, F.col("x"))) == 0, F.lit(False)).alias("constant"))


def top_counts(rows: DataFrame, columns: list[str], k: int = 8) -> DataFrame:
    """(columns, n): the k most frequent values, ties in the order of the columns."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns).limit(k)


def require(report: DataFrame) -> DataFrame:
    """The report (check, severity, passed, n_affected) itself, or an error that names the hard checks that failed."""
    failed = [r[0] for r in report.where("severity = 'hard' and not passed").select("check").collect()]  # a row a check
    if failed:
        raise ValueError("hard checks failed: " + ", ".join(sorted(failed)))
    return report


def in_split(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds split, the name of the one whose effective range holds the date; rows in gaps have none."""
    spans = plan.select(F.col("name").alias("split"), F.col("start").alias("__a"), F.col("end").alias("__b"))
    return rows.join(F.broadcast(spans), F.col("date").between(F.col("__a"), F.col("__b")), "left").drop("__a", "__b")  # a row a split


def outside(rows: DataFrame, plan: DataFrame, name: str) -> DataFrame:
    """(n): rows within the range of the split that must not be read; sound code gives 0."""
    return in_split(rows, plan.where(F.col("name") == name)).agg(F.count("split").alias("n"))


def plan_faults(plan: DataFrame, sessions: DataFrame, embargo: int) -> DataFrame:
    """(name, empty, unordered, gap, short): what is wrong with each split, in the order of their starts: no sessions, an
    end before the start, sessions between it and the one before, and whether these are fewer than the embargo."""
    w = Window.orderBy("start")
    both = plan.withColumn("before", F.lag("end").over(w))
    held = sessions.select(F.col("date").alias("__d"))
    count = lambda low, high: F.count_if((F.col("__d") > F.col(low)) & (F.col("__d") < F.col(high)))
    inside = F.count_if(F.col("__d").between(F.col("start"), F.col("end")))
    found = both.join(held, F.lit(True) & (F.col("__d") <= F.col("end")), "left").groupBy("name", "start", "end", "before").agg(inside.alias("n"), count("before", "start").alias("between"))
    gap = F.when(F.col("before").isNotNull(), F.col("between"))
    return found.select("name", (F.col("n") == 0).alias("empty"), (F.col("end") < F.col("start")).alias("unordered"), gap.alias("gap"), F.coalesce(gap < embargo, F.lit(False)).alias("short"))


def fold_faults(folds: DataFrame, sessions: DataFrame, embargo: int) -> DataFrame:
    """(fold, ordered, gap, ok): fit before application with at least embargo sessions between."""
    ordered = (F.col("fit_start") <= F.col("fit_end")) & (F.col("fit_end") < F.col("apply_start")) & (F.col("apply_start") <= F.col("apply_end"))
    between = folds.join(sessions.select(F.col("date").alias("__d")), (F.col("__d") > F.col("fit_end")) & (F.col("__d") < F.col("apply_start")), "left")
    gap = between.groupBy("fold", ordered.alias("ordered")).agg(F.count("__d").alias("gap"))
    return gap.withColumn("ok", F.col("ordered") & (F.col("gap") >= embargo))


def tiling(folds: DataFrame, sessions: DataFrame) -> DataFrame:
    """(date, n): sessions from the first application on that not exactly one fold applies to."""
    first = folds.agg(F.min("apply_start").alias("__a"))
    due = sessions.join(F.broadcast(first), F.col("date") >= F.col("__a")).select("date")
    return due.join(F.broadcast(folds.select("apply_start", "apply_end")), F.col("date").between(F.col("apply_start"), F.col("apply_end")), "left").groupBy("date").agg(F.count("apply_start").alias("n")).where("n <> 1")


def inner_split(rows: DataFrame, keys: tuple[str, ...] = ("ticker",), share: float = 0.15, context: int = 0) -> DataFrame:
    """Adds part to a fit window's rows: the last share of each key's rows is val, the rest train; with context, that many
    train rows before it come a second time as part context."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("date"))
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    cut = F.floor(total * (1 - share))
    parts = F.when(n > cut, F.array(F.lit("val"))).when(n > cut - context, F.array(F.lit("train"), F.lit("context"))).otherwise(F.array(F.lit("train")))
    return rows.withColumn("__parts", parts).withColumn("part", F.explode("__parts")).drop("__parts")


def weight_faults(weights: DataFrame, cap: float = 1.0, tolerance: float = 1e-9) -> DataFrame:
    """(strategy, decision, total, n_negative, n_over): sums and bounds of the weights that are not sound."""
    one = weights.groupBy("strategy", "decision").agg(F.sum("weight").alias("total"), F.count_if(F.col("weight") < -tolerance).alias("n_negative"), F.count_if(F.col("weight") > cap + tolerance).alias("n_over"))
    return one.where((F.abs(F.col("total") - 1) > tolerance) | (F.col("n_negative") > 0) | (F.col("n_over") > 0))


def weight_distances(weights: DataFrame) -> DataFrame:
    """(a, b, distance): mean over decisions of half the summed absolute difference of two strategies' weights."""
    side = lambda n: weights.select("decision", "line", F.col("strategy").alias(n), F.col("weight").alias(f"w{n}"))
    both = side("a").join(side("b"), ["decision", "line"]).where("a < b")
    return both.groupBy("a", "b", "decision").agg((F.sum(F.abs(F.col("wa") - F.col("wb"))) / 2).alias("d")).groupBy("a", "b").agg(F.avg("d").alias("distance"))


def differences(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(name, only_left, only_right, worst): of two tables of one key the rows that one lacks, and of each column the
    largest absolute difference; values that only one has count as infinite."""
    a = left.select(*keys, F.lit(True).alias("__l"), *[F.col(c).cast("double").alias(f"__a{i}") for i, c in enumerate(columns)])
    b = right.select(*keys, F.lit(True).alias("__r"), *[F.col(c).cast("double").alias(f"__b{i}") for i, c in enumerate(columns)])
    gap = lambda x, y: F.when(x.isNull() & y.isNull(), 0.0).when(x.isNull() | y.isNull(), float("inf")).otherwise(F.abs(x - y))
    both = a.join(b, keys, "full")
    cells = F.array(*[F.struct(F.lit(c).alias("name"), gap(F.col(f"__a{i}"), F.col(f"__b{i}")).alias("d")) for i, c in enumerate(columns)])
    return both.select("__l", "__r", F.inline(cells)).groupBy("name").agg(F.count_if(F.col("__r").isNull()).alias("only_left"), F.count_if(F.col("__l").isNull()).alias("only_right"), F.max(F.when(F.col("__l") & F.col("__r"), F.col("d"))).alias("worst"))


def digest(*columns: Column) -> Column:
    """SHA-256 of the columns' JSON, doubles rounded to 12 places first by the caller."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def reconstruction_error(rows: DataFrame, keys: list[str], value: str, estimate: str) -> DataFrame:
    """(keys, n, mse) of an estimate."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(value) - F.col(estimate), 2)).alias("mse"))


def paired_losses(predictions: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, mean_d, t): d is a's squared error less b's on the same rows; t its mean over its standard error."""
    d = F.pow(F.col("y") - F.col(a), 2) - F.pow(F.col("y") - F.col(b), 2)
    one = predictions.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean_d"), F.stddev_samp(d).alias("sd"))
    return one.select(*keys, "n", "mean_d", F.try_divide(F.col("mean_d") * F.sqrt("n"), F.col("sd")).alias("t"))


def quantile_label(rows: DataFrame, value: str, fit: Column, q: float, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Adds label: the value lies above the quantile of the fit window."""
    edge = rows.where(fit).groupBy(*keys).agg(F.percentile(value, q).alias("__edge"))
    return rows.join(edge, list(keys)).withColumn("label", F.col(value) > F.col("__edge")).drop("__edge")
