"""Sessions, their ordinals, decision dates, holding periods, splits and folds.

A calendar is a table of sessions (date), one row each. Ordinals number them in date order; the few thousand sessions of
a market are small next to a panel, so a calendar is numbered in one window and joined by date or ordinal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Boundaries of walk-forward folds.
CADENCES = {"month": "1 month", "quarter": "3 months", "year": "1 year"}


def observed(panel: DataFrame) -> DataFrame:
    """The dates on which anything was observed."""
    return panel.select("date").distinct()


def weekdays(panel: DataFrame) -> DataFrame:
    """All Mondays to Fridays from the panel's first to its last date."""
    span = panel.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("date")).where(F.weekday("date") < 5)


def numbered(sessions: DataFrame) -> DataFrame:
    """Adds ord, from 0."""
    return sessions.withColumn("ord", F.row_number().over(Window.orderBy("date")) - 1)


def shift(sessions: DataFrame, n: int) -> DataFrame:
    """(date, shifted): the n-th session after, or before if n is negative; NULL beyond the calendar."""
    s = numbered(sessions)
    return s.join(s.select(F.col("date").alias("shifted"), (F.col("ord") - n).alias("ord")), "ord", "left").select("date", "shifted")


def between(sessions: DataFrame, spans: DataFrame, inclusive: str = "neither") -> DataFrame:
    """spans (a, b) with n, the sessions between: neither, left, right or both ends counted."""
    low = F.col("date") >= F.col("a") if inclusive in ("left", "both") else F.col("date") > F.col("a")
    high = F.col("date") <= F.col("b") if inclusive in ("right", "both") else F.col("date") < F.col("b")
    return spans.join(sessions, low & high, "left").groupBy("a", "b").agg(F.count("date").alias("n"))


def decisions(sessions: DataFrame, weekday: int = 4) -> DataFrame:
    """The last session up to the weekday (Monday is 0) of each ISO week."""
    week = [F.extract(F.lit("YEAROFWEEK"), F.col("date")).alias("iso_year"), F.weekofyear("date").alias("iso_week")]
    return sessions.where(F.weekday("date") <= weekday).groupBy(*week).agg(F.max("date").alias("date"))


def holding_periods(sessions: DataFrame, weekday: int = 4, lag: int = 1, decided: DataFrame | None = None) -> DataFrame:
    """(decision, start, end): decided at t, executed lag sessions later, held to the next execution, the last one to the
    last session. Decisions without an execution or without a session to hold drop out."""
    s = numbered(sessions)
    last = s.agg(F.max("ord").alias("last"))
    executed = (decided if decided is not None else decisions(sessions, weekday)).select("date").join(s, "date").withColumn("start_ord", F.col("ord") + lag).crossJoin(F.broadcast(last)).where("start_ord <= last")
    w = Window.orderBy("ord")
    periods = executed.withColumn("end_ord", F.coalesce(F.lead("start_ord").over(w), F.col("last"))).where("end_ord > start_ord")
    name = lambda c: s.select(F.col("date").alias(c), F.col("ord").alias(f"{c}_ord"))
    return periods.select(F.col("date").alias("decision"), "start_ord", "end_ord").join(name("start"), "start_ord").join(name("end"), "end_ord").select("decision", "start", "end")


def split_plan(sessions: DataFrame, starts: list[tuple[str, str]], embargo: int) -> DataFrame:
    """(name, start, end, n_sessions) of splits given by name and declared start, in order. Each begins at its first
    session at or after the declared start; its end is purged so that embargo sessions lie before the next begins."""
    s = numbered(sessions)
    declared = sessions.sparkSession.createDataFrame([(i, n, d) for i, (n, d) in enumerate(starts)], "i int, name string, declared string").withColumn("declared", F.to_date("declared"))
    first = declared.join(s, s.date >= declared.declared).groupBy("i", "name").agg(F.min("ord").alias("a"))
    last = s.agg((F.max("ord") + embargo + 1).alias("after"))
    plan = first.crossJoin(F.broadcast(last)).withColumn("b", F.coalesce(F.lead("a").over(Window.orderBy("i")), F.col("after")) - embargo - 1)
    ends = s.select(F.col("ord").alias("b"), F.col("date").alias("end"))
    return plan.join(s.select(F.col("ord").alias("a"), F.col("date").alias("start")), "a").join(ends, "b").select("name", "start", "end", (F.col("b") - F.col("a") + 1).alias("n_sessions"))


def expanding_folds(sessions: DataFrame, first_apply: str, cadence: str = "quarter", embargo: int = 25) -> DataFrame:
    """(fold, fit_start, fit_end, apply_start, apply_end): folds apply from boundary to boundary and fit on all sessions
    up to embargo before. Boundaries are first_apply and each month's, quarter's or year's first day after it; folds
    without sessions to apply to or to fit on drop out."""
    s = numbered(sessions)
    span = s.agg(F.max("date").alias("last"), F.min("date").alias("fit_start"))
    begin = F.to_date(F.lit(first_apply))
    steps = F.sequence(F.to_date(F.date_trunc(cadence, begin)), F.col("last"), F.expr(f"interval {CADENCES[cadence]}"))
    bounds = span.select("fit_start", "last", F.explode(F.array_distinct(F.concat(F.array(begin), F.filter(steps, lambda d: d > begin)))).alias("a"))
    bounds = bounds.withColumn("b", F.coalesce(F.lead("a").over(Window.orderBy("a")), F.date_add("last", 1)))
    applied = bounds.join(s, (F.col("date") >= F.col("a")) & (F.col("date") < F.col("b"))).groupBy("fit_start", "a").agg(F.min("date").alias("apply_start"), F.max("date").alias("apply_end"), F.min("ord").alias("ord"))
    fitted = applied.withColumn("fit_ord", F.col("ord") - embargo - 1).join(s.select(F.col("ord").alias("fit_ord"), F.col("date").alias("fit_end")), "fit_ord")
    return fitted.select((F.row_number().over(Window.orderBy("a")) - 1).alias("fold"), "fit_start", "fit_end", "apply_start", "apply_end")
