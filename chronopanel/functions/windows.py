"""Window expressions over one ticker's rows in date order. Frames are counts of rows; a value is NULL unless the whole
frame is there, so nothing depends on how far back a table happens to reach."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Sessions of a year.
YEAR = 252.0


def by(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(n: int, keys: tuple[str, ...] = ("ticker",)) -> WindowSpec:
    return by(*keys).rowsBetween(-(n - 1), 0)


def forward(n: int, keys: tuple[str, ...] = ("ticker",)) -> WindowSpec:
    return by(*keys).rowsBetween(1, n)


def running(keys: tuple[str, ...] = ("ticker",)) -> WindowSpec:
    return by(*keys).rowsBetween(Window.unboundedPreceding, 0)


def full(agg: Callable[[Column], Column], x: Column | str, spec: WindowSpec, n: int) -> Column:
    """agg of x over the frame, if it has n values."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(spec) == n, agg(x).over(spec))


def change(x: Column, n: int = 1, keys: tuple[str, ...] = ("ticker",)) -> Column:
    return x - F.lag(x, n).over(by(*keys))


def log_of(x: Column | str) -> Column:
    """Natural logarithm, NULL for what is not positive."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x > 0, F.ln(x))


def skew_of(x: Column, spec: WindowSpec, n: int) -> Column:
    """Bias-adjusted skewness of n values."""
    return full(F.skewness, x, spec, n) * (n * (n - 1)) ** 0.5 / (n - 2)


def kurt_of(x: Column, spec: WindowSpec, n: int) -> Column:
    """Bias-adjusted excess kurtosis of n values."""
    return ((n + 1) * full(F.kurtosis, x, spec, n) + 6) * ((n - 1) / ((n - 2) * (n - 3)))
