"""Window helpers for series of (ticker, date): one partitioning and order for all, so plans share one exchange and sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def ordered():
    return Window.partitionBy("ticker").orderBy("date")


def prefix():
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def trailing(period: int):
    return ordered().rowsBetween(-(period - 1), 0)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def prev(x: Column | str, k: int = 1) -> Column:
    return F.lag(col(x), k).over(ordered())


def full(x: Column, period: int, over: Column | str = "close") -> Column:
    """x where the trailing window is full of non-null values, else null: the warm-up."""
    return F.when(F.count(col(over)).over(trailing(period)) == period, x)


def mean(x: Column | str, period: int) -> Column:
    return full(F.avg(col(x)).over(trailing(period)), period, x)


def total(x: Column | str, period: int) -> Column:
    return full(F.sum(col(x)).over(trailing(period)), period, x)


def highest(x: Column | str, period: int) -> Column:
    return full(F.max(col(x)).over(trailing(period)), period, x)


def lowest(x: Column | str, period: int) -> Column:
    return full(F.min(col(x)).over(trailing(period)), period, x)


def pop_std(x: Column | str, period: int) -> Column:
    return full(F.stddev_pop(col(x)).over(trailing(period)), period, x)


def sample_std(x: Column | str, period: int) -> Column:
    return full(F.stddev_samp(col(x)).over(trailing(period)), period, x)


def weighted(x: Column | str, weights: Sequence[float]) -> Column:
    """Dot product of the trailing window, oldest first, with the weights."""
    pairs = F.zip_with(F.collect_list(col(x)).over(trailing(len(weights))), F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    return full(F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b), len(weights), x)


def ratio(num: Column, den: Column, otherwise: Column | float | None = None) -> Column:
    """num / den, or otherwise where den is 0."""
    return F.when(den != 0, num / F.when(den != 0, den)).when(den == 0, otherwise if isinstance(otherwise, Column) else F.lit(otherwise).cast("double"))


def hold(x: Column) -> Column:
    """The last non-zero value up to here, or 0."""
    return F.coalesce(F.last(F.nullif(x, F.lit(0)), ignorenulls=True).over(prefix()), F.lit(0))


def half_up(x: Column, digits: int) -> Column:
    """Rounded with halves towards plus infinity; infinities and nulls stay."""
    scale = float(10**digits)
    finite = F.abs(x) < 1e300
    return F.when(finite, F.floor(F.when(finite, x) * scale + 0.5) / scale).otherwise(x)
