"""Null-aware arithmetic and aggregates as Spark columns.

Rules kept everywhere: missing is not zero, a zero denominator gives NULL, sums come before divisions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    """A column from a name, a column or a number."""
    if isinstance(c, str):
        return F.col(c)
    return c if isinstance(c, Column) else F.lit(c)


def r6(c) -> Column:
    """Round to the six places at which results are compared and published."""
    return F.round(col(c).cast("double"), 6)


def ratio(a, b) -> Column:
    """a / b, NULL when b is zero or either side is missing."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def per90(count, minutes) -> Column:
    return F.when(col(minutes) > 0, col(count) / (col(minutes) / 90.0))


def zero_if_null(c) -> Column:
    return F.coalesce(col(c), F.lit(0.0))


def add_all(columns) -> Column:
    """Row total in which a missing part counts as zero; pair it with a completeness flag."""
    return reduce(lambda a, b: a + b, [zero_if_null(c) for c in columns])


def weighted_mean(value, weight) -> Column:
    """Aggregate: weighted mean over rows with a value and a positive weight."""
    v, w = col(value), col(weight)
    ok = v.isNotNull() & (w > 0)
    return ratio(F.sum(F.when(ok, v * w)), F.sum(F.when(ok, w)))


def share(condition: Column, amount) -> Column:
    """Aggregate: percentage of `amount` on rows that meet the condition."""
    return ratio(100 * F.sum(F.when(condition, col(amount)).otherwise(0)), F.sum(col(amount)))


def pearson(x, y, min_n: int = 2) -> Column:
    """Aggregate: Pearson r over complete pairs; NULL below `min_n` pairs or for a constant column."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    r = ratio(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))
    return F.when(F.count(xx) >= min_n, r)


def shrink_half_length(r) -> Column:
    """Spearman-Brown: reliability of the whole from the correlation of two halves."""
    return ratio(2 * col(r), 1 + col(r))


def season_start(season) -> Column:
    return F.substring(col(season), 1, 4).cast("int")


def rescale(value, low, high) -> Column:
    """Position of a value between fixed bounds, so that panels stay comparable."""
    return (col(value) - F.lit(low)) / (F.lit(high) - F.lit(low))


def finite_or_null(c) -> Column:
    """NaN and infinities never leave a source or enter a document."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
