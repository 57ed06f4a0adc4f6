"""Scalar functions on levels, ramps and exact sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Guards every division and logarithm.
EPS = 1e-10


def exact(c: Column) -> Column:
    """A measure whose sums don't depend on the order of its rows."""
    return c.cast("decimal(18,4)")


def ratio_db(a: Column, b: Column) -> Column:
    """20 log10(a / b); null where either is silent."""
    return F.when((a > EPS) & (b > EPS), 20 * F.log10(a / b))


def power_db(p: Column) -> Column:
    """10 log10(p); null where p is silent."""
    return F.when(p > EPS, 10 * F.log10(p))


def rms(c: Column) -> Column:
    return F.sqrt(F.avg(c * c))


def correlation(a: Column, b: Column) -> Column:
    """The correlation of a and b over a group's rows that have both; not a number where one of them doesn't vary (F.corr divides by zero there)."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))), F.when(F.count(x) > 0, F.lit(float("nan"))))


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def ramp(c: Column, start: float, width: float) -> Column:
    """0 below start, 1 from start + width on, linear between."""
    return clip((c - start) / width)


def reasons(*rules: tuple[Column, str], default: str) -> Column:
    """The messages of the rules that hold, in order; the default if none does."""
    said = F.filter(F.array(*(F.when(test, F.lit(text)) for test, text in rules)), lambda x: x.isNotNull())
    return F.when(F.size(said) == 0, F.array(F.lit(default))).otherwise(said)
