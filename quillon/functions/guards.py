"""Expressions that keep null, NaN and infinity apart, and that never raise under ANSI rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def finite(c: Column) -> Column:
    """The value as double; null where it is NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def present(c: Column, floating: bool = True) -> Column:
    """Neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c) if floating else c.isNotNull()


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b as floating-point units do it: infinities and NaN where b is 0."""
    x, y = a.cast("double"), b.cast("double")
    over = F.when(F.isnan(x) | (x == 0), float("nan")).when(x > 0, float("inf")).otherwise(float("-inf"))
    return F.when(y == 0, over).otherwise(F.try_divide(x, y))


def round_cents(c: Column) -> Column:
    """Nearest hundredth, ties to even in binary: rint(100 x) / 100."""
    return F.rint(c * 100) / 100


def pearson(a: Column, b: Column) -> Column:
    """Aggregate: correlation over rows where both are finite; null for constants and fewer than two rows."""
    x, y = finite(a), finite(b)
    both = x.isNotNull() & y.isNotNull()
    p, q = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(p, q), F.stddev_pop(p) * F.stddev_pop(q))
