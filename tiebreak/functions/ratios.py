"""Null-safe counting and ratios."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_true(cond: Column) -> Column:
    """A comparison with NULL counts as false, so the row stays in denominators."""
    return F.coalesce(cond, F.lit(False))


def rate(part: Column, whole: Column, default=0.0) -> Column:
    """part / whole as double, ``default`` where the whole is 0 or NULL."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(float(default)))
