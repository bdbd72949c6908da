"""Decimal rounding of the exact binary value, ties to even.

Spark's ``round`` works on the shortest printed form of a double, so 1/32 to
four places gives 0.0313; the value to match is 0.0312. The expressions below
decide on integers only: the fraction is scaled by a power of two, multiplied by
the power of ten, and the bits shifted out are compared with one half.
"""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_round(col: Column, digits: int) -> Column:
    """Round a double to ``digits`` places (magnitudes below 2**53 / 10**digits)."""
    power = 10 ** digits
    bits = min(52, 62 - math.ceil(math.log2(power)))
    size = F.abs(col.cast("double"))
    whole = F.floor(size)
    scaled = (size - whole) * float(2 ** bits)
    kept = F.floor(scaled)
    product = kept * F.lit(power).cast("bigint")
    quotient = F.shiftright(product, bits)
    rest = product.bitwiseAND(F.lit(2 ** bits - 1).cast("bigint"))
    below = whole * F.lit(power).cast("bigint") + quotient
    # what the scaling cut off still counts; it is exact unless the fraction is far
    # too small to matter
    cut_off = (scaled - kept) * float(power)
    to_half = (F.lit(2 ** (bits - 1)).cast("bigint") - rest).cast("double")
    up = (cut_off > to_half) | ((cut_off == to_half) & (below % 2 == 1))
    rounded = (below + up.cast("bigint")) / float(power)
    return F.when(col < 0, -rounded).otherwise(rounded)
