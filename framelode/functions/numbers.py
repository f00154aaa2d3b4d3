"""Rounding as the rules have it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves of 26 bits.
_SPLIT = float((1 << 27) + 1)
#: From here on a double has no fraction.
_WHOLE = float(1 << 52)


def half_even(value: Column, digits: int = 0) -> Column:
    """The double nearest to ``value``, as it is in binary, rounded to so many decimal digits; a half that is one in binary goes to the even neighbour.

    2.675 lies below its decimal writing and gives 2.67, where a rounding of that writing gives 2.68. The value times a power of ten is taken as a rounded
    product and its error, which is exact by splitting both factors; the error decides where the product is a half. Null, NaN, infinities and values
    without a fraction stay."""
    scale = float(10**digits)
    x = value.cast("double")
    big = x * _SPLIT
    high = big - (big - x)
    low = x - high
    top = scale * _SPLIT - (scale * _SPLIT - scale)
    rest = scale - top
    product = x * scale
    error = ((high * top - product) + high * rest + low * top) + low * rest
    near = F.rint(product)
    off = product - near
    whole = near + F.when((off == 0.5) & (error > 0), 1.0).when((off == -0.5) & (error < 0), -1.0).otherwise(0.0)
    return F.when(F.abs(product) < _WHOLE, whole / scale).otherwise(x)
