"""An order-preserving 64-bit key for numbers, so exact ranks can be found digit by digit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ordered_key(col: Column) -> Column:
    """A bigint that sorts exactly like the double ``col`` and is different for different values.

    The bit pattern of a double that is not negative sorts like the number; a
    negative one gets the negated key of its magnitude. Null and NaN give null.
    """
    size = F.when(col.isNotNull() & ~F.isnan(col), F.abs(col))
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), size).cast("bigint")
    key = bits * F.when(col < 0, F.lit(-1)).otherwise(F.lit(1))
    return F.when(size.isNotNull(), key)
