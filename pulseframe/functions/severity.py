"""How severe a change from one value to another is, as a column and as a number."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the severity scale: log-linear base, its floor, the base for values under SMALL, and the weight.
SLOPE, INTERCEPT, FLOOR, SMALL_BASE, SMALL, WEIGHT = -0.17949, 1.13489, 1.1, 4.8, 0.1, 30.0


def severity(old: float, new: float) -> int:
    """1 to 100; 0 if it can't be told, as between two zeros."""
    low, high = min(old, new), max(old, new)
    base = SMALL_BASE if low < SMALL else max(FLOOR, math.exp(SLOPE * math.log(low) + INTERCEPT))
    below, above = (base - 1) * low, WEIGHT * (high - low)
    if below == 0:
        return 0 if above == 0 else 100
    s = above / below
    return 0 if math.isnan(s) else int(max(1.0, min(100.0, s)))


def severity_col(old: Column, new: Column) -> Column:
    low, high = F.least(old, new), F.greatest(old, new)
    base = F.when(low < SMALL, F.lit(SMALL_BASE)).otherwise(F.greatest(F.lit(FLOOR), F.exp(SLOPE * F.log(low) + INTERCEPT)))
    s = F.try_divide(WEIGHT * (high - low), (base - 1) * low)
    return F.when(old.isNull() | new.isNull(), None).when(low == 0, F.when(high == 0, 0).otherwise(100)).otherwise(F.least(F.greatest(s, F.lit(1.0)), F.lit(100.0)).cast("int"))
