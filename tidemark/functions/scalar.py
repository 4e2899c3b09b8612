"""Column functions that the operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What no signal is scaled to.
FLOOR_VALUE = 0.01


def laplace_quantile(p: Column, m: float = 0.0, s: Column | float = 1.0) -> Column:
    s = F.lit(s) if isinstance(s, float | int) else s
    return F.when(p < 0.5, m + s * F.log(2 * p)).otherwise(m - s * F.log(2 * (1 - p)))


def logistic_scale(bins: Column) -> Column:
    """An array scaled so that 0 becomes about 0.01 and a twentieth of the maximum becomes one half; all zeros stay at 0.01."""
    top = F.array_max(bins)
    m = F.when(top == 0, F.lit(1.0)).otherwise(0.05 * top)
    return F.transform(bins, lambda x: 1 / (1 + F.exp(-(F.lit(math.log(1 / FLOOR_VALUE - 1)) / m) * (x - m))))
