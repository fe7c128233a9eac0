"""Small statistics as column expressions."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Functions used inside tasks travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a share by Wilson's score interval; null for n = 0."""
    n = F.when(n > 0, n.cast("double"))
    share = successes / n
    scale = 1 + z * z / n
    centre = (share + z * z / (2 * n)) / scale
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)) / scale
    return centre - half, centre + half


def _upper_tail(x: float, dof: int) -> float:
    """P(chi-square with `dof` degrees of freedom > x), by the finite series for whole dof."""
    half = x / 2
    if half <= 0:
        return 1.0
    odd = dof % 2
    total = math.erfc(math.sqrt(half)) if odd else 0.0
    log_term = -half + (0.5 * math.log(half) - math.lgamma(1.5) if odd else 0.0)
    for i in range(dof // 2):
        total += math.exp(log_term)
        log_term += math.log(half) - math.log(i + 1 + odd / 2)
    return min(total, 1.0)


def chi_square_p(statistic: Column, dof: Column) -> Column:
    """The p-value of a chi-square statistic; null when there is nothing to compare."""
    @F.pandas_udf("double")
    def tail(x: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([
            _upper_tail(float(a), int(b)) if pd.notna(a) and pd.notna(b) and b > 0 else None
            for a, b in zip(x, d)], dtype="float64")

    return tail(statistic, dof)
