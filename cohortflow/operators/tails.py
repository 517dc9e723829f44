"""Tail probabilities, applied to result rows only (one per test or coefficient)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-square with a whole number of degrees of freedom, as a finite sum."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    odd = df % 2
    total = math.erfc(math.sqrt(half)) if odd else 0.0
    power = 0.5 if odd else 0.0
    while power < df / 2.0:
        total += math.exp(power * math.log(half) - half - math.lgamma(power + 1.0))
        power += 1.0
    return min(1.0, total)


@pandas_udf(DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else normal_two_sided(v)).astype("float64")


@pandas_udf(DoubleType())
def _signed_rank_p(n: pd.Series, w: pd.Series) -> pd.Series:
    return pd.Series([_exact_signed_rank(int(a), float(b)) for a, b in zip(n, w)], dtype="float64")


def _exact_signed_rank(n: int, w: float) -> float:
    """P-value from the exact distribution of the rank sum of n untied pairs."""
    if n == 0:
        return 1.0
    ways = [1]
    for rank in range(1, n + 1):
        longer = ways + [0] * rank
        for total, count in enumerate(ways):
            longer[total + rank] += count
        ways = longer
    return min(1.0, 2.0 * sum(ways[: int(w) + 1]) / 2.0**n)


def normal_p(z: Column) -> Column:
    """Two-sided normal tail of a z value."""
    return _normal_p(z)


def chi2_one_p(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return _normal_p(F.sqrt(x))


def signed_rank_p(n: Column, w: Column) -> Column:
    return _signed_rank_p(n, w)
