"""Small numeric rules shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or_null(x: Column) -> Column:
    """NaN and infinities become NULL, so NaN never travels through a plan."""
    bad = F.isnan(x) | x.isin(float("inf"), float("-inf"))
    return F.when(~bad, x)


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(finite_or_null(x), F.lit(0.0))))


def safe_ratio(num: Column, den: Column, floor: float = 1e-9) -> Column:
    return num / F.greatest(den, F.lit(floor))


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Rounded for output; adding 0.0 drops a negative zero."""
    col = F.col(x) if isinstance(x, str) else x
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def null_safe_mean(cols: list[Column]) -> Column:
    """Row-wise mean of columns known to be non-null."""
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total / F.lit(float(len(cols)))


def cohens_d_from_moments(
    mean_a: Column, mean_b: Column, var_a: Column, var_b: Column, n_a: Column, n_b: Column
) -> Column:
    """Pooled effect size; NULL if a side has fewer than two rows or no spread."""
    pooled = ((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)
    usable = (n_a >= 2) & (n_b >= 2) & (pooled > 0)
    return F.when(usable, (mean_a - mean_b) / F.sqrt(F.when(usable, pooled)))
