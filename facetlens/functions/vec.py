"""Vector arithmetic on ARRAY<DOUBLE> columns.

Everything here is a plain Catalyst expression, so it needs no Python worker.
Undefined results (zero norm) are NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v
    )


def sq_norm(a: Column | str) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + v * v)


def norm(a: Column | str) -> Column:
    return F.sqrt(sq_norm(a))


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def sub(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def scale(a: Column | str, k: Column | float) -> Column:
    factor = k if isinstance(k, Column) else F.lit(float(k))
    return F.transform(_c(a), lambda x: x * factor)


def normalize(a: Column | str, eps: float = 0.0) -> Column:
    """Unit vector, NULL when the norm is not above ``eps``."""
    length = norm(a)
    return F.when(length > F.lit(eps), scale(a, F.lit(1.0) / length))


def cosine(a: Column | str, b: Column | str) -> Column:
    denom = norm(a) * norm(b)
    return F.when(denom > 0, dot(a, b) / denom)


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(
        F.aggregate(
            F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)),
            F.lit(0.0),
            lambda s, v: s + v,
        )
    )
