"""Joins that stay balanced when one key value holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    spread_by: list[str | Column],
    how: str = "inner",
    salts: int = 8,
) -> DataFrame:
    """Equi-join a large side to a lookup with few, possibly very hot, keys.

    The large side gets a salt from a hash of ``spread_by`` and each lookup row is
    repeated once per salt, so a hot key is handled by ``salts`` tasks instead of one.
    No broadcast hint is given: Spark still broadcasts the lookup when its measured
    size is under ``spark.sql.autoBroadcastJoinThreshold`` (at plan time or by AQE),
    and otherwise runs the salted shuffle join.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"spread_join does not support {how!r}")
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    left = big.withColumn("_salt", salt)
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
