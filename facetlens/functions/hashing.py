"""Portable seeded hashes: the same value in any engine and for any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: int | str, *keys: Column) -> Column:
    """Unsigned 32-bit hash as BIGINT, from the first 8 hex digits of an md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def seeded_order(seed: int | str, *keys: Column) -> Column:
    """Full md5 text: a total pseudo-random order over distinct keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


#: Fixed multipliers of the counter-based generator; products of 32-bit numbers with MIX stay below 2^63.
MIX, STEP = 73244475, 2654435769
MASK = (1 << 32) - 1


def counter_hashes(seed: Column, n: int) -> Column:
    """n 32-bit hashes of a 32-bit seed: each follows from the seed and its number alone."""
    # One transform a step, so that a step's input is computed once.
    numbers = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")), lambda i: (seed + i * F.lit(STEP)).bitwiseAND(F.lit(MASK)))
    for _ in range(2):
        for _ in range(2):
            numbers = F.transform(numbers, lambda x: (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(MIX)).bitwiseAND(F.lit(MASK)))
        numbers = F.transform(numbers, lambda x: x.bitwiseXOR(F.shiftright(x, 16)))
    return numbers


def normal_values(hashes: Column, n: int) -> Column:
    """n standard normal values from 2n 32-bit hashes, by pairs of uniforms (Box-Muller)."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.get(hashes, 2 * i).alias("a"), F.get(hashes, 2 * i + 1).alias("b")))
    whole = F.lit(float(1 << 32))
    values = lambda p: F.sqrt(-2.0 * F.log((p["a"] + 1) / whole)) * F.cos(F.lit(2 * math.pi) * p["b"] / whole)
    return F.transform(pairs, values)


def job_key(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 16)
