"""Seeded samples and grouped folds that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlens.functions.hashing import seeded_order
from facetlens.functions.joins import spread_join
from facetlens.functions.numbering import numbered


def uniform_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return df.withColumn("_h", seeded_order(seed, F.col(key))).orderBy("_h").limit(n).drop("_h")


def stratified_sample(df: DataFrame, stratum: Column, key: str, max_rows: int, seed: int = 0) -> DataFrame:
    """ceil(max / strata) rows per stratum in hash order, trimmed or topped up to ``max_rows``.

    The quota of a stratum ends at a hash value, found by a ranked limit that Spark applies
    inside every task; rows up to it come first, the others only top up. No window holds a
    whole stratum.
    """
    if max_rows <= 0:
        raise ValueError("max_rows must be positive")
    rows = df.withColumn("_s", stratum.cast("string")).withColumn("_h", seeded_order(seed, F.col(key)))
    n_strata = rows.select("_s").distinct().count()
    quota = max(1, -(-max_rows // max(1, n_strata)))
    w = Window.partitionBy("_s").orderBy("_h")
    limit = (
        rows.select("_s", "_h").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= quota)
        .groupBy("_s").agg(F.max("_h").alias("_last"))
    )
    placed = spread_join(rows, limit, ["_s"], spread_by=["_h"])
    late = (F.col("_h") > F.col("_last")).cast("int")
    return placed.orderBy(late, "_h").limit(max_rows).drop("_s", "_h", "_last")


def group_kfold(rows: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, n, fold): whole groups dealt to folds, largest first, in snake order.

    Groups are numbered by falling size without a window over all of them (``numbered``), and the
    number alone gives the fold. The number of folds is at most the number of groups.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    placed = numbered(sizes, [F.desc("n"), F.col(group).asc_nulls_first()], "group-folds")
    k = F.least(F.lit(folds).cast("bigint"), F.col("_total"))
    at = F.pmod(F.col("_rn"), 2 * k)
    return placed.withColumn("_k", k).withColumn("_at", at).select(
        group, "n", F.when(F.col("_at") < F.col("_k"), F.col("_at")).otherwise(2 * F.col("_k") - 1 - F.col("_at")).cast("int").alias("fold")
    )
