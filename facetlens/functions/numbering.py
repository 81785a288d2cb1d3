"""Row numbers of a whole table without a window that one task would have to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlens.functions.settle import settle, shared_root


def numbered(rows: DataFrame, order: list[Column], name: str = "numbered") -> DataFrame:
    """``rows`` with ``_rn`` (from 0, by ``order``) and ``_total``, the number of rows.

    Rows are dealt by ranges of ``order`` and written once, so that their places stay; a row's
    number is its place in its part plus the rows of the parts before, one number a part.
    Rows that ``order`` leaves equal have numbers in any order.
    """
    spark = rows.sparkSession
    if shared_root(spark) is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = settle(dealt, name).withColumn("_part", F.shiftright("_place", 33))
    totals = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    # One row a part: both windows are over at most as many rows as there are parts.
    every = Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("_n").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("_part", "_first", before.alias("_before"), F.sum("_n").over(every).alias("_total"))
    joined = placed.join(totals, "_part").withColumn("_rn", F.col("_place") - F.col("_first") + F.col("_before"))
    return joined.select(*rows.columns, "_rn", "_total")
