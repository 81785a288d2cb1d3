"""Incremental reruns: new files only, each exactly once.

The batch form of resuming is an anti-join on finished keys (``operators.grid.pending``).
When results arrive as files, the file source's checkpoint remembers what was read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def completed_jobs(spark: SparkSession, path: str) -> DataFrame:
    """(job_id) from a JSON-lines log; malformed lines and lines without a job id are ignored."""
    schema = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("job_id IS NOT NULL AND job_id <> ''").select("job_id").distinct()


def fully_processed(done: DataFrame, key: str, feature: str, n_features: int) -> DataFrame:
    """Keys that have rows for the full number of features."""
    return done.groupBy(key).agg(F.countDistinct(feature).alias("_n")).filter(F.col("_n") >= n_features).select(key)


def ingest_new_parts(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str) -> None:
    """Append result files that arrived since the last call to the ``target`` table."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = (
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
