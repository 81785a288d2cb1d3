"""Cut a lineage by writing an intermediate table to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str | None:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; a cluster session gets
    None, because a folder of one machine would not be seen by the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        app = sc.applicationId
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="facetlens-")
        return _LOCAL_ROOTS[app]
    return None


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written Parquet table: computed once, with known size and no lineage.

    The files live in the shared folder, so they survive lost executors, and their exact
    size lets Spark decide about broadcasting. Without a shared folder ``df`` is returned
    as it is.
    """
    root = shared_root(df.sparkSession)
    if root is None:
        return df
    path = f"{root}/facetlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
