"""Connected components of a link table, and a bounded membership filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlens.llm.common import mix, stage


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the smallest node reachable) of links (a, b).

    Alternates two steps until nothing changes: every larger neighbour of a node is tied to the node's
    least neighbour, then every smaller one is. Minima are pre-aggregated; each round is written.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = stage(small.distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Bits of a membership filter for each id, and of the smallest and the largest filter (32 MiB).
ID_BITS, LEAST_BITS, MOST_BITS = 8, 1 << 16, 1 << 28
_STRETCHES = 64


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64))
    last = np.uint64(bits - 1)
    return [(h & last).astype(np.int64), (h >> np.uint64(32) & last).astype(np.int64)]


def id_filter(ids: DataFrame) -> bytes:
    """Bits of all values of the only column of ``ids``, a staged table: ID_BITS for each distinct one, MOST_BITS
    together at most. A fuller filter lets more other ids through, never fewer of these."""
    wanted = ids.agg(F.approx_count_distinct(ids.columns[0])).first()[0]
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (ID_BITS * wanted).bit_length()))

    def mark(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            own = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            for at in _places(own, size):
                np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        stretch = bits.reshape(_STRETCHES, -1)
        some = np.flatnonzero(stretch.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([stretch[k].tobytes() for k in some], pa.binary())], ["k", "bits"])

    def union(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size // 8 // _STRETCHES, np.uint8)
        for batch in batches:
            for b in batch.column(1):
                total |= np.frombuffer(b.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["k", "bits"])

    out = {r["k"]: r["bits"] for r in ids.mapInArrow(mark, "k long, bits binary").groupBy("k").applyInArrow(union, "k long, bits binary").collect()}
    return b"".join(bytes(out.get(k, bytes(size // 8 // _STRETCHES))) for k in range(_STRETCHES))


def may_hold(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), bool)
    for at in _places(ids, 8 * len(bits)):
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def split_by_ids(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose doc_id is surely not among ``ids`` (its only column), and the rest: only the rest needs a
    join, so most texts are never shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids.select(F.col(ids.columns[0]).cast("long"))))

    def part(held: bool):
        def run(batches):
            bits = np.frombuffer(shared.value, np.uint8)
            for batch in batches:
                own = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
                ok = may_hold(bits, own.fill_null(0).to_numpy(zero_copy_only=False)) & own.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(ok == held))

        return docs.mapInArrow(run, docs.schema)

    return part(False), part(True)
