"""Matrices of model size as blocks in the shared folder, read by the tasks that multiply with them.

A table (layer, id, w, b) is dealt into blocks of bounded size, each written once by a task as an
uncompressed Arrow file. Tasks map the files of a mounted folder into memory, so the workers of a machine
share one copy and only the block in use has to be resident; files of other stores that pyarrow opens
(HDFS, S3, GCS) are read block by block. The driver keeps the list of file names only: a matrix may be
larger than the driver, an executor or a broadcast can hold.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlens.functions.settle import shared_root

#: A block's bytes as float64.
BLOCK_BYTES = 64 << 20
#: Bytes of a product, and of the vectors that go through all blocks at a time.
PRODUCT_BYTES, CHUNK_BYTES = 32 << 20, 32 << 20


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


@dataclass(frozen=True)
class MatrixBlocks:
    """files: of each layer, the names of its blocks; width: the length of its rows."""

    folder: str
    files: dict[int, list[str]]
    width: dict[int, int]

    def blocks(self, layer: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids ascending, rows as a matrix, b) of each block of a layer."""
        fs, path = _store(self.folder)
        for name in self.files.get(layer, []):
            local = isinstance(fs, pafs.LocalFileSystem)
            source = pa.memory_map(f"{path}/{name}") if local else fs.open_input_file(f"{path}/{name}")
            with source, pa.ipc.open_file(source) as file:
                batch = file.get_batch(0)
                w = batch.column("w").flatten().to_numpy().reshape(batch.num_rows, -1)
                yield batch.column("id").to_numpy(), w, batch.column("b").to_numpy()


def matrix_blocks(table: DataFrame, name: str, block_bytes: int = BLOCK_BYTES) -> MatrixBlocks:
    """Write ``table`` (layer, id, w and, if there is one, b) as blocks; a row's block follows from its id.

    A task writes whole files under names of its own, and only names that Spark returned are
    read, so repeated or lost attempts do no harm.
    """
    spark = table.sparkSession
    root = shared_root(spark)
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{root}/facetlens/{name}-{uuid.uuid4().hex}"
    shape = table.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("w")).alias("d"), F.min(F.size("w")).alias("least")).collect()
    for r in shape:
        if r["d"] != r["least"]:
            raise ValueError(f"rows of layer {r['layer']} differ in length")
    width = {int(r["layer"]): int(r["d"]) for r in shape}
    count = {int(r["layer"]): max(1, -(-int(r["n"]) * 8 * int(r["d"]) // block_bytes)) for r in shape}
    files: dict[int, list[str]] = {layer: [] for layer in width}
    if not count:
        return MatrixBlocks(folder, files, width)
    per_layer = F.create_map(*[F.lit(x) for pair in count.items() for x in pair])
    b = F.col("b").cast("double") if "b" in table.columns else F.lit(0.0)
    rows = table.select(F.col("layer").cast("int").alias("layer"), F.col("id").cast("long").alias("id"), F.col("w").cast("array<double>").alias("w"), b.alias("b"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), per_layer[F.col("layer")]).cast("int"))
    dealt = rows.repartition(sum(count.values()), "layer", "block").sortWithinPartitions("layer", "block", "id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _store(folder)
        fs.create_dir(path, recursive=True)

        def put(key: tuple[int, int], parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            flat = t["w"].combine_chunks().flatten()
            w = pa.FixedSizeListArray.from_arrays(flat, len(flat) // t.num_rows)
            one = pa.RecordBatch.from_arrays([t["id"].combine_chunks(), w, t["b"].combine_chunks()], ["id", "w", "b"])
            file = f"{key[0]}-{key[1]}-{uuid.uuid4().hex}.arrow"
            with fs.open_output_stream(f"{path}/{file}") as sink, pa.ipc.new_file(sink, one.schema) as out:
                out.write_batch(one)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([file])], ["layer", "file"])

        key, parts = None, []
        for batch in batches:
            layer, block = batch.column("layer").to_numpy(), batch.column("block").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (layer[1:] != layer[:-1]) | (block[1:] != block[:-1])]) if batch.num_rows else []
            for at, to in zip(cuts, [*cuts[1:], batch.num_rows]):
                here = (int(layer[at]), int(block[at]))
                if here != key and parts:
                    yield put(key, parts)
                    parts = []
                key = here
                parts.append(batch.slice(at, to - at))
        if parts:
            yield put(key, parts)

    for r in dealt.mapInArrow(write, "layer int, file string").collect():
        files[r["layer"]].append(r["file"])
    return MatrixBlocks(folder, {k: sorted(v) for k, v in files.items()}, width)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def layer_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(layer, rows): rows of one layer at a time, gathered up to about ``limit`` bytes."""

    def cut(parts: list[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        layers = whole.column("layer").to_numpy(zero_copy_only=False)
        for layer in np.unique(layers):
            yield int(layer), whole.filter(pa.array(layers == layer))

    parts, size = [], 0
    for batch in batches:
        if batch.num_rows:
            parts.append(batch)
            size += batch.nbytes
        if size >= limit:
            yield from cut(parts)
            parts, size = [], 0
    if parts:
        yield from cut(parts)
