"""Helpers of this package: staged tables, and vectorised word arrays inside Arrow tasks."""

from __future__ import annotations

import ctypes
import ctypes.util
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Texts are handled in slices of about this many bytes, which bounds a task's memory.
SLICE_BYTES = 2 << 20

#: Spark hands texts to Python workers in batches of about this size, unless the session names its own.
BATCH_BYTES = "8m"

#: Spark reads Parquet in batches of so many rows, unless the session names its own: rows hold whole texts.
BATCH_ROWS = "256"

_LOCAL: dict[str, str] = {}
_TRIM = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without it gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="facetlens-llm-")
    return _LOCAL[sc.applicationId]


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches in which texts are read and go to Python workers: rows of texts are long."""
    for name, size in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", BATCH_ROWS)):
        if name not in spark.conf.getAll:
            spark.conf.set(name, size)


def free_unused() -> None:
    """Gives memory of freed arrays back to the system, as idle Python workers live on beside the others."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage is cut there."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ids_and_text(docs: DataFrame) -> DataFrame:
    """The two columns the text operators read, whatever else ``docs`` holds."""
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def text_slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Record batches cut so that their texts have about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, base = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            free_unused()
            at, base = to, int(ends[to - 1])


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts and the offsets of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def binary_array(data: np.ndarray, off: np.ndarray) -> pa.Array:
    off = np.ascontiguousarray(off, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of many texts, dictionary encoded.

    codes: one entry a word, in text order; off: where each text's words begin; values: the
    distinct words as bytes; start, end: byte places of each word in ``raw``.
    """

    def __init__(self, texts: pa.Array, lower: bool = True, encode: bool = True):
        self.raw, self.byte_off = flat(texts)
        raw = _LOWER[self.raw] if lower else self.raw
        word = ~_SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[self.byte_off] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.off = np.searchsorted(self.start, self.byte_off)
        self.lengths = self.end - self.start
        if encode:
            ends = np.concatenate([[0], np.cumsum(self.lengths)])
            found = binary_array(raw[word], ends).dictionary_encode()
            self.codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            self.values = found.dictionary.to_pylist()

    def __len__(self) -> int:
        return len(self.byte_off) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        return np.fromiter((xxhash.xxh64_intdigest(w) for w in self.values), np.uint64, len(self.values))

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), self.counts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def shingles(words: Words, size: int, whole_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``size`` words and the text of each, in text order.

    With ``whole_short`` a text of fewer words gives its whole sequence as one.
    """
    n, counts = len(words.codes), words.counts
    h = words.hashes()[words.codes] if n else np.zeros(0, np.uint64)
    room = (words.off[1:][words.owner()] - np.arange(n)) if n else np.zeros(0, np.int64)
    acc = np.minimum(room, size).astype(np.uint64)
    for j in range(size):
        part = np.zeros(n, np.uint64)
        part[: max(0, n - j)] = h[j:] if j < n else part[:0]
        # Words past the end of a text do not count; that only matters for short ones.
        inside = room > j
        acc = np.where(inside, mix(acc + part * np.uint64(2 * j + 3)), acc)
    full = room >= size
    if whole_short:
        short = np.flatnonzero((counts > 0) & (counts < size))
        full[words.off[short]] = True
    at = np.flatnonzero(full)
    return acc[at], words.owner()[at] if n else at


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal rows begins in arrays sorted together."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
