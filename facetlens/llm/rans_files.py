"""Token ids in files, coded by a static range asymmetric numeral system.

A file is a part of the documents in ascending order of doc_id; it holds segments of whole documents
with about SEGMENT_TOKENS ids. A segment has one frequency table that all its blocks share. Its ids
are cut into blocks of BLOCK ids; a block is LANES interleaved coders over one stream of 32-bit words
and starts from its own states, so any block can be decoded alone. The index is the checkpoint list:
for each block the place of its words, its states and the checksum of its ids.

Null and empty texts are the end id alone. Repeated doc_ids keep one another's company, ordered by the
hash of their text. An empty table gives no segment and no row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetlens.llm.bpe import encoder
from facetlens.llm.common import ids_and_text, stage, text_slices
from facetlens.llm.packing import part_offsets

SEGMENT_TOKENS = 4 << 20
BLOCK, LANES = 1 << 16, 256
STEPS = BLOCK // LANES
#: Frequencies add up to 2**PRECISION; states stay in [2**31, 2**63).
PRECISION, LOW = 20, np.uint64(1 << 31)
MAGIC = 0x314E4152
#: How a missing doc_id is stored.
NO_ID = -(1 << 63)


#: Ids below it are counted and numbered by tables, without a sort or a search for each id.
TABLE_IDS = 1 << 22


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, their shares of 2**PRECISION, none below 1, and each id's place among the distinct ones."""
    if ids.max() < TABLE_IDS:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        rank = np.zeros(len(counts), np.int64)
        rank[symbols] = np.arange(len(symbols))
        counts, symbols, code = counts[symbols], symbols.astype(ids.dtype), rank[ids]
    else:
        symbols, code, counts = np.unique(ids, return_inverse=True, return_counts=True)
    total = 1 << PRECISION
    if len(symbols) > total:
        raise ValueError(f"{len(symbols)} distinct ids do not fit a table of {total}")
    share = np.maximum(1, counts * total // counts.sum())
    spare = total - int(share.sum())
    if spare >= 0:
        share[int(np.argmax(counts))] += spare
    else:
        # Rounding up to 1 went over; the largest shares give it back.
        for i in np.argsort(-share, kind="stable"):
            give = min(-spare, int(share[i]) - 1)
            share[i] -= give
            spare += give
            if spare == 0:
                break
    return symbols, share, code


def encode_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment's bytes; lengths are the documents' ids, ids those of all of them."""
    symbols, share, code = frequencies(ids)
    first = np.cumsum(share) - share
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.concatenate([code, np.full(blocks * BLOCK - n, code[0])]).reshape(blocks, STEPS, LANES)
    f_of, c_of = share.astype(np.uint64), first.astype(np.uint64)
    x = np.full((blocks, LANES), LOW, np.uint64)
    words, owners = [], []
    for t in range(STEPS - 1, -1, -1):
        s = padded[:, t, :]
        f = f_of[s]
        full = x >= (f << np.uint64(63 - PRECISION))
        at = np.nonzero(full)
        words.append(x[at].astype("<u4"))
        owners.append(at[0])
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(PRECISION)) + (x - q * f) + c_of[s]
    word, owner = np.concatenate(words[::-1]), np.concatenate(owners[::-1])
    order = np.argsort(owner, kind="stable")
    per_block = np.bincount(owner, minlength=blocks)
    sums = [zlib.crc32(np.asarray(ids[b * BLOCK:(b + 1) * BLOCK], "<u4").tobytes()) for b in range(blocks)]
    head = np.array([MAGIC, len(doc_ids), n, len(symbols), blocks], "<i8")
    body = [head, np.asarray(doc_ids, "<i8"), np.asarray(lengths, "<i8"), symbols.astype("<u4"), share.astype("<u4"), per_block.astype("<i8"), np.array(sums, "<u4"), x.astype("<u8"), word[order]]
    data = b"".join(part.tobytes() for part in body)
    return data + zlib.crc32(data).to_bytes(4, "little")


class Segment:
    """A segment read back: documents and lengths at once, ids by block."""

    def __init__(self, data: bytes):
        if zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError("a segment's checksum does not hold")
        magic, docs, self.n, kinds, self.blocks = np.frombuffer(data, "<i8", 5)
        if magic != MAGIC:
            raise ValueError("not a segment")
        at = 40

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.lengths = take("<i8", docs), take("<i8", docs)
        self.symbols, self.share = take("<u4", kinds), take("<u4", kinds).astype(np.uint64)
        per_block, self.sums = take("<i8", self.blocks), take("<u4", self.blocks)
        self.states = take("<u8", self.blocks * LANES).reshape(self.blocks, LANES)
        self.begin = np.concatenate([[0], np.cumsum(per_block)])
        self.words = take("<u4", int(self.begin[-1]))

    def decode(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The ids of blocks lo up to hi, all of them side by side."""
        hi = int(self.blocks) if hi is None else hi
        first = np.cumsum(self.share) - self.share
        slot = np.repeat(np.arange(len(self.share)), self.share.astype(np.int64))
        x = self.states[lo:hi].copy()
        out = np.empty((hi - lo, STEPS, LANES), np.int64)
        cursor = self.begin[lo:hi].copy()
        mask = np.uint64((1 << PRECISION) - 1)
        for t in range(STEPS):
            low = x & mask
            s = slot[low.astype(np.int64)]
            out[:, t, :] = s
            x = self.share[s] * (x >> np.uint64(PRECISION)) + low - first[s]
            need = x < LOW
            if need.any():
                rank = np.cumsum(need, axis=1)
                at = (cursor[:, None] + rank - 1)[need]
                x[need] = (x[need] << np.uint64(32)) | self.words[at]
                cursor += rank[:, -1]
        ids = self.symbols[out.reshape(-1)][: max(0, int(self.n) - lo * BLOCK)]
        for b in range(lo, hi):
            own = ids[(b - lo) * BLOCK:(b - lo + 1) * BLOCK]
            if zlib.crc32(own.astype("<u4").tobytes()) != int(self.sums[b]):
                raise ValueError(f"the checksum of block {b} does not hold")
        return ids


def write_files(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """part, segment, n_tokens, data: the files, in the shared folder, read back."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = ids_and_text(docs).withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        tool, part, segment = encoder(path), TaskContext.get().partitionId(), 0
        docs, lengths, ids, held = [], [], [], 0

        def close():
            data = encode_segment(np.concatenate(docs), np.concatenate(lengths), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([held], pa.int64()), pa.array([data], pa.large_binary())], ["part", "segment", "n_tokens", "data"])

        for batch in text_slices(batches):
            got, off = tool.encode(batch.column(1))
            docs.append(pc.fill_null(batch.column(0), NO_ID).to_numpy(zero_copy_only=False))
            lengths.append(np.diff(off) + 1)
            ids.append(np.insert(got, off[1:], end_id))
            held += len(ids[-1])
            if held >= SEGMENT_TOKENS:
                yield close()
                segment, docs, lengths, ids, held = segment + 1, [], [], [], 0
        if held:
            yield close()

    return stage(ordered.drop("tie").mapInArrow(run, "part int, segment int, n_tokens long, data binary"), "rans")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""

    def run(batches):
        for batch in batches:
            for part, segment, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = Segment(data.as_buffer().to_pybytes())
                raw = own.decode().astype("<u4").tobytes()
                stop = np.cumsum(own.lengths)
                start = stop - own.lengths
                sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(start, stop)]
                n = len(sums)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, segment, np.int32)), pa.array(own.doc_ids, mask=own.doc_ids == NO_ID), pa.array(start), pa.array(own.lengths), pa.array(sums, pa.int64())], ["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = files.select("part", "segment", "data").mapInArrow(run, "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    sizes = files.select("part", "segment", "n_tokens")
    base = part_offsets(sizes.groupBy("part").agg(F.sum("n_tokens").alias("total")))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.join(base, "part").select("part", "segment", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("before"))
    return rows.join(places, ["part", "segment"]).select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
