"""Concatenate and cut: documents one after the other, cut into windows of a fixed number of tokens.

Two passes. The first encodes every document once and stores its ids with the number of ids before it
in its task's part. The parts' totals, one number a part, give each part's global offset. The second
pass cuts: window w holds the ids of global places w * size up to (w + 1) * size, so every window but
the last is full and needs no padding; boundary records say which document lies where.

Null and empty texts give the end id alone. Repeated rows are packed each. An empty table gives none.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetlens.llm.bpe import encoder
from facetlens.llm.common import free_unused, ids_and_text, stage, text_slices


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """part, place (ids before the document in its part), doc_id, n_tokens, ids (little-endian 32-bit)."""

    def run(batches):
        tool, part, place = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in text_slices(batches):
            ids, off = tool.encode(batch.column(1))
            n = np.diff(off) + 1
            data = ids.tobytes()
            rows = [data[4 * a:4 * b] + end for a, b in zip(off[:-1], off[1:])]
            before = place + np.cumsum(n) - n
            place += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(before), batch.column(0), pa.array(n), pa.array(rows, pa.binary())], ["part", "place", "doc_id", "n_tokens", "ids"])

    return ids_and_text(docs).mapInArrow(run, "part int, place long, doc_id long, n_tokens long, ids binary")


def part_offsets(totals: DataFrame) -> DataFrame:
    """part, base: the sum of ``total`` over the parts before it. One row a part, so one task does."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """The boundary records, one a piece, with the piece's ids: doc_id, start, length, doc_tokens,
    sequence_id, offset, ids."""
    kept = stage(encoded(docs, path, end_id), "encoded")
    # One number for each part: what the driver holds grows with the tasks, not with the documents.
    bases = {r["part"]: r["base"] for r in part_offsets(kept.groupBy("part").agg(F.sum("n_tokens").alias("total"))).collect()}

    def cut(batches):
        # Workers of the first pass live on; what they remember of its texts is not needed any more.
        encoder.cache_clear()
        free_unused()
        for batch in batches:
            out = []
            for part, place, doc, n, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                at = bases[part] + place
                data = ids.as_buffer().to_pybytes()
                start = 0
                while start < n:
                    seq, offset = divmod(at + start, size)
                    length = min(size - offset, n - start)
                    out.append((doc, start, length, n, seq, offset, data[4 * start:4 * (start + length)]))
                    start += length
                if len(out) >= 4096:
                    yield _records(out)
                    out = []
            if out:
                yield _records(out)
            free_unused()

    return kept.select("part", "place", "doc_id", "n_tokens", "ids").mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the windows themselves. A window has at most its size in pieces."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    # Binary pieces are joined by way of their hexadecimal digits, which concat_ws can hold.
    return packed.groupBy("sequence_id").agg(F.unhex(F.concat_ws("", F.transform(rows, lambda r: F.hex(r["ids"])))).alias("ids"))


def ids_crc32(ids):
    """The unsigned checksum of ids as they are stored."""
    return F.crc32(ids)


def packed_digest(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    return pieces(docs, path, size, end_id).select("doc_id", "start", "length", ids_crc32(F.col("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
