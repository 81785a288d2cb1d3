"""Records of quoted text files, found in parallel: a file is read by many tasks though records span lines.

Inside quotes a line break belongs to the record. Whether a line begins inside quotes follows from the parity of
all quotes before it in its file, so borders are found by a prefix scan: tasks count the quotes of
their byte ranges, the counts' parities are summed up range by range, and then every task knows
where it stands. What a range holds of records that begin or end in another is put together by the
number of the record's first range. Quotes are doubled inside quoted fields, not escaped otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE = ["file", "start"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the byte range), line: in the order of the file within a range."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """(range, its lines) of a batch, in order."""
    file, start = batch.column("file").dictionary_encode(), batch.column("start").to_numpy()
    code = file.indices.to_numpy()
    cuts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (start[1:] != start[:-1])]) if batch.num_rows else []
    for at, to in zip(cuts, [*cuts[1:], batch.num_rows]):
        yield (file.dictionary[int(code[at])].as_py(), int(start[at])), batch.column("line").slice(at, to - at)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, first, record): every record of the files under ``path`` as text, line breaks inside quotes kept.

    ``first`` marks the first record of a file. Blank lines between records are left out. The driver
    holds one parity a byte range that begins inside quotes.
    """
    lines = _lines(spark, path)
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    counts = lines.groupBy(*RANGE).agg((F.sum(quotes) % 2).alias("odd"))
    # One row a byte range.
    order = Window.partitionBy("file").orderBy("start")
    before = F.coalesce(F.sum("odd").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    placed = counts.select(*RANGE, before.alias("inside"), (F.row_number().over(order) == 1).alias("opens"))
    inside = {(r["file"], r["start"]) for r in placed.filter("inside = 1").collect()}
    opening = {(r["file"], r["start"]) for r in placed.filter("opens").select(*RANGE).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, open_lines, head, seen = None, [], False, 0

        def close(ended: bool) -> list[tuple]:
            """The open record: kind 0 whole, 1 the end of one that began before, 2 the beginning of one that goes on, 3 neither end here."""
            if not open_lines:
                return []
            kind = (1 if head else 0) + (0 if ended else 2)
            return [(*here, here in opening and seen == 0 and not head, kind, "\n".join(open_lines))]

        for batch in batches:
            out = []
            for key, own in _runs(batch):
                if key != here:
                    out += close(False) if here else []
                    here, open_lines, head, seen = key, [], key in inside, 0
                odd = pc.count_substring(own, '"').to_numpy(zero_copy_only=False) % 2
                for line, turn in zip(own.to_pylist(), odd):
                    open_lines.append(line)
                    quoted = (len(open_lines) == 1 and head) if len(open_lines) == 1 else state
                    state = bool(quoted) ^ bool(turn)
                    if not state:
                        if head or len(open_lines) > 1 or line.strip("\r") != "":
                            out += close(True)
                            seen += 1
                        open_lines, head = [], False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.string()))], [*RANGE, "first", "kind", "record"])
        out = close(False) if here else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.string()))], [*RANGE, "first", "kind", "record"])

    pieces = lines.mapInArrow(run, "file string, start long, first boolean, kind int, record string")
    whole = pieces.filter("kind = 0").select(*RANGE, "first", "record")
    # At most two pieces a byte range. A record goes on until the next end; where two meet, the end comes first.
    parts = pieces.filter("kind <> 0").withColumn("_begins", (F.col("kind") == 2).cast("int"))
    number = F.sum("_begins").over(Window.partitionBy("file").orderBy("start", "_begins"))
    joined = parts.withColumn("_no", number).groupBy("file", "_no").agg(
        F.min("start").alias("start"), F.bool_or("first").alias("first"), F.array_sort(F.collect_list(F.struct("start", "_begins", "record"))).alias("_p"))
    return whole.unionByName(joined.select(*RANGE, "first", F.array_join("_p.record", "\n").alias("record")))


def read_csv_ranges(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with headers as text columns, one large file read by many tasks; fields that are absent are NULL.

    All files have the columns of the first one's header.
    """
    records = csv_records(spark, path)
    clean = F.regexp_replace("record", "\r$", "")
    header = records.filter("first").orderBy("file").select(clean.alias("h")).first()
    if header is None:
        raise ValueError(f"no header in {path}")
    text = header["h"].removeprefix("﻿")
    names = spark.range(1).select(F.from_csv(F.lit(text), ", ".join(f"c{i} string" for i in range(text.count(",") + 1)), {"escape": '"'}).alias("h")).select("h.*").first()
    columns = [n for n in names if n is not None]
    schema = ", ".join(f"c{i} string" for i in range(len(columns)))
    rows = records.filter("NOT first").select(F.from_csv(clean, schema, {"escape": '"', "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("r"))
    return rows.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(columns)])
