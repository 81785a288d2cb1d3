"""Language identification by rank-order profiles.

A language's profile ranks the n-grams (1 to 3 letters, words padded with a blank) of its training
texts by frequency and keeps the first ``profile_size``. A document's own ranking is compared with each
profile: an n-gram adds the difference of its two ranks, or ``profile_size`` when the profile lacks it
(the out-of-place distance). The nearest profile wins; equal distances go to the first name.

Texts that are null or have no letter get ``und`` and score 0, as does everything when nothing was
learned. Ranks break ties by the n-gram itself, so results do not depend on how rows are dealt.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetlens.llm.common import runs, small_batches, text_slices

_BITS = 21


@lru_cache(maxsize=None)
def letters() -> np.ndarray:
    """The lower-case letter of each code point, or 0 (blank) where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _padded(text: bytes) -> np.ndarray:
    """Letters of UTF-8 text as code points with single blanks between, before and after words."""
    own = letters()[np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32)]
    own = np.concatenate([[0], own, [0]]).astype(np.int64)
    keep = np.ones(len(own), bool)
    keep[1:] = (own[1:] != 0) | (own[:-1] != 0)
    return own[keep]


def _grams(own: np.ndarray) -> np.ndarray:
    """All n-grams of 1 to 3 letters as 63-bit numbers; a blank is 0 and stands at an edge only."""
    a, b, c = own, own[1:], own[2:]
    one = a[a > 0]
    two = (a[:-1] << _BITS | b)[(a[:-1] | b) > 0]
    mid = b[:-1] > 0
    three = (a[:-2] << 2 * _BITS | b[:-1] << _BITS | c)[mid]
    # The length of an n-gram is told by its blanks: two letters with a blank are marked as such.
    return np.concatenate([one, two | 1 << 62, three])


def ranked(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' ``size`` most frequent n-grams: text, n-gram, rank from 0; sorted by text and rank."""
    out = [[], [], []]
    for at, text in enumerate(texts):
        own = _padded(text.as_buffer().to_pybytes()) if text.is_valid else np.zeros(0, np.int64)
        if not own.any():
            continue
        gram, count = np.unique(_grams(own), return_counts=True)
        best = np.argsort(-count, kind="stable")[:size]
        out[0].append(np.full(len(best), at))
        out[1].append(gram[best])
        out[2].append(np.arange(len(best)))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def profiles(docs: DataFrame, learn, profile_size: int = 300) -> dict[str, list[int]]:
    """Language to its n-grams by rank. Counts cover all rows of ``learn`` with text and lang; what
    comes back is languages times profile_size numbers."""
    small_batches(docs.sparkSession)
    rows = docs.where(learn & docs["lang"].isNotNull() & docs["text"].isNotNull()).select(docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))

    def count(batches):
        # All n-grams of a slice are held as 64-bit numbers a few times over, so slices are small here.
        for batch in text_slices(batches, "text", 1 << 20):
            names = batch.column(1).dictionary_encode()
            codes = names.indices.to_numpy()
            for k, lang in enumerate(names.dictionary.to_pylist()):
                texts = [t.as_buffer().to_pybytes() for t in batch.column(0).filter(pa.array(codes == k))]
                gram, n = np.unique(_grams(_padded(b"\n".join(texts))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile_size)
    out: dict[str, list[int]] = {}
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def identify(docs: DataFrame, profile: dict[str, list[int]], keep: list[str], profile_size: int = 300, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns with lang_pred and score (called by ``names``): 1 minus the distance as a share of the largest possible."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs["text"].cast("string").alias("__text"), *keep)
    languages = sorted(profile)
    grams = np.unique(np.array([g for own in profile.values() for g in own], np.int64))
    rank = np.full((len(grams) + 1, len(languages)), profile_size, np.int64)  # the last row: in no profile
    for k, name in enumerate(languages):
        rank[np.searchsorted(grams, profile[name]), k] = np.arange(len(profile[name]))

    def run(batches):
        for batch in text_slices(batches, "__text"):
            text, gram, own = ranked(batch.column(0), profile_size)
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            if len(text) and languages:
                at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
                row = np.where(grams[at] == gram, at, len(grams))
                place = rank[row]
                out = np.where(place < profile_size, np.abs(place - own[:, None]), profile_size)
                first = runs(text)
                total = np.add.reduceat(out, first)
                pick = total.argmin(axis=1)
                best[text[first]] = pick
                score[text[first]] = 1 - total[np.arange(len(pick)), pick] / (profile_size * np.diff(np.append(first, len(text))))
            pred = pa.array([languages[k] if k >= 0 else "und" for k in best])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pred, pa.array(score)], [*keep, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{fields}, `{names[0]}` string, `{names[1]}` double")
