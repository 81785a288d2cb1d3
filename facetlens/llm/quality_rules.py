"""Quality rules: boosted trees over document statistics, scored from flat node arrays.

The trees are trained on a sample of labelled documents (``sample_rows`` at most, chosen by hash) on
the driver, with histograms and logistic loss; shares of signs, repeated lines and repeated words may
only lower the score (monotonic constraints). All trees become five numpy arrays (feature, threshold,
left, right, value), and a batch of documents walks down every tree at once.

Null and empty texts have no word, so they fail the base rule. Repeated labels count each; without any
label of both kinds the model keeps everything that passes the base rule. An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlens.llm.common import Words, binary_array, ids_and_text, runs, text_slices

#: Fixed value: the signs that count as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in SYMBOLS]] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "digit_share", "distinct_share", "line_words"]
#: -1: the score may only fall as the feature grows.
MONOTONE = [0, 0, -1, -1, -1, 0, 0, 0]


def _per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (whole numbers) and FEATURES of every text."""
    words = Words(texts, lower=False)
    raw, off, n = words.raw, words.byte_off, words.counts
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    word_chars = _per_text(chars[words.end] - chars[words.start], words.off)
    symbols = _per_text(_SYMBOL[raw], off)
    owner = words.owner()
    # Windows of three words within a text, by exact codes.
    at = np.flatnonzero(words.off[1:][owner] - np.arange(len(owner)) >= 3) if len(owner) else np.zeros(0, np.int64)
    c = words.codes
    if len(words.values) < 1 << 21:
        key = c[at] << 42 | c[at + 1] << 21 | c[at + 2]
    else:
        pair = np.unique(c[at] << 32 | c[at + 1], return_inverse=True)[1]
        key = pair << 32 | c[at + 2]
    order = np.lexsort((key, owner[at]))
    first = runs(owner[at][order], key[order])
    size = np.diff(np.append(first, len(at)))
    again = at[order][np.repeat(size > 1, size)]
    cover = np.zeros(len(owner) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 3, -1)
    repeated = _per_text((np.cumsum(cover[:-1]) > 0).astype(np.int64), words.off)
    # Lines: between breaks and text borders, those with a word.
    broken = np.flatnonzero(raw == 10)
    begin = np.sort(np.concatenate([off[:-1], broken + 1]), kind="stable")
    stop = np.sort(np.concatenate([off[1:], broken]), kind="stable")
    line_owner = np.repeat(np.arange(len(n)), _per_text((raw == 10).astype(np.int64), off) + 1)
    line_words = np.searchsorted(words.start, stop) - np.searchsorted(words.start, begin)
    lines = binary_array(raw[raw != 10], np.concatenate([[0], np.cumsum(stop - begin)])).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    full = line_words > 0
    order = np.lexsort((lines[full], line_owner[full]))
    first = runs(line_owner[full][order], lines[full][order])
    dup = np.bincount(line_owner[full], minlength=len(n)) - np.bincount(line_owner[full][order][first], minlength=len(n))
    n_lines = np.bincount(line_owner[full], minlength=len(n))
    order = np.lexsort((c, owner))
    distinct = np.bincount(owner[order][runs(owner[order], c[order])], minlength=len(n))
    counts = np.stack([n, word_chars, symbols, dup, repeated], axis=1)
    some, length = np.maximum(n, 1), np.maximum(word_chars, 1)
    features = np.stack([np.log1p(n), word_chars / some, symbols / length, dup / np.maximum(n_lines, 1), repeated / some, _per_text(_DIGIT[raw], off) / length, distinct / some, n / np.maximum(n_lines, 1)], axis=1)
    return counts, features


class Trees:
    """Boosted trees as flat node arrays; a leaf points to itself."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.smooth = rounds, depth, rate, bins, smooth
        self.feature, self.threshold, self.left, self.right, self.value, self.roots, self.start = [], [], [], [], [], [], 0.0

    def _node(self, value: float) -> int:
        k = len(self.value)
        for own, x in ((self.feature, 0), (self.threshold, np.inf), (self.left, k), (self.right, k), (self.value, value)):
            own.append(x)
        return k

    def fit(self, x: np.ndarray, y: np.ndarray, monotone: list[int]) -> Trees:
        if len(y) and 0 < y.mean() < 1:
            self.start = float(np.log(y.mean() / (1 - y.mean())))
            edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
            binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
            total = np.full(len(y), self.start)
            for _ in range(self.rounds):
                p = 1 / (1 + np.exp(-total))
                step = np.zeros(len(y))
                self.roots.append(self._grow(binned, edges, y - p, p * (1 - p), np.arange(len(y)), 0, -np.inf, np.inf, monotone, step))
                total += step
        for name in ("feature", "left", "right", "roots"):
            setattr(self, name, np.array(getattr(self, name), np.int64))
        self.threshold, self.value = np.array(self.threshold), np.array(self.value)
        return self

    def _grow(self, binned, edges, g, h, rows, level, low, high, monotone, step) -> int:
        best = lambda a, b: a / (b + self.smooth)
        ga, ha = g[rows].sum(), h[rows].sum()
        own = float(np.clip(best(ga, ha), low, high))
        node = self._node(own * self.rate)
        top, split = 1e-6, None
        if level < self.depth and len(rows) >= 40:
            for f in range(binned.shape[1]):
                n = len(edges[f])
                if n == 0:
                    continue
                b = binned[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, n + 1))[:-1] for w in (g[rows], h[rows], None))
                vl, vr = np.clip(best(gl, hl), low, high), np.clip(best(ga - gl, ha - hl), low, high)
                score = lambda v, a, c: 2 * a * v - (c + self.smooth) * v * v
                gain = score(vl, gl, hl) + score(vr, ga - gl, ha - hl) - score(own, ga, ha)
                gain[(nl < 20) | (len(rows) - nl < 20)] = -1
                if monotone[f]:
                    gain[(vr - vl) * monotone[f] < 0] = -1
                k = int(gain.argmax())
                if gain[k] > top:
                    top, split = gain[k], (f, k, vl[k], vr[k])
        if split is None:
            step[rows] = own * self.rate
            return node
        f, k, vl, vr = split
        middle = (vl + vr) / 2
        bounds = [(low, high), (low, high)] if not monotone[f] else [(low, middle), (middle, high)] if monotone[f] > 0 else [(middle, high), (low, middle)]
        goes = binned[rows, f] <= k
        self.feature[node], self.threshold[node] = f, edges[f][k]
        self.left[node] = self._grow(binned, edges, g, h, rows[goes], level + 1, *bounds[0], monotone, step)
        self.right[node] = self._grow(binned, edges, g, h, rows[~goes], level + 1, *bounds[1], monotone, step)
        return node

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds, all trees and rows at once."""
        if len(self.roots) == 0 or len(x) == 0:
            return np.full(len(x), self.start)
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.start + self.value[node].sum(axis=1)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS and FEATURES of every document."""

    def run(batches):
        for batch in text_slices(batches):
            counts, features = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in counts.T], *[pa.array(f) for f in features.T]], ["doc_id", *COUNTS, *FEATURES])

    return ids_and_text(docs).mapInArrow(run, ", ".join(["doc_id long", *[f"{c} long" for c in COUNTS], *[f"{f} double" for f in FEATURES]]))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Trees:
    """Trees for ``quality``; at most ``sample_rows`` labelled rows, the first by hash, come to the driver."""
    some = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    # The sample's ids go to the tasks (its size is bounded), so no text is shuffled to find its rows.
    chosen = ids_and_text(docs).join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = document_statistics(chosen).join(F.broadcast(some), "doc_id").select("quality", *FEATURES).toArrow()
    table = np.stack([rows.column(c).to_numpy().astype(np.float64) for c in rows.column_names], axis=1) if rows.num_rows else np.zeros((0, len(FEATURES) + 1))
    table = table[np.lexsort(table.T)]
    return Trees().fit(table[:, 1:], table[:, 0], MONOTONE)


def apply_rules(docs: DataFrame, trees: Trees, least: float = 0.5) -> DataFrame:
    """doc_id, COUNTS, base_failed, quality (the trees' probability) and kept."""

    def run(batches):
        for batch in text_slices(batches):
            counts, features = statistics(batch.column(1))
            n, repeated = counts[:, 0], counts[:, 4]
            failed = (n < 50) | (100 * repeated > 50 * n)
            p = 1 / (1 + np.exp(-trees.score(features)))
            kept = ~failed & ((p >= least) | (len(trees.roots) == 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in counts.T], pa.array(failed), pa.array(p), pa.array(kept)], ["doc_id", *COUNTS, "base_failed", "quality", "kept"])

    return ids_and_text(docs).mapInArrow(run, ", ".join(["doc_id long", *[f"{c} long" for c in COUNTS], "base_failed boolean, quality double, kept boolean"]))
