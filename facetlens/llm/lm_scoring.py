"""A language model in a log-frequency Bloom filter: smoothed probabilities from membership probes.

Texts are split into blocks of bounded size. A block sends its distinct bigrams (v, w), with their counts in
training texts, to the bucket of v. The task of a bucket adds them up, which also gives the count c(v) of
the word itself, as every word has one successor. It quantises each bigram's count to a level q = 1 +
floor(2 log2 count), sets the bits of (bigram, 1), ..., (bigram, q) in its own stretch of the filter, and reads
every asked bigram by probing levels 1, 2, ... until one is absent. What it has read goes back to the
blocks, which then score their texts. So the filter grows with the distinct bigrams, no task or driver
holds it whole, and nothing of it is broadcast.

p(w | v) = max(r(v,w) - d, 0) / D(v) + d T(v) / D(v) p(w), with p(w) the base model, r the count that the
filter gives, D(v) the sum of r and T(v) the number over all followers of v in training, d = 0.75. Over the
vocabulary and one unknown word it sums to 1. A false probe adds to that sum: a bigram is probed
log2(vocabulary) + 7 times, so that a context has 1/128 false followers on average, at every size.
Contexts unseen in training give p(w).

A word with more than ``HOT`` tokens is dealt over several buckets by its followers; its few sums (at most
one word per HOT tokens of the corpus) are added up and sent to all blocks.

Null and empty texts are the end token alone; a null doc_id counts as the empty string in the split.
Repeated rows count each. An empty table gives no row; without training text all counts are zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlens.llm.common import Words, mix, stage, text_slices

#: A block's bytes of text: larger blocks repeat fewer words and bigrams on their way.
BLOCK_BYTES = 8 << 20
#: Training tokens that one bucket is meant for, and beyond which a word is dealt over several of them.
BUCKET_TOKENS, HOT = 1 << 20, 1 << 24
#: A block reports words with at least this share of its training tokens as possibly hot.
HOT_SHARE = 1 / 16384
DISCOUNT = 0.75
#: Fixed hash values of the end of a text and of the place before its first word.
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_LOW48 = np.uint64((1 << 48) - 1)


def split_remainder(doc_id, modulus: int = 5):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def _blocks(docs: DataFrame, held_out) -> DataFrame:
    """One row a block: its documents, word codes (compressed), the hashes of its words, and its frequent words."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), held_out.alias("held_out"))

    def run(batches):
        part, serial, squeeze = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1)
        for batch in text_slices(batches, limit=BLOCK_BYTES):
            words = Words(batch.column(1))
            learn = ~batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(words.codes[learn[words.owner()]], minlength=len(words.values))
            hashes, tokens = words.hashes(), int(counts.sum()) + int(learn.sum())
            often = np.flatnonzero(counts >= max(1, HOT_SHARE * tokens)) if tokens >= 1 / HOT_SHARE else np.zeros(0, np.int64)
            # The place before the first word is a context like a word, as often as there are texts.
            frequent = [{"word": int(w), "n": int(n)} for w, n in zip([*hashes[often].view(np.int64), BEGIN.view(np.int64)], [*counts[often], learn.sum()])]
            yield pa.RecordBatch.from_arrays([
                pa.array([part << 32 | serial]), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([(~learn).tolist()], pa.list_(pa.bool_())), pa.array([words.counts.tolist()], pa.list_(pa.int32())),
                pa.array([squeeze.compress(words.codes.astype("<u4").tobytes())], pa.binary()), pa.array([hashes.astype("<u8").tobytes()], pa.binary()),
                pa.array([frequent], pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))), pa.array([tokens]), pa.array([int(learn.sum())]), pa.array([len(hashes)]),
            ], ["block", "doc_ids", "held", "lengths", "codes", "hashes", "frequent", "learned", "learned_docs", "distinct"])
            serial += 1

    return rows.mapInArrow(run, "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, codes binary, hashes binary, frequent array<struct<word:long,n:long>>, learned long, learned_docs long, distinct long")


class Bigrams:
    """The distinct bigrams of a block, ordered by bucket, context and follower; the same at both ends of the way.

    Words have numbers; the next one is the place before a text as a context, and its end as a follower.
    pair: of each token, its bigram's place; v: of each bigram, its context's place in ``contexts``.
    """

    def __init__(self, lengths: np.ndarray, codes: np.ndarray, hashes: np.ndarray, buckets: int, hot: dict[int, int]):
        d = len(hashes)
        self.off = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.here = np.empty(self.off[-1], np.int64)
        is_end = np.zeros(self.off[-1], bool)
        is_end[self.off[1:] - 1] = True
        self.here[~is_end], self.here[is_end] = codes, d
        before = np.empty_like(self.here)
        before[1:] = self.here[:-1]
        before[self.off[:-1]] = d
        kinds, pair = np.unique(before * (d + 1) + self.here, return_inverse=True)
        v, w = kinds // (d + 1), kinds % (d + 1)
        context = mix(np.append(hashes, BEGIN))
        follower = mix(np.append(hashes, END) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        home = context % np.uint64(buckets)
        bucket = home[v]
        for word, splits in hot.items():
            for k in np.flatnonzero(np.append(hashes, BEGIN) == np.uint64(word)):
                own = np.flatnonzero(v == k)
                bucket[own] = (home[k] + follower[w[own]] % np.uint64(splits)) % np.uint64(buckets)
        bucket = bucket.astype(np.int64)
        key = (follower & np.uint64(0xFFFFFFFF)).astype("<u4")
        order = np.lexsort((key[w], context[v], bucket))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.pair, self.bucket, self.key = place[pair], bucket[order], key[w[order]]
        v = v[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (self.bucket[1:] != self.bucket[:-1])
        self.first = np.flatnonzero(new)
        self.contexts, self.context = v[self.first], context[v[self.first]] & _LOW48
        self.size = np.diff(np.append(self.first, len(v)))
        self.own_bucket = self.bucket[self.first]


def _wide(x: np.ndarray) -> bytes:
    """48-bit numbers as 6 bytes."""
    return (x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (x >> np.uint64(32)).astype("<u2").tobytes()


def _small(x: np.ndarray) -> bytes:
    """Numbers as bytes; those above 254 follow as 32-bit values."""
    return np.minimum(x, 255).astype("u1").tobytes() + x[x > 254].astype("<u4").tobytes()


def _read_small(blob: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    x = np.frombuffer(blob, "u1", n, at).astype(np.int64)
    big = np.flatnonzero(x == 255)
    x[big] = np.frombuffer(blob, "<u4", len(big), at + n)
    return x, at + n + 4 * len(big)


def _pack(context: np.ndarray, size: np.ndarray, key: np.ndarray, count: np.ndarray) -> bytes:
    return np.array([len(context), len(key)], "<u4").tobytes() + _wide(context) + _small(size) + key.tobytes() + _small(count)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    m, n = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    context = np.frombuffer(blob, "<u4", m, 8).astype(np.uint64) | np.frombuffer(blob, "<u2", m, 8 + 4 * m).astype(np.uint64) << np.uint64(32)
    size, at = _read_small(blob, m, 8 + 6 * m)
    key = np.frombuffer(blob, "<u4", n, at)
    return context, size, key, _read_small(blob, n, at + 4 * n)[0]


class Stretch:
    """A bucket's part of the filter: ``probes`` bits for each level of each bigram."""

    def __init__(self, kinds: np.ndarray, level: np.ndarray, probes: int):
        self.probes, self.top = probes, int(level.max(initial=0))
        # With k probes, a filter half full holds one entry per k / ln 2 bits.
        self.room = max(64, int(level.sum() * probes * 1.443)) // 8 * 8
        bits = np.zeros(self.room, bool)
        for q in range(1, self.top + 1):
            for at in self._places(kinds[level >= q], q):
                bits[at] = True
        self.bits = np.packbits(bits, bitorder="little")

    def _places(self, key: np.ndarray, level: int):
        g = mix(key + np.uint64(level * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        a, b = g & np.uint64(0xFFFFFFFF), (g >> np.uint64(32)) | np.uint64(1)
        return (((a + np.uint64(i) * b) % np.uint64(self.room)).astype(np.int64) for i in range(self.probes))

    def read(self, key: np.ndarray) -> np.ndarray:
        level, live = np.zeros(len(key), np.int64), np.arange(len(key))
        for q in range(1, self.top + 1):
            g = mix(key[live] + np.uint64(q * 0xD1B54A32D192ED03 & (1 << 64) - 1))
            a, b = g & np.uint64(0xFFFFFFFF), (g >> np.uint64(32)) | np.uint64(1)
            for i in range(self.probes):
                at = ((a + np.uint64(i) * b) % np.uint64(self.room)).astype(np.int64)
                held = (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                if not held.all():
                    live, a, b = live[held], a[held], b[held]
            if not len(live):
                break
            level[live] = q
        return level


def _value(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for."""
    return np.where(level > 1, 2.0 ** ((level - 1) / 2 + 0.25), level)


def _levels(total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 1 + np.floor(2 * np.log2(np.maximum(total, 1))), 0).astype(np.int64)


_READ = "block long, bucket long, read binary, words long, hot array<struct<word:long,c:long,t:long,d:double>>"


def _read_back(blocks: DataFrame, buckets: int, hot: dict[int, int], probes: int) -> DataFrame:
    """block, bucket, read (of each context c, D, T / D, of each bigram its level), words and hot of the bucket in one row of it."""
    split = {int(mix(np.array([w], np.uint64))[0] & _LOW48): w for w in hot}

    def send(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for block, held, lengths, codes, hashes in zip(*(batch.column(i).to_pylist() for i in range(5))):
                b = Bigrams(np.array(lengths, np.int64), np.frombuffer(unpack.decompress(codes), "<u4"), np.frombuffer(hashes, "<u8"), buckets, hot)
                learn = np.repeat(~np.array(held, bool), np.diff(b.off))
                count = np.bincount(b.pair[learn], minlength=len(b.key))
                own, at = np.unique(b.bucket, return_index=True)
                of = np.searchsorted(b.own_bucket, own)
                at, of = np.append(at, len(b.key)), np.append(of, len(b.contexts))
                blobs = [_pack(b.context[of[k]:of[k + 1]], b.size[of[k]:of[k + 1]], b.key[at[k]:at[k + 1]], count[at[k]:at[k + 1]]) for k in range(len(own))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(own), pa.array(blobs, pa.binary())], ["block", "bucket", "blob"])

    def answer(table: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_py()) for x in table.column("blob")]
        size = np.concatenate([p[1] for p in parts])
        contexts, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        of = np.repeat(which, size)
        key = mix(mix(contexts)[of] * np.uint64(3) + np.concatenate([p[2] for p in parts]).astype(np.uint64))
        count = np.concatenate([p[3] for p in parts])
        lengths = [(len(p[0]), len(p[2])) for p in parts]
        del parts
        kinds, first, back = np.unique(key, return_index=True, return_inverse=True)
        total = np.bincount(back, count, len(kinds)).astype(np.int64)
        learned = total > 0
        level = Stretch(kinds[learned], _levels(total[learned]), probes).read(kinds)
        owner = of[first]
        n = len(contexts)
        c, t = np.bincount(owner, total, n).astype(np.int64), np.bincount(owner[learned], minlength=n)
        d = np.bincount(owner[learned], _value(level[learned]), n)
        out, at, to = [], 0, 0
        for m, k in lengths:
            own = which[at:at + m]
            out.append(b"".join((c[own].astype("<i8" if c[own].max(initial=0) >> 31 else "<i4").tobytes(), d[own].astype("<f4").tobytes(), np.divide(t[own], d[own], out=np.zeros(m), where=d[own] > 0).astype("<f4").tobytes(), level[back[to:to + k]].astype("u1").tobytes())))
            at, to = at + m, to + k
        hot_here = [(split[int(x)], i) for i, x in enumerate(contexts) if int(x) in split] if split else []
        sums = [{"word": int(np.uint64(w).view(np.int64)), "c": int(c[i]), "t": int(t[i]), "d": float(d[i])} for w, i in hot_here]
        begin = mix(np.array([BEGIN]))[0] & _LOW48
        words = int((c > 0).sum()) - sum(c[i] > 0 for _, i in hot_here if int(contexts[i]) != int(begin)) - int(((contexts == begin) & (c > 0)).sum())
        rows = table.num_rows
        return pa.table([
            table.column("block"), table.column("bucket"), pa.array(out, pa.binary()), pa.array([words] + [0] * (rows - 1)),
            pa.array([sums] + [[]] * (rows - 1), pa.list_(pa.struct([("word", pa.int64()), ("c", pa.int64()), ("t", pa.int64()), ("d", pa.float64())]))),
        ], ["block", "bucket", "read", "words", "hot"])

    sent = blocks.select("block", "held", "lengths", "codes", "hashes").mapInArrow(send, "block long, bucket long, blob binary")
    return sent.groupBy("bucket").applyInArrow(answer, _READ)


def score_texts(docs: DataFrame, held_out=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every text."""
    spark = docs.sparkSession
    held_out = split_remainder(docs["doc_id"]) == 1 if held_out is None else held_out
    blocks = stage(_blocks(docs, held_out), "lm-blocks")
    distinct, learned, texts = (int(x or 0) for x in blocks.agg(F.sum("distinct"), F.sum("learned"), F.sum("learned_docs")).first())
    # At most one word per HOT training tokens comes to the driver.
    frequent = blocks.select(F.explode("frequent").alias("f")).groupBy("f.word").agg(F.sum("f.n").alias("n")).where(F.col("n") > HOT)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-learned // BUCKET_TOKENS))
    hot = {int(np.int64(r["word"]).view(np.uint64)): min(buckets, -(-r["n"] // HOT)) for r in frequent.collect()}
    read = stage(_read_back(blocks, buckets, hot, distinct.bit_length() + 7), "lm-read")
    sums = {int(np.int64(r["word"]).view(np.uint64)): (r["c"], r["t"], r["d"]) for r in read.select(F.explode("hot").alias("h")).groupBy("h.word").agg(F.sum("h.c").alias("c"), F.sum("h.t").alias("t"), F.sum("h.d").alias("d")).collect()}
    vocabulary = int(read.agg(F.sum("words")).first()[0] or 0) + sum(c > 0 and w != int(BEGIN) for w, (c, _, _) in sums.items()) + (texts > 0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        row = left.slice(0, 1).to_pylist()[0]
        hashes = np.frombuffer(row["hashes"], "<u8")
        b = Bigrams(np.array(row["lengths"], np.int64), np.frombuffer(unpack.decompress(row["codes"]), "<u4"), hashes, buckets, hot)
        right = right.sort_by("bucket")
        c, d, share = (np.zeros(len(hashes) + 1, t) for t in (np.int64, np.float64, np.float64))
        levels, at, m_at = [], 0, 0
        for bucket, blob in zip(right.column("bucket").to_pylist(), right.column("read").to_pylist()):
            m = int(np.searchsorted(b.own_bucket, bucket, "right")) - m_at
            k = int(np.searchsorted(b.bucket, bucket, "right")) - at
            wide = 4 if len(blob) == 12 * m + k else 8
            own = b.contexts[m_at:m_at + m]
            c[own] = np.frombuffer(blob, f"<i{wide}", m)
            d[own] = np.frombuffer(blob, "<f4", m, wide * m)
            share[own] = np.frombuffer(blob, "<f4", m, (wide + 4) * m)
            levels.append(np.frombuffer(blob, "u1", k, (wide + 8) * m))
            at, m_at = at + k, m_at + m
        # Words dealt over several buckets have their sums from all of them.
        known = np.append(hashes, BEGIN)
        for word, (cw, tw, dw) in sums.items():
            k = np.flatnonzero(known == np.uint64(word))
            c[k], d[k], share[k] = cw, dw, tw / dw if dw else 0
        before = np.empty_like(b.here)
        before[1:] = b.here[:-1]
        before[b.off[:-1]] = len(hashes)
        of_word = c.copy()
        of_word[-1] = texts  # the end of a text, as a follower
        seen = of_word[b.here]
        p = (seen + 0.5) / (learned + 0.5 * (vocabulary + 1))
        r = np.where(seen > 0, _value(np.concatenate(levels).astype(np.int64))[b.pair], 0)
        own = d[before]
        with np.errstate(divide="ignore", invalid="ignore"):
            q = np.where(own > 0, np.maximum(r - DISCOUNT, 0) / own + DISCOUNT * share[before] * p, p)
        n = np.diff(b.off)
        return pa.table([
            pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"]), pa.array(n), pa.array(np.add.reduceat((seen > 0).astype(np.int64), b.off[:-1])), pa.array(np.full(len(n), learned)),
            pa.array(np.add.reduceat(np.log10(p), b.off[:-1])), pa.array(np.add.reduceat(np.log10(q), b.off[:-1])),
        ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    left = blocks.select("block", "doc_ids", "held", "lengths", "codes", "hashes").groupBy("block")
    right = read.select("block", "bucket", "read").groupBy("block")
    return left.cogroup(right).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
