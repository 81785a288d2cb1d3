"""Passages that repeat across documents, found by collinear chaining of shared word k-mers.

Each text gives the minimizers of its k-mers (of 16 k-mers in a row at least one is taken). A seed that
occurs in several documents ties every later one to the first (by doc_id): first within a slice of a
task, then, for one document a slice, within the seed's bucket, so a seed that is everywhere costs the
rows of one document a slice. All places of a seed in the later document are tied, each to the first place
in the first document. A seed is a minimizer, and once more the SHORTEST words from there on, which have a
first document of their own: where a passage's minimizers each occur in other earlier texts, the passage
is still tied to the first that has it, or to texts that each have SHORTEST words of it or more. (Words
at its ends that no such seed reaches may then stay unreported, up to WINDOW at either end.) The matches of two documents are chained: a chain's score is its seeds' words less the gaps
on both sides, and the best chain ending at a match is found with a Fenwick tree of prefix maxima; where that one is out of reach, among the matches within reach. Chains
are aligned word by word between and beyond their seeds. Passages of one source that lie less than SHORTEST
words apart are one repetition, reported if they cover ``least`` words or more; passages of different
sources next to one another do not add up. Repetitions that touch form a stretch.

Null and empty texts, and texts of fewer than ``least`` words, hold no passage. Rows with a null doc_id are
not looked at; repeated rows of one doc_id count once. An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetlens.llm.common import Words, ids_and_text, mix, runs, shingles, stage, text_slices
from facetlens.llm.graph import id_filter, may_hold, split_by_ids

K, WINDOW = 6, 16
#: A word of gap on either side of a chain takes this much from its score; a seed brings K.
GAP_COST = 0.1
#: Gaps of up to this many words are aligned exactly; a chain's ends are extended by as much at most.
REACH = 48
#: A passage by itself has so many words at least, and so much of both its sides is alike.
SHORTEST, IDENTITY = 16, 0.75
#: Bytes of text whose seeds make a bucket, which a task holds at once; the number of buckets grows with the texts.
BUCKET_TEXT = 64 << 20


def _slide(x: np.ndarray, f) -> np.ndarray:
    """f (minimum or maximum) of each WINDOW values in a row."""
    step = 1
    while step < WINDOW:
        x = f(x[:-step], x[step:])
        step *= 2
    return x


def minimizers(words: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and word place of each text's minimizers, at every place, and of the SHORTEST words from each on."""
    h, owner = shingles(words, K, whole_short=False)
    use = words.counts[owner] >= max(least, K + WINDOW)
    h, owner = h[use], owner[use]
    if len(h) < WINDOW:
        return h[:0], owner[:0], owner[:0]
    pos = np.arange(len(h)) - np.searchsorted(owner, owner)
    low = _slide(h, np.minimum)
    low[owner[: len(low)] != owner[WINDOW - 1:]] = 0  # not within one text
    pad = np.zeros(WINDOW - 1, np.uint64)
    taken = h == _slide(np.concatenate([pad, low, pad]), np.maximum)
    h, owner, pos = h[taken], owner[taken], pos[taken]
    at = words.off[:-1][owner] + pos
    long = at + SHORTEST <= words.off[1:][owner]
    each, at = words.hashes(), at[long]
    more = np.full(len(at), SHORTEST, np.uint64)
    for j in range(SHORTEST):
        more = mix(more + each[words.codes[at + j]] * np.uint64(2 * j + 3))
    return np.concatenate([h, more]), np.concatenate([owner, owner[long]]), np.concatenate([pos, pos[long]])


def _tie(h: np.ndarray, doc: np.ndarray, pos: np.ndarray):
    """Rows sorted by seed, document and place; the row of each one's seed that is first."""
    order = np.lexsort((pos, doc, h))
    h, doc, pos = h[order], doc[order], pos[order]
    first = runs(h)
    return h, doc, pos, np.repeat(first, np.diff(np.append(first, len(h))))


def _matches(rows: DataFrame, least: int) -> DataFrame:
    """doc, pos, src, spos: a seed of a document and its earlier occurrence in another one."""
    length = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-length // BUCKET_TEXT))

    def batch_of(bucket, blob, doc, pos, src, spos):
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(blob, pa.binary()), pa.array(doc, pa.int64()), pa.array(pos, pa.int64()), pa.array(src, pa.int64()), pa.array(spos, pa.int64())], ["bucket", "blob", "doc", "pos", "src", "spos"])

    def send(batches):
        for batch in text_slices(batches):
            h, owner, pos = minimizers(Words(batch.column(1)), least)
            doc = batch.column(0).to_numpy(zero_copy_only=False)[owner]
            h, doc, pos, head = _tie(h, doc, pos)
            later = np.flatnonzero(doc != doc[head])
            first = np.flatnonzero(doc == doc[head])
            none = [None] * len(later)
            yield batch_of(none, none, doc[later], pos[later], doc[head[later]], pos[head[later]])
            h, doc, pos = h[first], doc[first], pos[first]
            b = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            full = b[order]
            cuts = runs(full)
            blobs = []
            for x, y in zip(cuts, np.append(cuts[1:], len(order))):
                own = order[x:y]
                ids, which = np.unique(doc[own], return_inverse=True)
                s = h[own] >> np.uint64(16)
                blobs.append(np.array([len(own), len(ids)], "<u4").tobytes() + ids.astype("<i8").tobytes() + (s & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + pos[own].astype("<u4").tobytes() + which.astype("<u4").tobytes() + (s >> np.uint64(32)).astype("<u2").tobytes())
            none = [None] * len(cuts)
            yield batch_of(full[cuts], blobs, none, none, none, none)

    def meet(table: pa.Table) -> pa.Table:
        seed, doc, pos = [], [], []
        for blob in table.column("blob").to_pylist():
            n, k = (int(x) for x in np.frombuffer(blob, "<u4", 2))
            at = 8 + 8 * k
            low, place, which = (np.frombuffer(blob, "<u4", n, at + 4 * n * i) for i in range(3))
            seed.append(low.astype(np.uint64) | np.frombuffer(blob, "<u2", n, at + 12 * n).astype(np.uint64) << np.uint64(32))
            doc.append(np.frombuffer(blob, "<i8", k, 8)[which])
            pos.append(place.astype(np.int64))
        _, doc, pos, head = _tie(np.concatenate(seed), np.concatenate(doc), np.concatenate(pos))
        later = np.flatnonzero(doc != doc[head])
        return pa.table([pa.array(doc[later]), pa.array(pos[later]), pa.array(doc[head[later]]), pa.array(pos[head[later]])], ["doc", "pos", "src", "spos"])

    sent = stage(rows.mapInArrow(send, "bucket long, blob binary, doc long, pos long, src long, spos long"), "seeds")
    near = sent.where("bucket is null").select("doc", "pos", "src", "spos")
    far = sent.where("bucket is not null").select("bucket", "blob").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(meet, "doc long, pos long, src long, spos long")
    return near.unionByName(far)


class Fenwick:
    """Prefix maxima of (score, index) over ranks."""

    def __init__(self, size: int):
        self.best = [(-1e18, -1)] * (size + 1)

    def add(self, rank: int, value: tuple[float, int]) -> None:
        rank += 1
        best, n = self.best, len(self.best)
        while rank < n:
            if value > best[rank]:
                best[rank] = value
            rank += rank & -rank

    def upto(self, rank: int) -> tuple[float, int]:
        """The best with a rank below ``rank``."""
        out, best = (-1e18, -1), self.best
        while rank:
            if best[rank] > out:
                out = best[rank]
            rank &= rank - 1
        return out


def chain(pos: list[int], spos: list[int]) -> list[list[int]]:
    """Chains of matches (given by ascending pos), as lists of their indices."""
    n = len(pos)
    if n == 1:
        return [[0]]
    ranks = {s: r for r, s in enumerate(sorted(set(spos)))}
    tree, score, before = Fenwick(len(ranks)), [0.0] * n, [-1] * n
    added = near = 0
    for i in range(n):
        while pos[added] < pos[i]:  # matches of one place do not follow one another
            tree.add(ranks[spos[added]], (score[added] + GAP_COST * (pos[added] + spos[added]), added))
            added += 1
        far = GAP_COST * (pos[i] + spos[i])
        best, j = tree.upto(ranks[spos[i]])
        # The gap is what lies between the ends of one seed and the next; overlapping seeds add less.
        gain = best - far + 2 * GAP_COST * K
        # A gap beyond REACH is not bridged, however long the chain before it: then the best within it counts.
        if j >= 0 and gain > 0 and max(pos[i] - pos[j], spos[i] - spos[j]) > REACH + K:
            while pos[i] - pos[near] > REACH + K:
                near += 1
            within = [(score[m] + GAP_COST * (pos[m] + spos[m]), m) for m in range(near, added) if 0 < spos[i] - spos[m] <= REACH + K]
            best, j = max(within, default=(-1e18, -1))
            gain = best - far + 2 * GAP_COST * K
        if j >= 0 and gain > 0:
            score[i], before[i] = gain + min(K, pos[i] - pos[j], spos[i] - spos[j]), j
        else:
            score[i] = K
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        own = []
        while i >= 0 and not used[i]:
            used[i] = True
            own.append(i)
            i = before[i]
        if own:
            out.append(own[::-1])
    return out


def _chains(matches: DataFrame) -> DataFrame:
    """doc, src, pos, spos (lists) of each chain; stretches that could not reach SHORTEST are left out."""
    parts = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = matches.select("doc", "src", "pos", "spos").repartition(parts, "doc").sortWithinPartitions("doc", "src", "pos", "spos")

    def run(batches):
        held = None
        for batch in batches:
            table = np.stack([c.to_numpy() for c in batch.columns])
            table = table if held is None else np.concatenate([held, table], axis=1)
            if table.shape[1] == 0:
                continue
            first = runs(table[0], table[1])
            yield link(table[:, :first[-1]], first[:-1])
            held = table[:, first[-1]:]
        if held is not None and held.shape[1]:
            yield link(held, np.zeros(1, np.int64))

    def link(table, first):
        rows = [[], [], [], []]
        stops = np.append(first, table.shape[1])
        for a, b in zip(stops[:-1], stops[1:]):
            one = a + runs(table[2, a:b], table[3, a:b])  # two seeds, or a repeated row, match a place twice
            pos, spos = table[2, one].tolist(), table[3, one].tolist()
            for own in chain(pos, spos):
                for column, x in zip(rows, (table[0, a], table[1, a], [pos[i] for i in own], [spos[i] for i in own])):
                    column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.list_(pa.int32())), pa.array(rows[3], pa.list_(pa.int32()))], ["doc", "src", "pos", "spos"])

    return dealt.mapInArrow(run, "doc long, src long, pos array<int>, spos array<int>")


def _common(x: list[int], y: list[int]) -> int:
    """Words of the longest common subsequence."""
    row = [0] * (len(y) + 1)
    for a in x:
        left = corner = 0
        for j, b in enumerate(y, 1):
            up = row[j]
            left = corner + 1 if a == b else up if up > left else left
            corner, row[j] = up, left
    return row[-1]


def _extend(x: list[int], y: list[int]) -> tuple[int, int, int]:
    """How far the beginnings of x and y go on alike: words of x, of y, and common words. After a
    difference both go on where two words in a row are alike again, at most three words on."""
    i = j = same = 0
    last = (0, 0, 0)
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j, same = i + 1, j + 1, same + 1
            last = (i, j, same)
            continue
        for d, e in ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2), (3, 3)):
            if x[i + d:i + d + 2] == y[j + e:j + e + 2] and len(x) >= i + d + 2 and len(y) >= j + e + 2:
                i, j = i + d, j + e
                break
        else:
            break
    return last


def unbroken(x: list[int], y: list[int], pos: list[int], spos: list[int]) -> list[tuple[int, int]]:
    """Where a chain is cut: at gaps of more than K words of which less than half is alike."""
    cuts = [0]
    for k in range(1, len(pos)):
        gap, sgap = x[pos[k - 1] + K:pos[k]], y[spos[k - 1] + K:spos[k]]
        longer = max(len(gap), len(sgap))
        if longer > K and gap != sgap and 2 * _common(gap, sgap) < longer:
            cuts.append(k)
    return list(zip(cuts, [*cuts[1:], len(pos)]))


def align(x: list[int], y: list[int], pos: list[int], spos: list[int]) -> tuple[int, int, int, int, int]:
    """begin, end in x, begin, end in y, and common words, of a chain of seeds at pos and spos."""
    a, b, same = _extend(x[:pos[0]][::-1][:REACH], y[:spos[0]][::-1][:REACH])
    begin, sbegin = pos[0] - a, spos[0] - b
    i, j = pos[0], spos[0]
    for p, s in zip(pos, spos):
        gap, sgap = x[i:p], y[j:s]
        if gap == sgap:
            same += len(gap)
        elif gap and sgap and max(len(gap), len(sgap)) <= REACH:
            same += _common(gap, sgap)
        # Seeds that overlap the one before on either side add the words that are new on both.
        new = max(0, min(p + K - max(i, p), s + K - max(j, s)))
        same += new
        i, j = max(i, p + K), max(j, s + K)
    a, b, more = _extend(x[i:i + REACH], y[j:j + REACH])
    return begin, i + a, sbegin, j + b, same + more


def passages(docs: DataFrame, least: int = 50) -> DataFrame:
    """doc_id, begin, end (words), source_doc_id, source_begin, source_end, common_words, stretch_begin,
    stretch_end: the repeated passages; the source is the earlier document."""
    rows = ids_and_text(docs).where("doc_id is not null")
    chains = stage(_chains(_matches(rows, least)), "chains")
    wanted = rows.sparkSession.sparkContext.broadcast(id_filter(chains.select(F.explode(F.array("doc", "src")))))

    def load(batches):
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            some = batch.filter(pa.array(may_hold(bits, batch.column(0).to_numpy())))
            for own in text_slices([some]):
                words = Words(own.column(1))
                short = (words.hashes() & np.uint64(0xFFFF)).astype("<u2")[words.codes] if len(words.codes) else np.zeros(0, "<u2")
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([short[a:b].tobytes() for a, b in zip(words.off[:-1], words.off[1:])], pa.binary())], ["id", "codes"])

    # 16 bits of each word: what is compared lies between matching seeds or next to them.
    codes = stage(rows.mapInArrow(load, "id long, codes binary").dropDuplicates(["id"]), "word-codes")

    def cut(frame: DataFrame, key: str, places: str, low: str, out: str) -> DataFrame:
        """The words around a chain, REACH more on both sides, and where they begin."""
        frame = frame.join(codes.withColumnRenamed("id", key), key)
        frame = frame.withColumn(low, F.greatest(F.element_at(places, 1) - REACH, F.lit(0)))
        stop = F.element_at(places, -1) + K + REACH
        return frame.withColumn(out, F.substr("codes", F.col(low) * 2 + 1, (stop - F.col(low)) * 2)).drop("codes")

    both = cut(cut(chains, "src", "spos", "slow", "y"), "doc", "pos", "low", "x")

    def run(batches):
        for batch in batches:
            out = []
            for doc, src, pos, spos, low, slow, x, y in zip(*(batch.column(i).to_pylist() for i in range(6)), batch.column(6), batch.column(7)):
                x, y = (np.frombuffer(v.as_buffer(), "<u2").tolist() for v in (x, y))
                pos, spos = [p - low for p in pos], [s - slow for s in spos]
                for i, j in unbroken(x, y, pos, spos):
                    a, b, c, d, same = align(x, y, pos[i:j], spos[i:j])
                    if same >= SHORTEST and same >= IDENTITY * max(b - a, d - c):
                        out.append((doc, a + low, b + low, src, c + slow, d + slow, same))
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "begin", "end", "source_doc_id", "source_begin", "source_end", "common_words"])

    found = both.select("doc", "src", "pos", "spos", "low", "slow", "x", "y").mapInArrow(run, "doc_id long, begin long, end long, source_doc_id long, source_begin long, source_end long, common_words long")
    # Dealt by doc_id once; both windows use that.
    found = found.repartition("doc_id")
    first, now = Window.unboundedPreceding, Window.currentRow
    order = Window.partitionBy("doc_id", "source_doc_id").orderBy("begin", "end", "source_begin", "source_end")
    run = Window.partitionBy("doc_id", "source_doc_id", "k")
    one = found.withColumn("upto", F.coalesce(F.max("end").over(order.rowsBetween(first, -1)), F.lit(-SHORTEST)))
    one = one.withColumn("k", F.sum((F.col("begin") >= F.col("upto") + SHORTEST).cast("int")).over(order.rowsBetween(first, now)))
    one = one.withColumn("covers", F.sum(F.greatest(F.col("end") - F.greatest("begin", "upto"), F.lit(0))).over(run))
    one = one.withColumn("low", F.min("begin").over(run)).withColumn("high", F.max("end").over(run)).where(F.col("covers") >= least)
    order = Window.partitionBy("doc_id").orderBy("low", "high", "source_doc_id", "begin", "end", "source_begin")
    parted = one.withColumn("new", F.coalesce((F.col("low") > F.max("high").over(order.rowsBetween(first, -1))).cast("int"), F.lit(1)))
    parted = parted.withColumn("k", F.sum("new").over(order.rowsBetween(first, now)))
    stretch = Window.partitionBy("doc_id", "k")
    whole = parted.withColumn("stretch_begin", F.min("low").over(stretch)).withColumn("stretch_end", F.max("high").over(stretch))
    return whole.drop("new", "k", "upto", "covers", "low", "high")


def without_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the stretches of ``found`` (doc_id, stretch_begin, stretch_end): later copies of a
    passage go, the first stays. A document of which nothing is left goes too."""
    spans = stage(found.select("doc_id", F.struct("stretch_begin", "stretch_end").alias("s")).distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("s")).alias("__spans")), "spans")
    names = docs.columns
    whole, some = split_by_ids(docs, spans.select("doc_id"))
    joined = some.join(spans.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"), "left").drop("__id")
    text_at = names.index("text")

    def cut(batches):
        for batch in text_slices(batches, "text"):
            spans = batch.column(batch.num_columns - 1)
            text = batch.column(text_at)
            some = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                words = Words(text.take(pa.array(some)), encode=False)
                new = dict()
                raw = words.raw.tobytes()
                for k, row in enumerate(some):
                    at, stop, parts = int(words.byte_off[k]), int(words.byte_off[k + 1]), []
                    for s in spans[int(row)].as_py():
                        b, e = words.off[k] + s["stretch_begin"], words.off[k] + s["stretch_end"]
                        if b >= words.off[k + 1]:
                            break  # another row of this doc_id, with a shorter text
                        parts.append(raw[at:words.start[b]])
                        at = int(words.end[min(e, words.off[k + 1]) - 1])
                    parts.append(raw[at:stop])
                    new[int(row)] = b"".join(parts).decode()
                whole = text.to_pylist()
                for row, t in new.items():
                    whole[row] = t
                keep = pa.array([i not in new or bool(t.split()) for i, t in enumerate(whole)])
                batch = pa.RecordBatch.from_arrays([pa.array(whole, pa.string()) if i == text_at else c for i, c in enumerate(batch.columns)], batch.schema.names).filter(keep)
            yield batch.select(list(range(batch.num_columns - 1)))

    schema = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in names)
    out = joined.select(*names, "__spans").mapInArrow(cut, schema)
    out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
    return whole.unionByName(out)
