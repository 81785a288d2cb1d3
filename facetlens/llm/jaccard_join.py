"""Links between texts whose sets of word shingles are similar, found by PartEnum signatures.

Sets of a size band [2^b, 2^(b+1)) have their feature domain cut into 2^(b+1) partitions. Two sets with
a Jaccard similarity of at least ``percent`` % differ in at most D features, so at most D partitions
differ and all the others are alike: the content of a single partition (a subset of one partition, with
no difference left inside it) is a signature, and D + 1 of a set's non-empty partitions cannot all be
hit. Which D + 1 is settled by one order for all sets, rarest first by a sketch of fixed size, so frequent
passages are signatures only of sets that have little else. A set whose non-empty partitions are too few
also sends single features. A set near the lower border of its band also signs for the band below.

Signatures travel to buckets; sets that share one are candidates. A signature's group ties every member
to one of them (another one for each signature); what the links found so do not connect is then compared
inside the groups, from parity sketches and where components differ: small groups many at a time, larger
ones in blocks, so no task holds a group and no group's pairs are sent. Candidates pass a bound on the difference (the bits in which two parity sketches differ are never
more than the features in which the sets do) and are then compared exactly.

Null, empty and blank texts have an empty set: size 0, linked with nothing, their own component. Rows with
a null doc_id get a size and no component. Equal texts are one set; a doc_id that occurs twice is one
document. An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetlens.llm.common import Words, ids_and_text, mix, runs, shingles, stage, text_slices
from facetlens.llm.graph import components, id_filter, may_hold, split_by_ids

#: Slots of the frequency sketch and bits of a parity sketch; neither grows with the data.
SLOTS, PARITY = 1 << 23, 2048
#: Members of a block; a group of up to so many is compared at once.
BLOCK = 256
#: Of signatures with more members than this, one in so many ties its members at once; the ties of the others
#: are compared only where those leave sets apart.
LARGE_GROUP, AT_ONCE = 64, 4
#: Signatures of a bucket, and rows of small groups, that a task holds at once; their number grows with the data.
BUCKET_SIGNATURES, GROUP_ROWS = 1 << 22, 1 << 16
_CHUNKS = 64


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted by text and value; where each text's begin; a fingerprint of each set."""
    h, owner = shingles(Words(texts), size)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = runs(owner, h)
    h, owner = h[first], owner[first]
    off = np.searchsorted(owner, np.arange(len(texts) + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h), dtype=np.uint64)])
    return h, off, mix((total[off[1:]] - total[off[:-1]]) + np.diff(off).astype(np.uint64)).view(np.int64)


def _slot(h: np.ndarray) -> np.ndarray:
    return (mix(h + np.uint64(0x2545F4914F6CDD1D)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _parity(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of PARITY bits a set: each feature flips one."""
    n = len(off) - 1
    bit = (h >> np.uint64(20) & np.uint64(PARITY - 1)).astype(np.int64)
    own = np.repeat(np.arange(n), np.diff(off)) * PARITY + bit
    return np.packbits((np.bincount(own, minlength=n * PARITY) & 1).astype(bool).reshape(n, PARITY), axis=1)


def _first_pass(docs: DataFrame, size: int) -> DataFrame:
    """kind 0: doc_id, n, fp, sketch of each document; kind 1: a stretch of a task's shingle counts."""

    def run(batches):
        seen = np.zeros(SLOTS, np.uint32)
        for batch in text_slices(batches):
            h, off, fp = shingle_sets(batch.column(1), size)
            np.add.at(seen, _slot(h), 1)
            n = np.diff(off)
            for a in range(0, len(n), 1024):
                b = min(len(n), a + 1024)
                sketch = _parity(h[off[a]:off[b]], off[a:b + 1] - off[a])
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b - a, np.int32)), batch.column(0).slice(a, b - a), pa.array(n[a:b]), pa.array(fp[a:b]), pa.array([x.tobytes() for x in sketch], pa.binary())], ["kind", "doc_id", "n", "fp", "sketch"])
        if seen.any():
            squeeze = zstandard.ZstdCompressor(level=1)
            own = np.minimum(seen, 65535).astype("<u2").reshape(_CHUNKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(_CHUNKS, np.int32)), pa.array(np.arange(_CHUNKS)), pa.array(np.zeros(_CHUNKS, np.int64)), pa.array(np.zeros(_CHUNKS, np.int64)), pa.array([squeeze.compress(x.tobytes()) for x in own], pa.binary())], ["kind", "doc_id", "n", "fp", "sketch"])

    return docs.mapInArrow(run, "kind int, doc_id long, n long, fp long, sketch binary")


def _rarity(first: DataFrame) -> bytes:
    """The power of two of every slot's count; SLOTS bytes, whatever the corpus."""

    def add(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        total = np.zeros(SLOTS // _CHUNKS, np.int64)
        for b in table.column("sketch").to_pylist():
            total += np.frombuffer(unpack.decompress(b), "<u2")
        return pa.table([table.column("doc_id").slice(0, 1), pa.array([np.log2(total + 1).astype(np.uint8).tobytes()], pa.binary())], ["k", "power"])

    rows = first.where("kind = 1").select("doc_id", "sketch").groupBy("doc_id").applyInArrow(add, "k long, power binary").collect()
    return b"".join(bytes(r["power"]) for r in sorted(rows, key=lambda r: r["k"])) or bytes(SLOTS)


class Bound:
    """What a similarity of at least percent / 100 allows."""

    def __init__(self, percent: int):
        self.percent = percent

    def largest(self, n: np.ndarray) -> np.ndarray:
        return n * 100 // self.percent

    def smallest(self, n: np.ndarray) -> np.ndarray:
        return -(-n * self.percent // 100)

    def differ(self, a, b):
        """The features that may be in one of the two sets only: |A| + |B| - 2 |A n B| at most."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def signatures(self, shingles: int, sets: int) -> int:
        """How many signatures so many sets with so many shingles together have, with those for the band below."""
        return 2 * (shingles * (100 - self.percent) // self.percent + sets)


def signatures(h: np.ndarray, off: np.ndarray, power: np.ndarray, bound: Bound) -> tuple[np.ndarray, np.ndarray]:
    """Signature and set of each, for sets laid out one after the other."""
    n = np.diff(off)
    most = bound.differ(n, bound.largest(n))
    band = np.where(n > 0, np.log2(np.maximum(n, 1)).astype(np.int64), 0)
    down = (n > 1) & (bound.smallest(n) < 1 << band)
    owner = np.repeat(np.arange(len(n)), n)
    rare = power[_slot(h)]
    where, scramble = mix(h + np.uint64(0x632BE59BD9B4E019)), mix(h + np.uint64(0x9E6C63D0876A9A47))
    sig, sets = [], []

    def choose(own, value, rank):
        """The first most + 1 values of each set, rarest first."""
        order = np.lexsort((value, rank, own))
        own, value = own[order], value[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        keep = place <= most[own]
        sig.append(value[keep])
        sets.append(own[keep])

    for below in (0, 1):
        use = down[owner] if below else np.ones(len(owner), bool)
        own, level = owner[use], band[owner[use]] - below
        part = where[use] & ((np.uint64(2) << level.astype(np.uint64)) - np.uint64(1))
        order = np.lexsort((part, own))
        own, part, level = own[order], part[order], level[order]
        first = runs(own, part)
        if len(first) == 0:
            continue
        content = np.add.reduceat(scramble[use][order], first)
        rank = np.minimum.reduceat(rare[use][order], first)
        own, part, level = own[first], part[first], level[first].astype(np.uint64)
        choose(own, mix(content + mix(part * np.uint64(64) + level)), rank)
        few = np.bincount(own, minlength=len(n))
        few = (few > 0) & (few <= most)
        if few.any():
            take = use & few[owner]
            choose(owner[take], mix(h[take] + mix((band[owner[take]] - below).astype(np.uint64) + np.uint64(1 << 40))), rare[take])
    return (np.concatenate(sig), np.concatenate(sets)) if sig else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _candidates(docs: DataFrame, size: int, bound: Bound, power: bytes, buckets: int) -> DataFrame:
    """a, b (fingerprints): candidate pairs, ``late`` ones if a large group can do without them at first; where ``sig``
    is not null, a is a member of that group of three or more."""
    shared = docs.sparkSession.sparkContext.broadcast(power)

    def send(batches):
        rarity = np.frombuffer(shared.value, np.uint8)
        for batch in text_slices(batches):
            h, off, fp = shingle_sets(batch.column(1), size)
            # Equal sets of a slice sign once.
            kept = np.sort(np.unique(fp, return_index=True)[1])
            kept = kept[np.diff(off)[kept] > 0]
            n = np.diff(off)[kept]
            take = np.repeat(off[kept] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            sig, own = signatures(h[take], np.concatenate([[0], np.cumsum(n)]), rarity, bound)
            b = (sig % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((sig, b))
            sig, own, b = sig[order] >> np.uint64(16), own[order], b[order]
            first = runs(b)
            blobs = []
            for x, y in zip(first, np.append(first[1:], len(b))):
                s, o = sig[x:y], own[x:y]
                sets, o = np.unique(o, return_inverse=True)
                blobs.append(np.array([len(s), len(sets)], "<u4").tobytes() + fp[kept][sets].astype("<i8").tobytes() + (s & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (s >> np.uint64(32)).astype("<u2").tobytes() + o.astype("<u2" if len(sets) < 65536 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(b[first], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def meet(table: pa.Table) -> pa.Table:
        sig, fp = [], []
        for blob in table.column("blob").to_pylist():
            n, k = np.frombuffer(blob, "<u4", 2)
            sets = np.frombuffer(blob, "<i8", k, 8)
            at = 8 + 8 * int(k)
            low, high = np.frombuffer(blob, "<u4", n, at), np.frombuffer(blob, "<u2", n, at + 4 * int(n))
            own = np.frombuffer(blob, "<u2" if k < 65536 else "<u4", n, at + 6 * int(n))
            sig.append(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32))
            fp.append(sets[own])
        sig, fp = np.concatenate(sig), np.concatenate(fp)
        order = np.lexsort((fp, sig))
        sig, fp = sig[order], fp[order]
        one = runs(sig, fp)
        sig, fp = sig[one], fp[one]
        first = runs(sig)
        count = np.diff(np.append(first, len(sig)))
        big = count > 2
        # Groups with the same members say the same: one of them is enough.
        total = np.add.reduceat(mix(fp.view(np.uint64)), first) if len(first) else np.zeros(0, np.uint64)
        big = np.flatnonzero(big)
        once = np.zeros(len(first), bool)
        once[big[np.unique(total[big] + count[big].astype(np.uint64), return_index=True)[1]]] = True
        two = first[count == 2]
        pairs = [np.stack([fp[two], fp[two + 1]])]
        # The pivot of a group: the least by a hash that differs from signature to signature.
        inside = np.repeat(once, count)
        s, f = sig[inside], fp[inside]
        order = np.lexsort((mix(f.view(np.uint64) ^ mix(s)), s))
        s, f = s[order], f[order]
        members = np.diff(np.append(runs(s), len(s)))
        pivot = f[np.repeat(runs(s), members)]
        rest = f != pivot
        late = (np.repeat(members, members) > LARGE_GROUP) & ((mix(s + np.uint64(1)) >> np.uint64(20)) % np.uint64(AT_ONCE) > 0)
        late = np.concatenate([np.zeros(len(two), bool), late[rest]])
        pairs.append(np.stack([np.minimum(f, pivot)[rest], np.maximum(f, pivot)[rest]]))
        hs, hf = s, f
        pair = np.concatenate(pairs, axis=1)
        order = np.lexsort((late, pair[1], pair[0]))
        pair, late = pair[:, order], late[order]
        one = runs(pair[0], pair[1])
        pair, late = pair[:, one], late[one]
        return pa.table([
            pa.array(np.concatenate([pair[0], hf])), pa.array(np.concatenate([pair[1], hf])),
            pa.array(np.concatenate([np.zeros(pair.shape[1], np.int64), hs.astype(np.int64)]), mask=np.concatenate([np.ones(pair.shape[1], bool), np.zeros(len(hs), bool)])),
            pa.array(np.concatenate([late, np.zeros(len(hs), bool)])),
        ], ["a", "b", "sig", "late"])

    sent = docs.mapInArrow(send, "bucket long, blob binary")
    return sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(meet, "a long, b long, sig long, late boolean")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int, bound: Bound) -> DataFrame:
    """a, b (doc_ids of sets) of the candidate pairs (fingerprints) that are similar enough."""
    spark = docs.sparkSession
    side = lambda c: sets.select(F.col("fp").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "rep", "sketch")])
    close = pairs.join(side("a"), "a").join(side("b"), "b")

    def near(batches):
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            x = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(-1, PARITY // 8)
            y = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(-1, PARITY // 8)
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            ok = (100 * np.minimum(na, nb) >= bound.percent * np.maximum(na, nb)) & (apart <= bound.differ(na, nb))
            yield batch.filter(pa.array(ok)).select([0, 1, 4, 5])

    kept = stage(close.select("a", "b", "n_a", "n_b", "rep_a", "rep_b", "sketch_a", "sketch_b").mapInArrow(near, "a long, b long, rep_a long, rep_b long"), "near")
    wanted = spark.sparkContext.broadcast(id_filter(kept.select(F.explode(F.array("rep_a", "rep_b")))))

    def load(batches):
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array(may_hold(bits, ids)))
            for own in text_slices([some]):
                h, off, fp = shingle_sets(own.column(1), size)
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array([h[a:b].astype("<u8").tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())], ["fp", "items"])

    wide = docs.mapInArrow(load, "fp long, items binary")
    wide = wide.join(kept.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp").dropDuplicates(["fp"])
    wide = stage(wide, "sets")
    both = kept.join(wide.select(F.col("fp").alias("a"), F.col("items").alias("x")), "a").join(wide.select(F.col("fp").alias("b"), F.col("items").alias("y")), "b")

    def compare(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= bound.percent * (len(x) + len(y) - shared))
            yield batch.filter(pa.array(ok, pa.bool_())).select([0, 1])

    links = both.select(F.col("rep_a").alias("la"), F.col("rep_b").alias("lb"), "x", "y").mapInArrow(compare, "la long, lb long")
    return stage(links.select(F.col("la").alias("a"), F.col("lb").alias("b")), "links")


def _apart(pairs: DataFrame, sets: DataFrame, reached: DataFrame) -> DataFrame:
    """The pairs of fingerprints that the links do not connect yet."""
    of = stage(sets.join(reached, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("c")), "reached")
    side = lambda x: of.select(F.col("fp").alias(x), F.col("c").alias(f"c_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where("c_a <> c_b").select("a", "b")


def _open_pairs(members: DataFrame, sets: DataFrame, reached: DataFrame, bound: Bound) -> DataFrame:
    """Pairs of fingerprints inside groups (sig, a) that the links do not connect yet, in blocks."""
    named = members.join(sets.select(F.col("fp").alias("a"), "rep"), "a").join(reached, F.col("rep") == F.col("node"), "left")
    named = stage(named.select("sig", "a", F.coalesce("component", "rep").alias("c")), "groups")
    still = named.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("a").alias("any"), F.count("*").alias("size")).where("lo <> hi")
    rows = stage(named.join(still.select("sig", "any", "size"), "sig"), "open-groups")
    sketched = sets.select(F.col("fp").alias("a"), "n", "sketch")

    def unlike(left, right, a, c, n, bits):
        """Pairs of rows in different components that the bounds allow."""
        out = []
        for k in left:
            other = right[c[right] != c[k]]
            other = other[100 * np.minimum(n[k], n[other]) >= bound.percent * np.maximum(n[k], n[other])]
            apart = np.bitwise_count(bits[k] ^ bits[other]).sum(axis=1, dtype=np.int64)
            other = other[apart <= bound.differ(n[k], n[other])]
            out.extend((int(min(a[k], x)), int(max(a[k], x))) for x in a[other] if x != a[k])
        out = sorted(set(out))
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    def arrays(table: pa.Table, *names: str):
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, PARITY // 8).view(np.uint64)
        return *(table.column(x).to_numpy() for x in names), bits

    # Small groups, many at a time.
    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // GROUP_ROWS))

    def within(table: pa.Table) -> pa.Table:
        sig, a, c, n, bits = arrays(table.sort_by("sig"), "sig", "a", "c", "n")
        stops = np.append(runs(sig), len(sig))
        return pa.concat_tables([unlike(np.arange(x, y), np.arange(x, y), a, c, n, bits) for x, y in zip(stops[:-1], stops[1:])])

    small = rows.where(F.col("size") <= BLOCK).join(sketched, "a").withColumn("k", F.pmod(F.xxhash64("sig"), F.lit(parts)))
    small = small.select("k", "sig", "a", "c", "n", "sketch").groupBy("k").applyInArrow(within, "a long, b long")

    # Large groups that share members are one cluster: their pairs are compared once, in blocks.
    large = rows.where(F.col("size") > BLOCK)
    cluster = components(large.select("a", F.col("any").alias("b")), "clusters")
    inside = stage(large.select("a", "c").distinct().join(cluster, F.col("a") == F.col("node")).select("component", "a", "c"), "cluster-members")
    total = inside.groupBy("component").agg(F.count("*").alias("size"))
    blocked = inside.join(total, "component").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    full = blocked.join(sketched, "a")
    # A member meets every block, its own included: block pair (i, j) with i <= j.
    spread = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own"), "a", "c", "n", "sketch")

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own, a, c, n, bits = arrays(table, "own", "a", "c", "n")
        return unlike(np.flatnonzero(own == i), np.flatnonzero(own == j), a, c, n, bits)

    return small.unionByName(spread.groupBy("component", "i", "j").applyInArrow(compare, "a long, b long"))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark, bound = docs.sparkSession, Bound(percent)
    rows = ids_and_text(docs)
    first = stage(_first_pass(rows, words), "shingle-sets")
    own = first.where("kind = 0").select("doc_id", "n", "fp", "sketch")
    sets = stage(own.where("n > 0 and doc_id is not null").groupBy("fp", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "distinct-sets")
    named = rows.where("doc_id is not null")
    total = own.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shingles"), F.count("*").alias("sets")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bound.signatures(total["shingles"], total["sets"]) // BUCKET_SIGNATURES))
    found = stage(_candidates(named, words, bound, _rarity(first), buckets), "candidates")
    ties = lambda late: found.where(F.col("sig").isNull() & (F.col("late") == late)).select("a", "b").distinct()
    links = _verified(ties(False), sets, named, words, bound)
    groups = found.where("sig is not null").select("sig", "a")
    if not groups.isEmpty():
        reached = components(links)
        if not (late := ties(True)).isEmpty():
            apart = stage(_apart(late, sets, reached), "late-ties")
            if not apart.isEmpty():
                links = links.unionByName(_verified(apart, sets, named, words, bound))
                reached = components(links)
        more = stage(_open_pairs(groups, sets, reached, bound).distinct(), "open-pairs")
        if not more.isEmpty():
            links = links.unionByName(_verified(more, sets, named, words, bound))
    # A doc_id with several texts ties their sets together.
    twice = own.where("n > 0 and doc_id is not null").join(sets.select("fp", "rep"), "fp").where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    group = components(links.unionByName(twice))
    out = own.select("doc_id", F.col("n").alias("n_shingles")).join(group, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group; of a doc_id that occurs twice, one row."""
    group = stage(jaccard_components(docs, words, percent), "groups")
    gone = group.where("component_id <> doc_id").select("doc_id").distinct()
    twice = group.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    sure, rest = split_by_ids(docs, stage(gone.unionByName(twice), "gone"))
    rest = rest.join(gone.select(F.col("doc_id").alias("__gone")), F.col("doc_id") == F.col("__gone"), "left_anti")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    return sure.unionByName(rest.withColumn("__row", F.row_number().over(first)).where("__row = 1").drop("__row"))
