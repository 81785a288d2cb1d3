import random
from collections import defaultdict

import numpy as np
import pytest

from facetlens.llm import graph, jaccard_join
from llm_helpers import words


def shingles_of(text):
    w = words(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return set(zip(w, w[1:], w[2:], w[3:], w[4:]))


def brute(rows):
    """doc_id to size and smallest reachable doc_id."""
    sets = [(d, shingles_of(t)) for d, t in rows]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, (d, s) in enumerate(sets):
        near = defaultdict(int)
        for x in s:
            for j in where[x]:
                if j < i:
                    near[j] += 1
        for j, n in near.items():
            e, t = sets[j]
            if 100 * n >= 75 * (len(s) + len(t) - n) and root(d) != root(e):
                a, b = sorted((root(d), root(e)))
                up[b] = a
    return [(d, len(s), root(d)) for d, s in sets]


def got(df):
    return sorted(tuple(r) for r in jaccard_join.jaccard_components(df).collect())


def test_components_of_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert got(df) == sorted(brute(rows))


@pytest.mark.parametrize("block, bucket, rows", [(8, 700, 16), (256, 1 << 22, 1 << 16)])
def test_components_of_edited_copies(spark, monkeypatch, block, bucket, rows):
    """Many edited copies around the limit, a frequent passage, short texts; also with small blocks and many buckets."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "BUCKET_SIGNATURES", bucket)
    monkeypatch.setattr(jaccard_join, "GROUP_ROWS", rows)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], [rng.choice(vocabulary) for _ in range(60)]
    for base in range(4):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([12, 40, 130, 260]))]
        for _ in range(45):
            own = list(text)
            for _ in range(rng.randrange(0, 1 + len(own) // 25)):
                k = rng.randrange(len(own))
                own[k:k + rng.randrange(2)] = [rng.choice(vocabulary)]
            rows.append(" ".join(own))
    rows += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))]) for _ in range(60)]
    rows += ["a b c d e", "A b c\td e", "a b c d", "a b c d ", "a", "", " ", "b a", "a b c d e f", "x " * 50, "x " * 80]
    rng.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    assert got(df) == sorted(brute(list(enumerate(rows))))


def test_odd_rows(spark, odd_docs):
    out = jaccard_join.jaccard_components(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}
    assert by[0] == (0, 0) and by[1] == (0, 1) and by[2] == (0, 2) and by[3] == by[4] == (1, 3) and by[None] == (1, None) and by[7] == (5, 7)
    assert jaccard_join.jaccard_components(odd_docs.limit(0)).count() == 0


def test_no_set_has_more_signatures_than_counted():
    rng, bound = np.random.default_rng(5), jaccard_join.Bound(75)
    power = np.zeros(jaccard_join.SLOTS, np.uint8)
    for n in (1, 2, 3, 7, 8, 30, 64, 100, 1000):
        h = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        sig, _ = jaccard_join.signatures(h, np.array([0, len(h)]), power, bound)
        assert len(sig) <= 2 * bound.signatures(n, 1)


@pytest.mark.parametrize("most", [1 << 10, 1 << 28])
def test_id_filter_grows_and_loses_no_id(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "MOST_BITS", most)
    monkeypatch.setattr(graph, "LEAST_BITS", 1 << 10)
    every = spark.range(0, 60_000, 1, 5).toDF("doc_id")
    wanted = every.where("doc_id % 3 = 0").unionByName(every.limit(9)).unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS doc_id"))
    bits = np.frombuffer(graph.id_filter(wanted), np.uint8)
    held = graph.may_hold(bits, np.arange(60_000))
    assert held[::3].all() and len(bits) * 8 == min(most, 1 << 18)
    assert most == 1 << 10 or held.mean() < 0.40
    sure, rest = graph.split_by_ids(every, wanted)
    assert sure.where("doc_id % 3 = 0").count() == 0 and sure.count() + rest.count() == 60_000
    assert graph.id_filter(wanted.limit(0)) == bytes(128)


def test_signatures_meet_for_all_similar_sets():
    rng = np.random.default_rng(2)
    bound, power = jaccard_join.Bound(75), rng.integers(0, 20, jaccard_join.SLOTS).astype(np.uint8)
    for _ in range(400):
        n = int(rng.integers(1, 60))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: n - int(rng.integers(0, 1 + n // 5))], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 5))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)):
            sig, own = jaccard_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), power, bound)
            assert set(sig[own == 0].tolist()) & set(sig[own == 1].tolist())


def test_ties_of_large_groups_wait_and_lose_no_link(spark, monkeypatch):
    """Near copies share many signatures; what one in four of them connects is not compared by the others."""
    rng = random.Random(8)
    text = [f"w{i}" for i in range(150)]
    rows = []
    for _ in range(150):
        own = list(text)
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(10_000)}"
        rows.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    compared, real = [], jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or real(pairs, *rest))
    want = sorted(brute(list(enumerate(rows))))
    assert got(df) == want
    few, compared[:] = sum(compared), []
    monkeypatch.setattr(jaccard_join, "LARGE_GROUP", 1 << 30)
    assert got(df) == want
    assert 2 * few < sum(compared), (few, compared)
    # Ties that connect nothing at first are all compared later.
    monkeypatch.setattr(jaccard_join, "LARGE_GROUP", 2)
    monkeypatch.setattr(jaccard_join, "AT_ONCE", 1 << 30)
    assert got(df) == want
