import random

import pytest

from facetlens.llm import substring_dedup
from llm_helpers import words


def test_chains_are_the_best_by_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 9)
        pos, spos = sorted(rng.sample(range(70), n)), [rng.randrange(70) for _ in range(n)]

        def value(own):
            total = substring_dedup.K
            for j, i in zip(own, own[1:]):
                if spos[j] >= spos[i] or max(pos[i] - pos[j], spos[i] - spos[j]) > substring_dedup.REACH + substring_dedup.K:
                    return -1
                gap = pos[i] - pos[j] + spos[i] - spos[j] - 2 * substring_dedup.K
                total += min(substring_dedup.K, pos[i] - pos[j], spos[i] - spos[j]) - substring_dedup.GAP_COST * gap
            return total

        chains = substring_dedup.chain(pos, spos)
        assert sorted(i for c in chains for i in c) == list(range(n))
        for c in chains:
            assert all(spos[a] < spos[b] and a < b for a, b in zip(c, c[1:]))
        # Where seeds do not overlap, the first chain is the best of all.
        if pos[-1] - pos[0] <= 54 and max(spos) - min(spos) <= 54 and all(b - a >= substring_dedup.K for a, b in zip(sorted(set(spos)), sorted(set(spos))[1:])) and all(b - a >= substring_dedup.K for a, b in zip(pos, pos[1:])):
            best = max(value([i for i in range(n) if m >> i & 1]) for m in range(1, 1 << n))
            assert abs(value(chains[0]) - best) < 1e-9


def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = text(70)
    fuzzy = [w if rng.random() > 0.06 else "edit" for w in passage]
    short = text(30)
    rows = [
        (10, text(40) + passage + text(100)), (11, passage + text(200)), (12, text(90) + fuzzy), (13, text(300)), (14, text(60) + short + text(60)), (15, text(20) + short + text(90)),
        (16, text(51)), (17, text(10) * 30), (18, passage),
    ]
    rows += [(100 + i, text(rng.randrange(60, 400))) for i in range(40)]
    return rows, passage


@pytest.mark.parametrize("bucket", [500, 64 << 20])
def test_repeated_passages_and_no_others(spark, monkeypatch, bucket):
    monkeypatch.setattr(substring_dedup, "BUCKET_TEXT", bucket)
    rows, passage = corpus()
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id long, text string").repartition(4)
    found = substring_dedup.passages(df).toPandas()
    assert set(found.doc_id) == {11, 12, 18}
    for _, r in found.iterrows():
        assert r.source_doc_id < r.doc_id and r.stretch_end - r.stretch_begin >= 50
    exact = found[found.doc_id == 11].iloc[0]
    assert (exact.begin, exact.end, exact.source_begin, exact.source_end, exact.common_words) == (0, 70, 40, 110, 70)
    left = {r["doc_id"]: r["text"] for r in substring_dedup.without_passages(df, found_table(spark, found)).collect()}
    text = dict(rows)
    assert 18 not in left and left[10] == " ".join(text[10]) and words(left[11]) == text[11][70:]
    assert len(words(left[12])) <= 95 and words(left[12])[:85] == text[12][:85]
    assert all(left[d] == " ".join(t) for d, t in rows if d not in (11, 12, 18))


def found_table(spark, pandas):
    return spark.createDataFrame(pandas)


def test_documents_by_exact_brute_force(spark, sf_dir):
    """Every run of 50 words that an earlier document holds lies in a reported stretch."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r["doc_id"], words(r["text"])) for r in df.collect())
    found = substring_dedup.passages(df).toPandas()
    cover = {}
    for r in found.itertuples():
        cover.setdefault(r.doc_id, set()).update(range(r.stretch_begin, r.stretch_end))
    seen, n = set(), 50
    for d, t in rows:
        own = [tuple(t[i:i + n]) for i in range(len(t) - n + 1)]
        for i, w in enumerate(own):
            if w in seen:
                assert set(range(i, i + n)) <= cover.get(d, set()), (d, i)
        seen.update(own)


def test_odd_rows(spark, odd_docs):
    found = substring_dedup.passages(odd_docs)
    assert found.count() == 0
    kept = substring_dedup.without_passages(odd_docs, found)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert substring_dedup.passages(odd_docs.limit(0)).count() == 0


def spans(spark, rows):
    """The reported stretches of each document."""
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id long, text string").repartition(3)
    out = {}
    for r in substring_dedup.passages(df).collect():
        out.setdefault(r["doc_id"], set()).update(range(r["stretch_begin"], r["stretch_end"]))
    return out


def test_passage_repeated_inside_a_document(spark):
    """Every run of 50 words that an earlier document holds is reported, at each of its places."""
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage = text(50)
    found = spans(spark, [(1, text(20) + passage + text(20)), (2, text(80) + passage + text(150) + passage + text(100) + passage)])
    assert set(found) == {2}
    for at in (80, 280, 430):
        assert set(range(at, at + 50)) <= found[2]
    assert len(found[2]) <= 3 * 52


def test_passage_whose_seeds_other_texts_have_first(spark):
    """Each seed of a passage, and all its 15 words in a row, occur in several earlier texts."""
    rng = random.Random(13)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage = text(120)
    rows = [(at, text(30) + passage[at:at + 15] + text(30)) for at in range(120)]
    rows += [(1000, text(50) + passage + text(50)), (1001, text(70) + passage + text(50))]
    found = spans(spark, rows)
    assert set(found) == {1001} and set(range(70, 190)) <= found[1001] and len(found[1001]) <= 122


def test_chains_are_the_best_within_reach():
    """The first chain is the best of all, whatever lies out of reach before it."""
    rng, far = random.Random(14), substring_dedup.REACH + substring_dedup.K
    K, cost = substring_dedup.K, substring_dedup.GAP_COST
    for _ in range(400):
        dense, sparse = rng.randrange(6), rng.randrange(2, 10)
        pos, spos = ([*range(0, dense * K, K), *sorted(rng.sample(range(90, 270, K), sparse))] for _ in range(2))
        if rng.random() < 0.2:
            rng.shuffle(spos)
        n = len(pos)
        best = [K] * n
        for i in range(n):
            for j in range(i):
                if 0 < spos[i] - spos[j] <= far and pos[i] - pos[j] <= far:
                    best[i] = max(best[i], best[j] + K - cost * (pos[i] - pos[j] + spos[i] - spos[j] - 2 * K))
        first = substring_dedup.chain(pos, spos)[0]
        value = K * len(first) - sum(cost * (pos[i] - pos[j] + spos[i] - spos[j] - 2 * K) for j, i in zip(first, first[1:]))
        assert abs(value - max(best)) < 1e-9


def test_fuzzy_passage_after_a_long_one(spark):
    """A second passage of the same two documents, with words inserted, 150 words after a first one."""
    rng = random.Random(15)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    first, a, b = text(100), text(25), text(25)
    for k in range(6):
        edited = a + text(5) + b
        found = spans(spark, [(1, text(10) + first + text(150) + a + b + text(9)), (2, text(30) + first + text(150) + edited)])
        assert set(range(282, 332)) <= found[2], k


def test_neighbours_of_different_sources(spark):
    """Passages of three sources in a row are no repetition; the pieces of one source are."""
    rng = random.Random(16)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    a, b, c, long = text(30), text(30), text(30), text(90)
    edited = long[:28] + text(9) + long[30:58] + text(9) + long[60:]
    rows = [(1, text(40) + a + text(40)), (2, text(50) + b + text(40)), (3, text(60) + c + text(40)), (4, text(40) + long + text(30))]
    found = spans(spark, rows + [(10, text(40) + a + b + c + text(40)), (11, text(40) + edited + text(40)), (12, text(40) + a + text(2) + long + b + text(40))])
    assert set(found) == {11, 12}
    assert set(range(40, 68)) | set(range(40 + 74, 40 + 104)) <= found[11] and max(found[11]) <= 40 + 106
    assert set(range(72, 162)) <= found[12] and len(found[12]) <= 92


def test_passages_in_very_long_texts(spark):
    """Passages of an earlier very long text, one of which a later long text holds at both ends and in the middle."""
    rng = random.Random(17)
    text = lambda n: [f"w{rng.randrange(40000)}" for _ in range(n)]
    long, passage = text(120_000), text(60)
    later = passage + text(30_000) + passage + text(30_000) + long[70_000:70_080] + text(500) + passage
    found = spans(spark, [(1, long[:90_000] + passage + long[90_000:]), (2, later)])
    want = {*range(60), *range(30_060, 30_120), *range(60_120, 60_200), *range(60_700, 60_760)}
    assert set(found) == {2} and want <= found[2] and len(found[2] - want) <= 16
