import random

import numpy as np
import pyarrow as pa

from facetlens.llm import decontamination as dc
from facetlens.llm.common import Words
from llm_helpers import words


def test_search_by_brute_force():
    """All (text, item) at or above the threshold, as scored term by term over every passage."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 20)))) for i in range(70)] + [(99, None), (98, " ")]
    index = dc.Index(items)
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))) for _ in range(60)] + [f"x {items[3][1]} y", ""]
    dense = np.zeros((len(index.term), len(index.items)))
    for t in range(len(index.term)):
        own = slice(index.begin[t], index.begin[t + 1])
        dense[t, index.post[own]] = index.weight[own]
    assert np.allclose(dense.sum(axis=0), 1)
    size, step = 2 * index.longest, index.longest
    for threshold in (0.5, 0.8):
        want = {}
        for d, t in enumerate(texts):
            own = words(t)
            at = 0
            while own:
                terms = {index.term[w.encode()] for w in own[at:at + size] if w.encode() in index.term}
                for k, s in enumerate(dense[sorted(terms)].sum(axis=0)):
                    if s >= threshold - 1e-9:
                        want[d, k] = max(want.get((d, k), 0), s)
                if at + size >= len(own):
                    break
                at += step
        got = {(d, k): s for d, k, s in index.search(Words(pa.array(texts)), threshold)}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_question_and_answer():
    assert dc.parts("Who was it? A man") == ("Who was it", " A man")
    assert dc.parts("One two. Three four.") == ("One two.", " Three four.")
    assert dc.parts("a b c d e f") == ("a b c d", "e f")


def test_documents_with_whole_items(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows, own = docs.collect(), [(r["item_id"], words(r["text"])) for r in items.collect()]
    want = {(r["doc_id"], i) for r in rows for i, w in own if f" {' '.join(w)} " in f" {' '.join(words(r['text']))} "}
    found = dc.find_leaks(docs, items).collect()
    assert want and want <= {(r["doc_id"], r["item_id"]) for r in found}
    assert all(r["question_overlap"] >= 0.75 and r["answer_overlap"] >= 0.75 and r["score"] >= 0.6 for r in found)
    bad = {r["doc_id"] for r in found}
    assert {r["doc_id"] for r in dc.without_leaks(docs, items).collect()} == {r["doc_id"] for r in rows} - bad


def test_groups_of_items(spark, sf_dir, monkeypatch):
    """Frequencies, lengths and windows are those of all items, so groups of any size give the same rows."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda: sorted(tuple(r) for r in dc.find_leaks(docs, items, 0.3, 0.2).collect())
    one = rows()
    for size in (4000, 900):
        monkeypatch.setattr(dc, "GROUP_BYTES", size)
        assert len(dc._indexes(items)) > 2 and rows() == one


def test_walk_skips_postings():
    """Block-max WAND scores what a full scan of the postings scores, and looks at fewer items."""
    rng = random.Random(8)
    vocabulary = [f"w{int(rng.paretovariate(0.4)) % 400}" for _ in range(4000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(500)]
    index = dc.Index(items)
    for at in range(0, 500, 25):
        terms = sorted({index.term[w.encode()] for w in items[at][1].split()[:26]})
        scores = np.zeros(len(items))
        for t in terms:
            scores[index.post[index.begin[t]:index.begin[t + 1]]] += index.weight[index.begin[t]:index.begin[t + 1]]
        for threshold in (0.3, 0.6):
            got = index.wand(terms, threshold)
            assert [k for k, _ in got] == np.flatnonzero(scores >= threshold).tolist()
            assert np.allclose([s for _, s in got], scores[scores >= threshold])


def test_odd_rows(spark, odd_docs):
    items = spark.createDataFrame([(1, "no id here at all"), (2, None), (3, ""), (None, "one")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in dc.find_leaks(odd_docs, items).collect()] == [(None, 1)]
    assert dc.without_leaks(odd_docs, items).count() == odd_docs.count() - 1
    assert dc.find_leaks(odd_docs, items.limit(0)).count() == 0 and dc.find_leaks(odd_docs.limit(0), items).count() == 0
    assert dc.without_leaks(odd_docs, items).columns == odd_docs.columns


def test_signs_glued_to_items():
    """Items with signs, or signs and words, glued to both ends; short answers with a changed word."""
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    items = [(n, f"{text(30)}? {text(n)}.") for n in range(1, 12)] + [(20, f"{text(3)}? {text(30)}."), (21, f"{text(2)}? {text(1)}.")]
    texts, want = [], []
    for i, t in items:
        for form in ("{}", "***{}***", "&&&{}%%%x y", "x.{}$$$y", "\u201c{}\u201d\u2014z", "x({})"):
            want.append((len(texts), i))
            texts.append(f"{text(40)} {form.format(t)} {text(40)}")
    found = {(d, i) for d, i, *_ in dc.Index(items).leaks(pa.array(texts), 0.6, 0.75)}
    assert found == set(want)


def test_short_answers_beside_the_question():
    rng = random.Random(6)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    question, answer = text(30), text(6)
    item = [(1, f"{' '.join(question)}? {' '.join(answer)}.")]
    changed, other = answer[:2] + ["edit"] + answer[3:], text(6)
    far = question + text(40) + changed
    texts = [" ".join(text(40) + q + text(40)) for q in (question + changed, question + other, question, answer, far)]
    assert [(d, i) for d, i, *_ in dc.Index(item).leaks(pa.array(texts), 0.6, 0.75)] == [(0, 1)]
