"""Each stage on its own input, against brute force; the whole run; odd rows."""
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from facetlens.llm import bpe  # noqa: E402
from llm_helpers import words  # noqa: E402
from test_jaccard import brute  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(docs)
    for k, (_, apply) in enumerate(corpus_pipeline.STAGES):
        apply(spark, out[-1], sf_dir).write.parquet(str(root / str(k)))
        out.append(spark.read.parquet(str(root / str(k))))
    return out


def test_columns_stay(stages):
    for table in stages[1:5]:
        assert table.dtypes == stages[0].dtypes


def test_language_keeps_all_with_letters(stages):
    want = {r["doc_id"] for r in stages[0].collect() if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in stages[1].collect()} == want


def test_one_of_each_group(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted({c for _, _, c in brute(rows)})


def test_no_long_run_is_left_twice(stages):
    before, after = ({r["doc_id"]: r["text"] for r in t.collect()} for t in stages[2:4])
    n, seen = 60, {}
    for d, t in sorted(after.items()):
        own = words(t)
        for i in range(len(own) - n + 1):
            assert seen.setdefault(tuple(own[i:i + n]), d) == d
    # Words only go, and the first document of every passage keeps it.
    for d, t in after.items():
        assert not Counter(words(t)) - Counter(words(before[d])) or t != before[d]
    assert sum(t != before[d] for d, t in after.items()) < len(after) / 2


def test_items_are_gone(stages, spark, sf_dir):
    items = [f" {' '.join(words(r['text']))} " for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = ({r["doc_id"]: f" {' '.join(words(r['text']))} " for r in t.collect()} for t in stages[3:5])
    for d, t in before.items():
        assert (d not in after) == any(i in t for i in items) or not any(i in t for i in items) and d not in after
    assert not any(i in t for t in after.values() for i in items)
    assert len(before) - len(after) < len(before) / 10


def test_packing_holds_every_token(stages):
    pieces, text = stages[5].collect(), {r["doc_id"]: r["text"] for r in stages[4].collect()}
    total = Counter()
    for r in pieces:
        total[r["doc_id"]] += r["length"]
    encode = bpe.load(corpus_pipeline.BYTE_BPE).encode
    assert total == {d: len(encode(t or "", add_special_tokens=False).ids) + 1 for d, t in text.items()}


def test_run_equals_the_stages(spark, sf_dir, stages):
    got = {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    total = {(d, n) for d, n in ((r["doc_id"], r["doc_tokens"]) for r in stages[5].collect())}
    assert {d for d, *_ in got} == {d for d, _ in total}


def test_odd_rows_and_empty_tables(spark, sf_dir, odd_docs):
    """Clashing extra columns, nulls and repeated rows go through every stage."""
    docs = odd_docs.selectExpr("*", "'en' AS lang", "start AS source", "length(text) AS n_chars", "'s' AS spans", "0 AS component", "1 AS score", "2 AS node", "doc_id AS rep")
    names = docs.columns
    for _, apply in corpus_pipeline.STAGES[:-1]:
        docs = apply(spark, docs, sf_dir)
        assert docs.columns == names
    # Texts like the learned language stay (6 is like none), one of each group: "one" (3, 3, 4) once.
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in docs.collect()) == [-1, 3, 5, 7]
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, apply in corpus_pipeline.STAGES[:-1]:
        none = apply(spark, none, sf_dir)
    assert none.count() == 0
