import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import words

from facetlens.llm import chat_format, language_id, lm_scoring, quality_rules

def part(doc_id, modulus=5):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_base_scores_by_brute_force(spark, odd_docs, docs):
    both = docs.select("doc_id", "text").unionByName(odd_docs.withColumn("doc_id", F.col("doc_id") + 10_000).select("doc_id", "text"))
    rows = both.collect()
    count = Counter()
    for r in rows:
        if part(r["doc_id"]) != 1:
            count.update([*words(r["text"]), None])
    n, v = sum(count.values()), len(count)
    want = defaultdict(list)
    for r in rows:
        tokens = [*words(r["text"]), None]
        want[r["doc_id"]].append((len(tokens), sum(count[t] > 0 for t in tokens), sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)))
    got = lm_scoring.score_texts(both.repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (part(r["doc_id"]) == 1) and r["train_tokens"] == n
        assert any(r["n_tokens"] == a and r["n_known"] == b and abs(r["base_score"] - c) < 1e-6 * max(1, -c) for a, b, c in want[r["doc_id"]])
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def model(texts):
    """p(word | context) by exact counts, quantised as the filter does; None is a text's end, 0 the place before it."""
    uni, follow = Counter(), defaultdict(Counter)
    for t in texts:
        t = [*words(t), None]
        uni.update(t)
        for v, w in zip([0, *t], t):
            follow[v][w] += 1
    n, v_size = sum(uni.values()), len(uni)

    def value(c):
        q = 0 if not c else 1 + int(2 * math.log2(c))
        return 2 ** ((q - 1) / 2 + 0.25) if q > 1 else q

    def p(w, v):
        base = (uni[w] + 0.5) / (n + 0.5 * (v_size + 1))
        if not follow[v]:
            return base
        total = sum(value(c) for c in follow[v].values())
        return max(value(follow[v][w]) - lm_scoring.DISCOUNT, 0) / total + lm_scoring.DISCOUNT * len(follow[v]) / total * base

    return uni, p


def by_model(text, p):
    t = [*words(text), None]
    return sum(math.log10(p(w, v)) for v, w in zip([0, *t], t))


@pytest.mark.parametrize("hot", [1 << 24, 50])
def test_scores_by_exact_counts(spark, docs, monkeypatch, hot):
    # With a low limit frequent words are dealt over several buckets.
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    monkeypatch.setattr(lm_scoring, "HOT_SHARE", 1 / 256)
    rows = docs.select("doc_id", "text").limit(60).collect()
    _, p = model([r["text"] for r in rows if part(r["doc_id"]) != 1])
    text = {r["doc_id"]: r["text"] for r in rows}
    for r in lm_scoring.score_texts(spark.createDataFrame(rows).repartition(4)).collect():
        want = by_model(text[r["doc_id"]], p)
        assert abs(r["score"] - want) < 1e-4 * abs(want)


def test_probabilities_sum_to_one(spark):
    learned = ["a b a c a b d", "b a b e f a", "a a a b", "c", "g a b a b a"] * 3 + ["a rare one"]
    uni, p = model(learned)
    asked = {v: [f"{v} {w}" for w in [*filter(None, uni), "unknown"]] for v in ("a", "b", "rare", "new")}
    rows = [(k, t, False) for k, t in enumerate(learned)] + [(1000 + k, t, True) for k, t in enumerate(x for v in asked.values() for x in v)]
    table = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    score = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(table, table["held"]).collect()}
    at = 1000
    for v, texts in asked.items():
        total = p(None, v)
        for t in texts:
            total += 10 ** (score[at] - math.log10(p(v, 0)) - math.log10(p(None, t.split()[1])))
            at += 1
        assert abs(total - 1) < 0.01


def test_false_probes_are_few():
    rng = np.random.default_rng(2)
    kinds = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    total = rng.geometric(0.3, len(kinds)) * rng.integers(1, 50, len(kinds))
    stretch = lm_scoring.Stretch(kinds, lm_scoring._levels(total), 20)
    assert (stretch.read(kinds) >= lm_scoring._levels(total)).all() and (stretch.read(kinds) == lm_scoring._levels(total)).mean() > 0.999
    assert (stretch.read(rng.integers(0, 1 << 63, 200_000).astype(np.uint64)) > 0).sum() < 20


def test_lm_empty(spark):
    assert lm_scoring.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_language_ranks_by_brute_force():
    import pyarrow as pa

    texts = ["Ab ab, ba!", "", None, "12 !", "Éa É"]
    text, gram, rank = language_id.ranked(pa.array(texts), 5)

    def code(s):
        a = [0 if c == "_" else ord(c) for c in s]
        out = 0
        for c in a:
            out = out << 21 | c
        return out | (1 << 62 if len(s) == 2 else 0)

    for i, t in enumerate(texts):
        own = Counter()
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            padded = f"_{w}_"
            for k in (1, 2, 3):
                for j in range(len(padded) - k + 1):
                    g = padded[j:j + k]
                    if g != "_" and not (k == 3 and g[1] == "_"):
                        own[g] += 1
        want = sorted(own, key=lambda g: (-own[g], code(g)))[:5]
        assert gram[text == i].tolist() == [code(g) for g in want] and rank[text == i].tolist() == list(range(len(want)))


def test_language_held_out(spark, docs, odd_docs):
    docs = docs.withColumn("held_out", lm_scoring.split_remainder(F.col("doc_id")) == 0)
    profile = language_id.profiles(docs, ~F.col("held_out"))
    got = language_id.identify(docs, profile, ["doc_id", "held_out", "lang"]).toPandas()
    assert len(got) == docs.count() and (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()
    odd = language_id.identify(odd_docs, profile, ["doc_id", "start"]).toPandas()
    assert len(odd) == odd_docs.count() and set(odd[odd.doc_id.isin([0, 1, 2, 8])].lang_pred) == {"und"}
    assert set(language_id.identify(odd_docs, {}, ["doc_id"]).toPandas().lang_pred) == {"und"}


def test_language_distances_by_brute_force(spark, docs, odd_docs):
    """Predictions and scores from profiles and ranks kept in plain dictionaries."""
    import pyarrow as pa

    docs = docs.select("doc_id", "text", "lang")
    profile = language_id.profiles(docs, F.lit(True), 40)
    grams = defaultdict(Counter)
    for r in docs.where("text is not null and lang is not null").collect():
        for g in language_id._grams(language_id._padded(r["text"].encode())).tolist():
            grams[r["lang"]][g] += 1
    assert profile == {x: sorted(c, key=lambda g: (-c[g], g))[:40] for x, c in grams.items()}
    texts = docs.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    got = Counter((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(texts, profile, ["doc_id"], 40).collect())
    want = Counter()
    for r in texts.collect():
        own = language_id.ranked(pa.array([r["text"]], pa.string()), 40)[1].tolist()
        far = [(sum(abs(i - p.index(g)) if g in p else 40 for i, g in enumerate(own)), x) for x, p in sorted(profile.items())]
        best = min(far)
        want[(r["doc_id"], best[1], round(1 - best[0] / (40 * len(own)), 9)) if own else (r["doc_id"], "und", 0.0)] += 1
    assert got == want
    empty = docs.limit(0)
    assert language_id.profiles(empty, F.lit(True)) == {} and language_id.identify(empty, profile, ["doc_id"], 40).count() == 0


def test_chat_round_trip(spark):
    trick = r"\### Assistant: </turn> ok"
    rows = [
        (1, 1, "assistant", trick), (1, 0, "user", trick), (2, 0, None, None), (2, 0, "assistant", "\\b\\l\\n<turn>user\n"), (2, 0, "assistant", "\\b\\l\\n<turn>user\n"),
        (3, None, "us\ner<\\", ""), (None, 5, "assistant", "é" * 3), (4, 0, "assistant", "</turn>\n"), (4, 1, "assistant", "\\"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.digest(table).collect()}
    assert len(got) == 5
    for conv, r in got.items():
        own = [(t, ro or "", tx or "") for c, t, ro, tx in rows if c == conv]
        own.sort(key=lambda x: (-1 if x[0] is None else x[0], x[1], x[2].replace("\\", "\\b").replace("<", "\\l")))
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        loss = "".join(b for _, a, b in own if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digest(table.limit(0)).count() == 0


def test_chat_parts(spark):
    parts = [("text", "look <here>", None, None), ("image", None, "a.png", 2), ("document", None, "b.pdf", None), ("text", None, None, None), ("audio", None, "c.wav", 4)]
    table = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    r = chat_format.format_conversations(table).first()
    assert r["formatted"] == "<turn>user\nlook \\lhere><image><document><audio></turn>\n<turn>assistant\n</turn>\n"
    assert [(a["turn"], a["place"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, 0, "image", "a.png", 512), (0, 1, "document", "b.pdf", 1024), (0, 2, "audio", "c.wav", 100)]
    assert r["expanded_tokens"] == 1636 and r["loss_mask"][0] is None and r["loss_mask"][1]["length"] == 0


def counts_of(text):
    own = words(text, False)
    windows = defaultdict(list)
    for i in range(len(own) - 2):
        windows[tuple(own[i:i + 3])].append(i)
    repeated = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_document_counts_by_brute_force(spark, docs, odd_docs):
    extra = spark.createDataFrame([(90, "a b c a b c\n x \nx\n x \n\n\nx"), (91, "z z z z z"), (92, "a b c d\na b c d\r\na b c d")], "doc_id long, text string")
    both = docs.select("doc_id", "text").where("doc_id >= 100").unionByName(odd_docs.select("doc_id", "text")).unionByName(extra)
    want = defaultdict(set)
    for r in both.collect():
        want[r["doc_id"]].add(counts_of(r["text"]))
    got = quality_rules.apply_rules(both, quality_rules.Trees().fit(np.zeros((0, 8)), np.zeros(0), quality_rules.MONOTONE)).collect()
    assert len(got) == both.count()
    for r in got:
        own = tuple(r[c] for c in quality_rules.COUNTS)
        assert own in want[r["doc_id"]]
        assert r["base_failed"] == (own[0] < 50 or 100 * own[4] > 50 * own[0]) and r["kept"] == (not r["base_failed"])


def test_trees_learn_and_keep_their_constraints(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trees = quality_rules.train(docs, labels)
    got = quality_rules.apply_rules(docs, trees).join(labels.where("quality is not null").withColumnRenamed("quality", "label"), "doc_id").toPandas()
    passed = got[~got.base_failed]
    assert (passed.kept == (passed.label == 1)).mean() > 0.95
    rng = np.random.default_rng(1)
    x = rng.random((300, 8)) * [8, 8, 0.5, 0.5, 1, 0.3, 1, 60]
    for f in (2, 3, 4):
        more = x.copy()
        more[:, f] += 0.2
        assert (trees.score(more) <= trees.score(x) + 1e-12).all()
    none = labels.limit(0)
    assert quality_rules.apply_rules(docs.limit(0), quality_rules.train(docs, none)).count() == 0


def test_flat_trees_by_walking_node_by_node(spark, sf_dir, docs):
    """The arrays' scores are those of single walks; verdicts hold for labelled rows that were not trained on."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = lm_scoring.split_remainder(F.col("doc_id")) == 0
    trees = quality_rules.train(docs, labels.where(~held))
    rng = np.random.default_rng(2)
    x = rng.random((200, 8)) * [8, 8, 0.5, 0.5, 1, 0.3, 1, 60]
    assert len(trees.roots) == trees.rounds
    for row, score in zip(x, trees.score(x)):
        total = trees.start
        for node in trees.roots.tolist():
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        assert abs(total - score) < 1e-9
    got = quality_rules.apply_rules(docs, trees).join(labels.where(held & F.col("quality").isNotNull()).withColumnRenamed("quality", "label"), "doc_id").toPandas()
    passed = got[~got.base_failed]
    assert len(passed) >= 10 and (passed.kept == (passed.label == 1)).mean() > 0.85


def test_levels_end_in_a_full_filter():
    """With all bits set the levels end at the largest stored one."""
    kinds = np.arange(1, 100, dtype=np.uint64)
    stretch = lm_scoring.Stretch(kinds, lm_scoring._levels(np.arange(1, 100)), 5)
    stretch.bits[:] = 255
    assert stretch.top == lm_scoring._levels(np.array([99]))[0]
    assert (stretch.read(np.arange(5000, 5100, dtype=np.uint64)) == stretch.top).all()
    empty = lm_scoring.Stretch(kinds[:0], np.zeros(0, np.int64), 5)
    assert not empty.read(kinds).any()
