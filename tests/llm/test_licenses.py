import random
import re

import pyarrow as pa
import pytest

from facetlens.llm import license_scan as L

SEP = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text):
    return re.findall(SEP, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def pattern(parts):
    """The template as a regular expression over words that end in a blank: an independent matcher."""
    out = ""
    for part in parts:
        if part[0] == "word":
            out += re.escape(part[1]) + " "
        elif part[0] == "optional":
            out += f"(?:{pattern(part[1])})?"
        elif part[0] == "one of":
            out += "(?:" + "|".join(pattern(w) for w in part[1]) + ")"
        else:
            out += f"(?:[^ ]+ ){{{part[1]},{part[2]}}}"
    return out


def accepted(markup, said):
    """Longest accepted stretches from the left, not overlapping, by trying every end of every start."""
    form, spans, at = re.compile(pattern(L.parse(markup))), [], 0
    said = [L.VARIANTS.get(w, w) for w in said]
    while at < len(said):
        ends = [to for to in range(len(said), at, -1) if form.fullmatch(" ".join(said[at:to]) + " ")]
        if ends:
            spans.append((at, ends[0]))
        at = ends[0] if ends else at + 1
    return spans


def expected(text, phrases, templates):
    said, base, spans = words(text), [], []
    for phrase, label in phrases.items():
        p = phrase.split()
        base += [(k, label, k + len(p)) for k in range(len(said)) if said[k:k + len(p)] == p]
    for label, markup in templates:
        spans += [(a, label, b) for a, b in accepted(markup, said)]
    cover = {k for a, _, b in base + spans for k in range(a, b)}
    return {
        "n_words": len(said), "n_base": len(base), "first_word": min((b[0] for b in base), default=None), "last_word": max((b[0] for b in base), default=None),
        "base_labels": ",".join(sorted({b[1] for b in base})), "labels": ",".join(sorted({b[1] for b in base + spans})), "score": len(cover) / len(said) if said else 0.0,
        "spans": [{"label": label, "start": a, "end": b} for a, label, b in sorted(spans)],
    }


def scan(texts, phrases=L.PHRASES, templates=L.TEMPLATES):
    got = L.Scanner(phrases, templates).scan(pa.array(texts, pa.string()))
    return [{k: v[i] for k, v in got.items()} for i in range(len(texts))]


ODD = [
    ("x", 'a b <<beginOptional>>c <<beginOptional>>d<<endOptional>><<endOptional>> e <<var;words="0-2">> f'),
    ("y", 'a <<var;match="b c|b|d d d">> e'),
    ("z", '<<beginOptional>>c<<endOptional>> d'),
    ("w", 'licence a <<var;words="1-3">> a b'),
]


def test_random_texts_against_regular_expressions():
    draw = random.Random(5)
    texts = [" ".join(draw.choices(["a", "B", "c", "d", "e", "f", "é", "license", "licence"], [6, 6, 3, 3, 4, 3, 1, 2, 2], k=draw.randint(0, 40))) for _ in range(400)]
    texts += [None, "", " \n", "ab", "CC BY NC cc by nc. Apache-License (version 2)", "Under the\nMIT-License under the mit license"]
    for text, got in zip(texts, scan(texts, L.PHRASES | {"a b": "ab", "a": "one"}, ODD)):
        assert got == expected(text, L.PHRASES | {"a b": "ab", "a": "one"}, ODD), text


def filled(markup, optional, holder="THE AUTHORS or others"):
    while "<<beginOptional>>" in markup:
        markup = re.sub(r"<<beginOptional>>((?:(?!<<beginOptional>>).)*?)<<endOptional>>", r"\1" if optional else "", markup)
    markup = re.sub(r'<<var;match="([^"|]*)[^>]*>>', r"\1", markup)
    return re.sub(r'<<var;words="(\d+)-\d+">>', lambda m: " ".join((holder.split() * 5)[: max(1, int(m.group(1)))]), markup)


@pytest.mark.parametrize("optional", [True, False])
def test_every_template_takes_its_wording_and_no_other(optional):
    for label, markup in L.TEMPLATES:
        text = "Some words before. " + filled(markup, optional) + " And after."
        got = scan([text])[0]
        assert label in got["labels"].split(","), label
        said = words(filled(markup, optional))
        # A changed mandatory word in the middle of a long wording is not accepted.
        if len(said) > 30:
            hole = next(k for k in range(len(said) // 2, len(said)) if said[k] not in {"the", "authors", "or", "others"})
            broken = " ".join([*said[:hole], "zzz", *said[hole + 1:]])
            assert not any(s["label"] == label and s["end"] - s["start"] > 30 for s in scan([broken])[0]["spans"]), label


def test_table(spark, odd_docs, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = odd_docs.selectExpr("doc_id + 100000 AS doc_id", "text").collect() + [(-1, "Released under the MIT License. " * 3), (-2, "word " * 50_000 + "Licensed under CC BY-NC 4.0"), (-3, "It is licensed under the GNU General Public License, version 2.")]
    table = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    # A regular expression for every start is slow on long texts; their places are compared by phrase.
    short = [t for t in L.TEMPLATES if len(t[1]) < 400]
    texts = {}
    for r in table.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    rows = L.scan_licenses(table.repartition(3), templates=short).collect()
    assert len(rows) == table.count() and any(r["labels"] != r["base_labels"] for r in rows)
    for r in rows:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        bases = [expected(t, L.PHRASES, []) for t in texts[r["doc_id"]]]
        assert any(all(r[k] == b[k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels")) for b in bases)


def test_markup_errors_and_empty(spark):
    for wrong in ("a <<beginOptional>>b", "a<<endOptional>>", 'a <<var;words="3-2">>', "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            L.Automaton(wrong)
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string, labels string")).count() == 0
