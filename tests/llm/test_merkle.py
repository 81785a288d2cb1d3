import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from facetlens.llm import merkle_manifest as M


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    n = r["n_chars"]
    return sha(*(field(v) for v in (r["doc_id"], r["source"], r["lang"], n if n is None else n + more, r["text"])))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def expected(rows):
    """Every row's result by building all the trees in memory."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees.append(levels([leaf(r) for r in groups[g]]))
    top = levels([t[-1][0] for t in trees])
    found = []
    for g, (name, tree) in enumerate(zip(names, trees)):
        for i, r in enumerate(groups[name]):
            wrong = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            proof, h = [], leaf(r, int(wrong))
            for floors, at in ((tree, i), (top, g)):
                for floor in floors[:-1]:
                    pair = floor[at & ~1:(at & ~1) + 2]
                    proof += pair[:at & 1] + pair[(at & 1) + 1:]
                    h = sha(*pair[:at & 1], h, *pair[(at & 1) + 1:])
                    at >>= 1
            found.append((r["doc_id"], leaf(r), tree[-1][0], top[-1][0], sha(*proof), h, h == top[-1][0]))
    return found


def order(rows):
    return sorted(map(tuple, rows), key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def test_against_trees_in_memory(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = M.audit(docs, M.seventh(docs["doc_id"])).collect()
    assert order(got) == order(expected(docs.collect()))
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("stride", [1, 2])
def test_shapes_of_trees(spark, stride):
    sizes = {None: 1, "en": 2, "é": 3, "z": 8, "a": 9, "": 17, "Z": 4}
    rows = [(k, f"text {k}", lang, None, None if k % 3 else k) for lang, n in sizes.items() for k in range(n)] + [(5, "tie", "only", "s", 3)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert order(M.audit(docs, M.seventh(docs["doc_id"]), stride).collect()) == order(expected(docs.collect()))


def test_one_group_and_one_leaf(spark):
    for n in (1, 5):
        docs = spark.createDataFrame([(k, "t", "en", "s", k) for k in range(n)], SCHEMA)
        assert order(M.audit(docs, M.seventh(docs["doc_id"]), 2).collect()) == order(expected(docs.collect()))


def test_nulls_ties_repeated_rows_long_texts_and_clashing_columns(spark):
    rows = [(None, None, None, None, None)] * 3 + [(7, "same", "en", "s", 4)] * 4 + [(7, "other", "en", "s", 4), (8, "", "", "", 0), (9, "é" * 300_000, "en", "long", 300_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    clash = docs.withColumns({c: F.lit(1) for c in ("leaf", "spot", "tree", "level", "idx", "salt", "place", "claimed", "id", "size")})
    assert order(M.audit(clash, M.seventh(clash["doc_id"]), 2).collect()) == order(expected(docs.collect()))


def test_copies_of_node_rows(spark, monkeypatch):
    # Every level's rows are repeated for the leaves below it; each leaf must still meet one parent.
    monkeypatch.setattr(M, "SALT_ROWS", 3)
    rows = [(k, "t", "a" if k % 3 else "b", "s", k) for k in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert order(M.audit(docs, M.seventh(docs["doc_id"]), 2).collect()) == order(expected(docs.collect()))


def test_any_changed_field_is_found(spark):
    rows = [(k, f"t{k}", "en", "s", k) for k in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    first = M.audit(docs)
    assert first.agg(F.bool_and("verified")).first()[0]
    other = M.audit(docs.withColumn("text", F.when(F.col("doc_id") == 4, F.lit("x")).otherwise(F.col("text"))))
    assert first.first()["root"] != other.first()["root"]


def test_empty_table(spark):
    empty = M.audit(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and empty.count() == 0
