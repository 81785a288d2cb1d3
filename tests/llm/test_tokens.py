import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from facetlens.llm import bpe, packing, rans_files, token_counts  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts(n=1500):
    random.seed(5)
    letters = [*"ab'srtlve .,\n\t é日1 2!\xa0　\x85­́", "<|endoftext|>", "'re", "  "]
    return ["", "  ", "a  b", "a" * 3000, " " * 300 + "b", "\n" * 50] + ["".join(random.choice(letters) for _ in range(random.randrange(40))) for _ in range(n)]


def test_ids_equal_the_library():
    own = texts() + ["Ȁ́x ɐ ʰ", "x  y", "ɏ ɐ 0x"] + [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}" for c in range(0x80, 0x260)]
    ids, off = bpe.Encoder(PATH).encode(pa.array(own))
    for i, t in enumerate(own):
        assert ids[off[i]:off[i + 1]].tolist() == bpe.load(PATH).encode(t, add_special_tokens=False).ids, t


def test_prefix_counts_equal_encoding_each_prefix(spark):
    own = [t for t in texts(300) if len(t) < 60]
    got = {r[0]: r[1] for r in token_counts.prefix_counts(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string"), PATH).collect()}
    for i, t in enumerate(own):
        assert got[i] == [len(bpe.load(PATH).encode(t[:k], add_special_tokens=False).ids) for k in range(1, len(t) + 1)], t


def test_counts_and_longest_fitting_prefix(spark, odd_docs):
    rows = token_counts.token_counts(odd_docs, PATH, 4).collect()
    text = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        t, encode = text[r["doc_id"]], bpe.load(PATH).encode
        n = len(encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 4)
        if len(t) < 100:
            assert r["fit_bytes"] == max(len(t[:k].encode()) for k in range(len(t) + 1) if len(encode(t[:k], add_special_tokens=False).ids) <= 4)


def test_pieces_cover_every_id_once(spark, odd_docs):
    rows = packing.pieces(odd_docs.repartition(3), PATH, 64, 1).collect()
    seen = {}
    for r in rows:
        assert r["length"] * 4 == len(r["ids"]) and 0 < r["length"] <= 64 - r["offset"]
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    filled = [sum(n for _, n in v) for _, v in sorted(seen.items())]
    assert filled[:-1] == [64] * (len(filled) - 1) and sorted(seen) == list(range(len(filled)))
    for v in seen.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
    text = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    assert sum(r["length"] for r in rows if r["doc_id"] == 3) == 4  # a repeated row is packed twice
    for d in (0, 1, 2, 5, 6, 7, 8, None):
        got = np.concatenate([np.frombuffer(bytes(r["ids"]), "<u4") for r in sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"])])
        assert got.tolist() == bpe.load(PATH).encode(text[d], add_special_tokens=False).ids + [1]
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packing.pieces(odd_docs, PATH, 64, 1)).collect()}
    assert sum(map(len, whole.values())) == 4 * sum(filled)
    digest = packing.packed_digest(odd_docs, PATH, 64, 1).where("doc_id = 0").collect()
    assert digest[0]["ids_crc32"] == zlib.crc32(np.array([1], "<u4").tobytes())


def test_rans_round_trip():
    rng = np.random.default_rng(3)
    for n in (1, 5, 255, rans_files.BLOCK, rans_files.BLOCK * 2 + 17):
        ids = np.minimum(rng.geometric(0.01, n), 50_000)
        own = rans_files.Segment(rans_files.encode_segment(np.array([7]), np.array([n]), ids))
        assert (own.decode() == ids).all()
        if n > rans_files.BLOCK:
            assert (own.decode(1, 2) == ids[rans_files.BLOCK:2 * rans_files.BLOCK]).all()
    every = np.arange(60_000)
    assert (rans_files.Segment(rans_files.encode_segment(np.array([7]), np.array([60_000]), every)).decode() == every).all()
    data = bytearray(rans_files.encode_segment(np.array([7]), np.array([n]), ids))
    data[-100] ^= 1
    with pytest.raises(ValueError):
        rans_files.Segment(bytes(data))


def test_rans_files_in_order(spark, odd_docs, monkeypatch):
    files = rans_files.write_files(odd_docs.repartition(3), PATH, 0)
    rows = sorted(rans_files.read_files(files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted([r["doc_id"] for r in odd_docs.collect()], key=lambda d: -1 if d is None else d)
    text, at = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}, 0
    for r in rows:
        ids = bpe.load(PATH).encode(text[r["doc_id"]], add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(none, PATH).count() == 0
    assert packing.packed_digest(none, PATH).count() == 0
    assert rans_files.read_files(rans_files.write_files(none, PATH)).count() == 0


def test_segments_neither_sort_nor_search_their_ids(monkeypatch):
    import numpy as np

    from facetlens.llm import rans_files as R

    draw = np.random.default_rng(5)
    ids = np.minimum(draw.zipf(1.3, 200_000), 49_999).astype(np.uint32)
    docs, lengths = np.arange(2), np.array([150_000, 50_000])

    def slow(*_, **__):
        raise AssertionError("a sort or search over all ids")

    with monkeypatch.context() as m:
        m.setattr(np, "unique", slow)
        m.setattr(np, "searchsorted", slow)
        data = R.encode_segment(docs, lengths, ids)
    assert (R.Segment(data).decode() == ids).all()
    # Ids beyond the table give the same bytes.
    monkeypatch.setattr(R, "TABLE_IDS", 0)
    assert R.encode_segment(docs, lengths, ids) == data
    large = draw.integers(0, 1 << 32, 500, dtype=np.uint64).astype(np.uint32)
    monkeypatch.undo()
    assert (R.Segment(R.encode_segment(docs, np.array([400, 100]), large)).decode() == large).all()


def test_plain_words_skip_the_split_and_memory_keeps_two_generations(monkeypatch):
    own = ["word another 12 1984", "Zebra  x\ty", "don't <|endoftext|> end", "é word 12", ""]
    want = [bpe.load(PATH).encode(t, add_special_tokens=False).ids for t in own]
    tool = bpe.Encoder(PATH)
    tool.known = bpe.Recent(2)
    for _ in range(3):
        ids, off = tool.encode(pa.array(own))
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == want
    memory, asked = bpe.Recent(2), []
    learn = lambda keys: asked.append(keys) or [k * 2 for k in keys]
    for keys in (["a", "b", "c"], ["a", "d"], ["e", "f"], ["a", "b"]):
        assert memory.fetch(keys, learn) == [k * 2 for k in keys]
    # a came back from the old generation; b was not used again and went.
    assert asked == [["a", "b", "c"], ["d"], ["e", "f"], ["b"]]

    def slow(_):
        raise AssertionError("a regular expression over a plain word")

    tool = bpe.Encoder(PATH)
    tool.split = slow
    ids, off = tool.encode(pa.array(own[:1]))
    assert ids.tolist() == want[0]
