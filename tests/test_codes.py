import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlens.functions.blocks import matrix_blocks
from facetlens.operators import codes as C
from helpers import brute_auc, brute_d

D, NF, K = 5, 11, 3


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = {(l, i): rng.normal(size=D) for l in (1, 2) for i in range(90)}
    w = rng.normal(size=(NF, D))
    w[7] = w[4]  # equal rows tie
    w[9] = -50 * np.abs(w[9])  # rarely fires
    b = rng.normal(size=NF) * 0.1
    b[7] = b[4]
    b[9] = -1000.0  # never fires
    vectors = spark.createDataFrame([(l, i, [float(v) for v in x[l, i]]) for l, i in x], "layer int, row_id long, vec array<double>")
    weights = spark.createDataFrame([(l, f, [float(v) for v in w[f]], float(b[f])) for l in (1, 2) for f in range(NF)], "layer int, feature_id int, w array<double>, b double")
    meta = spark.createDataFrame(
        [(l, i, f"g{i % 3 if i % 4 else 0}", "ax" + str((i % 3 if i % 4 else 0) % 2), f"G{i % 3 if i % 4 else 0}") for l, i in x],
        "layer int, row_id long, entity string, axis string, canonical_label string",
    )
    want = {}
    for key, v in x.items():
        act = np.maximum(w @ v + b, 0)
        for f in sorted(range(NF), key=lambda f: (-act[f], f))[:K]:
            if act[f] > 0:
                want[(*key, f)] = act[f]
    return vectors, weights, meta, want


def as_map(codes):
    return {(r["layer"], r["row_id"], r["feature_id"]): r["activation"] for r in codes.collect()}


def test_encoder_matches_numpy_whatever_the_blocks(spark, data):
    vectors, weights, _, want = data
    for block_bytes in (1, 4 * D * 8, 64 << 20):
        got = as_map(C.codes_to_long(C.linear_relu_topk(vectors.repartition(3), weights, K, block_bytes=block_bytes)))
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k])


def test_running_top_k_with_ties():
    rng = np.random.default_rng(1)
    acts = rng.integers(0, 4, size=(50, 40)).astype(float)
    ids = np.sort(rng.choice(1000, 40, replace=False))
    for k in (1, 3, 9):
        want = np.argsort(-acts, axis=1, kind="stable")[:, :k]
        whole = C._first_k(acts, ids, k)
        best = None
        deal = rng.integers(0, 3, 40)
        for block in range(3):
            best = C._merge_k(best, C._first_k(acts[:, deal == block], ids[deal == block], k), k)
        for got in (whole, best):
            assert (got[0] == ids[want]).all() and (got[1] == np.take_along_axis(acts, want, axis=1)).all()


def test_blocks_hold_every_row_once(spark):
    table = spark.createDataFrame([(l, f, [float(f), 1.0], 0.5 * f) for l, n in ((3, 50), (9, 1)) for f in range(n)], "layer int, id int, w array<double>, b double")
    for size in (1, 100, 1 << 20):
        store = matrix_blocks(table, "test", size)
        assert store.width == {3: 2, 9: 2} and (size > 1 or len(store.files[3]) > 20)
        for layer, n in ((3, 50), (9, 1)):
            blocks = list(store.blocks(layer))
            assert sorted(f for ids, _, _ in blocks for f in ids) == list(range(n))
            assert all((w[:, 0] == ids).all() and (b == 0.5 * ids).all() and (np.diff(ids) > 0).all() for ids, w, b in blocks)
    assert matrix_blocks(table.limit(0), "test").files == {}
    with pytest.raises(ValueError):
        matrix_blocks(table.withColumn("w", F.slice("w", 1, F.least(F.col("id") + 1, F.lit(2)))), "test")


def dense(want, meta):
    rows = meta.collect()
    return {r: {f: want.get((r["layer"], r["row_id"], f), 0.0) for f in range(NF)} for r in rows}


def test_contrast_selectivity_matches_dense_computation(spark, data):
    vectors, weights, meta, want = data
    codes = C.codes_to_long(C.linear_relu_topk(vectors, weights, K))
    contrasts = spark.createDataFrame([("g0_vs_g2", "ax0", "g0", "g2")], "contrast_name string, axis string, entity_a string, entity_b string")
    got = C.contrast_feature_selectivity(codes, meta, contrasts, weights, top_n=4).collect()
    full = dense(want, meta)
    assert len(got) == 8
    for r in got:
        a = [v[r["feature_id"]] for m, v in full.items() if m["layer"] == r["layer"] and m["entity"] == "g0"]
        b = [v[r["feature_id"]] for m, v in full.items() if m["layer"] == r["layer"] and m["entity"] == "g2"]
        assert r["auc"] == pytest.approx(brute_auc(a, b)) and r["diff_mean"] == pytest.approx(np.mean(a) - np.mean(b))
        d = brute_d(a, b)
        assert r["cohens_d"] == (None if d is None else pytest.approx(d))


def test_entity_selectivity_matches_dense_computation(spark, data):
    vectors, weights, meta, want = data
    codes = C.codes_to_long(C.linear_relu_topk(vectors, weights, K))
    full = dense(want, meta)
    got = C.entity_feature_selectivity(codes, meta, weights, top_n=NF).collect()
    assert {r["entity"] for r in got} == {"g0", "g2"}  # g1 is alone on its axis
    for r in got:
        a = [v[r["feature_id"]] for m, v in full.items() if m["layer"] == r["layer"] and m["entity"] == r["entity"]]
        b = [v[r["feature_id"]] for m, v in full.items() if m["layer"] == r["layer"] and m["axis"] == r["axis"] and m["entity"] != r["entity"]]
        assert r["auc"] == pytest.approx(brute_auc(a, b)) and (r["n_entity"], r["n_other"]) == (len(a), len(b))


def test_feature_stats_cover_silent_features(spark, data):
    vectors, weights, meta, want = data
    codes = C.codes_to_long(C.linear_relu_topk(vectors, weights, K))
    n = meta.groupBy("layer").agg(F.count("*").alias("n_rows"))
    got = {(r["layer"], r["feature_id"]): r for r in C.feature_stats(codes, weights, n).collect()}
    assert len(got) == 2 * NF
    assert got[1, 9]["activation_count"] == 0 and got[1, 9]["p95_activation"] == 0.0
    for (l, f), r in got.items():
        vals = [v for (ll, _, ff), v in want.items() if (ll, ff) == (l, f)]
        if vals:
            assert r["p95_activation"] == pytest.approx(np.percentile(vals, 95)) and r["activation_frequency"] == pytest.approx(len(vals) / 90)


def test_edit_and_decode(spark, data):
    vectors, weights, meta, want = data
    codes = C.codes_to_long(C.linear_relu_topk(vectors, weights, K))
    dec = weights.select("layer", "feature_id", "w")
    w = {(r["layer"], r["feature_id"]): np.array(r["w"]) for r in dec.collect()}
    back = {(r["layer"], r["row_id"]): np.array(r["vec"]) for r in C.code_decode(codes, meta, dec, bias=0.5, block_bytes=100).collect()}
    assert len(back) == 180
    for l, i in back:
        ref = sum((v * w[ll, f] for (ll, ii, f), v in want.items() if (ll, ii) == (l, i)), np.zeros(D)) + 0.5
        assert np.allclose(back[l, i], ref)
    assert not C.ablate_codes(codes, [4, 7]).filter("feature_id IN (4, 7)").count()
    patched = {(r["layer"], r["row_id"]): np.array(r["vec"]) for r in C.patch_residual(vectors, C.ablate_codes(codes, [4]), codes, dec).collect()}
    assert len(patched) == 180
    for r in vectors.collect():
        key = (r["layer"], r["row_id"])
        assert np.allclose(patched[key], np.array(r["vec"]) - want.get((*key, 4), 0.0) * w[key[0], 4])


def test_decoder_bias_vector(spark):
    rng = np.random.default_rng(11)
    x, w, b, c = rng.normal(size=(30, 6)), rng.normal(size=(6, 9)), rng.normal(size=9), rng.normal(size=6)
    vectors = spark.createDataFrame([(2, i, row.tolist()) for i, row in enumerate(x)], "layer int, row_id bigint, vec array<double>")
    weights = spark.createDataFrame([(2, f, w[:, f].tolist(), float(b[f])) for f in range(9)], "layer int, feature_id int, w array<double>, b double")
    bias = spark.createDataFrame([(2, c.tolist())], "layer int, vec array<double>")
    want = np.maximum((x - c) @ w + b, 0)
    for limit in (64 << 20, 64):
        got = C.linear_relu_topk(vectors, weights, 9, bias, limit).collect()
        for r in got:
            own = np.zeros(9)
            own[r["indices"]] = r["values"]
            assert np.allclose(own, want[r["row_id"]])
    chosen = C.linear_relu_selected(vectors, weights, [1, 4], bias).collect()
    assert all(abs(r["activation"] - want[r["row_id"], r["feature_id"]]) < 1e-9 for r in chosen)
    codes = spark.createDataFrame([(2, i, f, float(want[i, f])) for i in range(29) for f in range(9) if want[i, f] > 0], "layer int, row_id bigint, feature_id int, activation double")
    dec = spark.createDataFrame([(2, f, w[:, f].tolist()) for f in range(9)], "layer int, feature_id int, w array<double>")
    plan = C.code_decode(codes, vectors, dec, bias)
    text = plan._jdf.queryExecution().executedPlan().toString()
    # Codes travel as pairs; no exchange carries a vector a code.
    assert not any("Exchange" in line and "w#" in line for line in text.splitlines())
    for r in plan.collect():
        base = want[r["row_id"]] @ w.T if r["row_id"] < 29 else 0
        assert np.allclose(r["vec"], base + c)
