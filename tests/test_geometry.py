import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlens.operators import geometry as G, means as M, subspace as S
from helpers import brute_auc, brute_d

VARIANTS = {"raw": None, "family": "family", "template": "template_id"}


@pytest.fixture(scope="module")
def data(spark):
    """A third of the rows share one family; one entity has a single row; one vector dimension is constant."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(160):
        e = "solo" if i == 7 else f"g{rng.integers(4)}"
        fam = "fam0" if i % 3 == 0 else f"fam{rng.integers(1, 4)}"
        vec = rng.normal(size=6) + (int(e[1]) if e != "solo" else 5) * np.array([0.4, 0, 0, 0.2, 0, 0])
        vec[5] = 2.5
        for layer in (1, 2):
            rows.append((layer, i, e, "ax" + str((int(e[1]) if e != "solo" else 0) % 2), e.upper(), fam, f"{fam}t{i % 2}", [float(x) for x in vec * layer]))
    df = spark.createDataFrame(rows, "layer int, row_id long, entity string, axis string, canonical_label string, family string, template_id string, vec array<double>")
    contrasts = spark.createDataFrame(
        [("g0_vs_g2", "ax0", "g0", "g2"), ("g1_vs_g3", "ax1", "g1", "g3"), ("g0_vs_solo", "ax0", "g0", "solo"), ("g0_vs_gx", "ax0", "g0", "gx"), ("g2_vs_g2", "ax0", "g2", "g2")],
        "contrast_name string, axis string, entity_a string, entity_b string",
    )
    return rows, df.cache(), contrasts


def residual(rows, layer, variant):
    part = [r for r in rows if r[0] == layer]
    x = np.array([r[7] for r in part])
    if VARIANTS[variant]:
        col = {"family": 5, "template_id": 6}[VARIANTS[variant]]
        groups = np.array([r[col] for r in part])
        out = x.copy()
        for g in set(groups):
            out[groups == g] += x.mean(0) - x[groups == g].mean(0)
        x = out
    return part, x


def test_residualized_group_means_equal_global_mean(spark, data):
    rows, df, _ = data
    res = M.residualize(df, VARIANTS).filter("resid = 'family' AND layer = 2")
    overall = np.array(M.group_vector_mean(df.filter("layer = 2"), ["layer"]).first()["mean"])
    for r in M.group_vector_mean(res, ["family"]).collect():
        assert np.allclose(r["mean"], overall)
    eta = {r["factor"]: r["eta_squared"] for r in M.variance_decomposition(res, ["family", "entity"]).collect()}
    assert eta["family"] == pytest.approx(0, abs=1e-9) and 0 < eta["entity"] < 1


def test_variant_means_equal_means_of_residualized_rows(spark, data):
    rows, df, _ = data
    for cell in (["entity"], ["entity", "family"]):
        direct = {tuple(r[k] for k in ["layer", "resid", *cell]): r for r in M.group_vector_mean(M.residualize(df, VARIANTS), ["layer", "resid", *cell]).collect()}
        smart = {tuple(r[k] for k in ["layer", "resid", *cell]): r for r in M.VariantMeans(df, VARIANTS, cell).means.collect()}
        assert direct.keys() == smart.keys()
        for k in direct:
            assert direct[k]["n"] == smart[k]["n"] and np.allclose(direct[k]["mean"], smart[k]["mean"])


def test_endpoint_metrics_from_raw_vectors(spark, data):
    rows, df, contrasts = data
    got = {(r["layer"], r["resid"], r["contrast_name"]): r for r in G.layer_endpoint_metrics(M.VariantMeans(df, VARIANTS, ["entity"]), contrasts).collect()}
    assert {k[2] for k in got} == {"g0_vs_g2", "g1_vs_g3", "g0_vs_solo"}
    for (layer, variant, name), r in got.items():
        part, x = residual(rows, layer, variant)
        ents = np.array([p[2] for p in part])
        a, b = name.split("_vs_")
        d = x[ents == a].mean(0) - x[ents == b].mean(0)
        s = (x - x.mean(0)) @ (d / np.linalg.norm(d))
        assert r["auc"] == pytest.approx(brute_auc(s[ents == a], s[ents == b]), abs=1e-9)
        want = brute_d(s[ents == a], s[ents == b])
        assert r["cohens_d"] == (None if want is None else pytest.approx(want))
        # The gap of the mean scores is the norm of the mean difference.
        assert r["mean_a"] - r["mean_b"] == pytest.approx(np.linalg.norm(d))


@pytest.mark.parametrize("center", ["train", "global"])
def test_family_holdout_equals_rescans(spark, data, center):
    rows, df, contrasts = data
    got = G.family_holdout(M.VariantMeans(df, VARIANTS, ["entity", "family"]), contrasts, center=center).collect()
    assert got
    for r in got:
        part, x = residual(rows, r["layer"], r["resid"])
        ents, fams = np.array([p[2] for p in part]), np.array([p[5] for p in part])
        held = fams == r["heldout_family"]
        d = x[(ents == r["entity_a"]) & ~held].mean(0) - x[(ents == r["entity_b"]) & ~held].mean(0)
        c = x[~held].mean(0) if center == "train" else x.mean(0)
        s = (x - c) @ (d / np.linalg.norm(d))
        a, b = s[(ents == r["entity_a"]) & held], s[(ents == r["entity_b"]) & held]
        assert r["auc"] == pytest.approx(brute_auc(a, b), abs=1e-9)
        assert r["mean_a"] == pytest.approx(a.mean()) and (r["n_a"], r["n_b"]) == (len(a), len(b))


def test_family_transfer_counts_and_holdout_rows(spark, data):
    rows, df, contrasts = data
    vm = M.VariantMeans(df, {"raw": None}, ["entity", "family"])
    t = G.family_transfer(vm, contrasts).collect()
    hold = {(r["layer"], r["contrast_name"], r["heldout_family"]): r for r in G.family_holdout(vm, contrasts, center="global").collect()}
    seen = 0
    for r in t:
        if r["train_family"].startswith("all_except_"):
            assert r["train_family"] == "all_except_" + r["test_family"]
            h = hold.get((r["layer"], r["contrast_name"], r["test_family"]))
            if h:
                seen += 1
                assert r["auc"] == pytest.approx(h["auc"])
    assert seen == len(hold) > 0


def test_same_result_for_any_partitioning(spark, data):
    _, df, contrasts = data
    outs = []
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        m = G.layer_endpoint_metrics(M.VariantMeans(df.repartition(n), VARIANTS, ["entity"]), contrasts)
        outs.append({tuple(r)[:3]: round(r["auc"], 9) for r in m.collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert outs[0] == outs[1]


def test_degenerate_layers(spark):
    rows = [(1, i, [float(i), 1.0]) for i in range(5)] + [(2, i, [3.0, 3.0]) for i in range(5)] + [(3, 0, [float("nan"), 1.0]), (3, 1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "layer int, row_id long, vec array<double>")
    assert {r["layer"] for r in M.drop_degenerate_layers(df).select("layer").collect()} == {1}


def test_shared_subspace(spark, data):
    _, df, contrasts = data
    vm = M.VariantMeans(df, VARIANTS, ["entity"])
    dirs = G.contrast_directions(vm.means, contrasts, G.KEYS)
    basis = S.shared_subspace_svd(dirs)
    by = {}
    for r in S.cumulative_explained(basis).orderBy("component").collect():
        by.setdefault((r["layer"], r["resid"]), []).append(r)
    stacked = {}
    for r in dirs.collect():
        stacked.setdefault((r["layer"], r["resid"]), []).append(r["dir"])
    for key, comps in by.items():
        b = np.array([c["vec"] for c in comps])
        assert np.allclose(b @ b.T, np.eye(len(b)), atol=1e-8)
        assert np.allclose([c["singular_value"] for c in comps], np.linalg.svd(np.array(stacked[key]), compute_uv=False))
        ratios = [c["explained_variance_ratio"] for c in comps]
        assert sum(ratios) == pytest.approx(1) and ratios == sorted(ratios, reverse=True)
        assert comps[-1]["cumulative_explained_variance"] == pytest.approx(1)
        assert all(v[np.abs(v).argmax()] > 0 for v in b)
    dec = S.subspace_decomposition(vm, dirs, basis, ks=[1, 2, 3]).collect()
    parts = {}
    for r in dec:
        parts.setdefault((r["layer"], r["resid"], r["contrast_name"], r["k"]), {})[r["component_type"]] = r
    for (layer, resid, _, k), p in parts.items():
        assert p["shared"]["fraction_norm"] + p["residual"]["fraction_norm"] == pytest.approx(1)
        if k == 3:
            assert p["shared"]["fraction_norm"] == pytest.approx(1)
            assert p["shared"]["auc"] == pytest.approx(p["full"]["auc"], abs=1e-6)
    share = S.axis_sharedness(S.subspace_decomposition(vm, dirs, basis, ks=[3]))
    assert all(r["mean_fraction_shared"] == pytest.approx(1) for r in share.collect())


def test_pca(spark, data):
    rows, df, _ = data
    scores, ratios = S.pca(df, 4)
    assert {r["layer"] for r in ratios.select("layer").distinct().collect()} == {r[0] for r in rows}
    scores, ratios = scores.filter("layer = 2"), ratios.filter("layer = 2")
    p = np.array([r["pcs"] for r in scores.orderBy("row_id").collect()])
    x = np.array([r[7] for r in sorted((r for r in rows if r[0] == 2), key=lambda r: r[1])])
    z = (x - x.mean(0)) / np.where(x.std(0) > 1e-12, x.std(0), 1)
    vals = np.linalg.svd(z - z.mean(0), compute_uv=False) ** 2
    got = [r["explained_variance_ratio"] for r in ratios.orderBy("component").collect()]
    assert got == pytest.approx(list(vals[:4] / vals.sum()), abs=1e-9)
    assert np.allclose(p.mean(0), 0, atol=1e-9)
    assert np.allclose((p**2).sum(0), vals[:4])


def test_pca_by_a_sketch_narrower_than_the_vectors(spark, monkeypatch):
    monkeypatch.setattr(S, "STRIPE", 7)
    rng = np.random.default_rng(8)
    x = {}
    for layer, d in ((1, 40), (2, 12)):
        m = rng.normal(size=(200, 5)) @ rng.normal(size=(5, d)) * 3 + rng.normal(size=(200, d)) * 0.05
        m[:, 3] = 2.5  # a constant column
        x[layer] = m
    x[3] = np.ones((6, 4))
    rows = [(k, i, v.tolist()) for k, m in x.items() for i, v in enumerate(m)]
    rows[0][2][5] = float("nan")
    x[1][0, 5] = 0
    df = spark.createDataFrame(rows, "layer int, row_id long, vec array<double>").repartition(6)
    scores, ratios = S.pca(df, 3, sketch=10)
    got = {(r["layer"], r["component"]): r["explained_variance_ratio"] for r in ratios.collect()}
    pcs = {(r["layer"], r["row_id"]): np.array(r["pcs"]) for r in scores.collect()}
    for layer in (1, 2):
        m = x[layer]
        z = np.where(m.std(0) > 1e-9, (m - m.mean(0)) / np.where(m.std(0) > 1e-9, m.std(0), 1), 0)
        _, s, vt = np.linalg.svd(z, full_matrices=False)
        assert np.allclose([got[layer, i] for i in (1, 2, 3)], s[:3] ** 2 / (s**2).sum(), rtol=1e-6)
        p = np.array([pcs[layer, i] for i in range(200)])
        assert np.allclose(np.abs(p), np.abs(z @ vt[:3].T), atol=1e-3)
    assert all(got[3, i] == 0 for i in (1, 2, 3)) and not pcs[3, 0].any()


def test_inner_product_extremes_against_all_products(spark):
    from facetlens.operators.subspace import Extremes, inner_product_extremes

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)) * rng.uniform(0.1, 3, size=(300, 1))
    x[200:230] = x[10]  # ties, by row id
    q = rng.normal(size=(25, 6))
    q[3] = 0
    rows = spark.createDataFrame([(layer, i, v.tolist()) for layer in (1, 2, 5) for i, v in enumerate(x)], "layer int, row_id bigint, vec array<double>").repartition(4)
    queries = spark.createDataFrame([(layer, j, v.tolist()) for layer in (1, 2) for j, v in enumerate(q)], "layer int, query_id int, q array<double>")
    for block_bytes in (100, 1 << 20):
        got = inner_product_extremes(queries, rows, 7, block_bytes).collect()
        assert len(got) == 2 * 25 * 2 * 7
        for r in got:
            s = np.round(x @ q[r["query_id"]], 12)
            order = np.lexsort((np.arange(300), -s if r["side"] == "top" else s))
            assert abs(r["score"] - s[r["row_id"]]) < 1e-9 and abs(s[order[r["rank"] - 1]] - r["score"]) < 1e-9
    # Short rows are left out once the best ones are long.
    m = x[np.argsort(-np.linalg.norm(x, axis=1))]
    state = Extremes(np.arange(2), q[:2], 1)
    for at in range(0, 300, 10):
        state.meet(m[at:at + 10], np.arange(at, at + 10), np.linalg.norm(m[at:at + 10], axis=1))
    assert state.met < 600 and np.allclose(state.best[0, :, 0], (q[:2] @ m.T).max(axis=1))
    assert inner_product_extremes(queries.limit(0), rows, 3).count() == 0


def test_component_scores_carry_numbers_instead_of_names(spark, monkeypatch):
    draw = np.random.default_rng(4)
    rows = [(1, i, f"g{i % 3}", f"fam{i % 2}", [float(x) for x in draw.normal(size=4) + i % 3]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "layer int, row_id int, entity string, family string, vec array<double>").withColumn("axis", F.lit("ax"))
    vm = M.VariantMeans(vectors, {"raw": None, "family": "family"}, ["entity"])
    contrasts = spark.createDataFrame([("a", "ax", "g0", "g1"), ("b", "ax", "g1", "g2")], "contrast_name string, axis string, entity_a string, entity_b string")
    dirs = G.contrast_directions(vm.means, contrasts, G.KEYS)
    seen = []
    metrics = G.endpoint_metrics
    monkeypatch.setattr(G, "endpoint_metrics", lambda scores, keys: (seen.append((scores, keys)), metrics(scores, keys))[1])
    dec = S.subspace_decomposition(vm, dirs, S.shared_subspace_svd(dirs), ks=[1, 2]).collect()
    (scores, keys), = seen
    assert keys == ["number"] and set(scores.columns) == {"row_id", "number", "is_a", "score"}
    # Two variants and contrasts; shared parts of both sizes, a rest of the smaller, the whole direction once and not for every size.
    assert scores.select("number").distinct().count() == 2 * 2 * 4
    whole = {(r["resid"], r["contrast_name"]): r for r in metrics(G.projection_scores(vm, dirs, "endpoints"), [*G.KEYS, *G.CONTRAST]).collect()}
    full = [r for r in dec if r["component_type"] == "full"]
    assert len(dec) == 24 and len(full) == 8
    for r in full:
        want = whole[r["resid"], r["contrast_name"]]
        assert all(abs(r[c] - want[c]) < 1e-9 for c in ("auc", "cohens_d", "accuracy_midpoint", "mean_a", "sd_b")) and (r["n_a"], r["n_b"]) == (20, 20)
