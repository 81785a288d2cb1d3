import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlens.operators import experiment as X, grid, probes, sampling


def scores(spark, rows):
    names = ["item_uid", "context_condition", *X.ROLES.values(), *X.BASE, *X.INTER]
    kinds = ["string", "string", *["int"] * 4, *["double"] * 6]
    return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def test_choice_metrics_rules(spark):
    df = scores(spark, [
        ("a", "ambig", 0, 2, 1, 2, -1.0, -2.0, -1.5, -2.0, -2.0, -1.0),
        ("d", "disambig", 0, 2, 1, 1, -1.0, -1.0, -3.0, -1.0, -0.5, -3.0),
        ("m", "disambig", None, None, None, None, -1.0, -2.0, -3.0, -1.0, -2.0, -3.0),
    ])
    got = {r["item_uid"]: r for r in X.choice_metrics(df).collect()}
    a, d, m = got["a"], got["d"], got["m"]
    assert (a["bias_margin_base"], a["bias_margin_intervened"]) == (0.5, -1.0) and a["prediction_changed"]
    assert (a["predicted_base"], a["predicted_intervened"], a["correct_intervened"]) == (0, 2, True)
    assert d["predicted_base"] == 0 and d["predicted_intervened"] == 1 and d["bias_margin_base"] == 0.0
    assert m["bias_margin_delta"] is None and not m["correct_base"] and m["stereotyped_delta"] is None
    soft = X.choice_softmax(df).first()
    assert sum(soft[f"ans{i}_choice_prob_base"] for i in range(3)) == pytest.approx(1)


def test_interpretation_label_order(spark):
    cols = ["mean_bias_margin_delta", "mean_unknown_delta", "mean_nonstereotyped_delta", "mean_correct_delta", "accuracy_change_disambig"]
    rows = [
        ((-1.0, 1.0, 0.0, -0.5, 0.0), "capability_degrading"), ((-1.0, 1.0, 0.0, 0.0, None), "bias_reducing_uncertainty_increasing"),
        ((-1.0, -1.0, 0.5, 0.0, 0.0), "substitution_effect"), ((0.0, 0.0, 0.0, 0.0, 0.0), "no_effect"),
        ((0.3, 0.0, 0.0, 0.0, 0.0), "identity_salience_only"), ((None, None, None, None, None), "identity_salience_only"),
    ]
    df = spark.createDataFrame([(*r, w) for r, w in rows], ", ".join(f"{c} double" for c in cols) + ", want string")
    for r in df.withColumn("got", X.interpretation_label()).collect():
        assert r["got"] == r["want"]


def test_bootstrap(spark):
    rng = np.random.default_rng(5)
    rows = [("big", f"i{i % 400}", float(rng.normal())) for i in range(1200)] + [("one", "x", 2.0), ("one", "x", 4.0), (None, "p", 1.0), (None, "q", 3.0)]
    df = spark.createDataFrame(rows, "k string, item string, x double")
    means = {}
    for k, i, x in rows[:1200]:
        means.setdefault(i, []).append(x)
    m = np.array([np.mean(v) for v in means.values()])
    se = m.std() / np.sqrt(len(m))
    got = {r["k"]: r for r in X.bootstrap_mean_ci(df, ["k"], "item", "x", 300).collect()}
    assert (got["one"]["ci_low"], got["one"]["ci_high"]) == (3.0, 3.0)
    assert 1.0 <= got[None]["ci_low"] <= got[None]["ci_high"] <= 3.0
    assert got["big"]["ci_low"] == pytest.approx(m.mean() - 1.96 * se, abs=0.5 * se)
    assert got["big"]["ci_high"] == pytest.approx(m.mean() + 1.96 * se, abs=0.5 * se)


def test_bootstrap_by_all_weights(spark, monkeypatch):
    """Every replicate by hand, with batches cut small and sums sent often."""
    import hashlib

    monkeypatch.setattr(X, "WEIGHT_ROWS", 3)
    monkeypatch.setattr(X, "KEPT_GROUPS", 2)
    rows = [(g, h, f"i{i}", float(i * i % 17)) for g in ("a", None, "b", "c") for h in (1.5, None) for i in range(11)]
    got = X.bootstrap_mean_ci(spark.createDataFrame(rows, "g string, h double, item string, x double").repartition(5), ["g", "h"], "item", "x", 40).collect()
    assert len(got) == 8
    digest = [hashlib.md5(f"0:i{i}".encode()).hexdigest() for i in range(11)]
    w = X.replicate_weights(*(np.array([int(d[k:k + 8], 16) for d in digest]) for k in (0, 8)), 40)

    def mix(x):
        for _ in range(2):
            x = (x ^ x >> 16) * X.MIX % 2**32
        return x ^ x >> 16

    for i, d in enumerate(digest):
        for rep in range(40):
            u = mix(mix((int(d[:8], 16) + rep * X.STEP) % 2**32) ^ int(d[8:16], 16)) / 2**32
            assert w[i, rep] == sum(u >= c for c in X.POISSON_CDF)
    x = np.array([i * i % 17 for i in range(11)])
    low, high = np.percentile((w * x[:, None]).sum(0) / w.sum(0), [2.5, 97.5])
    assert all(r["ci_low"] == pytest.approx(low) and r["ci_high"] == pytest.approx(high) for r in got)
    big = X.replicate_weights(np.arange(20_000) * 7919, np.arange(20_000), 50)
    assert abs(big.mean() - 1) < 0.01 and abs(big.var() - 1) < 0.02 and abs(np.corrcoef(big[:, 0], big[:, 1])[0, 1]) < 0.03


def test_samples_and_folds(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", f"t{i % 11}") for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, s string, g string")
    picks = [
        sorted(r["row_id"] for r in sampling.stratified_sample(df.repartition(n), F.col("s"), "row_id", 100, seed=1).collect()) for n in (1, 6)
    ]
    assert picks[0] == picks[1] and len(picks[0]) == 100
    assert len(set(r["s"] for r in df.filter(F.col("row_id").isin(picks[0])).collect())) == len(set(r[1] for r in rows))
    assert sampling.uniform_sample(df, "row_id", 50).count() == 50
    folds = sampling.group_kfold(df, "g", 4).collect()
    assert len(folds) == 11 and {r["fold"] for r in folds} == {0, 1, 2, 3}
    assert {r["fold"] for r in sampling.group_kfold(df.filter("g IN ('t1', 't2')"), "g", 5).collect()} == {0, 1}
    # Many groups of many sizes, null among them: every group once, folds within one largest group.
    many = spark.range(3000).selectExpr("CASE WHEN id < 40 THEN NULL ELSE concat('g', CAST(pow(id, 0.75) AS INT)) END AS g")
    dealt = sampling.group_kfold(many, "g", 7).collect()
    assert len(dealt) == len({r["g"] for r in dealt}) and sum(r["n"] for r in dealt) == 3000
    size = {}
    for r in dealt:
        size[r["fold"]] = size.get(r["fold"], 0) + r["n"]
    assert max(size.values()) - min(size.values()) <= max(r["n"] for r in dealt)
    assert [r["n"] for r in sorted(dealt, key=lambda r: (-r["n"], r["g"] is not None, r["g"]))][0] == 40
    assert sampling.group_kfold(many.limit(0), "g", 3).count() == 0


def test_probe_has_no_leak_and_learns(spark):
    rng = np.random.default_rng(2)
    rows = []
    for layer in (5, 6):
        for i in range(240):
            y = i % 3
            spread = 0.3 if layer == 5 else 1.5
            rows.append((layer, i, f"c{y}", f"t{i // 3 % 8}", "odd" if i % 2 else "even", [float(v) for v in rng.normal(size=4) * spread + np.eye(4)[y] * 2]))
    df = spark.createDataFrame(rows, "layer int, row_id long, cls string, grp string, half string, pcs array<double>").repartition(5)
    tasks = [probes.Task("all", "cls", "grp"), probes.Task("odd", "cls", "grp", "half = 'odd'"), probes.Task("one class", "half", "grp", "half = 'odd'")]
    pred = probes.cross_validated_predictions(df, tasks, 4)
    every = pred.filter("task = 'all'").join(df, ["layer", "row_id"])
    per_group = every.groupBy("layer", "grp").agg(F.countDistinct("fold").alias("n")).collect()
    assert all(r["n"] == 1 for r in per_group) and every.count() == 480
    got = {(r["layer"], r["split_type"]): r for r in probes.grouped_probe(df, tasks, 4).collect()}
    assert set(got) == {(k, t) for k in (5, 6) for t in ("all", "odd")}
    assert 0.9 < got[5, "all"]["accuracy_mean"] <= 1 and 0.9 < got[5, "odd"]["macro_f1_mean"] <= 1 and got[6, "all"]["accuracy_mean"] < 1
    assert [(r["n_classes"], r["n_samples"], r["n_folds"]) for r in (got[5, "all"], got[6, "odd"])] == [(3, 240, 4), (3, 120, 4)]

    # Against single fits by another optimiser, on uneven classes.
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    uneven = df.filter("layer = 6 AND NOT (cls = 'c1' AND row_id % 5 < 3)")
    pred = probes.cross_validated_predictions(uneven, tasks[:1], 3)
    for fold in range(3):
        test = pred.filter(F.col("fold") == fold)
        rows = uneven.join(test.select("row_id", "label", "prediction"), "row_id", "left").withColumn("y", F.substring("cls", 2, 1).cast("double"))
        train = rows.filter("label IS NULL").drop("label", "prediction").withColumn("v", array_to_vector("pcs"))
        n = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
        weight = F.create_map(*[F.lit(x) for y, c in n.items() for x in (y, sum(n.values()) / (3 * c))])
        fit = LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", family="multinomial", maxIter=200, tol=1e-9, regParam=1 / sum(n.values()), standardization=False).fit(train.withColumn("w", weight[F.col("y")]))
        held = rows.filter("label IS NOT NULL").withColumn("v", array_to_vector("pcs")).withColumnRenamed("prediction", "own")
        assert fit.transform(held).filter("own <> prediction").count() == 0


def test_quasi_newton_step_reaches_the_minimum():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(30, 12))
    h, b = a.T @ a + np.eye(12), rng.normal(size=12)
    m = probes.Model(np.ones(2), np.zeros(12), 1.0)
    for _ in range(100):
        x = m.trial
        m.take(0.5 * x @ h @ x - b @ x, h @ x - b, 1e-9)
        if m.done:
            break
    assert np.allclose(m.point, np.linalg.solve(h, b), atol=1e-7)


def test_random_directions_are_normal_and_portable(spark):
    df = spark.range(400).selectExpr("id", "CASE WHEN id > 0 THEN id * 7919 END AS seed")
    got = {r["id"]: r["vec"] for r in grid.random_directions(df.repartition(7), "seed", 24).collect()}
    again = {r["id"]: r["vec"] for r in grid.random_directions(df.coalesce(1), "seed", 24).collect()}
    assert got == again and got[0] is None
    m = np.array([got[i] for i in range(1, 400)])
    assert np.allclose((m**2).sum(1), 1) and abs(m.mean()) < 0.01
    z = np.sort((m * np.sqrt(24)).ravel())
    normal = np.array([statistics.NormalDist().cdf(x) for x in z])
    assert np.abs(normal - np.arange(len(z)) / len(z)).max() < 0.03
    assert np.abs(np.corrcoef(m.T) - np.eye(24)).max() < 0.25


def test_grid_controls_and_pending(spark):
    items = spark.createDataFrame([(f"i{n}", "age" if n % 2 else "ses") for n in range(6)], "item_uid string, axis_mapped string")
    sets = spark.createDataFrame(
        [(8, "s1", "age", [1, 5], [1.0, -1.0]), (8, "s2", "none", [2], [1.0])], "layer int, set_id string, axis string, feature_ids array<int>, signs array<double>"
    )
    jobs = grid.experiment_grid(items, sets, [0.5, 1.0], ["p"], ["m1", "m2"], "s")
    assert jobs.count() == 3 * 4 and jobs.select("job_id").distinct().count() == 12
    assert grid.pending(jobs, jobs.limit(5)).count() == 7
    every = grid.experiment_grid(items, sets, [0.5, 1.0], ["p"], ["m1", "m2"], "s", "all")
    assert every.count() == 6 * 2 * 4 and every.select("job_id").distinct().count() == 48
    assert every.filter("axis = axis_mapped").select("job_id").exceptAll(jobs.select("job_id")).isEmpty()
    with pytest.raises(ValueError):
        grid.experiment_grid(items, sets, [0.5], ["p"], ["m1"], "s", "some")
    controls = grid.control_rows(items, sets, [0.5], "s", n_features=3).collect()
    assert len(controls) == 9
    for r in controls:
        if r["control_type"] == "sign_flip":
            assert r["signs"] == [-1.0, 1.0]
        if r["control_type"] == "random_feature_matched":
            assert len(set(r["feature_ids"])) == 2 and set(r["feature_ids"]) <= {0, 1, 2}


def test_control_rows_takes_every_feature_set(views):
    """The sets are those the tables lead to, as in the experiment grid."""
    from facetlens.plans import experiment_queries as Q

    wanted = {(r["layer"], r["set_id"]) for r in Q.experiment_grid(views).select("layer", "set_id").distinct().collect()}
    got = Q.control_rows(views).groupBy("layer", "set_id").agg(F.countDistinct("alpha").alias("a"), F.countDistinct("control_type").alias("c")).collect()
    assert wanted and {(r["layer"], r["set_id"]) for r in got} == wanted
    assert all((r["a"], r["c"]) == (len(Q.RESULT_ALPHAS), len(grid.CONTROLS)) for r in got)


def test_summary_counts_items_once_and_sets_apart(spark):
    """Means, distinct counts and intervals by hand, with null items and sets; no copy of the rows for each distinct count."""
    rng = random.Random(3)
    names = ["k", "item_uid", "feature_set_id", "context_condition", "prediction_changed", "correct_base", "correct_intervened", *X.MEAN_COLS]
    pick = lambda *xs: rng.choice(xs)
    rows = [
        (pick("a", "b", None), pick("i1", "i2", "i3", None), pick("s1", "s2", None), pick("ambig", "disambig", None), pick(True, False, None), pick(True, False), pick(True, False, None),
         *[pick(None, float(rng.randrange(-8, 9))) for _ in X.MEAN_COLS])
        for _ in range(120)
    ] + [("empty", None, None, None, None, None, None, *[None] * 5)]
    types = ["string"] * 4 + ["boolean"] * 3 + ["double"] * 5
    df = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types))).repartition(5)
    rows = [dict(zip(names, r)) for r in rows]
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    for keys in (["k"], ["k", "feature_set_id"]):
        out = X.experiment_summary(df, keys, 30)
        assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {tuple(r[k] for k in keys): r for r in out.collect()}
        plain = {tuple(r[k] for k in keys): r for r in X.bootstrap_mean_ci(df, keys, "item_uid", "bias_margin_delta", 30).collect()}
        assert got.keys() == {tuple(r[k] for k in keys) for r in rows}
        for key, r in got.items():
            own = [x for x in rows if tuple(x[k] for k in keys) == key]
            distinct = lambda c: len({x[c] for x in own} - {None})
            assert (r["n_rows"], r["n_items"], r["n_featuresets"]) == (len(own), distinct("item_uid"), distinct("feature_set_id"))
            for c in X.MEAN_COLS:
                assert r[f"mean_{c}"] == pytest.approx(mean([x[c] for x in own if x[c] is not None]))
            assert r["prediction_change_rate"] == pytest.approx(mean([float(bool(x["prediction_changed"])) for x in own]))
            gain = [float(x["correct_intervened"]) - float(x["correct_base"]) for x in own if x["context_condition"] == "disambig" and x["correct_intervened"] is not None]
            assert r["accuracy_change_disambig"] == (pytest.approx(mean(gain)) if gain else None)
            for c in ("ci_low", "ci_high"):
                want = plain[key][c] if key in plain else None
                assert r[c] == (pytest.approx(want) if want is not None else None)


def test_scores_are_written_without_texts_and_labels_nobody_reads(spark, sf_dir, monkeypatch):
    from facetlens.plans import experiment_queries, views

    written, real = {}, views.settle
    monkeypatch.setattr(views, "settle", lambda df, name: written.setdefault(name, df.columns) and real(df, name))
    v = views.Views(spark, sf_dir)
    assert experiment_queries.strongest_examples(v).count() == 20
    assert "results" not in written and not {"context", "prompt", "question"} & set(written["scored-items"])
    experiment_queries.bootstrap_mean_ci(v)
    assert len(written["results"]) == 4
