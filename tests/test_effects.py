import numpy as np
import pytest

from facetlens.operators import effects
from facetlens.operators.quantiles import exact_medians, exact_percentiles
from helpers import brute_auc, brute_d


@pytest.fixture(scope="module")
def skewed():
    """One key holds most rows; scores repeat often; one key lacks a class; one has single rows."""
    rng = np.random.default_rng(0)
    rows = []
    for key, n, levels in (("hot", 4000, 37), ("cold", 40, 1000), ("flat", 20, 1)):
        rows += [(i, key, float(rng.integers(levels)) / 7, bool(rng.random() < 0.4)) for i in range(n)]
    rows += [(0, "one_class", 1.0, True), (1, "one_class", 2.0, True), (0, "pair", 1.0, True), (1, "pair", 0.0, False)]
    return rows


def by_key(rows):
    keys = sorted({r[1] for r in rows})
    return {k: ([r[2] for r in rows if r[1] == k and r[3]], [r[2] for r in rows if r[1] == k and not r[3]]) for k in keys}


@pytest.mark.parametrize("blocks", [1, 2, 64])
def test_endpoint_metrics_match_brute_force(spark, skewed, blocks):
    df = spark.createDataFrame(skewed, "row_id long, key string, score double, is_a boolean")
    got = {r["key"]: r for r in effects.endpoint_metrics(df, ["key"], blocks=max(2, blocks)).collect()}
    for key, (a, b) in by_key(skewed).items():
        assert got[key]["auc"] == (None if brute_auc(a, b) is None else pytest.approx(brute_auc(a, b), abs=1e-12))
        d = brute_d(a, b)
        assert got[key]["cohens_d"] == (None if d is None else pytest.approx(d, abs=1e-9))
        assert (got[key]["n_a"], got[key]["n_b"]) == (len(a), len(b))
        if a and b:
            mid = (np.mean(a) + np.mean(b)) / 2
            want = (sum(x >= mid for x in a) + sum(x < mid for x in b)) / (len(a) + len(b))
            assert got[key]["accuracy_midpoint"] == pytest.approx(want)


def test_standalone_metrics_agree(spark, skewed):
    df = spark.createDataFrame(skewed, "row_id long, key string, score double, is_a boolean")
    full = {r["key"]: r for r in effects.endpoint_metrics(df, ["key"]).collect()}
    for r in effects.auc(df, ["key"]).collect():
        assert r["auc"] == full[r["key"]]["auc"]
    for r in effects.cohens_d(df, ["key"]).collect():
        want = full[r["key"]]["cohens_d"]
        assert r["cohens_d"] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_swapping_endpoints_mirrors(spark, skewed):
    df = spark.createDataFrame(skewed, "row_id long, key string, score double, is_a boolean")
    a = {r["key"]: r for r in effects.endpoint_metrics(df, ["key"]).collect()}
    b = {r["key"]: r for r in effects.endpoint_metrics(df.selectExpr("row_id", "key", "score", "NOT is_a AS is_a"), ["key"]).collect()}
    for k in ("hot", "cold"):
        assert a[k]["auc"] + b[k]["auc"] == pytest.approx(1)
        assert a[k]["cohens_d"] == pytest.approx(-b[k]["cohens_d"])


def test_macro_f1_is_unweighted(spark):
    rows = [("a", "a")] * 8 + [("a", "b")] * 2 + [("b", "a")] * 1 + [("b", "b")] * 1 + [("a", "c")]
    r = effects.macro_f1(spark.createDataFrame([(1, *x) for x in rows], "g int, label string, prediction string"), ["g"]).first()
    f = lambda tp, t, p: 2 * tp / (t + p)
    assert r["macro_f1"] == pytest.approx(np.mean([f(8, 11, 9), f(1, 2, 3), f(0, 0, 1)]))
    assert r["accuracy"] == pytest.approx(9 / 13)


@pytest.mark.parametrize("blocks", [2, 5, 16])
def test_percentiles_match_numpy(spark, skewed, blocks):
    df = spark.createDataFrame(skewed, "row_id long, key string, score double, is_a boolean")
    got = {r["key"]: r for r in exact_percentiles(df, ["key"], "score", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}, blocks).collect()}
    for key, (a, b) in by_key(skewed).items():
        want = np.percentile(a + b, [0, 50, 95, 100])
        assert [got[key][c] for c in ("p0", "p50", "p95", "p100")] == pytest.approx(list(want))
    med = {r["key"]: r["m"] for r in exact_medians(df, ["key"], {"score": "m"}).collect()}
    assert med == pytest.approx({k: float(np.median(a + b)) for k, (a, b) in by_key(skewed).items()})
