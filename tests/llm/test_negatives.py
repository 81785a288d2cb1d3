import math
import random

import numpy as np
from pyspark.sql import functions as F

from facetlens.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label long"


def expected(rows, k=5, floor=80, several=5):
    """All scores of all pairs in whole numbers, sorted."""
    taken = []
    for r in rows:
        v = r["embedding"]
        if r["label"] is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            taken.append((r["vec_id"], r["label"], [math.floor(256 * x) for x in v]))
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for i, (own, label, v) in enumerate(taken):
        if own is None or own % 100:
            continue
        scores = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), other, other_label) for j, (other, other_label, w) in enumerate(taken) if j != i]
        for p, positive, _ in sorted((s for s in scores if s[2] == label), key=key)[:k]:
            window = sorted((s for s in scores if s[2] != label and floor * p <= 100 * s[0] <= 100 * p), key=key)[:several]
            out += [(own, positive, rank + 1, other, p, s) for rank, (s, other, _) in enumerate(window)]
    return out


def check(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    got = H.mine(table, F.col("vec_id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = expected([dict(zip(("vec_id", "embedding", "label"), r)) for r in rows])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    return want


def test_pairs_above_against_all_pairs():
    draw = np.random.default_rng(3)
    for width in (1, 5, 16, 33):
        for share in (-0.2, 0.0, 0.1, 0.4, 0.8, 1.1):
            x = np.floor(draw.normal(size=(60, width)) * 100 * draw.uniform(0, 2, size=(60, 1)))
            q = np.floor(draw.normal(size=(7, width)) * 100)
            x[3], q[2] = 0, 0
            x[5, : width // 2], x[6, width // 2:] = 0, 0
            sides = [H.Side(len(m), "<f8", m.tobytes(), width) for m in (q, x)]
            t = share * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max() * draw.uniform(0.5, 1, 7)
            wanted = draw.random((7, 60)) < 0.7
            for mask in (None, wanted):
                a, r, score = H.pairs_above(*sides, t, mask)
                every = (q @ x.T).astype(np.int64)
                hit = every >= t[:, None] if mask is None else (every >= t[:, None]) & mask
                assert {(i, j) for i, j in zip(a, r)} == set(zip(*np.nonzero(hit))) and (score == every[a, r]).all()


def test_tables_against_all_pairs(spark, monkeypatch):
    # Small blocks, so that windows are filled from many of them.
    for name, size in (("BLOCK_ROWS", 16), ("BLOCK_ANCHORS", 2), ("CELL_ROWS", 64), ("GROUP_ANCHORS", 3)):
        monkeypatch.setattr(H, name, size)
    draw = random.Random(7)
    centre = [[draw.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = []
    for k in range(240):
        c = draw.choice(centre)
        # Ids stand a few times each, so that scores tie and anchors repeat.
        rows.append((draw.choice([k * 25, k * 25, 100 * (k % 9), k]), [x + draw.gauss(0, 0.3) for x in c], draw.randrange(4)))
    hot = [0.5, -0.25] * 6
    rows += [(7000 + k, hot, k % 2) for k in range(40)] + [(9000, hot, 0), (9000, hot, 0)]
    assert len(check(spark, rows)) > 200


def test_nulls_odd_vectors_and_few_rows(spark):
    rows = [
        (0, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (1, [1.0, 2.0, 3.0], 1), (2, [], 2), (3, [1.0, 1.9], 2), (None, [1.0, 1.95], 2), (4, None, 1), (5, [1.0, None], 1),
        (6, [float("nan"), 1.0], 2), (8, [float("inf"), 1.0], 2), (9, [1.0, 2.0], None), (100, [0.0, 0.0], 3), (101, [-1.0, -1.0], 3), (200, [-1.0, 0.5], 4), (300, [], 2), (400, [1e9, 1e9], 5), (401, [1e9, 1e9], 5),
        (402, [1e9, 0.9e9], 6),
    ]
    assert check(spark, rows)
    check(spark, [(0, [1.0], 1)])
    check(spark, [])


def test_relabelled_and_clashing_columns(spark):
    rows = [(k, [float(k % 5), float(k % 3)], k % 10 if k % 11 else None) for k in range(0, 210, 5)]
    table = H.relabelled(spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("rid", "norm", "t", "score", "cell")}))
    assert {r["vec_id"]: r["label"] for r in table.collect()} == {k: None if v is None else (v + 1) % 10 if k % 7 == 0 else v for k, _, v in rows}
    got = H.mine(table, F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(expected([r.asDict() for r in table.collect()]))


def test_other_windows(spark, floor=50):
    draw = random.Random(1)
    rows = [(k * 50, [draw.gauss(0, 1) for _ in range(4)], k % 2) for k in range(30)]
    got = H.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, 3, 2, floor).collect()
    assert sorted(map(tuple, got)) == sorted(expected([dict(zip(("vec_id", "embedding", "label"), r)) for r in rows], 3, floor, 2))


def test_blocks_do_not_pass_the_driver(spark, monkeypatch):
    """However small Spark takes blocks for, a join of them is no broadcast: anchors stand in it once a cell."""
    joins = []
    join = H._join
    monkeypatch.setattr(H, "_join", lambda *a, **b: joins.append(join(*a, **b)) or joins[-1])
    draw = random.Random(4)
    rows = [(k * 20, [draw.gauss(0, 1) for _ in range(8)], k % 3) for k in range(120)]
    assert H.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).count()
    assert len(joins) >= 2
    for df in joins:
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
