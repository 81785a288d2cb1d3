"""A sample of the registered queries against their SQL, and registry checks."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "endpoint_metrics", "variance_decomposition", "cross_axis_projection_summary", "linear_relu_topk", "contrast_feature_selectivity",
    "prompt_grid", "assign_answer_roles", "match_contrast", "entity_span", "token_ranks", "token_localization",
    "triage_roles", "feature_set_build", "choice_metrics", "experiment_summary", "coverage_report", "stratified_sample",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    idx = [names.index(c) for c in cols]
    want = Counter(tuple(norm(r[i]) for i in idx) for r in cur.fetchall())
    assert got == want


def test_every_oracle_parses(con):
    for name, sql in entry.oracle_sql().items():
        con.execute("EXPLAIN " + sql)
        assert name in entry.queries()


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() == 72
