"""Queries on readers, writers, conformance, sampling, folds and set operations.

Readers are exercised on tables that Spark writes from the given data into the session's
shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from facetlens.functions.settle import shared_root
from facetlens.operators import effects, geometry as G, items, sampling
from facetlens.plans.geometry_queries import explode_vec, r_cols
from facetlens.plans.item_queries import ROLE_COLS, prompt_grid
from facetlens.plans.registry import query
from facetlens.plans.sqlviews import R
from facetlens.sources import tables as S


def out_path(v, name: str) -> str:
    """A fresh folder for a table that a reader query writes first."""
    root = shared_root(v.spark)
    if root is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root}/sources/{name}-{uuid.uuid4().hex}"


@query("read_prompt_metadata", "SELECT * FROM v_prompts")
def read_prompt_metadata(v):
    path = out_path(v, "prompts")
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "header": True, "escape": '"'}
    prompt_grid(v).write.options(**keep).csv(path)
    return S.read_prompt_metadata(v.spark, path).select(*S.PROMPT_COLUMNS)


@query(
    "read_vectors_aligned",
    """SELECT l.layer, count(r.row_id) > 0 AS present, count(r.row_id) AS n_rows, count(r.row_id) FILTER (WHERE r.row_id % 10 = 3) AS n_unlabelled,
 CASE WHEN count(r.row_id) > 0 THEN (SELECT count(*) FROM v_meta WHERE row_id % 10 <> 3) - count(r.row_id) FILTER (WHERE r.row_id % 10 <> 3) END AS n_missing_vectors,
 CASE WHEN count(r.row_id) > 0 THEN 64 END AS min_dim, CASE WHEN count(r.row_id) > 0 THEN 64 END AS max_dim
FROM (VALUES (8), (16), (24), (32)) l(layer) LEFT JOIN (SELECT y.layer, m.row_id FROM v_meta m, v_layers y WHERE NOT (y.layer = 16 AND m.row_id % 50 = 7)) r ON r.layer = l.layer GROUP BY l.layer""",
)
def read_vectors_aligned(v):
    """The alignment report that the reader's checks are made from, on damaged inputs."""
    vec = v.vectors.filter("NOT (layer = 16 AND row_id % 50 = 7)")
    return S.vector_alignment(vec, v.meta.filter("row_id % 10 <> 3"), [8, 16, 24, 32])


@query("missing_requested", "SELECT unnest([32, 40]) AS layer FROM (SELECT count(*) FROM embeddings)")
def missing_requested(v):
    want = v.spark.createDataFrame([(x,) for x in (8, 24, 32, 40)], "layer int")
    return S.missing_requested(want, v.vectors, "layer")


@query(
    "vector_weight_alignment",
    """SELECT layer, name, name_layer, name_position, name_width, 64 AS vector_dim, wd AS weight_dim_min, wd AS weight_dim, nf AS n_features, coalesce(name_layer = layer, true) AND coalesce(name_position, 'R') = 'R' AND wd = 64 AS passed, st AS parse_status
FROM (VALUES (8, 'x/L08R-8x/final', 8, 'R', 8, 'parsed'), (16, 'run_layer_16.resid_post_32x', 16, 'R', 32, 'parsed'), (24, 'L23M-8x', 23, 'M', 8, 'parsed')) t(layer, name, name_layer, name_position, name_width, st),
 (SELECT count(DISTINCT feature_id) AS nf, max(pos + 1)::INT AS wd FROM v_wdec) WHERE EXISTS (SELECT 1 FROM embeddings)""",
)
def vector_weight_alignment(v):
    names = v.spark.createDataFrame([(8, "x/L08R-8x/final"), (16, "run_layer_16.resid_post_32x"), (24, "L23M-8x")], "layer int, name string")
    return S.vector_weight_alignment(v.vectors, v.dec_weights, names)


@query(
    "read_contrasts_valid",
    """SELECT contrast_name, axis, entity_a, entity_b, (SELECT count(*) FROM v_contrasts) - count(*) OVER () AS n_skipped
FROM v_contrasts WHERE entity_a IN (SELECT entity FROM v_meta) AND entity_b IN (SELECT entity FROM v_meta)""",
)
def read_contrasts_valid(v):
    valid = G.valid_contrasts(v.contrasts, v.meta).select(*G.CONTRAST)
    counts = v.contrasts.select(F.count(F.lit(1))).scalar() - valid.select(F.count(F.lit(1))).scalar()
    return valid.withColumn("n_skipped", counts)


RES = ["item_uid", "feature_set_id", "alpha", "bias_margin_delta", "prediction_changed"]


@query(
    "read_result_parts",
    f"SELECT item_uid, feature_set_id, alpha, {R('bias_margin_delta')} AS bias_margin_delta, CASE WHEN doc_id % 3 <> 0 THEN prediction_changed END AS prediction_changed FROM v_labelled",
)
def read_result_parts(v):
    """Two Parquet parts and one CSV part that lacks a column's values."""
    folder = out_path(v, "parts")
    r = v.labelled_results
    for i in (1, 2):
        r.filter(f"doc_id % 3 = {i}").select(*RES).write.parquet(f"{folder}/part_0000{i}.parquet")
    r.filter("doc_id % 3 = 0").select(*RES[:-1], F.lit(None).cast("boolean").alias("prediction_changed")).write.option("header", True).csv(f"{folder}/part_00003.csv")
    return r_cols(S.read_result_parts(v.spark, folder, r.select(*RES).schema), ["bias_margin_delta"])


@query(
    "read_items_jsonl",
    """SELECT example_id, question_index::VARCHAR AS question_index, category_raw AS category, context, question, ans1, correct_answer_idx AS label, array_to_string(stereotyped_groups, '|') AS groups, ans0 || '|' || l0 AS info0 FROM v_raw""",
)
def read_items_jsonl(v):
    path = out_path(v, "items")
    info = F.create_map(*[
        x for i in range(3) for x in (F.lit(f"ans{i}"), F.array(F.get("answer_texts", i), F.get("answer_labels", i)))
    ])
    meta = F.struct(F.lit("").alias("subcategory"), F.col("stereotyped_groups"))
    v.raw_items.select(
        "example_id", F.col("question_index").cast("string").alias("question_index"), F.col("category_raw").alias("category"), "context_condition", "question_polarity",
        "context", "question", "ans0", "ans1", "ans2", F.col("correct_answer_idx").alias("label"), info.alias("answer_info"), meta.alias("additional_metadata"),
    ).write.json(path)
    i = S.read_items_jsonl(v.spark, path)
    return i.select(
        "example_id", "question_index", "category", "context", "question", "ans1", "label",
        F.array_join("additional_metadata.stereotyped_groups", "|").alias("groups"), F.array_join(F.col("answer_info")["ans0"], "|").alias("info0"),
    )


_RAW_TEXT, _RAW_LABEL = "[ans0, ans1, ans2]", "CASE WHEN doc_id % 6 = 5 THEN [ans0, ans1, ans2] ELSE [l0, l1, l2] END"


def _raw_lines(v, name, sparse):
    """The items as JSON lines, with lines that are none; with ``sparse`` some items lack fields."""
    path = out_path(v, name)
    lacks = lambda n, c: F.when(~F.lit(sparse) | (F.col("doc_id") % n != n - 1), c)
    info = F.struct(*[
        F.when(F.lit(sparse) & (F.col("doc_id") % 6 == 5), F.array(F.get("answer_texts", i))).otherwise(F.array(F.get("answer_texts", i), F.get("answer_labels", i))).alias(f"ans{i}") for i in range(3)
    ])
    meta = F.struct(F.lit("s").alias("subcategory"), F.col("stereotyped_groups"))
    line = F.to_json(F.struct(
        "example_id", "question_index", F.col("category_raw").alias("category"), "context_condition", "question_polarity", lacks(7, F.col("context")).alias("context"), "question",
        "ans0", "ans1", "ans2", F.col("correct_answer_idx").alias("label"), info.alias("answer_info"), lacks(4, meta).alias("additional_metadata")))
    odd = F.when(F.col("doc_id") % 50 == 0, F.array(line, F.lit('{"example_id": 1, '))).when(F.col("doc_id") % 50 == 1, F.array(F.lit("[1, 2]"), line, F.lit("  "))).otherwise(F.array(line))
    v.raw_items.select(F.explode(odd)).write.text(path)
    return S.read_raw_items(v.spark, path)


@query(
    "read_raw_items",
    f"""SELECT doc_id::VARCHAR AS example_id, (doc_id % 7)::VARCHAR AS question_index, category_raw, CASE WHEN doc_id % 4 <> 3 THEN 's' ELSE '' END AS subcategory,
 CASE WHEN doc_id % 7 <> 6 THEN coalesce(context, '') ELSE '' END AS context, question, ans2, correct_answer_idx, array_to_string({_RAW_TEXT}, '|') AS texts, array_to_string({_RAW_LABEL}, '|') AS labels,
 CASE WHEN doc_id % 4 <> 3 THEN array_to_string(stereotyped_groups, '|') ELSE '' END AS groups, (SELECT count(*) FILTER (doc_id % 50 < 2) FROM v_raw) AS bad_lines FROM v_raw""",
)
def read_raw_items(v):
    """Items of lines that lack fields, and the number of lines that hold none."""
    i, bad = _raw_lines(v, "raw-items-sparse", True)
    join = lambda c, name: F.array_join(c, "|").alias(name)
    out = i.select("example_id", "question_index", "category_raw", "subcategory", "context", "question", "ans2", "correct_answer_idx", join("answer_texts", "texts"), join("answer_labels", "labels"), join("stereotyped_groups", "groups"))
    return out.withColumn("bad_lines", bad.agg(F.count(F.lit(1)).alias("n")).select("n").scalar())


@query(
    "prepare_raw_items",
    f"SELECT w.doc_id::VARCHAR AS example_id, {', '.join('r.' + c for c in ROLE_COLS if c != 'item_uid')} FROM v_roles r JOIN v_raw w USING (item_uid)",
)
def prepare_raw_items(v):
    """From JSON lines to the roles of the answers."""
    i, _ = _raw_lines(v, "raw-items", False)
    roles = items.assign_answer_roles(i.withColumn("item_uid", F.col("example_id")), v.aliases)
    return roles.select(F.col("item_uid").alias("example_id"), *[c for c in ROLE_COLS if c != "item_uid"])


@query(
    "conform_columns",
    """SELECT l_linenumber::DOUBLE AS feature_id, CASE WHEN l_orderkey % 5 <> 0 THEN l_tax END AS combined_score, l_discount AS auc, l_returnflag AS contrast_name, l_quantity AS cosine_with_direction FROM lineitem""",
)
def conform_columns(v):
    t = v.table("lineitem")
    raw = t.select(
        F.col("l_linenumber").cast("string").alias(" feature "), F.when(F.col("l_orderkey") % 5 == 0, F.lit("bad")).otherwise(F.col("l_tax").cast("string")).alias("score"),
        F.col("l_discount").cast("string").alias("roc_auc"), F.col("l_returnflag").alias("contrast"), F.col("l_quantity").alias("decoder_cosine"),
    )
    return S.conform_columns(raw)


@query(
    "read_token_tables",
    "SELECT 24::DOUBLE AS layer, feature_id::DOUBLE AS feature_id, prompt_id, token_idx::DOUBLE AS token_idx, token_str, act AS token_feature_activation FROM v_tok WHERE prompt_id % 2 = 0 UNION ALL SELECT 24, feature_id, prompt_id, token_idx, token_str, act FROM v_tok WHERE prompt_id % 2 = 1 AND feature_id <> 40",
)
def read_token_tables(v):
    """A Parquet table without a layer column and one with a foreign layer, both in alias names."""
    a, b = out_path(v, "tokens"), out_path(v, "tokens")
    names = {"feature_id": "feature", "prompt_id": "row_idx", "token_str": "token", "token_feature_activation": "value"}
    t = v.tokens.select("layer", "feature_id", "prompt_id", "token_idx", "token_str", "token_feature_activation")
    t.filter("prompt_id % 2 = 0").drop("layer").withColumnsRenamed(names).write.parquet(a)
    odd = t.filter("prompt_id % 2 = 1").withColumn("layer", F.when(F.col("feature_id") == 40, F.lit(8)).otherwise(F.col("layer")))
    odd.withColumnsRenamed(names).write.parquet(b)
    cols = ["layer", "feature_id", "prompt_id", "token_idx", "token_str", "token_feature_activation"]
    return S.read_token_tables(v.spark, a, None, 24, cols).unionByName(S.read_token_tables(v.spark, b, None, 24, cols))


@query("write_tables", f"SELECT layer, row_id, {R('activation')} AS activation, feature_id FROM v_codes UNION ALL SELECT layer, row_id, {R('activation')}, feature_id FROM v_codes WHERE feature_id < 10")
def write_tables(v):
    """A partitioned write, then an append, read back."""
    path = out_path(v, "codes")
    cols = ["layer", "row_id", "feature_id", "activation"]
    S.write_table(v.codes, path, cols, partition_by=["layer"])
    S.write_table(v.codes.filter("feature_id < 10"), path, cols, mode="append", partition_by=["layer"])
    return r_cols(v.spark.read.parquet(f"{path}.parquet"), ["activation"])


@query(
    "distinct_rows",
    """SELECT 'full' AS kind, o_custkey, o_orderstatus, NULL::BIGINT AS o_orderkey FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)
UNION ALL SELECT 'key', o_custkey, arg_min(o_orderstatus, (-o_totalprice, o_orderkey)), arg_min(o_orderkey, (-o_totalprice, o_orderkey)) FROM orders GROUP BY o_custkey""",
)
def distinct_rows(v):
    o = v.table("orders")
    full = o.select("o_custkey", "o_orderstatus").distinct().select(F.lit("full").alias("kind"), "*", F.lit(None).cast("bigint").alias("o_orderkey"))
    one = S.drop_duplicates_ordered(o.select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice"), ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")])
    return full.unionByName(one.select(F.lit("key").alias("kind"), "o_custkey", "o_orderstatus", "o_orderkey"))


STRAT = "(SELECT row_id, axis || '||' || family AS s, md5(concat_ws(':', '7', row_id)) AS h, axis, family FROM v_meta)"


def _strat_sql(n):
    return f"""SELECT row_id, axis, family FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h) AS rn FROM {STRAT})
ORDER BY (rn > ceil({n}.0 / (SELECT count(DISTINCT s) FROM {STRAT})))::INT, h LIMIT {n}"""


@query("stratified_sample", f"SELECT * FROM (SELECT 100 AS max_rows, * FROM ({_strat_sql(100)})) UNION ALL SELECT * FROM (SELECT 403, * FROM ({_strat_sql(403)}))")
def stratified_sample(v):
    out = None
    for n in (100, 403):
        s = sampling.stratified_sample(v.meta, F.concat_ws("||", "axis", "family"), "row_id", n, seed=7)
        part = s.select(F.lit(n).alias("max_rows"), "row_id", "axis", "family")
        out = part if out is None else out.unionByName(part)
    return out


@query("uniform_sample", "SELECT doc_id, lang FROM documents ORDER BY md5(concat_ws(':', '3', doc_id)) LIMIT 150")
def uniform_sample(v):
    return sampling.uniform_sample(v.table("documents"), "doc_id", 150, seed=3).select("doc_id", "lang")


@query(
    "group_kfold",
    """SELECT template_id, n, CASE WHEN slot < k THEN slot ELSE 2 * k - 1 - slot END::INT AS fold FROM (SELECT *, (row_number() OVER (ORDER BY n DESC, template_id) - 1) % (2 * k) AS slot FROM (
 SELECT template_id, n, least(5, count(*) OVER ()) AS k FROM (SELECT template_id, count(*) AS n FROM v_meta GROUP BY template_id)))""",
)
def group_kfold(v):
    return sampling.group_kfold(v.meta, "template_id", 5)


@query(
    "macro_f1",
    f"""WITH p AS (SELECT c_nationkey % 4 AS g, c_mktsegment AS label, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN 'BUILDING' ELSE 'OTHER' END AS prediction FROM customer),
 cl AS (SELECT DISTINCT g, label AS cls FROM p UNION SELECT DISTINCT g, prediction FROM p),
 s AS (SELECT cl.g, cls, count(*) FILTER (WHERE label = cls) AS nt, count(*) FILTER (WHERE prediction = cls) AS np, count(*) FILTER (WHERE label = cls AND prediction = cls) AS tp FROM cl JOIN p USING (g) GROUP BY cl.g, cls)
SELECT g, {R('avg(2.0 * tp / (nt + np))')} AS macro_f1, {R('sum(tp) / sum(nt)')} AS accuracy, count(*) FILTER (WHERE nt > 0) AS n_classes FROM s GROUP BY g""",
)
def macro_f1(v):
    k = F.col("c_custkey") % 3
    p = v.table("customer").select(
        (F.col("c_nationkey") % 4).alias("g"), F.col("c_mktsegment").alias("label"),
        F.when(k == 0, F.col("c_mktsegment")).when(k == 1, F.lit("BUILDING")).otherwise(F.lit("OTHER")).alias("prediction"),
    )
    return r_cols(effects.macro_f1(p, ["g"]), ["macro_f1", "accuracy"])


@query(
    "vector_edit",
    f"""WITH e AS (SELECT v.layer, v.row_id, v.pos, v.x, w.w, sum(v.x * w.w) OVER p AS xd, sqrt(sum(w.w * w.w) OVER p) AS nw FROM v_long v JOIN v_wdec w ON w.pos = v.pos AND w.feature_id = v.row_id % 96 WINDOW p AS (PARTITION BY v.layer, v.row_id))
SELECT layer, row_id, pos, {R('CASE WHEN row_id % 3 <> 0 THEN x WHEN row_id % 2 = 0 THEN x + 0.5::DOUBLE * w ELSE x - 0.5::DOUBLE * (xd / nw) * (w / nw) END')} AS x FROM e""",
)
def vector_edit(v):
    from facetlens.operators.subspace import vector_edit as edit

    rows = v.layer_meta.filter("row_id % 3 = 0").select("layer", "row_id", (F.col("row_id") % 96).cast("int").alias("feature_id"))
    e = rows.join(v.dec_weights.withColumnRenamed("w", "edit_vec"), ["layer", "feature_id"]).select(
        "layer", "row_id", "edit_vec", F.lit(0.5).alias("alpha"),
        F.when(F.col("row_id") % 2 == 0, F.lit("add_vector")).otherwise(F.lit("ablate_projection")).alias("mode"),
    )
    return explode_vec(edit(v.vectors.select("layer", "row_id", "vec"), e), ["layer", "row_id"], F.col("vec"), "x")


@query(
    "inner_product_extremes",
    f"""WITH s AS (SELECT v.layer, w.feature_id AS query_id, v.row_id, sum(v.x * w.w) AS score FROM v_long v JOIN v_wdec w USING (pos) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY layer, query_id ORDER BY score DESC, row_id) AS t, row_number() OVER (PARTITION BY layer, query_id ORDER BY score, row_id) AS b FROM s)
SELECT layer, query_id, row_id, {R('score')} AS score, t::INT AS rank, 'top' AS side FROM r WHERE t <= 20 UNION ALL SELECT layer, query_id, row_id, {R('score')}, b::INT, 'bottom' FROM r WHERE b <= 20""",
)
def inner_product_extremes(v):
    from facetlens.operators.subspace import inner_product_extremes as extremes

    q = v.dec_weights.select("layer", F.col("feature_id").alias("query_id"), F.col("w").alias("q"))
    # The fixture's queries are few; this makes several blocks of them.
    return r_cols(extremes(q, v.vectors, 20, 8 << 10), ["score"])
