"""Queries on token activation tables, over every token of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetlens.functions import text as T
from facetlens.functions.numeric import rounded
from facetlens.operators import tokens as K
from facetlens.plans.geometry_queries import r_cols
from facetlens.plans.registry import query
from facetlens.plans.sqlviews import LABEL_SQL, PROMPT_SQL, R

PA = ["max_token_activation", "final_token_activation", "max_span_activation", "mean_span_activation"]
PA_SQL = f"{R('mx')} AS max_token_activation, {R('fi')} AS final_token_activation, {R('sm')} AS max_span_activation, {R('sa')} AS mean_span_activation"
MEANS = ["mean_target_identity", "mean_nontarget_identity", "mean_stereotype_language", "mean_final_token"]


def rs(cols):
    return ", ".join(f"{R(c)} AS {c}" for c in cols)


@query("token_norm", r"SELECT token_norm, count(*) AS n FROM v_tn GROUP BY token_norm")
def token_norm(v):
    return v.tokens.groupBy(T.token_norm(F.col("token_str")).alias("token_norm")).agg(F.count(F.lit(1)).alias("n"))


@query("content_token_filter", r"SELECT prompt_id, count(*) AS n_content, sum(token_idx)::BIGINT AS idx_sum FROM v_doctok WHERE token_end_char > token_start_char AND NOT regexp_matches(token_str, '<\|.*\|>') GROUP BY prompt_id")
def content_token_filter(v):
    return K.content_only(v.doc_tokens).groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n_content"), F.sum("token_idx").alias("idx_sum"))


@query(
    "all_term_spans",
    """WITH t AS (SELECT doc_id, lower(text) AS p, unnest(list_distinct(['the', 'of', lower(source), lang, 'in e'])) AS term FROM documents),
 s AS (SELECT doc_id, term, unnest(string_split(p, term)) AS piece, generate_subscripts(string_split(p, term), 1) AS i FROM t WHERE instr(p, term) > 0),
 b AS (SELECT doc_id, term, i, max(i) OVER (PARTITION BY doc_id, term) AS mi, sum(length(piece)) OVER (PARTITION BY doc_id, term ORDER BY i) AS upto FROM s)
SELECT doc_id, term, (upto + (i - 1) * length(term))::INT AS start_char, (upto + i * length(term))::INT AS end_char FROM b WHERE i < mi""",
)
def all_term_spans(v):
    d = v.table("documents").select("doc_id", "text", F.array(F.lit("The"), F.lit(" of "), F.col("source"), F.col("lang"), F.lit("in e")).alias("terms"))
    return K.all_term_spans(d, "doc_id", "text", "terms")


SPANS_SQL = """SELECT doc_id AS prompt_id, s::INT AS start_char, e::INT AS end_char FROM (
  SELECT doc_id, doc_id % 11 AS s, doc_id % 11 + 20 AS e, n_chars FROM documents UNION ALL SELECT doc_id, 15, 31, n_chars FROM documents UNION ALL SELECT doc_id, n_chars // 2, n_chars // 2 + 40, n_chars FROM documents)"""


def _spans(v):
    d = F.col("doc_id")
    pairs = F.array(
        F.struct((d % 11).alias("s"), (d % 11 + 20).alias("e")),
        F.struct(F.lit(15).cast("bigint").alias("s"), F.lit(31).cast("bigint").alias("e")),
        F.struct(F.floor(F.col("n_chars") / 2).alias("s"), (F.floor(F.col("n_chars") / 2) + 40).alias("e")),
    )
    return v.table("documents").select(d.alias("prompt_id"), F.explode(pairs).alias("p")).select(
        "prompt_id", F.col("p.s").cast("int").alias("start_char"), F.col("p.e").cast("int").alias("end_char")
    )


@query(
    "token_span_overlap",
    f"""WITH sp AS ({SPANS_SQL}) SELECT t.prompt_id, t.token_idx, t.token_start_char, t.token_end_char,
 coalesce(bool_or(t.token_end_char > sp.start_char AND t.token_start_char < sp.end_char), false) AS in_span FROM v_doctok t LEFT JOIN sp USING (prompt_id) GROUP BY ALL""",
)
def token_span_overlap(v):
    return K.token_span_overlap(v.doc_tokens, _spans(v), "prompt_id")


@query(
    "token_positions",
    f"""WITH sp AS ({SPANS_SQL}), k AS (SELECT *, CASE WHEN start_char = 15 AND end_char = 31 THEN 'target' WHEN end_char - start_char = 20 THEN 'nontarget' ELSE 'terms' END AS position FROM sp),
 k2 AS (SELECT prompt_id, position, CASE WHEN prompt_id % 5 <> 0 THEN start_char END AS start_char, CASE WHEN prompt_id % 5 <> 0 THEN end_char END AS end_char FROM k),
 c AS (SELECT * FROM v_doctok WHERE token_end_char > token_start_char), f AS (SELECT prompt_id, coalesce(max(token_idx) FILTER (token_end_char > token_start_char), max(token_idx)) AS fin FROM v_doctok GROUP BY prompt_id),
 e AS (SELECT * FROM (VALUES ('target', 'all_identity_tokens'), ('nontarget', 'all_identity_tokens'), ('terms', 'all_stereotype_language_tokens')) t(position, name)),
 h2 AS (SELECT DISTINCT k2.prompt_id, e.name, c.token_idx FROM k2 JOIN e USING (position) JOIN c ON c.prompt_id = k2.prompt_id AND c.token_end_char > k2.start_char AND c.token_start_char < k2.end_char),
 h AS (SELECT k2.prompt_id, position, max(token_idx) AS last FROM k2 JOIN c ON c.prompt_id = k2.prompt_id AND c.token_end_char > k2.start_char AND c.token_start_char < k2.end_char GROUP BY ALL)
SELECT d.prompt_id, d.position, coalesce(h.last, f.fin) AS token_idx FROM (SELECT DISTINCT prompt_id, position FROM k2) d JOIN f USING (prompt_id) LEFT JOIN h USING (prompt_id, position)
UNION ALL SELECT prompt_id, 'final_prompt_token', fin FROM f
UNION ALL SELECT d.prompt_id, d.name, coalesce(h2.token_idx, f.fin) FROM (SELECT DISTINCT prompt_id, name FROM k2 JOIN e USING (position)) d JOIN f USING (prompt_id) LEFT JOIN h2 USING (prompt_id, name)""",
)
def token_positions(v):
    wide = F.col("end_char") - F.col("start_char")
    kind = F.when((F.col("start_char") == 15) & (F.col("end_char") == 31), F.lit("target")).when(wide == 20, F.lit("nontarget")).otherwise(F.lit("terms"))
    keep = F.col("prompt_id") % 5 != 0
    s = _spans(v).withColumn("position", kind)
    s = s.withColumns({c: F.when(keep, F.col(c)) for c in ("start_char", "end_char")})
    every = {"all_identity_tokens": ["target", "nontarget"], "all_stereotype_language_tokens": ["terms"]}
    return K.token_positions(v.doc_tokens, s, "prompt_id", every)


@query(
    "token_ranks",
    """SELECT layer, feature_id, prompt_id, token_idx, CASE WHEN c THEN r ELSE -1 END::INT AS token_rank_within_prompt, o::INT AS feature_rank_within_prompt, c AND r = 1 AS is_top_token_for_feature
FROM (SELECT *, token_end_char > token_start_char AS c, row_number() OVER (PARTITION BY layer, feature_id, prompt_id, token_end_char > token_start_char ORDER BY act DESC, token_idx) AS r,
  row_number() OVER (PARTITION BY layer, feature_id, prompt_id ORDER BY act DESC, token_idx) AS o FROM v_tok)""",
)
def token_ranks(v):
    return K.token_ranks(v.token_lists, ["layer", "feature_id", "prompt_id", "token_idx"])


@query(
    "localization_label",
    f"SELECT layer, feature_id, prompt_id, {PA_SQL}, best_idx AS token_idx_of_max, best_str AS token_str_of_max, {LABEL_SQL.format(outside='AND NOT best_in')} AS localization FROM v_pact",
)
def localization_label(v):
    p = K.prompt_activation(v.token_lists)
    lab = K.localization_label(F.col("max_span_activation"), F.col("final_token_activation"), F.col("max_token_activation"), ~F.col("max_inside_span"))
    return r_cols(p.select("layer", "feature_id", "prompt_id", *PA, "token_idx_of_max", "token_str_of_max", lab.alias("localization")), PA)


LOC = [
    "max_token_activation", "final_token_activation", "max_span_activation", "mean_span_activation", "span_localization_score", "span_localization_score_mean",
    "final_token_integration_score", "fraction_top_tokens_inside_span", "fraction_top_tokens_template_words", "top_token_span_fraction", "token_entropy",
    "family_entropy", "fraction_top_prompts_single_family", "template_entropy", "cross_axis_activation_score",
]


@query("token_localization", f"SELECT layer, feature_id, top_token_strings, feature_localization_type, {rs(LOC)} FROM v_loc")
def token_localization(v):
    return r_cols(K.token_localization(v.token_lists).select("layer", "feature_id", "top_token_strings", "feature_localization_type", *LOC), LOC)


@query("top_token_fallback", f"SELECT layer, feature_id, top_token_strings, {R('tw')} AS fraction_top_tokens_template_words, {R('te')} AS token_entropy FROM v_top30_all")
def top_token_fallback(v):
    return r_cols(K.top_token_fallback(v.token_lists), ["fraction_top_tokens_template_words", "token_entropy"])


@query(
    "normalized_entropy",
    f"""SELECT layer, feature_id, {R('CASE WHEN count(*) > 1 THEN -sum((a / t) * ln(a / t)) / ln(count(*)) ELSE 0 END')} AS entropy
FROM (SELECT *, sum(a) OVER (PARTITION BY layer, feature_id) AS t FROM (SELECT layer, feature_id, token_norm, sum(act) AS a FROM v_tn GROUP BY ALL) WHERE a > 0) GROUP BY layer, feature_id""",
)
def normalized_entropy(v):
    return r_cols(K.normalized_entropy(K.token_totals(v.token_lists), K.FEATURE, "activation", "entropy"), ["entropy"])


@query(
    "localization_share",
    f"SELECT layer, feature_id, l AS localization_type, {R('count(*) / sum(count(*)) OVER (PARTITION BY layer, feature_id)')} AS share FROM (SELECT layer, feature_id, {LABEL_SQL.format(outside='AND NOT best_in')} AS l FROM v_pact) GROUP BY layer, feature_id, l",
)
def localization_share(v):
    p = K.prompt_activation(v.token_lists)
    lab = K.localization_label(F.col("max_span_activation"), F.col("final_token_activation"), F.col("max_token_activation"), ~F.col("max_inside_span"))
    return r_cols(K.localization_share(p.withColumn("feature_localization_type", lab)), ["share"])


@query(
    "exemplar_prompts",
    f"""SELECT layer, feature_id, prompt_id, rn::INT AS rank, {PA_SQL}, best_idx AS token_idx_of_max, {LABEL_SQL.format(outside='')} AS feature_localization_type
FROM (SELECT *, row_number() OVER (PARTITION BY layer, feature_id ORDER BY mx DESC, fi DESC, prompt_id) AS rn FROM (SELECT * REPLACE (fr AS fi) FROM v_pact)) WHERE rn <= 25""",
)
def exemplar_prompts(v):
    e = K.exemplar_prompts(K.prompt_activation(v.token_lists, filled=False), 25)
    return r_cols(e.select("layer", "feature_id", "prompt_id", "rank", *PA, "token_idx_of_max", "feature_localization_type"), PA)


@query("span_top_tokens", f"SELECT layer, feature_id, prompt_id, token_idx, token_str, {R('act')} AS activation, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY layer, feature_id ORDER BY act DESC, prompt_id, token_idx) AS rn FROM v_tok WHERE in_span AND NOT special) WHERE rn <= 40")
def span_top_tokens(v):
    return r_cols(K.span_top_tokens(v.tokens, 40).select("layer", "feature_id", "prompt_id", "token_idx", "token_str", F.col(K.ACT).alias("activation"), "rank"), ["activation"])


@query("top_k_per_group", f"SELECT layer, feature_id, prompt_id, token_idx, token_str, {R('act')} AS activation, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY layer, feature_id ORDER BY act DESC, prompt_id, token_idx) AS rn FROM v_tok WHERE NOT special) WHERE rn <= 200")
def top_k_per_group(v):
    t = K.top_k_per_group(K.content_rows(v.tokens), K.FEATURE, [F.col(K.ACT).desc(), F.col("prompt_id"), F.col("token_idx")], 200)
    return r_cols(t.select("layer", "feature_id", "prompt_id", "token_idx", "token_str", F.col(K.ACT).alias("activation"), "rank"), ["activation"])


@query(
    "token_role",
    """SELECT role, count(*) AS n, min(item_uid) AS first_item FROM (SELECT item_uid, CASE WHEN is_target_token THEN 'target_identity' WHEN is_nontarget_token THEN 'nontarget_identity' WHEN is_stereotype_language_token THEN 'stereotype_language'
 WHEN is_answer_option_token THEN 'answer_option' WHEN is_final_prompt_token THEN 'final_token' ELSE 'other_context' END AS role FROM v_itok) GROUP BY role""",
)
def token_role(v):
    return v.item_tokens.groupBy(K.token_role().alias("role")).agg(F.count(F.lit(1)).alias("n"), F.min("item_uid").alias("first_item"))


@query("role_behavior_label", f"SELECT layer, feature_id, {rs([*MEANS, 'overall_mean'])}, behavior_role FROM v_behavior")
def role_behavior_label(v):
    return r_cols(K.role_behavior(v.item_tokens), [*MEANS, "overall_mean"])


def _map_sql(col):
    return f"(SELECT layer, feature_id, '{{' || string_agg('\"' || k || '\":' || x::VARCHAR, ',' ORDER BY k) || '}}' AS activation_by_{col} FROM (SELECT layer, feature_id, {col} AS k, {R('avg(feature_activation)')} AS x FROM v_itok GROUP BY ALL) GROUP BY layer, feature_id)"


CONDS = ["context_condition", "question_polarity", "category_raw"]


@query(
    "token_feature_summary",
    f"""SELECT s.layer, s.feature_id, {rs(MEANS)}, {R('mm')} AS max_activation_per_prompt, {R('na / (SELECT count(*) FROM documents)')} AS fraction_prompts_active, {', '.join(f'activation_by_{c}' for c in CONDS)}
FROM (SELECT layer, feature_id, {', '.join(f'avg(feature_activation) FILTER (WHERE {f}) AS mean_{n}' for n, f in K.FLAGS.items())} FROM v_itok GROUP BY layer, feature_id) s
JOIN (SELECT layer, feature_id, avg(m) AS mm, count(*) AS na FROM (SELECT layer, feature_id, item_uid, max(feature_activation) AS m FROM v_itok GROUP BY ALL) GROUP BY layer, feature_id) p USING (layer, feature_id)
{' '.join(f'JOIN {_map_sql(c)} j{i} USING (layer, feature_id)' for i, c in enumerate(CONDS))}""",
)
def token_feature_summary(v):
    n = v.raw_items.agg(F.count(F.lit(1)).alias("n"))
    return r_cols(K.token_feature_summary(v.item_tokens, n), [*MEANS, "max_activation_per_prompt", "fraction_prompts_active"])


@query("json_map_column", f"SELECT layer, feature_id, activation_by_category_raw AS by_category FROM {_map_sql('category_raw')}")
def json_map_column(v):
    by = v.item_tokens.groupBy(*K.FEATURE, "category_raw").agg(F.avg("feature_activation").alias("m"))
    return K.group_map(by, K.FEATURE, "category_raw", "m", "by_category")


@query(
    "activation_breakdowns",
    " UNION ALL ".join(f"SELECT layer, feature_id, '{c}' AS condition, {c} AS value, {R('avg(feature_activation)')} AS mean_activation FROM v_itok_content GROUP BY layer, feature_id, {c}" for c in CONDS[:2]),
)
def activation_breakdowns(v):
    return r_cols(K.activation_breakdowns(v.item_tokens, CONDS[:2]), ["mean_activation"])


@query(
    "scan_probe_join",
    f"""SELECT t.layer, t.feature_id, t.item_uid, t.token_idx, t.token_str, {R('t.feature_activation')} AS feature_activation, t.rank::INT AS rank, role AS token_role, t.category_raw, prompt_md5
FROM (SELECT *, row_number() OVER (PARTITION BY layer, feature_id ORDER BY feature_activation DESC, item_uid, token_idx) AS rank,
   CASE WHEN is_target_token THEN 'target_identity' WHEN is_nontarget_token THEN 'nontarget_identity' WHEN is_stereotype_language_token THEN 'stereotype_language' WHEN is_answer_option_token THEN 'answer_option' WHEN is_final_prompt_token THEN 'final_token' ELSE 'other_context' END AS role FROM v_itok_content) t
JOIN (SELECT item_uid, md5({PROMPT_SQL}) AS prompt_md5 FROM v_raw) r USING (item_uid) WHERE rank <= 50""",
)
def scan_probe_join(v):
    p = T.item_prompt(F.col("context"), F.col("question"), [F.col(f"ans{i}") for i in range(3)])
    its = v.raw_items.select("item_uid", F.md5(p).alias("prompt_md5"))
    out = K.scan_probe_join(v.item_tokens, its, 50)
    return r_cols(out.select("layer", "feature_id", "item_uid", "token_idx", "token_str", "feature_activation", "rank", "token_role", "category_raw", "prompt_md5"), ["feature_activation"])
