"""SQL definitions of the working tables, and the composer that prefixes them."""

from __future__ import annotations

import re

from facetlens.functions.constants import AXIS_MAP, AXIS_PREFIX_MAP, MANUAL_ALIASES, TEMPLATE_WORDS, UNKNOWN_ALIASES
from facetlens.functions.hashing import MIX, STEP
from facetlens.plans.views import (
    CONTRASTS, DIM, FORM_COLUMNS, ITEM_CATEGORIES, ITEM_CONTRASTS, ITEM_LABELS, LAYERS, N_FEATURES, RESULT_ALPHAS, RESULT_POSITIONS,
    RESULT_SET_COLS, RESULT_SETS, TOKEN_FEATURES, TOP_K,
)


def R(expr: str, digits: int = 6) -> str:
    """Rounding that matches ``numeric.rounded``."""
    return f"round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE"


def values(rows, cols: str) -> str:
    def lit(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, float):
            return f"{x!r}::DOUBLE"
        if isinstance(x, int):
            return str(x)
        return "'" + x.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({cols})"


VIEWS: dict[str, str] = {}

VIEWS["v_meta"] = """
SELECT vec_id AS row_id, 'g' || label AS entity, 'ax' || (label % 3) AS axis,
       'Group ' || label AS canonical_label, 'fam' || (vec_id % 5) AS family,
       't' || (vec_id % 25) AS template_id, 'form' || ((vec_id // 5) % 3) AS required_form
FROM embeddings"""

VIEWS["v_layers"] = values([(x,) for x in LAYERS], "layer")

# One row per vector element.
VIEWS["v_long"] = """
SELECT l.layer, e.vec_id AS row_id, u.i - 1 AS pos,
       e.embedding[u.i]::DOUBLE * (1.0::DOUBLE + l.layer * 0.01::DOUBLE * (((u.i - 1) % 3) - 1)) AS x
FROM embeddings e, v_layers l, (SELECT unnest(range(1, 65)) AS i) u"""

VIEWS["v_long"] = VIEWS["v_long"].replace("range(1, 65)", f"range(1, {DIM + 1})")

VIEWS["v_ml"] = "SELECT v.layer, v.pos, v.x, m.* FROM v_long v JOIN v_meta m USING (row_id)"

VIEWS["v_vec"] = "SELECT layer, row_id, list(x ORDER BY pos) AS vec FROM v_long GROUP BY layer, row_id"

VIEWS["v_resid"] = """
SELECT layer, 'raw' AS resid, row_id, pos, x, entity, axis, canonical_label, family FROM v_ml
UNION ALL
SELECT layer, 'family', row_id, pos, x - avg(x) OVER (PARTITION BY layer, pos, family) + avg(x) OVER (PARTITION BY layer, pos), entity, axis, canonical_label, family FROM v_ml
UNION ALL
SELECT layer, 'template', row_id, pos, x - avg(x) OVER (PARTITION BY layer, pos, template_id) + avg(x) OVER (PARTITION BY layer, pos), entity, axis, canonical_label, family FROM v_ml
UNION ALL
SELECT layer, 'form', row_id, pos, x - avg(x) OVER (PARTITION BY layer, pos, required_form) + avg(x) OVER (PARTITION BY layer, pos), entity, axis, canonical_label, family FROM v_ml"""

VIEWS["v_contrasts"] = values(CONTRASTS, "contrast_name, axis, entity_a, entity_b")

VIEWS["v_gm"] = "SELECT layer, resid, pos, avg(x) AS gm FROM v_resid GROUP BY ALL"

VIEWS["v_em"] = """
SELECT layer, resid, entity, axis, canonical_label, pos, avg(x) AS m, count(*) AS n FROM v_resid GROUP BY ALL"""

VIEWS["v_diff"] = """
SELECT a.layer, a.resid, c.contrast_name, c.axis, c.entity_a, c.entity_b, a.pos, a.m - b.m AS d
FROM v_contrasts c JOIN v_em a ON a.entity = c.entity_a
JOIN v_em b ON b.entity = c.entity_b AND b.layer = a.layer AND b.resid = a.resid AND b.pos = a.pos"""

VIEWS["v_dir"] = """
SELECT layer, resid, contrast_name, axis, entity_a, entity_b, pos,
       d / sqrt(sum(d * d) OVER (PARTITION BY layer, resid, contrast_name)) AS d
FROM v_diff"""

# Scores of the rows on the contrast axis.
VIEWS["v_scores"] = """
SELECT r.layer, r.resid, d.contrast_name, d.axis, d.entity_a, d.entity_b, r.row_id, r.entity, r.canonical_label, r.family,
       sum((r.x - g.gm) * d.d) AS score
FROM v_resid r JOIN v_gm g USING (layer, resid, pos)
JOIN v_dir d ON d.layer = r.layer AND d.resid = r.resid AND d.pos = r.pos AND d.axis = r.axis
GROUP BY ALL"""

VIEWS["v_ends"] = """
SELECT *, entity = entity_a AS is_a FROM v_scores WHERE entity = entity_a OR entity = entity_b"""


def metric_sql(source: str, keys: str) -> str:
    """AUC, effect size, midpoint accuracy and moments over (keys, score, is_a)."""
    return f"""
SELECT {keys},
  CASE WHEN n_a > 0 AND n_b > 0 THEN (rsum - n_a * (n_a + 1) / 2.0) / (n_a::DOUBLE * n_b) END AS auc,
  CASE WHEN n_a >= 2 AND n_b >= 2 AND ((n_a - 1) * v_a + (n_b - 1) * v_b) > 0
       THEN (mean_a - mean_b) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2)) END AS cohens_d,
  CASE WHEN n_a > 0 AND n_b > 0 THEN hits / (n_a + n_b) END AS accuracy_midpoint,
  mean_a, mean_b, sqrt(v_a) AS sd_a, sqrt(v_b) AS sd_b, n_a, n_b
FROM (
  SELECT {keys}, sum(rk) FILTER (WHERE is_a) AS rsum, count(*) FILTER (WHERE is_a) AS n_a,
    count(*) FILTER (WHERE NOT is_a) AS n_b, any_value(ma) AS mean_a, any_value(mb) AS mean_b,
    var_samp(score) FILTER (WHERE is_a) AS v_a, var_samp(score) FILTER (WHERE NOT is_a) AS v_b,
    sum(CASE WHEN is_a THEN (score >= (ma + mb) / 2)::INT ELSE (score < (ma + mb) / 2)::INT END)::DOUBLE AS hits
  FROM (
    SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS rk,
      avg(score) FILTER (WHERE is_a) OVER (PARTITION BY {keys}) AS ma,
      avg(score) FILTER (WHERE NOT is_a) OVER (PARTITION BY {keys}) AS mb
    FROM {source}) GROUP BY {keys})"""


VIEWS["v_metrics"] = metric_sql("v_ends", "layer, resid, contrast_name, axis, entity_a, entity_b")


def compose(sql: str) -> str:
    """Prefix ``sql`` with the views it uses, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+\b", text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    body = sql.strip()
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


# ---- sparse features ------------------------------------------------------------
VIEWS["v_wenc"] = f"""
SELECT f AS feature_id, (f % 5 - 2) * 0.01::DOUBLE AS b,
       (SELECT list((((i * 31 + f * 17) % 23) - 11) / 11.0::DOUBLE ORDER BY i) FROM (SELECT unnest(range(0, {DIM})) AS i)) AS w
FROM (SELECT unnest(range(0, {N_FEATURES})) AS f)"""

VIEWS["v_wdec"] = f"""
SELECT f::INT AS feature_id, i AS pos, (((f * 13 + i * 7) % 19) - 9) / 9.0::DOUBLE AS w
FROM (SELECT unnest(range(0, {N_FEATURES})) AS f), (SELECT unnest(range(0, {DIM})) AS i)"""

VIEWS["v_pre"] = """
SELECT v.layer, v.row_id, e.feature_id::INT AS feature_id, greatest(0.0::DOUBLE, list_dot_product(v.vec, e.w) + e.b) AS activation
FROM v_vec v, v_wenc e"""

# The decoder bias, and what the encoder gives when its input is centred by it.
VIEWS["v_bdec"] = f"""
SELECT l.layer, i AS pos, (((i * 5 + l.layer) % 7) - 3) / 20.0::DOUBLE AS c FROM v_layers l, (SELECT unnest(range(0, {DIM})) AS i)"""

VIEWS["v_pre_centred"] = """
SELECT v.layer, v.row_id, e.feature_id::INT AS feature_id, greatest(0.0::DOUBLE, list_dot_product(v.vec, e.w) - list_dot_product(c.c, e.w) + e.b) AS activation
FROM v_vec v JOIN (SELECT layer, list(c ORDER BY pos) AS c FROM v_bdec GROUP BY layer) c USING (layer), v_wenc e"""

VIEWS["v_codes"] = f"""
SELECT layer, row_id, feature_id, activation FROM (
  SELECT *, row_number() OVER (PARTITION BY layer, row_id ORDER BY activation DESC, feature_id) AS rn FROM v_pre)
WHERE rn <= {TOP_K} AND activation > 0"""

VIEWS["v_dense"] = """
SELECT p.layer, p.row_id, p.feature_id, coalesce(c.activation, 0.0::DOUBLE) AS activation
FROM v_pre p LEFT JOIN v_codes c USING (layer, row_id, feature_id)"""

VIEWS["v_csd"] = """
SELECT d.layer, c.contrast_name, c.axis, c.entity_a, c.entity_b, d.feature_id, d.row_id, m.entity = c.entity_a AS is_a, d.activation AS score
FROM v_dense d JOIN v_meta m USING (row_id)
JOIN v_contrasts c ON (m.entity = c.entity_a OR m.entity = c.entity_b) AND c.entity_b IN (SELECT entity FROM v_meta)"""

VIEWS["v_csm"] = metric_sql("v_csd", "layer, contrast_name, axis, entity_a, entity_b, feature_id")

VIEWS["v_csf"] = """
SELECT layer, contrast_name, feature_id,
  avg((score > 0)::INT) FILTER (WHERE is_a) AS freq_a, avg((score > 0)::INT) FILTER (WHERE NOT is_a) AS freq_b,
  coalesce(avg(score) FILTER (WHERE is_a AND score > 0), 0) AS mean_nonzero_a, coalesce(avg(score) FILTER (WHERE NOT is_a AND score > 0), 0) AS mean_nonzero_b
FROM v_csd GROUP BY layer, contrast_name, feature_id"""

TOP_N = 10

VIEWS["v_sel"] = f"""
SELECT * EXCLUDE (rn) FROM (
 SELECT *, row_number() OVER (PARTITION BY layer, contrast_name ORDER BY rank_abs_d NULLS LAST, rank_auc NULLS LAST, rank_abs_diff, feature_id) AS rn FROM (
  SELECT layer, contrast_name, axis, entity_a, entity_b, feature_id, mean_a, mean_b, freq_a, freq_b, mean_nonzero_a, mean_nonzero_b, diff_mean, cohens_d, auc, n_a, n_b,
   CASE WHEN cohens_d IS NOT NULL THEN rank() OVER (PARTITION BY layer, contrast_name ORDER BY abs(cohens_d) DESC NULLS LAST) END AS rank_abs_d,
   rank() OVER (PARTITION BY layer, contrast_name ORDER BY abs(auc - 0.5::DOUBLE) DESC) AS rank_auc,
   rank() OVER (PARTITION BY layer, contrast_name ORDER BY abs(diff_mean) DESC) AS rank_abs_diff
  FROM (SELECT m.*, f.freq_a, f.freq_b, f.mean_nonzero_a, f.mean_nonzero_b, mean_a - mean_b AS diff_mean,
     row_number() OVER (PARTITION BY layer, contrast_name ORDER BY abs(mean_a - mean_b) DESC, feature_id) AS prune
   FROM v_csm m JOIN v_csf f USING (layer, contrast_name, feature_id)) WHERE prune <= {5 * TOP_N}))
WHERE rn <= {TOP_N}"""

VIEWS["v_esd"] = """
SELECT d.layer, e.axis, e.entity, e.canonical_label, d.feature_id, d.row_id, m.entity = e.entity AS is_a, d.activation AS score
FROM v_dense d JOIN v_meta m USING (row_id) JOIN (SELECT DISTINCT axis, entity, canonical_label FROM v_meta) e ON e.axis = m.axis"""

VIEWS["v_esel"] = f"""
SELECT * EXCLUDE (rn) FROM (
 SELECT *, row_number() OVER (PARTITION BY layer, entity ORDER BY abs(cohens_d) DESC NULLS LAST, feature_id) AS rn FROM (
  SELECT layer, axis, entity, canonical_label, feature_id, mean_a AS mean_entity, mean_b AS mean_other_same_axis, mean_a - mean_b AS diff_mean, cohens_d, auc, n_a AS n_entity, n_b AS n_other, freq_entity, freq_other,
   row_number() OVER (PARTITION BY layer, entity ORDER BY abs(mean_a - mean_b) DESC, feature_id) AS prune
  FROM ({metric_sql("v_esd", "layer, axis, entity, canonical_label, feature_id")}) m
  JOIN (SELECT layer, entity, feature_id, avg((score > 0)::INT) FILTER (WHERE is_a) AS freq_entity, avg((score > 0)::INT) FILTER (WHERE NOT is_a) AS freq_other FROM v_esd GROUP BY ALL) f USING (layer, entity, feature_id))
 WHERE prune <= {3 * TOP_N})
WHERE rn <= {TOP_N}"""

VIEWS["v_align"] = """
SELECT d.layer, d.resid, d.contrast_name, d.axis, d.entity_a, d.entity_b, w.feature_id,
  sqrt(sum(w.w * w.w)) AS decoder_norm, sum(w.w * d.d) / greatest(sqrt(sum(w.w * w.w)), 1e-12) AS cosine_with_direction, sum(w.w * d.d) AS signed_dot
FROM v_dir d JOIN v_wdec w USING (pos) GROUP BY d.layer, d.resid, d.contrast_name, d.axis, d.entity_a, d.entity_b, w.feature_id"""

VIEWS["v_sa"] = """
SELECT s.*, a.resid, a.decoder_norm, a.cosine_with_direction, a.signed_dot
FROM v_sel s LEFT JOIN v_align a USING (layer, contrast_name, axis, entity_a, entity_b, feature_id)"""


def z_sql(x: str) -> str:
    w = "OVER (PARTITION BY layer, resid, contrast_name)"
    return f"(CASE WHEN stddev_pop({x}) {w} > 0 THEN ({x} - avg({x}) {w}) / stddev_pop({x}) {w} WHEN {x} IS NOT NULL THEN 0 END)"


VIEWS["v_joined"] = f"""
SELECT *, {z_sql('abs(cohens_d)')} + {z_sql('abs(cosine_with_direction)')} + {z_sql('abs(auc - 0.5::DOUBLE)')} AS combined_score FROM v_sa"""

VIEWS["v_cand"] = """
SELECT * EXCLUDE (rn) FROM (SELECT layer, resid, contrast_name, axis, entity_a, entity_b, feature_id,
  CASE WHEN diff_mean >= 0 THEN 'identity_a_positive' ELSE 'identity_b_positive' END AS direction_side,
  mean_a AS mean_activation_a, mean_b AS mean_activation_b, cosine_with_direction AS decoder_cosine, cohens_d, auc, combined_score,
  row_number() OVER (PARTITION BY layer, resid, contrast_name ORDER BY combined_score DESC NULLS LAST, feature_id) AS rn FROM v_joined) WHERE rn <= 5"""


# ---- prompts and items ------------------------------------------------------------
def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def pick_sql(xs, i: str) -> str:
    return f"([{', '.join(chr(39) + x + chr(39) for x in xs)}])[(({i}) % {len(xs)}) + 1]"


VIEWS["v_forms"] = """
SELECT 'grp_' || k AS entity, 'ax' || (k % 3) AS axis, 'Group ' || k AS canonical_label, lower(n_name) || ' ' || k AS adj_form,
  CASE WHEN k % 4 <> 0 THEN 'a member of group ' || k END AS noun_form,
  CASE WHEN k % 7 = 0 THEN '   ' ELSE 'members ' || k END AS plural_noun_form,
  CASE WHEN k % 5 = 0 THEN 'NA' WHEN k % 3 = 0 THEN '' ELSE ' with tag ' || k || ' ' END AS with_form,
  CASE WHEN k % 11 = 0 THEN '' ELSE 'Grp-' || k || ';g_' || k || '; dup' || (k // 2) END AS aliases,
  k AS source_order, s_name AS entity_notes
FROM (SELECT s_suppkey AS k, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

VIEWS["v_templates"] = f"""
SELECT replace(p_name, ' ', '_') || '_' || p_type AS template_id, lower(p_type) AS family,
  CASE WHEN p_type = 'PROMO' AND starts_with(p_name, 'red') THEN 'one a ' || p_name || ' has is {{form}}.' ELSE 'the ' || p_name || ' is {{form}}.' END AS template_text,
  {pick_sql(FORM_COLUMNS, 'length(p_name)')} AS required_form, 'singular' AS number, ' ' || p_type AS notes
FROM (SELECT DISTINCT p_name, p_type FROM part)"""

VIEWS["v_forms_long"] = " UNION ALL ".join(
    f"SELECT entity, axis, canonical_label, entity_notes, source_order, '{c}' AS form_name, {strip_sql(c)} AS form_used FROM v_forms WHERE {strip_sql(f'coalesce({c}, {chr(39)*2})')} <> ''"
    for c in FORM_COLUMNS
)

VIEWS["v_prompts"] = f"""
SELECT template_id || '__' || entity AS prompt_id, template_id, family, template_text, required_form, form_used, number, entity, axis, canonical_label,
  upper(substr(txt, 1, 1)) || substr(txt, 2) AS prompt, {strip_sql('notes')} AS template_notes, entity_notes
FROM (SELECT *, replace(template_text, '{{form}}', form_used) AS txt FROM v_templates JOIN v_forms_long ON required_form = form_name)"""

_ALIAS_COLS = ["entity", "canonical_label", *FORM_COLUMNS]
VIEWS["v_alias_raw"] = (
    " UNION ALL ".join(
        f"SELECT 0 AS src, source_order AS row, {i} AS pos, {c} AS t, entity FROM v_forms" for i, c in enumerate(_ALIAS_COLS)
    )
    + f" UNION ALL SELECT 0, source_order, {len(_ALIAS_COLS)} + j - 1, (string_split(aliases, ';'))[j], entity FROM v_forms, (SELECT unnest(range(1, 5)) AS j) WHERE j <= len(string_split(aliases, ';'))"
    + " UNION ALL SELECT 1, 0, pos, t, entity FROM ("
    + values([(i, k, v) for i, (k, v) in enumerate(MANUAL_ALIASES.items())], "pos, t, entity")
    + ")"
)
VIEWS["v_alias"] = f"""
SELECT alias, replace(alias, ' ', '') AS compact, arg_max(entity, ord) AS entity, min(ord) AS first_ord
FROM (SELECT {norm_sql('t')} AS alias, entity, (src, row, pos) AS ord FROM v_alias_raw WHERE {strip_sql("coalesce(t, '')")} <> '')
GROUP BY alias"""


def _label(j: int) -> str:
    base = pick_sql(ITEM_LABELS, f"doc_id * 3 + {j * 5} + doc_id // 16")
    if j == 2:
        return f"CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE {base} END"
    if j == 1:
        return f"CASE WHEN doc_id % 13 = 0 THEN 'g_' || (doc_id % 90) ELSE {base} END"
    return base


def _answer(c: str) -> str:
    return f"CASE WHEN {c} = 'unknown' THEN 'Not enough information' ELSE 'The ' || {c} || ' person' END"


VIEWS["v_raw"] = f"""
SELECT lower(category_raw) || ':' || doc_id || ':' || (doc_id % 7) || ':' || context_condition || ':' || question_polarity || ':' || source AS item_uid,
  doc_id AS example_id, doc_id % 7 AS question_index, category_raw, context_condition, question_polarity, text AS context,
  'Who is likely the ' || source || ' speaker of ' || lang || ' words that don''t end?' AS question,
  {_answer('l0')} AS ans0, {_answer('l1')} AS ans1, {_answer('l2')} AS ans2, l0, l1, l2,
  CASE WHEN doc_id % 17 <> 0 THEN (doc_id % 3)::INT END AS correct_answer_idx,
  CASE WHEN doc_id % 5 = 4 THEN ['Jewish'] WHEN doc_id % 4 = 0 THEN [l0, {pick_sql(ITEM_LABELS, 'doc_id * 11')}] ELSE [l0] END AS stereotyped_groups,
  source AS source_file, doc_id
FROM (SELECT *, {pick_sql(ITEM_CATEGORIES, 'doc_id')} AS category_raw, CASE WHEN doc_id % 2 = 0 THEN 'ambig' ELSE 'disambig' END AS context_condition,
   CASE WHEN (doc_id // 2) % 2 = 0 THEN 'neg' ELSE 'nonneg' END AS question_polarity, {_label(0)} AS l0, {_label(1)} AS l1, {_label(2)} AS l2 FROM documents)"""

VIEWS["v_mentions"] = """
SELECT item_uid, 'label' AS kind, 0 AS idx, l0 AS label FROM v_raw UNION ALL SELECT item_uid, 'label', 1, l1 FROM v_raw UNION ALL SELECT item_uid, 'label', 2, l2 FROM v_raw
UNION ALL SELECT item_uid, 'text', 0, ans0 FROM v_raw UNION ALL SELECT item_uid, 'text', 1, ans1 FROM v_raw UNION ALL SELECT item_uid, 'text', 2, ans2 FROM v_raw
UNION ALL SELECT item_uid, 'stereo', j - 1, stereotyped_groups[j] FROM v_raw, (SELECT unnest(range(1, 3)) AS j) WHERE j <= len(stereotyped_groups)"""

VIEWS["v_labels"] = f"SELECT label, {norm_sql('label')} AS norm FROM (SELECT DISTINCT label FROM v_mentions)"

# Components in order: the raw label and its pieces, each normalised then compact, then f/m expansions.
VIEWS["v_comp"] = f"""
SELECT label, comp, min(ord) AS ord FROM (
 WITH p AS (SELECT label, 0 AS pi, label AS piece FROM v_labels UNION ALL
   SELECT label, j, (string_split_regex(label, '[-_/+]'))[j] FROM v_labels, (SELECT unnest(range(1, 6)) AS j) WHERE j <= len(string_split_regex(label, '[-_/+]'))),
 n AS (SELECT label, pi, {norm_sql('piece')} AS nm FROM p WHERE {norm_sql('piece')} <> ''),
 c AS (SELECT label, pi * 2 AS ord, nm AS comp FROM n UNION ALL SELECT label, pi * 2 + 1, replace(nm, ' ', '') FROM n)
 SELECT * FROM c UNION ALL SELECT label, ord + 100, CASE comp WHEN 'f' THEN 'female' WHEN 'm' THEN 'male' ELSE comp END FROM c)
GROUP BY label, comp"""

_UNK = "(" + ", ".join("'" + u.replace("'", "''") + "'" for u in UNKNOWN_ALIASES) + ")"

VIEWS["v_compid"] = """
SELECT c.label, list_sort(list_distinct(list(a.entity))) AS component_ids, arg_min(a.entity, c.ord) AS first_id
FROM v_comp c JOIN v_alias a ON a.alias = c.comp GROUP BY c.label"""

VIEWS["v_resolved"] = f"""
SELECT l.label, l.norm, CASE WHEN l.norm IN {_UNK} THEN 'unknown' ELSE coalesce(e.entity, k.entity, c.first_id, '') END AS entity,
  CASE WHEN l.norm IN {_UNK} THEN 'unknown' WHEN e.entity IS NOT NULL OR k.entity IS NOT NULL THEN 'alias' WHEN c.first_id IS NOT NULL THEN 'component_alias' ELSE 'unmapped' END AS status,
  coalesce(c.component_ids, []::VARCHAR[]) AS component_ids, (SELECT list(comp ORDER BY ord) FROM v_comp q WHERE q.label = l.label) AS components
FROM v_labels l LEFT JOIN v_alias e ON e.alias = l.norm
LEFT JOIN (SELECT compact, arg_min(entity, (first_ord, alias)) AS entity FROM v_alias GROUP BY compact) k ON k.compact = replace(l.norm, ' ', '')
LEFT JOIN v_compid c ON c.label = l.label"""


def axis_sql(x: str) -> str:
    cases = " ".join(f"WHEN split_part({x}, '_', 1) = '{k}' THEN '{v}'" for k, v in AXIS_PREFIX_MAP.items())
    return f"CASE WHEN instr({x}, '_') = 0 THEN '' {cases} ELSE split_part({x}, '_', 1) END"


def prefix_axis_sql(x: str) -> str:
    cases = " ".join(f"WHEN split_part({x}, '_', 1) = '{k}' THEN '{v}'" for k, v in AXIS_PREFIX_MAP.items())
    return f"(CASE {cases} ELSE '' END)"


def category_axis_sql(x: str) -> str:
    key = f"replace({norm_sql(x)}, ' ', '_')"
    return f"CASE {' '.join(f'WHEN {key} = {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in AXIS_MAP.items())} ELSE {key} END"


VIEWS["v_stereo"] = """
SELECT m.item_uid, list_distinct(list(r.norm)) AS norms, list_distinct(list_filter(flatten(list(list_concat([r.entity], r.component_ids))), lambda e: e <> '')) AS ids
FROM (SELECT m.item_uid, m.label FROM v_mentions m WHERE kind = 'stereo') m JOIN v_resolved r USING (label) GROUP BY m.item_uid"""

VIEWS["v_answers"] = f"""
SELECT l.item_uid, l.idx, l.label, a.entity, list_sort(list_distinct(list_concat(a.component_ids, b.component_ids))) AS cids,
  a.entity = 'unknown' OR b.norm IN {_UNK} AS is_unknown,
  list_contains(s.norms, a.norm) OR list_contains(s.ids, a.entity) OR list_has_any(list_concat(a.component_ids, b.component_ids), s.ids)
    OR list_has_any(list_concat(a.components, b.components), s.norms) AS is_stereo, s.ids
FROM v_mentions l JOIN v_mentions t ON t.item_uid = l.item_uid AND t.kind = 'text' AND t.idx = l.idx
JOIN v_resolved a ON a.label = l.label JOIN v_resolved b ON b.label = t.label JOIN v_stereo s ON s.item_uid = l.item_uid WHERE l.kind = 'label'"""

VIEWS["v_roles0"] = """
SELECT item_uid, min(idx) FILTER (WHERE is_unknown) AS unknown_answer_idx, min(idx) FILTER (WHERE is_stereo AND NOT is_unknown) AS stereotyped_answer_idx,
  min(idx) FILTER (WHERE NOT is_stereo AND NOT is_unknown) AS nonstereotyped_answer_idx FROM v_answers GROUP BY item_uid"""

VIEWS["v_roles"] = f"""
SELECT item_uid, unknown_answer_idx, stereotyped_answer_idx, nonstereotyped_answer_idx, target_label, target_entity, nontarget_label,
  coalesce(CASE WHEN {axis_sql('target_entity')} <> '' THEN (list_filter(oc, lambda c: {axis_sql('c')} = {axis_sql('target_entity')}))[1] END, oc[1], '') AS nontarget_entity
FROM (SELECT r.*, coalesce(t.label, '') AS target_label, coalesce(o.label, '') AS nontarget_label,
   coalesce((list_filter(list_filter(list_concat([t.entity], t.cids), lambda c: c <> '' AND c <> 'unknown'), lambda c: list_contains(t.ids, c)))[1], (list_filter(list_concat([t.entity], t.cids), lambda c: c <> '' AND c <> 'unknown'))[1], '') AS target_entity,
   list_filter(list_concat([o.entity], o.cids), lambda c: c <> '' AND c <> 'unknown') AS oc
 FROM v_roles0 r LEFT JOIN v_answers t ON t.item_uid = r.item_uid AND t.idx = r.stereotyped_answer_idx
 LEFT JOIN v_answers o ON o.item_uid = r.item_uid AND o.idx = r.nonstereotyped_answer_idx)"""

VIEWS["v_icontrasts"] = values(ITEM_CONTRASTS, "contrast_name, entity_a, entity_b, axis")

VIEWS["v_match"] = """
SELECT i.item_uid, min(c.contrast_name) FILTER (WHERE c.pri = 0) AS ex, arg_min(c.contrast_name, (c.pri, c.contrast_name)) FILTER (WHERE c.pri > 0) AS nr
FROM (SELECT r.item_uid, r.target_entity AS t, r.nontarget_entity AS n, w.axis_mapped FROM v_roles r JOIN v_rawaxis w USING (item_uid)) i
JOIN LATERAL (SELECT contrast_name, CASE WHEN (entity_a = i.t AND entity_b = i.n) OR (entity_a = i.n AND entity_b = i.t) THEN 0 WHEN axis = i.axis_mapped AND (i.t IN (entity_a, entity_b) OR i.n IN (entity_a, entity_b)) THEN 1 WHEN axis = i.axis_mapped THEN 2 END AS pri FROM v_icontrasts) c ON c.pri IS NOT NULL
WHERE i.t <> '' AND i.n <> '' GROUP BY i.item_uid"""

VIEWS["v_rawaxis"] = f"SELECT *, {category_axis_sql('category_raw')} AS axis_mapped FROM v_raw"

PROMPT_SQL = r"'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Answer choices:' || chr(10) || 'A. ' || ans0 || chr(10) || 'B. ' || ans1 || chr(10) || 'C. ' || ans2 || chr(10) || chr(10) || 'Answer:'"

VIEWS["v_prepared"] = f"""
SELECT *, array_to_string(list_filter([CASE WHEN unknown_answer_idx IS NULL THEN 'missing_unknown_answer' END, CASE WHEN stereotyped_answer_idx IS NULL THEN 'missing_stereotyped_answer' END,
   CASE WHEN mapped_contrast_confidence = 'unmapped' THEN 'unmapped_contrast' END], lambda x: x IS NOT NULL), ';') AS notes
FROM (SELECT w.* EXCLUDE (item_uid), {PROMPT_SQL} AS prompt, r.*, coalesce(m.ex, m.nr, '') AS mapped_contrast_name,
  CASE WHEN m.ex IS NOT NULL THEN 'exact' WHEN m.nr IS NOT NULL THEN 'fallback_axis' ELSE 'unmapped' END AS mapped_contrast_confidence
 FROM v_rawaxis w JOIN v_roles r USING (item_uid) LEFT JOIN v_match m USING (item_uid))"""


# ---- tokens -------------------------------------------------------------------------
VIEWS["v_doctok"] = """
SELECT prompt_id, token_idx::INT AS token_idx, token_str, s::INT AS token_start_char, (CASE WHEN token_idx = 0 THEN s ELSE s + length(token_str) END)::INT AS token_end_char
FROM (SELECT *, coalesce(sum(CASE WHEN token_idx = 0 THEN 0 ELSE length(token_str) + 1 END) OVER (PARTITION BY prompt_id ORDER BY token_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM (SELECT doc_id AS prompt_id, unnest(list_concat(['<|begin_of_text|>'], string_split(text, ' '))) AS token_str, generate_subscripts(list_concat(['<|begin_of_text|>'], string_split(text, ' ')), 1) - 1 AS token_idx FROM documents))"""

VIEWS["v_tok"] = f"""
SELECT 24 AS layer, f AS feature_id, prompt_id, token_idx, token_str, token_start_char, token_end_char,
  ((prompt_id * 7 + token_idx * 13 + f * 29) % 101) / 100.0::DOUBLE AS act, token_end_char <= token_start_char AS special, token_idx BETWEEN 3 AND 5 AS in_span,
  CASE WHEN prompt_id % 3 <> 0 THEN ((prompt_id * 7 + f * 29) % 97) / 100.0::DOUBLE END AS fin,
  'g' || (prompt_id % 10) AS entity, 'ax' || (prompt_id % 3) AS axis, 'fam' || (prompt_id % 5) AS family, 't' || (prompt_id % 25) AS template_id
FROM v_doctok, (VALUES {', '.join(f'({x})' for x in TOKEN_FEATURES)}) t(f)"""

VIEWS["v_pact"] = """
SELECT layer, feature_id, prompt_id, max(act) AS mx, max(coalesce(fin, 0)) AS fi, max(fin) AS fr, coalesce(max(act) FILTER (WHERE in_span), 0) AS sm, coalesce(avg(act) FILTER (WHERE in_span), 0) AS sa,
  arg_max(token_idx, (act, -token_idx)) AS best_idx, arg_max(token_str, (act, -token_idx)) AS best_str, arg_max(in_span, (act, -token_idx)) AS best_in,
  any_value(entity) AS entity, any_value(axis) AS axis, any_value(family) AS family, any_value(template_id) AS template_id
FROM v_tok WHERE NOT special GROUP BY layer, feature_id, prompt_id"""

VIEWS["v_tn"] = rf"""
SELECT layer, feature_id, translate(lower({strip_sql('token_str')}), 'ġ▁Ġ', '') AS token_norm, act, in_span, special FROM v_tok"""


def top30_sql(where: str) -> str:
    return f"""
SELECT layer, feature_id, string_agg(token_norm, ';' ORDER BY rn) AS top_token_strings, avg((token_norm IN ({", ".join(chr(39) + w + chr(39) for w in TEMPLATE_WORDS)}))::INT) FILTER (WHERE rn <= 20) AS tw,
  avg(sf) FILTER (WHERE rn <= 20) AS tsf, -sum(CASE WHEN a > 0 THEN (a / tot) * ln(a / tot) END) / ln(count(*) FILTER (WHERE a > 0)) AS te
FROM (SELECT *, sum(a) OVER (PARTITION BY layer, feature_id) AS tot FROM (
  SELECT layer, feature_id, token_norm, a, sf, row_number() OVER (PARTITION BY layer, feature_id ORDER BY a DESC, token_norm) AS rn
  FROM (SELECT layer, feature_id, token_norm, sum(act) AS a, avg(in_span::INT) AS sf FROM v_tn WHERE {where} GROUP BY ALL)) WHERE rn <= 30)
GROUP BY layer, feature_id"""


VIEWS["v_top30"] = top30_sql("NOT special")
VIEWS["v_top30_all"] = top30_sql("true")


def cat_entropy_sql(col: str) -> str:
    return f"(SELECT layer, feature_id, CASE WHEN count(*) > 1 THEN -sum((n / t) * ln(n / t)) / ln(count(*)) ELSE 0 END AS h, max(n / t) AS share FROM (SELECT layer, feature_id, {col}, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY layer, feature_id) AS t FROM v_pact GROUP BY layer, feature_id, {col}) GROUP BY layer, feature_id)"


VIEWS["v_loc"] = f"""
SELECT *, CASE WHEN span_localization_score >= 0.7 THEN 'identity_span_local' WHEN final_token_integration_score >= 0.7 THEN 'final_token_integrated'
  WHEN fraction_top_tokens_template_words >= 0.5 THEN 'template_context' ELSE 'diffuse_or_unclear' END AS feature_localization_type
FROM (SELECT p.layer, p.feature_id, max(mx) AS max_token_activation, median(fi) AS final_token_activation, median(sm) AS max_span_activation, median(sa) AS mean_span_activation,
  least(1, median(sm / greatest(mx, 1e-9))) AS span_localization_score, least(1, avg(sm / greatest(mx, 1e-9))) AS span_localization_score_mean,
  least(1, median(fi / greatest(mx, 1e-9))) AS final_token_integration_score, avg(best_in::INT) AS fraction_top_tokens_inside_span,
  any_value(t.top_token_strings) AS top_token_strings, any_value(t.tw) AS fraction_top_tokens_template_words, any_value(t.tsf) AS top_token_span_fraction, any_value(t.te) AS token_entropy,
  any_value(a.h) AS family_entropy, any_value(a.share) AS fraction_top_prompts_single_family, any_value(b.h) AS template_entropy, any_value(c.h) AS cross_axis_activation_score
 FROM v_pact p JOIN v_top30 t USING (layer, feature_id) JOIN {cat_entropy_sql('family')} a USING (layer, feature_id) JOIN {cat_entropy_sql('template_id')} b USING (layer, feature_id) JOIN {cat_entropy_sql('axis')} c USING (layer, feature_id)
 GROUP BY p.layer, p.feature_id)"""

LABEL_SQL = "CASE WHEN mx > 0 AND sm >= 0.7::DOUBLE * mx THEN 'identity_span_local' WHEN mx > 0 AND fi >= 0.7::DOUBLE * mx THEN 'final_token_integrated' WHEN mx > 0 {outside} THEN 'template_context' ELSE 'diffuse_or_unclear' END"

VIEWS["v_itok"] = """
SELECT t.layer, t.feature_id, r.item_uid, token_idx, token_str, token_start_char, token_end_char, act AS feature_activation, token_idx % 11 = 2 AS is_target_token, token_idx % 13 = 3 AS is_nontarget_token,
  token_idx % 7 = 1 AS is_stereotype_language_token, token_idx % 17 = 5 AS is_answer_option_token, token_idx = r.last AS is_final_prompt_token, r.context_condition, r.question_polarity, r.category_raw
FROM v_tok t JOIN (SELECT doc_id, item_uid, context_condition, question_polarity, category_raw, len(string_split(context, ' ')) AS last FROM v_raw) r ON r.doc_id = t.prompt_id WHERE act > 0"""
VIEWS["v_itok_content"] = r"SELECT * FROM v_itok WHERE token_end_char > token_start_char AND NOT regexp_matches(token_str, '<\|.*\|>')"

FLAG_SQL = ", ".join(
    f"avg(feature_activation) FILTER (WHERE {flag}) AS mean_{name}"
    for name, flag in [("target_identity", "is_target_token"), ("nontarget_identity", "is_nontarget_token"), ("stereotype_language", "is_stereotype_language_token"), ("final_token", "is_final_prompt_token")]
)

VIEWS["v_behavior"] = f"""
SELECT *, CASE WHEN v > 0 AND v >= overall_mean * 1.25 THEN CASE WHEN v = mean_target_identity THEN 'target_identity_local' WHEN v = mean_nontarget_identity THEN 'nontarget_identity_local' WHEN v = mean_stereotype_language THEN 'stereotype_language_local' ELSE 'final_token_integrated' END ELSE 'mixed_or_unclear' END AS behavior_role
FROM (SELECT *, greatest(mean_target_identity, mean_nontarget_identity, mean_stereotype_language, mean_final_token) AS v FROM (
  SELECT layer, feature_id, coalesce(mean_target_identity, 0) AS mean_target_identity, coalesce(mean_nontarget_identity, 0) AS mean_nontarget_identity, coalesce(mean_stereotype_language, 0) AS mean_stereotype_language, coalesce(mean_final_token, 0) AS mean_final_token, overall_mean
  FROM (SELECT layer, feature_id, {FLAG_SQL}, avg(feature_activation) AS overall_mean FROM v_itok_content GROUP BY layer, feature_id)))"""


# ---- triage ---------------------------------------------------------------------------
VIEWS["v_src_jc"] = """
SELECT layer, feature_id, contrast_name, axis, entity_a, entity_b, cohens_d, auc, cosine_with_direction, combined_score FROM v_joined
UNION ALL SELECT layer, feature_id, contrast_name, axis, entity_a, entity_b, cohens_d, auc, decoder_cosine, combined_score FROM v_cand"""
VIEWS["v_src"] = """
SELECT * FROM v_src_jc UNION ALL SELECT layer, feature_id, contrast_name, axis, entity_a, entity_b, NULL, NULL, cosine_with_direction, NULL FROM v_align"""

VIEWS["v_signal"] = """
WITH per AS (SELECT layer, feature_id, contrast_name, max(abs(cohens_d)) AS d, max(abs(cosine_with_direction)) AS c FROM v_src GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY layer, feature_id ORDER BY d DESC NULLS LAST, contrast_name) AS rd, row_number() OVER (PARTITION BY layer, feature_id ORDER BY c DESC NULLS LAST, contrast_name) AS rc FROM per),
 nm AS (SELECT layer, feature_id, string_agg(contrast_name, ';' ORDER BY rd) FILTER (WHERE rd <= 10) AS top_contrasts_by_selectivity, string_agg(contrast_name, ';' ORDER BY rc) FILTER (WHERE rc <= 10) AS top_contrasts_by_alignment,
   max(contrast_name) FILTER (WHERE rd = 1 AND d IS NOT NULL) AS top_contrast_by_selectivity, max(contrast_name) FILTER (WHERE rc = 1 AND c IS NOT NULL) AS top_contrast_by_decoder_alignment FROM rk GROUP BY layer, feature_id),
 en AS (SELECT layer, feature_id, count(DISTINCT e) AS n_entities_seen FROM (SELECT layer, feature_id, unnest([entity_a, entity_b]) AS e FROM v_src) GROUP BY layer, feature_id),
 ax AS (SELECT layer, feature_id, arg_min(axis, (-n, axis)) AS mode_axis FROM (SELECT layer, feature_id, axis, count(*) AS n FROM v_src GROUP BY ALL) GROUP BY layer, feature_id)
SELECT s.*, en.n_entities_seen, nm.* EXCLUDE (layer, feature_id), coalesce((SELECT any_value(q.axis) FROM v_contrasts q WHERE q.contrast_name = nm.top_contrast_by_selectivity), ax.mode_axis, '') AS signal_top_axis
FROM (SELECT layer, feature_id, count(DISTINCT contrast_name) AS n_contrasts_seen, count(DISTINCT axis) AS n_axes_seen, max(abs(cohens_d)) AS max_abs_cohens_d, max(abs(auc - 0.5::DOUBLE)) AS max_auc_distance_from_0_5,
  max(abs(cosine_with_direction)) AS max_abs_decoder_cosine, avg(abs(cosine_with_direction)) AS mean_abs_decoder_cosine, max(combined_score) AS max_combined_score FROM v_src GROUP BY layer, feature_id) s
JOIN en USING (layer, feature_id) JOIN nm USING (layer, feature_id) JOIN ax USING (layer, feature_id)"""

VIEWS["v_member"] = """
SELECT layer, feature_id, contrast_name, axis, membership_type FROM (SELECT layer, feature_id, contrast_name, axis, membership_type,
  row_number() OVER (PARTITION BY layer, contrast_name, membership_type ORDER BY v DESC NULLS LAST, feature_id) AS rn
 FROM (SELECT layer, feature_id, contrast_name, min(axis) AS axis, unnest(['abs_cohens_d', 'abs_decoder_cosine', 'combined_score']) AS membership_type, unnest([max(abs(cohens_d)), max(abs(cosine_with_direction)), max(combined_score)]) AS v FROM v_src_jc GROUP BY layer, feature_id, contrast_name) WHERE v IS NOT NULL) WHERE rn <= 5"""

VIEWS["v_memagg"] = """
SELECT layer, feature_id, count(DISTINCT contrast_name) AS n_contrasts_where_top_feature, count(DISTINCT axis) AS n_axes_where_top_feature, array_to_string(list_sort(list_distinct(list(axis))), ';') AS membership_axes FROM v_member GROUP BY layer, feature_id"""

VIEWS["v_espec"] = """
WITH r AS (SELECT *, greatest(mean_entity, 0) AS v, row_number() OVER (PARTITION BY layer, feature_id ORDER BY greatest(mean_entity, 0) DESC, entity) AS rn FROM v_esel),
 t AS (SELECT *, first_value(axis) OVER (PARTITION BY layer, feature_id ORDER BY rn) AS ta, sum(v) OVER (PARTITION BY layer, feature_id) AS tot FROM r),
 ax AS (SELECT layer, feature_id, CASE WHEN count(*) > 1 THEN -sum((n / s) * ln(n / s)) / ln(count(*)) ELSE 0 END AS axis_entropy FROM (SELECT layer, feature_id, axis, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY layer, feature_id) AS s FROM r WHERE v > 0 GROUP BY layer, feature_id, axis) GROUP BY layer, feature_id)
SELECT g.*, coalesce(ax.axis_entropy, 0) AS axis_entropy FROM (SELECT layer, feature_id, max(entity) FILTER (WHERE rn = 1) AS top_entity, max(canonical_label) FILTER (WHERE rn = 1) AS top_entity_label, any_value(ta) AS top_axis,
  max(v) FILTER (WHERE rn = 1) AS top_entity_mean_activation, coalesce(max(v) FILTER (WHERE rn = 2), max(v) FILTER (WHERE rn = 1)) AS second_entity_mean_activation,
  max(v) FILTER (WHERE rn = 1) / greatest(coalesce(max(v) FILTER (WHERE rn = 2), max(v) FILTER (WHERE rn = 1)), 1e-9) AS entity_specificity_ratio, max(v) FILTER (WHERE rn = 1) / greatest(any_value(tot), 1e-9) AS top_entity_share,
  avg((axis = ta)::INT) FILTER (WHERE rn <= 10) AS top_axis_fraction,
  CASE WHEN count(*) FILTER (WHERE v > 0) > 1 THEN -sum(CASE WHEN v > 0 THEN (v / tot) * ln(v / tot) END) / ln(count(*) FILTER (WHERE v > 0)) ELSE 0 END AS entity_entropy,
  string_agg(entity || ':' || canonical_label || ':' || printf('%.4g', v), ';' ORDER BY rn) FILTER (WHERE rn <= 8) AS top_entities_by_activation
 FROM t GROUP BY layer, feature_id) g LEFT JOIN ax USING (layer, feature_id)"""

VIEWS["v_shared"] = """
SELECT layer, feature_id, max(abs(signed_dot)) / (SELECT max(abs(signed_dot)) FROM v_align) AS shared_pc_loading_score FROM v_align GROUP BY layer, feature_id"""

VIEWS["v_spine"] = """
SELECT k.layer, k.feature_id, s.* EXCLUDE (layer, feature_id), m.* EXCLUDE (layer, feature_id), e.* EXCLUDE (layer, feature_id), l.* EXCLUDE (layer, feature_id)
FROM (SELECT layer, feature_id FROM v_signal UNION SELECT layer, feature_id FROM v_memagg UNION SELECT layer, feature_id FROM v_espec UNION SELECT layer, feature_id FROM v_loc) k
LEFT JOIN v_signal s USING (layer, feature_id) LEFT JOIN v_memagg m USING (layer, feature_id) LEFT JOIN v_espec e USING (layer, feature_id) LEFT JOIN v_loc l USING (layer, feature_id)"""


def _c01(x: str) -> str:
    return f"greatest(0, least(1, coalesce({x}, 0)))"


# DuckDB's least() skips NULLs, so caps are guarded.
def _cap(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN least(1, {x}) END)"


VIEWS["v_scored"] = f"""
SELECT * REPLACE (coalesce(shared_pc_loading_score, 0) AS shared_pc_loading_score, {_c01('coalesce(cross_axis_activation_score, axis_entropy)')} AS cross_axis_activation_score),
 {_c01(f"(1 - {_cap('(CASE WHEN n_axes_where_top_feature IS NOT NULL THEN greatest(n_axes_where_top_feature, 1) END - 1) / 4')}) * 0.6 + coalesce(top_axis_fraction, 0) * 0.2 + {_cap('max_abs_cohens_d / 2')} * 0.2")} AS contrast_specificity_score,
 {_c01(f"{_cap('n_axes_where_top_feature / 5')} * 0.5 + {_cap('n_contrasts_where_top_feature / 10')} * 0.3 + greatest(0, least(1, coalesce(shared_pc_loading_score, 0))) * 0.2")} AS sharedness_score,
 {_c01("coalesce(fraction_top_tokens_template_words, 0) * 0.4 + (1 - coalesce(family_entropy, 1)) * 0.3 + (1 - coalesce(template_entropy, 1)) * 0.2 + (1 - coalesce(span_localization_score, 0)) * 0.1")} AS template_artifact_score,
 {_c01("coalesce(axis_entropy, 0) * 0.35 + coalesce(entity_entropy, 0) * 0.35 + coalesce(token_entropy, 0) * 0.2 + (1 - coalesce(top_axis_fraction, 0)) * 0.1")} AS polysemanticity_score
FROM v_spine LEFT JOIN v_shared USING (layer, feature_id)"""

VIEWS["v_triage"] = """
WITH b AS (SELECT *, coalesce(max_abs_cohens_d, 0) AS d, coalesce(max_abs_decoder_cosine, 0) AS cs, template_artifact_score AS art, coalesce(span_localization_score, 0) AS sp, coalesce(final_token_integration_score, 0) AS fi, sharedness_score AS sh, contrast_specificity_score AS spec,
   coalesce(n_axes_where_top_feature, 0) AS axes FROM v_scored),
 n AS (SELECT *, greatest(0, least(1, d)) AS nd, greatest(0, least(1, cs / 0.12)) AS nc FROM b),
 r AS (SELECT *, CASE WHEN d < 0.5 AND cs < 0.03 THEN 'low_signal' WHEN art >= 0.5 THEN 'template_or_syntax_artifact' WHEN sp >= 0.7 AND d >= 0.5 THEN 'identity_token_local' WHEN fi >= 0.7 AND d >= 0.5 THEN 'sentence_final_integrated'
   WHEN sh >= 0.5 AND axes >= 3 THEN 'shared_social_feature' WHEN spec >= 0.5 AND d >= 0.5 AND cs >= 0.03 THEN 'contrast_specific_identity' ELSE 'polysemantic_or_unclear' END AS provisional_role FROM n),
 c AS (SELECT *, greatest(0, least(1, CASE provisional_role WHEN 'low_signal' THEN 1 - greatest(nd, nc) WHEN 'template_or_syntax_artifact' THEN art WHEN 'identity_token_local' THEN (sp + nd + 1 - art) / 3 WHEN 'sentence_final_integrated' THEN (fi + nd + 1 - art) / 3
   WHEN 'shared_social_feature' THEN sh WHEN 'contrast_specific_identity' THEN (spec + nd + nc + 1 - art) / 4 ELSE polysemanticity_score END)) AS role_confidence,
   provisional_role IN ('identity_token_local', 'sentence_final_integrated', 'shared_social_feature', 'contrast_specific_identity') AND d >= 0.5 AND art < 0.5 AS keep_for_intervention FROM r)
SELECT *, CASE WHEN keep_for_intervention AND role_confidence >= 0.7 AND d >= 0.75 THEN 'high' WHEN keep_for_intervention THEN 'medium' ELSE 'low' END AS intervention_priority,
 printf('%s: span=%.2f, final=%.2f, artifact=%.2f, shared=%.2f, specificity=%.2f, max|d|=%.2f, max|cos|=%.3f, top_axis=%s.', provisional_role, sp, fi, art, sh, spec, d, cs, coalesce(top_axis, '0')) AS reason FROM c"""

PRI = "(CASE intervention_priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 9 END)"

VIEWS["v_ctri"] = """
SELECT c.*, t.provisional_role, t.role_confidence, coalesce(t.keep_for_intervention, false) AS keep_for_intervention, t.intervention_priority, t.max_abs_cohens_d, coalesce(t.top_axis, '') AS top_axis,
  CASE WHEN c.decoder_cosine < 0 OR c.cohens_d < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign
FROM v_cand c LEFT JOIN v_triage t USING (layer, feature_id) WHERE c.resid = 'raw'"""

PORDER = f"{PRI}, role_confidence DESC NULLS LAST, max_abs_cohens_d DESC NULLS LAST, combined_score DESC NULLS LAST, contrast_name, feature_id"


def members_sql(source: str, keys: str, limit: str) -> str:
    return f"""SELECT {keys}, string_agg(feature_id::VARCHAR, ',' ORDER BY rn) AS feature_ids, string_agg(sign::INT::VARCHAR, ',' ORDER BY rn) AS signs, string_agg(provisional_role, ',' ORDER BY rn) AS roles, max(top_axis) FILTER (WHERE rn = 1) AS first_axis, count(*) AS n_features
FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {PORDER}) AS rn FROM {source}) WHERE {limit} GROUP BY {keys}"""


_CAX = prefix_axis_sql("contrast_name")
VIEWS["v_sets"] = f"""
WITH kept AS (SELECT * FROM v_ctri WHERE keep_for_intervention),
 s AS (SELECT *, row_number() OVER (PARTITION BY layer, feature_id ORDER BY {PORDER}) AS rn FROM kept),
 g AS (SELECT k.*, kk.k, b.bundle FROM kept k, (VALUES (1), (3)) kk(k), LATERAL (SELECT unnest([k.provisional_role, 'combined']) AS bundle) b),
 tk AS ({members_sql('g', 'layer, contrast_name, bundle, k', 'rn <= k')}),
 bu AS ({members_sql("(SELECT * FROM kept WHERE top_axis <> '')", 'layer, top_axis, provisional_role', 'true')}),
 ar AS ({members_sql("(SELECT * FROM v_ctri WHERE provisional_role = 'template_or_syntax_artifact')", 'layer', 'rn <= 20')})
SELECT layer, 'per_feature' AS mode, 'L' || lpad(layer::VARCHAR, 2, '0') || '_feature_' || lpad(feature_id::VARCHAR, 5, '0') AS set_id, feature_id::VARCHAR AS feature_ids, sign::INT::VARCHAR AS signs, provisional_role AS roles, contrast_name, coalesce(nullif({_CAX}, ''), top_axis) AS axis, 'kept_feature' AS control_type FROM s WHERE rn = 1
UNION ALL SELECT layer, 'per_contrast_topk', 'L' || lpad(layer::VARCHAR, 2, '0') || '_' || contrast_name || '_' || bundle || '_top' || k, feature_ids, signs, roles, contrast_name, coalesce(nullif({_CAX}, ''), first_axis), 'kept_feature' FROM tk
UNION ALL SELECT layer, 'role_bundle', 'L' || lpad(layer::VARCHAR, 2, '0') || '_' || top_axis || '_' || provisional_role || '_bundle', feature_ids, signs, roles, '', top_axis, 'kept_feature' FROM bu
UNION ALL SELECT layer, 'control_bundle', 'L' || lpad(layer::VARCHAR, 2, '0') || '_template_artifact_control_top20', feature_ids, signs, roles, '', first_axis, 'template_artifact_features' FROM ar"""


# ---- experiment -----------------------------------------------------------------------
VIEWS["v_rsets"] = values(RESULT_SETS, ", ".join(RESULT_SET_COLS))

VIEWS["v_scores0"] = f"""
SELECT *, b0 + alpha * (((doc_id + set_no * 5) % 7) - 3) / 10.0::DOUBLE AS i0, b1 + alpha * (((doc_id + set_no * 5 + 3) % 7) - 3) / 10.0::DOUBLE AS i1, b2 + alpha * (((doc_id + set_no * 5 + 6) % 7) - 3) / 10.0::DOUBLE AS i2
FROM (SELECT p.item_uid, p.doc_id, p.axis_mapped, p.category_raw, p.context_condition, p.question_polarity, p.mapped_contrast_name, p.stereotyped_answer_idx AS si, p.nonstereotyped_answer_idx AS ni, p.unknown_answer_idx AS ui, p.correct_answer_idx AS ci,
   s.*, a.alpha, q.intervention_position, -((doc_id * 37 + set_no * 11) % 997) / 100.0::DOUBLE AS b0, -((doc_id * 37 + set_no * 11 + 53) % 997) / 100.0::DOUBLE AS b1, -((doc_id * 37 + set_no * 11 + 106) % 997) / 100.0::DOUBLE AS b2
 FROM v_prepared p, v_rsets s, ({values([(a,) for a in RESULT_ALPHAS], 'alpha')}) a, ({values([(a,) for a in RESULT_POSITIONS], 'intervention_position')}) q)"""


def _at(p: str, idx: str) -> str:
    return f"(CASE {idx} WHEN 0 THEN {p}0 WHEN 1 THEN {p}1 WHEN 2 THEN {p}2 END)"


def _oth(p: str) -> str:
    return f"(CASE ci WHEN 0 THEN greatest({p}1, {p}2) WHEN 1 THEN greatest({p}0, {p}2) WHEN 2 THEN greatest({p}0, {p}1) END)"


def _am(p: str) -> str:
    return f"(CASE WHEN {p}0 >= {p}1 AND {p}0 >= {p}2 THEN 0 WHEN {p}1 >= {p}2 THEN 1 ELSE 2 END)"


VIEWS["v_results"] = f"""
SELECT *, mi - mb AS bias_margin_delta, pb <> pi AS prediction_changed, coalesce(pb = ci, false) AS correct_base, coalesce(pi = ci, false) AS correct_intervened
FROM (SELECT *, {_at('i', 'si')} - {_at('b', 'si')} AS stereotyped_delta, {_at('i', 'ni')} - {_at('b', 'ni')} AS nonstereotyped_delta, {_at('i', 'ui')} - {_at('b', 'ui')} AS unknown_delta, {_at('i', 'ci')} - {_at('b', 'ci')} AS correct_delta,
  CASE WHEN context_condition = 'ambig' THEN {_at('b', 'si')} - {_at('b', 'ui')} ELSE {_at('b', 'ci')} - {_oth('b')} END AS mb, CASE WHEN context_condition = 'ambig' THEN {_at('i', 'si')} - {_at('i', 'ui')} ELSE {_at('i', 'ci')} - {_oth('i')} END AS mi,
  {_am('b')} AS pb, {_am('i')} AS pi, CASE WHEN set_control = 'kept_feature' AND NOT (axis_mapped <> '' AND set_axis <> '' AND axis_mapped = set_axis) THEN 'wrong_axis_features' ELSE set_control END AS control_type FROM v_scores0)"""

_ROLE_LIST = "coalesce(from_json(CASE WHEN json_valid(feature_roles_json) THEN feature_roles_json END, '[\"VARCHAR\"]'), []::VARCHAR[])"
_IDAX = " ".join(f"WHEN instr('_' || feature_set_id || '_', '_{k}_') > 0 THEN '{v}'" for k, v in AXIS_PREFIX_MAP.items())
VIEWS["v_labelled"] = f"""
SELECT *, CASE WHEN contains(control_type, 'wrong_axis') THEN 'wrong_axis_control' WHEN feature_axis <> '' AND axis_mapped = feature_axis THEN 'matched_axis' WHEN feature_axis <> '' THEN 'wrong_axis_control' ELSE 'unknown_axis_match' END AS axis_match_type,
  CASE WHEN context_condition = 'ambig' AND bias_margin_delta < -1e-6 THEN 'reduces_stereotype_preference' WHEN context_condition = 'ambig' AND bias_margin_delta > 1e-6 THEN 'increases_stereotype_preference' WHEN context_condition = 'ambig' AND abs(bias_margin_delta) <= 1e-6 THEN 'near_zero' ELSE 'not_ambiguous' END AS ambiguous_bias_effect_label
FROM (SELECT *, coalesce(({_ROLE_LIST})[1], '') AS feature_role, array_to_string(list_sort(list_distinct({_ROLE_LIST})), ', ') AS feature_roles_readable,
  coalesce(nullif(CASE WHEN instr(feature_contrast_name, '_vs_') > 0 THEN {prefix_axis_sql('feature_contrast_name')} ELSE '' END, ''), CASE {_IDAX} END, '') AS feature_axis,
  CASE WHEN alpha > 0 THEN 'amplify_feature_direction' ELSE 'suppress_feature_direction' END AS steering_direction_label, CASE WHEN alpha >= 0 THEN '+' ELSE '-' END || regexp_replace(abs(alpha)::VARCHAR, '\\.0$', '') AS alpha_label FROM v_results)"""


def summary_sql(keys: str) -> str:
    m = lambda c: f"round({c}, 12)"
    bias, unknown, other = m("mean_bias_margin_delta"), m("mean_unknown_delta"), m("mean_nonstereotyped_delta")
    return f"""SELECT *, CASE WHEN coalesce({m('mean_correct_delta')} < -0.02, false) OR coalesce({m('accuracy_change_disambig')} < -0.02, false) THEN 'capability_degrading' WHEN {bias} < 0 AND {unknown} > 0 THEN 'bias_reducing_uncertainty_increasing'
  WHEN {bias} < 0 AND {other} > {unknown} THEN 'substitution_effect' WHEN abs({bias}) < 1e-4 THEN 'no_effect' ELSE 'identity_salience_only' END AS interpretation_label
FROM (SELECT {keys}, avg(stereotyped_delta) AS mean_stereotyped_delta, avg(unknown_delta) AS mean_unknown_delta, avg(nonstereotyped_delta) AS mean_nonstereotyped_delta, avg(bias_margin_delta) AS mean_bias_margin_delta, avg(correct_delta) AS mean_correct_delta,
  count(DISTINCT item_uid) AS n_items, count(*) AS n_rows, count(DISTINCT feature_set_id) AS n_featuresets, avg(coalesce(prediction_changed, false)::INT) AS prediction_change_rate,
  avg(CASE WHEN context_condition = 'disambig' THEN correct_intervened::INT - correct_base::INT END) AS accuracy_change_disambig FROM v_labelled GROUP BY {keys})"""


def boot_sql(keys: str, samples: int, cdf: list[float]) -> str:
    """Percentiles of item means under Poisson weights, which follow from the item and the replicate."""
    names = [k.strip() for k in keys.split(",")]
    seed = lambda at: f"('0x' || substr(md5(concat_ws(':', '0', item_uid)), {at}, 8))::BIGINT"
    step = lambda x: f"(xor({x}, {x} >> 16) * {MIX}) & 4294967295"
    w = " + ".join(f"(xor(x, x >> 16) / 4294967296.0::DOUBLE >= {c!r}::DOUBLE)::INT" for c in cdf)
    cond = " AND ".join(f"z.{k} IS NOT DISTINCT FROM y.{k}" for k in names)
    return f"""(WITH it AS (SELECT {keys}, item_uid, avg(bias_margin_delta) AS x FROM v_labelled WHERE bias_margin_delta IS NOT NULL GROUP BY {keys}, item_uid),
 sz AS (SELECT {keys}, count(*) AS n, avg(x) AS m FROM it GROUP BY {keys}),
 sd AS (SELECT item_uid, {seed(1)} AS a, {seed(9)} AS b FROM (SELECT DISTINCT item_uid FROM it)),
 x0 AS (SELECT item_uid, rep, b, (a + rep * {STEP}) & 4294967295 AS x FROM sd, (SELECT unnest(range(0, {samples})) AS rep)),
 x1 AS (SELECT item_uid, rep, b, {step('x')} AS x FROM x0), x2 AS (SELECT item_uid, rep, b, {step('x')} AS x FROM x1), x3 AS (SELECT item_uid, rep, xor(xor(x, x >> 16), b) AS x FROM x2),
 x4 AS (SELECT item_uid, rep, {step('x')} AS x FROM x3), x5 AS (SELECT item_uid, rep, {step('x')} AS x FROM x4),
 wt AS MATERIALIZED (SELECT item_uid, rep, {w} AS w FROM x5),
 st AS (SELECT {keys}, rep, sum(w * x) / nullif(sum(w), 0) AS s FROM it JOIN wt USING (item_uid) GROUP BY {keys}, rep),
 q AS (SELECT {keys}, quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi FROM st GROUP BY {keys})
SELECT {', '.join('z.' + k for k in names)}, CASE WHEN z.n <= 1 THEN z.m ELSE y.lo END AS ci_low, CASE WHEN z.n <= 1 THEN z.m ELSE y.hi END AS ci_high FROM sz z JOIN q y ON {cond})"""
