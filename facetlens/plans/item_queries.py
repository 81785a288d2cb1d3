"""Queries on prompts, labels and answer-choice items."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetlens.functions import text as T
from facetlens.functions.constants import STOPWORDS, STOPWORDS_TOKEN_EXTRA
from facetlens.functions.numeric import rounded
from facetlens.operators import grid, items
from facetlens.plans.registry import query
from facetlens.plans.sqlviews import (
    PROMPT_SQL, R, axis_sql, category_axis_sql, norm_sql, prefix_axis_sql, strip_sql,
)
from facetlens.plans.views import FORM_COLUMNS, ITEM_LABELS

q1 = "'"


@query("clean_text", f"SELECT doc_id, coalesce({strip_sql('t')}, '') AS cleaned FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN '  ' || text || chr(10) ELSE text END AS t FROM documents)")
def clean_text(v):
    d = F.col("doc_id")
    t = F.when(d % 7 == 0, F.lit(None)).when(d % 2 == 0, F.concat(F.lit("  "), "text", F.lit("\n"))).otherwise(F.col("text"))
    return v.table("documents").select("doc_id", T.clean_text(t).alias("cleaned"))


@query("sentence_case", f"SELECT conv_id, turn, upper(substr(s, 1, 1)) || substr(s, 2) AS cased FROM (SELECT conv_id, turn, {strip_sql('lower(text)')} AS s FROM conversations)")
def sentence_case(v):
    return v.table("conversations").select("conv_id", "turn", T.sentence_case(F.lower("text")).alias("cased"))


@query("norm_text", f"SELECT doc_id, {norm_sql('text')} AS normed FROM documents")
def norm_text(v):
    return v.table("documents").select("doc_id", T.norm_text(F.col("text")).alias("normed"))


@query("prompt_grid", "SELECT * FROM v_prompts")
def prompt_grid(v):
    return grid.prompt_grid(v.templates, v.forms, FORM_COLUMNS)


@query("lint_bad_patterns", r"SELECT prompt_id, template_id, entity, prompt FROM v_prompts WHERE regexp_matches(prompt, '(?i)\b(?:has is|has has|is is|A a|A an|One a|One an|The a|The an|people are people)\b')")
def lint_bad_patterns(v):
    return grid.lint_prompts(prompt_grid(v)).select("prompt_id", "template_id", "entity", "prompt")


@query("value_counts_report", "SELECT 'family' AS field, family AS value, count(*) AS n FROM v_prompts GROUP BY family UNION ALL SELECT 'axis', axis, count(*) FROM v_prompts GROUP BY axis")
def value_counts_report(v):
    return grid.value_counts_report(prompt_grid(v), ["family", "axis"])


@query(
    "map_axis",
    f"""SELECT item_uid, category_raw, {category_axis_sql('category_raw')} AS axis_mapped, {axis_sql("coalesce(r.entity, '')")} AS entity_axis, {prefix_axis_sql("coalesce(r.entity, '')")} AS prefix_axis
FROM v_raw LEFT JOIN v_resolved r ON r.label = v_raw.l0""",
)
def map_axis(v):
    r = items.resolve_labels(v.raw_items.select(F.get("answer_labels", 0).alias("label")), v.aliases).select("label", "entity")
    from facetlens.functions.joins import spread_join

    j = spread_join(v.raw_items.withColumn("label", F.get("answer_labels", 0)), r, ["label"], spread_by=["item_uid"], how="left")
    return j.select(
        "item_uid", "category_raw", T.axis_from_category(F.col("category_raw")).alias("axis_mapped"),
        T.entity_axis(F.col("entity")).alias("entity_axis"), T.axis_from_prefix(F.col("entity")).alias("prefix_axis"),
    )


@query(
    "split_contrast_name",
    f"""SELECT item_uid, name, CASE WHEN instr(name, '_vs_') > 0 THEN substr(name, 1, instr(name, '_vs_') - 1) END AS side_a,
 CASE WHEN instr(name, '_vs_') > 0 THEN substr(name, instr(name, '_vs_') + 4) END AS side_b,
 CASE WHEN instr(name, '_vs_') > 0 THEN {prefix_axis_sql("substr(name, 1, instr(name, '_vs_') - 1)")} ELSE '' END AS axis
FROM (SELECT item_uid, CASE WHEN doc_id % 6 = 0 THEN 'no contrast' WHEN doc_id % 6 = 1 THEN 'age_old_vs_x_vs_y' ELSE 'race_' || lower(l0) || '_vs_' || lower(l1) END AS name FROM v_raw)""",
)
def split_contrast_name(v):
    d = F.col("doc_id")
    l = lambda i: F.lower(F.get("answer_labels", i))
    name = F.when(d % 6 == 0, F.lit("no contrast")).when(d % 6 == 1, F.lit("age_old_vs_x_vs_y")).otherwise(
        F.concat(F.lit("race_"), l(0), F.lit("_vs_"), l(1))
    )
    a, b = T.contrast_sides(F.col("name"))
    return v.raw_items.select("item_uid", name.alias("name")).select(
        "item_uid", "name", a.alias("side_a"), b.alias("side_b"), T.axis_from_contrast(F.col("name")).alias("axis")
    )


@query("label_components", "SELECT label, string_agg(comp, '|' ORDER BY ord) AS components FROM v_comp GROUP BY label")
def label_components(v):
    labels = v.raw_items.select(F.explode(F.concat("answer_labels", "answer_texts", "stereotyped_groups")).alias("label")).distinct()
    return labels.select("label", F.array_join(T.label_components(F.col("label")), "|").alias("components"))


@query("alias_table", "SELECT alias, compact, entity FROM v_alias")
def alias_table(v):
    return v.aliases.select("alias", "compact", "entity")


@query("resolve_entity", "SELECT label, norm, entity, status, array_to_string(component_ids, '|') AS component_ids FROM (SELECT label, CASE WHEN status = 'unknown' THEN 'unknown' ELSE norm END AS norm, entity, status, component_ids FROM v_resolved)")
def resolve_entity(v):
    labels = v.raw_items.select(F.explode(F.concat("answer_labels", "answer_texts", "stereotyped_groups")).alias("label"))
    return items.resolve_labels(labels, v.aliases).select("label", "norm", "entity", "status", F.array_join("component_ids", "|").alias("component_ids"))


ROLE_COLS = ["item_uid", "unknown_answer_idx", "stereotyped_answer_idx", "nonstereotyped_answer_idx", "target_label", "target_entity", "nontarget_label", "nontarget_entity"]


@query("assign_answer_roles", f"SELECT {', '.join(ROLE_COLS)} FROM v_roles")
def assign_answer_roles(v):
    return items.assign_answer_roles(v.raw_items, v.aliases).select(*ROLE_COLS)


@query(
    "component_overlap",
    """SELECT item_uid, array_to_string(list_sort(list_intersect(a, b)), '|') AS shared_ids, array_to_string(list_sort(list_distinct(list_concat(a, b))), '|') AS all_ids, list_has_any(a, b) AS overlaps
FROM (SELECT item_uid, x.component_ids AS a, y.component_ids AS b FROM v_raw JOIN v_resolved x ON x.label = l0 JOIN v_resolved y ON y.label = l1)""",
)
def component_overlap(v):
    from facetlens.functions.joins import spread_join

    src = v.raw_items.select("item_uid", F.get("answer_labels", 0).alias("label_a"), F.get("answer_labels", 1).alias("label_b"))
    r = items.resolve_labels(src.select(F.explode(F.array("label_a", "label_b")).alias("label")), v.aliases)
    side = lambda s: r.select(F.col("label").alias(f"label_{s}"), F.col("component_ids").alias(s))
    j = spread_join(spread_join(src, side("a"), ["label_a"], ["item_uid"]), side("b"), ["label_b"], ["item_uid"])
    out = items.component_overlap(j, "a", "b")
    return out.select("item_uid", F.array_join("shared_ids", "|").alias("shared_ids"), F.array_join("all_ids", "|").alias("all_ids"), "overlaps")


@query("match_contrast", "SELECT item_uid, target_entity, nontarget_entity, axis_mapped, mapped_contrast_name, mapped_contrast_confidence FROM v_prepared")
def match_contrast(v):
    return v.prepared.select("item_uid", "target_entity", "nontarget_entity", "axis_mapped", "mapped_contrast_name", "mapped_contrast_confidence")


@query(
    "distinct_contrast_axes",
    f"""SELECT name AS contrast_name, substr(name, 1, instr(name, '_vs_') - 1) AS entity_a, substr(name, instr(name, '_vs_') + 4) AS entity_b, coalesce(arg_min(axis, doc_id) FILTER (WHERE axis IS NOT NULL), '') AS axis
FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE l0 || '_vs_' || l1 END AS name, CASE WHEN doc_id % 4 <> 0 THEN {category_axis_sql('category_raw')} END AS axis FROM v_raw) WHERE name IS NOT NULL GROUP BY name""",
)
def distinct_contrast_axes(v):
    d = F.col("doc_id")
    t = v.raw_items.select(
        d, F.when(d % 9 != 0, F.concat(F.get("answer_labels", 0), F.lit("_vs_"), F.get("answer_labels", 1))).alias("contrast_name"),
        F.when(d % 4 != 0, T.axis_from_category(F.col("category_raw"))).alias("axis"),
    )
    return items.distinct_contrast_axes(t, ["axis"], "doc_id")


@query("compose_item_prompt", f"SELECT item_uid, {PROMPT_SQL} AS prompt FROM v_raw")
def compose_item_prompt(v):
    p = T.item_prompt(F.col("context"), F.col("question"), [F.col(f"ans{i}") for i in range(3)])
    return v.raw_items.select("item_uid", p.alias("prompt"))


@query("item_uid", "SELECT doc_id, item_uid FROM v_raw")
def item_uid(v):
    return v.raw_items.select("doc_id", "item_uid")


@query(
    "item_display_label",
    """SELECT item_uid, CASE WHEN correct_answer_idx IS NULL THEN 'not identified' ELSE chr(65 + correct_answer_idx) || '. ' || ([ans0, ans1, ans2])[correct_answer_idx + 1] END AS gold,
 'Category: ' || category_raw || ' | Example ID: ' || example_id || ' | Question index: ' || question_index || ' | Context: ' || context_condition || ' | Polarity: ' || question_polarity AS line FROM v_raw""",
)
def item_display_label(v):
    c = F.col
    return v.raw_items.select(
        "item_uid", T.answer_label(c("correct_answer_idx"), [c("ans0"), c("ans1"), c("ans2")]).alias("gold"),
        T.item_line(c("category_raw"), c("example_id"), c("question_index"), c("context_condition"), c("question_polarity")).alias("line"),
    )


@query(
    "prepare_summary",
    f"""SELECT 'n_' || category_raw || '_' || context_condition || '_' || question_polarity AS metric, {R('count(*)')} AS value FROM v_prepared GROUP BY category_raw, context_condition, question_polarity
UNION ALL SELECT 'mapping_confidence_' || mapped_contrast_confidence, {R('count(*)')} FROM v_prepared GROUP BY mapped_contrast_confidence
UNION ALL SELECT 'fraction_unknown_answer_found', {R('avg((unknown_answer_idx IS NOT NULL)::INT)')} FROM v_prepared
UNION ALL SELECT 'fraction_stereotyped_answer_found', {R('avg((stereotyped_answer_idx IS NOT NULL)::INT)')} FROM v_prepared
UNION ALL SELECT 'fraction_mapped_to_contrast', {R("avg((mapped_contrast_confidence IN ('exact', 'alias', 'fallback_axis'))::INT)")} FROM v_prepared""",
)
def prepare_summary(v):
    return items.prepare_summary(v.prepared).withColumn("value", rounded("value"))


@query("mapping_diagnostics", "SELECT item_uid, category_raw, axis_mapped, target_label, target_entity, nontarget_label, nontarget_entity, mapped_contrast_confidence, notes FROM v_prepared WHERE notes <> ''")
def mapping_diagnostics(v):
    return items.mapping_diagnostics(v.prepared).select(
        "item_uid", "category_raw", "axis_mapped", "target_label", "target_entity", "nontarget_label", "nontarget_entity", "mapped_contrast_confidence", "notes"
    )


@query("top_unmapped_pairs", "SELECT target_label, nontarget_label, count(*) AS n FROM v_prepared WHERE notes LIKE '%unmapped_contrast%' GROUP BY ALL ORDER BY n DESC, target_label, nontarget_label LIMIT 20")
def top_unmapped_pairs(v):
    return items.top_unmapped_pairs(v.prepared)


@query(
    "prepared_items",
    "SELECT item_uid, example_id, axis_mapped, prompt, context_condition || '_' || question_polarity AS polarity_role, unknown_answer_idx, stereotyped_answer_idx, correct_answer_idx, mapped_contrast_name, notes FROM v_prepared",
)
def prepared_items(v):
    return v.prepared.select("item_uid", "example_id", "axis_mapped", "prompt", "polarity_role", "unknown_answer_idx", "stereotyped_answer_idx", "correct_answer_idx", "mapped_contrast_name", "notes")


JSON_LIST = "CASE WHEN doc_id % 5 = 0 THEN 'not json' WHEN doc_id % 5 = 1 THEN '[]' ELSE '[\"' || l1 || '\", \"' || l0 || '\", \"' || l1 || '\"]' END"


@query(
    "parse_json_list",
    f"""SELECT item_uid, len(a) AS n, coalesce(a[1], '') AS first_role, array_to_string(list_sort(list_distinct(a)), ', ') AS readable
FROM (SELECT item_uid, coalesce(from_json(CASE WHEN json_valid(j) THEN j END, '["VARCHAR"]'), []::VARCHAR[]) AS a FROM (SELECT item_uid, {JSON_LIST} AS j FROM v_raw))""",
)
def parse_json_list(v):
    d = F.col("doc_id")
    l = lambda i: F.get("answer_labels", i)
    j = F.when(d % 5 == 0, F.lit("not json")).when(d % 5 == 1, F.lit("[]")).otherwise(
        F.concat(F.lit('["'), l(1), F.lit('", "'), l(0), F.lit('", "'), l(1), F.lit('"]'))
    )
    a = v.raw_items.select("item_uid", T.parse_json_list(j).alias("a"))
    return a.select("item_uid", F.size("a").cast("bigint").alias("n"), T.first_of(F.col("a")).alias("first_role"), T.readable_join(F.col("a")).alias("readable"))


@query(
    "parse_bool",
    "SELECT item_uid, lower(trim(flag)) IN ('true', '1', 'yes') AS parsed FROM (SELECT item_uid, (['True', ' yes ', '0', 'no', '1', 'NA'])[(doc_id % 6) + 1] AS flag FROM v_raw)",
)
def parse_bool(v):
    flag = F.get(F.array(*[F.lit(x) for x in ["True", " yes ", "0", "no", "1", "NA"]]), (F.col("doc_id") % 6).cast("int"))
    return v.raw_items.select("item_uid", T.parse_bool(flag).alias("parsed"))


SPAN_FORM = "CASE WHEN doc_id % 3 = 0 THEN lower(w[2]) WHEN doc_id % 3 = 1 THEN w[2] || '--' || w[3] ELSE 'zzqqx' END"


@query(
    "entity_span",
    rf"""WITH f AS (SELECT doc_id, text, {SPAN_FORM} AS form FROM (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents)),
g AS (SELECT *, instr(lower(text), lower(form)) AS pos_a, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g') AS np, trim(regexp_replace(lower(form), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS nf FROM f),
h AS (SELECT *, CASE WHEN nf <> '' THEN instr(np, nf) ELSE 0 END AS nat, regexp_replace(nf, '\s+', '', 'g') AS cf FROM g),
i AS (SELECT *, regexp_replace(substr(np, 1, (nat - 1)::BIGINT), '\s+', '', 'g') AS px FROM h),
k AS (SELECT *, instr(regexp_replace(lower(text), '\s+', '', 'g'), px || cf) > 0 AS ok, coalesce({strip_sql('form')}, '') = '' AS blank FROM i)
SELECT doc_id, CASE WHEN NOT blank AND pos_a > 0 THEN pos_a - 1 WHEN NOT blank AND nat > 0 AND ok THEN length(px) END::INT AS start_char,
 CASE WHEN NOT blank AND pos_a > 0 THEN pos_a - 1 + length(form) WHEN NOT blank AND nat > 0 AND ok THEN length(px) + length(cf) END::INT AS end_char,
 CASE WHEN NOT blank AND pos_a > 0 THEN 'exact' WHEN NOT blank AND nat > 0 THEN 'normalized' ELSE 'failed' END AS status FROM k""",
)
def entity_span(v):
    w = F.split("text", " ")
    d = F.col("doc_id")
    form = F.when(d % 3 == 0, F.lower(F.get(w, 1))).when(d % 3 == 1, F.concat(F.get(w, 1), F.lit("--"), F.get(w, 2))).otherwise(F.lit("zzqqx"))
    s = v.table("documents").select("doc_id", "text", form.alias("form")).select("doc_id", T.entity_span(F.col("text"), F.col("form")).alias("s"))
    return s.select("doc_id", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), "s.status")


@query(
    "section_spans",
    f"""SELECT item_uid, name, (instr(prompt, t) - 1)::INT AS start_char, (instr(prompt, t) - 1 + length(t))::INT AS end_char FROM (
 SELECT item_uid, prompt, unnest(['context', 'question', 'ans0', 'ans1', 'ans2']) AS name, unnest([context, question, 'A. ' || ans0, 'B. ' || ans1, 'C. ' || ans2]) AS t
 FROM (SELECT *, {PROMPT_SQL} AS prompt FROM v_raw)) WHERE instr(prompt, t) > 0""",
)
def section_spans(v):
    a = [F.col(f"ans{i}") for i in range(3)]
    p = v.raw_items.withColumn("prompt", T.item_prompt(F.col("context"), F.col("question"), a))
    s = p.select("item_uid", F.explode(T.section_spans(F.col("prompt"), F.col("context"), F.col("question"), a)).alias("s"))
    return s.select("item_uid", "s.name", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"))


def _stop(ws):
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


@query(
    "content_terms",
    f"""SELECT doc_id, array_to_string(list_filter(w, lambda x: length(x) > 2 AND NOT list_contains({_stop(STOPWORDS)}, x)), ';') AS terms,
 array_to_string(list_filter(w, lambda x: length(x) > 2 AND NOT list_contains({_stop(STOPWORDS + STOPWORDS_TOKEN_EXTRA)}, x)), ';') AS token_terms
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z''-]+') AS w FROM documents)""",
)
def content_terms(v):
    t = F.col("text")
    return v.table("documents").select(
        "doc_id", F.array_join(T.content_terms(t), ";").alias("terms"), F.array_join(T.content_terms(t, STOPWORDS_TOKEN_EXTRA), ";").alias("token_terms")
    )
