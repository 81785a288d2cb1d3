"""Queries on feature triage: evidence, scores, roles, selections and feature sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetlens.functions.numeric import clip01, rounded, safe_ratio
from facetlens.functions.settle import settle
from facetlens.operators import grid, tokens as K, triage as T
from facetlens.plans import code_queries as CQ
from facetlens.plans.geometry_queries import explode_vec, r_cols
from facetlens.plans.registry import query
from facetlens.plans.views import N_FEATURES
from facetlens.plans.sqlviews import PORDER, PRI, R


def rs(cols):
    return ", ".join(f"{R(c)} AS {c}" for c in cols)


SRC = ["layer", "feature_id", "contrast_name", "axis", "entity_a", "entity_b"]


def sources(v):
    """Joined, alignment and candidate tables in canonical column names."""
    j = CQ.joined(v).select(*SRC, "cohens_d", "auc", "cosine_with_direction", "combined_score")
    a = CQ.alignment(v).select(*SRC, "cosine_with_direction")
    c = CQ.candidates(v).select(*SRC, "cohens_d", "auc", F.col("decoder_cosine").alias("cosine_with_direction"), "combined_score")
    return j, a, c


def settled(v, name, build):
    return v.memo(name, lambda: settle(build(), name))


def signal(v):
    j, a, c = sources(v)
    return settled(v, "signal", lambda: T.signal_metrics(j, a, c))


def membership(v):
    j, _, c = sources(v)
    return T.top_membership(j, c, 5)


def specificity(v):
    return settled(v, "specificity", lambda: T.entity_specificity(CQ.entity_selectivity(v)))


def localization(v):
    return settled(v, "localization", lambda: K.token_localization(v.token_lists))


def spine(v):
    return T.feature_key_spine(signal(v), settled(v, "membership", lambda: T.membership_counts(membership(v))), specificity(v), localization(v))


def shared(v):
    return T.shared_loading_score([CQ.alignment(v).select("layer", "feature_id", F.abs("signed_dot").alias("abs_loading"))])


def triage(v):
    return settled(v, "triage", lambda: T.triage_roles(T.triage_scores(spine(v), shared(v))))


def candidates_triaged(v):
    """Raw-variant candidates with verdicts and signs, as the feature-set builder reads them."""

    def build():
        c = CQ.candidates(v).filter("resid = 'raw'")
        t = T.candidate_triage_join(c, triage(v)).join(triage(v).select("layer", "feature_id", "max_abs_cohens_d", "top_axis"), T.FEATURE, "left")
        sign = grid.feature_sign(F.col("direction_side"), [F.col("decoder_cosine"), F.col("cohens_d")])
        return t.withColumn("sign", sign).withColumn("top_axis", F.coalesce("top_axis", F.lit("")))

    return settled(v, "candidates-triaged", build)


def sets(v):
    return settled(v, "feature-sets", lambda: grid.feature_sets(candidates_triaged(v), [1, 3]))


SIG = ["max_abs_cohens_d", "max_auc_distance_from_0_5", "max_abs_decoder_cosine", "mean_abs_decoder_cosine", "max_combined_score"]
SIG_ID = ["layer", "feature_id", "n_contrasts_seen", "n_axes_seen", "n_entities_seen", "top_contrast_by_selectivity", "signal_top_axis", "top_contrasts_by_selectivity"]


@query("signal_metrics", f"SELECT {', '.join(SIG_ID)}, {rs(SIG)} FROM v_signal")
def signal_metrics(v):
    return r_cols(signal(v).select(*SIG_ID, *SIG), SIG)


@query("top_membership", "SELECT layer, feature_id, contrast_name, axis, membership_type FROM v_member")
def top_membership(v):
    return membership(v)


@query("membership_counts", "SELECT * FROM v_memagg")
def membership_counts(v):
    return T.membership_counts(membership(v))


ES = ["top_entity_mean_activation", "second_entity_mean_activation", "entity_specificity_ratio", "top_entity_share", "top_axis_fraction", "axis_entropy", "entity_entropy"]
ES_ID = ["layer", "feature_id", "top_entity", "top_entity_label", "top_axis", "top_entities_by_activation"]


@query("entity_specificity", f"SELECT {', '.join(ES_ID)}, {rs(ES)} FROM v_espec")
def entity_specificity(v):
    return r_cols(specificity(v).select(*ES_ID, *ES), ES)


@query("shared_loading_score", f"SELECT layer, feature_id, {R('shared_pc_loading_score')} AS shared_pc_loading_score FROM v_shared")
def shared_loading_score(v):
    return r_cols(shared(v), ["shared_pc_loading_score"])


@query("feature_key_spine", "SELECT layer, feature_id, n_contrasts_seen, n_contrasts_where_top_feature, top_entity, feature_localization_type FROM v_spine")
def feature_key_spine(v):
    return spine(v).select("layer", "feature_id", "n_contrasts_seen", "n_contrasts_where_top_feature", "top_entity", "feature_localization_type")


@query("union_sources", f"SELECT layer, feature_id, contrast_name, {rs(['cohens_d', 'cosine_with_direction'])} FROM v_src")
def union_sources(v):
    return r_cols(T.union_sources(*sources(v)).select("layer", "feature_id", "contrast_name", "cohens_d", "cosine_with_direction"), ["cohens_d", "cosine_with_direction"])


SC = ["contrast_specificity_score", "sharedness_score", "template_artifact_score", "polysemanticity_score", "cross_axis_activation_score", "shared_pc_loading_score"]


@query("triage_scores", f"SELECT layer, feature_id, {rs(SC)} FROM v_scored")
def triage_scores(v):
    return r_cols(T.triage_scores(spine(v), shared(v)).select("layer", "feature_id", *SC), SC)


@query("triage_roles", f"SELECT layer, feature_id, provisional_role, {R('role_confidence')} AS role_confidence, keep_for_intervention, intervention_priority, reason FROM v_triage")
def triage_roles(v):
    return r_cols(triage(v).select("layer", "feature_id", "provisional_role", "role_confidence", "keep_for_intervention", "intervention_priority", "reason"), ["role_confidence"])


SUMM = ["mean_confidence", "mean_max_abs_d", "mean_max_abs_decoder_cosine", "mean_template_artifact_score"]


@query(
    "triage_summary",
    f"""SELECT provisional_role AS role, count(feature_id) AS n_features, {R('avg(role_confidence)')} AS mean_confidence, count(*) FILTER (WHERE keep_for_intervention) AS n_keep_for_intervention,
 {R('avg(max_abs_cohens_d)')} AS mean_max_abs_d, {R('avg(max_abs_decoder_cosine)')} AS mean_max_abs_decoder_cosine, {R('avg(template_artifact_score)')} AS mean_template_artifact_score FROM v_triage GROUP BY provisional_role""",
)
def triage_summary(v):
    return r_cols(T.triage_summary(triage(v)), SUMM)


@query("role_counts", "SELECT layer, provisional_role, count(*) AS n_features, count(*) FILTER (WHERE keep_for_intervention) AS n_keep_for_intervention FROM v_triage GROUP BY layer, provisional_role")
def role_counts(v):
    return T.role_counts(triage(v))


@query("role_axis_pivot", "SELECT top_axis, " + ", ".join(f"count(*) FILTER (WHERE provisional_role = '{r}') AS {r}" for r in T.K.ROLE_ORDER) + " FROM v_triage GROUP BY top_axis")
def role_axis_pivot(v):
    return T.role_axis_pivot(triage(v))


@query("kept_per_contrast", "SELECT contrast_name, count(DISTINCT feature_id) AS n_kept FROM v_ctri WHERE keep_for_intervention GROUP BY contrast_name")
def kept_per_contrast(v):
    return T.kept_per_contrast(candidates_triaged(v))


@query("triage_order", f"SELECT layer, feature_id, provisional_role, intervention_priority, {R('role_confidence')} AS role_confidence FROM v_triage WHERE keep_for_intervention ORDER BY keep_for_intervention DESC, {PRI}, role_confidence DESC, max_abs_cohens_d DESC NULLS LAST, layer, feature_id LIMIT 100")
def triage_order(v):
    top = T.triage_order(triage(v).filter("keep_for_intervention")).limit(100)
    return r_cols(top.select("layer", "feature_id", "provisional_role", "intervention_priority", "role_confidence"), ["role_confidence"])


@query("candidate_triage_join", f"SELECT layer, contrast_name, feature_id, keep_for_intervention, intervention_priority, provisional_role, {rs(['combined_score', 'role_confidence'])} FROM v_ctri")
def candidate_triage_join(v):
    c = candidates_triaged(v).select("layer", "contrast_name", "feature_id", "keep_for_intervention", "intervention_priority", "provisional_role", "combined_score", "role_confidence")
    out = c.orderBy(F.desc("keep_for_intervention"), grid.priority_number(F.col("intervention_priority")), F.desc("combined_score"), F.desc("role_confidence"), "contrast_name", "feature_id")
    return r_cols(out, ["combined_score", "role_confidence"])


@query("priority_sort", f"SELECT layer, contrast_name, feature_id, row_number() OVER (PARTITION BY layer ORDER BY {PORDER}) AS rank FROM v_ctri")
def priority_sort(v):
    from pyspark.sql import Window

    w = Window.partitionBy("layer").orderBy(*grid.priority_order(), "contrast_name", "feature_id")
    return candidates_triaged(v).select("layer", "contrast_name", "feature_id", F.row_number().over(w).alias("rank"))


@query("feature_sign", "SELECT layer, contrast_name, feature_id, sign FROM v_ctri")
def feature_sign(v):
    return candidates_triaged(v).select("layer", "contrast_name", "feature_id", "sign")


@query(
    "selected_features",
    """WITH rk AS (SELECT layer, feature_id, row_number() OVER (PARTITION BY layer, contrast_name ORDER BY combined_score DESC NULLS LAST, feature_id) AS a, row_number() OVER (PARTITION BY layer, contrast_name ORDER BY cosine_with_direction DESC NULLS LAST, feature_id) AS b,
  row_number() OVER (PARTITION BY layer, contrast_name ORDER BY cosine_with_direction NULLS LAST, feature_id) AS c, row_number() OVER (PARTITION BY layer, contrast_name ORDER BY abs(cohens_d) DESC NULLS LAST, feature_id) AS d FROM v_joined WHERE resid = 'raw')
SELECT layer, feature_id FROM rk WHERE least(a, b, c, d) <= 3
UNION SELECT layer, feature_id FROM (SELECT layer, feature_id, row_number() OVER (PARTITION BY layer, contrast_name ORDER BY combined_score DESC NULLS LAST, feature_id) AS a FROM v_cand WHERE resid = 'raw') WHERE a <= 3
UNION SELECT layer, feature_id FROM (SELECT layer, feature_id, row_number() OVER (PARTITION BY layer, entity ORDER BY abs(cohens_d) DESC NULLS LAST, feature_id) AS a FROM v_esel) WHERE a <= 1""",
)
def selected_features(v):
    raw = F.col("resid") == "raw"
    return T.selected_features(CQ.candidates(v).filter(raw), CQ.joined(v).filter(raw), CQ.entity_selectivity(v), 3, 1)


KEPT_ROLES = ["identity_token_local", "sentence_final_integrated", "contrast_specific_identity", "shared_social_feature"]


@query(
    "kept_features",
    f"""SELECT layer, feature_id, contrast_name, provisional_role, rank FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY {PORDER}) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY layer, feature_id ORDER BY {PORDER}) AS rn FROM v_ctri WHERE keep_for_intervention AND provisional_role IN ({', '.join(f"'{r}'" for r in KEPT_ROLES)})) WHERE rn = 1) WHERE rank <= 10""",
)
def kept_features(v):
    return T.kept_features(candidates_triaged(v), KEPT_ROLES, 10).select("layer", "feature_id", "contrast_name", "provisional_role", "rank")


@query(
    "rare_prompt_selection",
    f"""SELECT layer, feature_id, row_id, {R('activation')} AS activation, entity FROM (SELECT *, row_number() OVER (PARTITION BY layer, feature_id ORDER BY activation DESC, row_id) AS rn, max(activation) OVER (PARTITION BY layer, feature_id) AS mx
 FROM v_pre) JOIN v_meta USING (row_id) WHERE rn <= 20 AND (activation > 0 OR mx <= 0)""",
)
def rare_prompt_selection(v):
    vals = CQ.C.linear_relu_selected(v.vectors, v.enc_weights, list(range(N_FEATURES)))
    feats = v.enc_weights.select("layer", "feature_id")
    out = T.rare_prompt_selection(vals, v.layer_meta, feats, 20)
    return r_cols(out.select("layer", "feature_id", "row_id", "activation", "entity"), ["activation"])


@query(
    "feature_auto_label",
    """WITH p AS (SELECT d.layer, d.feature_id, m.axis, m.entity, m.canonical_label, avg(activation) AS v FROM v_dense d JOIN v_meta m USING (row_id) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY layer, feature_id ORDER BY v DESC, entity) AS rn FROM p),
 a AS (SELECT layer, feature_id, arg_min(axis, (-n, axis)) AS top_axis, max(n) / sum(n) AS share FROM (SELECT layer, feature_id, axis, count(*) AS n FROM r WHERE rn <= 10 GROUP BY ALL) GROUP BY layer, feature_id),
 lo AS (SELECT layer, feature_id, 1.0 * (feature_localization_type = 'identity_span_local')::INT AS loc FROM v_loc)
SELECT r.layer, r.feature_id, CASE WHEN v > 0 AND share >= 0.7 THEN replace(top_axis, '_', ' ') || ' feature' WHEN v > 0 THEN canonical_label || '-selective feature' WHEN loc > 0.5 THEN 'identity-token-local feature' ELSE 'mixed/polysemantic feature' END AS auto_label, top_axis, canonical_label AS top_entity
FROM r JOIN a USING (layer, feature_id) LEFT JOIN lo USING (layer, feature_id) WHERE rn = 1""",
)
def feature_auto_label(v):
    return T.feature_auto_label(CQ.profile(v), localization(v))


@query("feature_set_build", "SELECT layer, mode, set_id, feature_ids, signs, roles, contrast_name, axis, control_type FROM v_sets")
def feature_set_build(v):
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), ",").alias(c)
    return sets(v).select("layer", "mode", "set_id", join("feature_ids"), join("signs"), F.array_join("roles", ",").alias("roles"), "contrast_name", "axis", "control_type")


@query(
    "feature_set_vector",
    f"""WITH m AS (SELECT layer, set_id, unnest(string_split(feature_ids, ','))::INT AS feature_id, unnest(string_split(signs, ','))::DOUBLE AS sign FROM v_sets),
 n AS (SELECT feature_id, pos, w / greatest(sqrt(sum(w * w) OVER (PARTITION BY feature_id)), 1e-9) AS u FROM v_wdec),
 q AS (SELECT layer, set_id, pos, avg(sign * u) AS x FROM m JOIN n USING (feature_id) GROUP BY layer, set_id, pos)
SELECT layer, set_id, pos, {R('x / greatest(sqrt(sum(x * x) OVER (PARTITION BY layer, set_id)), 1e-9)')} AS x FROM q""",
)
def feature_set_vector(v):
    return explode_vec(grid.feature_set_vector(sets(v), v.dec_weights), ["layer", "set_id"], F.col("vec"), "x")


@query(
    "clip_ratio",
    f"SELECT l_orderkey, l_linenumber, {R('greatest(0, least(1, l_tax * 30 - 0.5))')} AS clipped, {R('l_extendedprice / greatest(l_discount, 1e-9)', 2)} AS ratio FROM lineitem",
)
def clip_ratio(v):
    t = v.table("lineitem")
    return t.select(
        "l_orderkey", "l_linenumber", rounded(clip01(F.col("l_tax") * 30 - 0.5)).alias("clipped"),
        rounded(safe_ratio(F.col("l_extendedprice"), F.col("l_discount")), 2).alias("ratio"),
    )


@query(
    "feature_card_index",
    f"""SELECT b.layer, b.feature_id, {rs(['mean_target_identity', 'mean_nontarget_identity', 'mean_stereotype_language', 'mean_final_token'])}, behavior_role, t.provisional_role, t.top_axis, {R('s.m')} AS max_activation, {R('s.f')} AS activation_frequency
FROM v_behavior b LEFT JOIN v_triage t USING (layer, feature_id) LEFT JOIN (SELECT layer, feature_id, max(activation) AS m, count(*) / (SELECT count(*) FROM v_meta) AS f FROM v_codes GROUP BY layer, feature_id) s USING (layer, feature_id)""",
)
def feature_card_index(v):
    n = v.layer_meta.groupBy("layer").agg(F.count(F.lit(1)).alias("n_rows"))
    stats = v.codes.groupBy("layer", "feature_id").agg(F.max("activation").alias("max_activation"), F.count(F.lit(1)).alias("c")).join(n, "layer").withColumn("activation_frequency", F.col("c") / F.col("n_rows"))
    meta = triage(v).select("layer", "feature_id", "provisional_role", "top_axis")
    out = K.feature_card_index(v.item_tokens, meta, stats)
    return r_cols(out, ["mean_target_identity", "mean_nontarget_identity", "mean_stereotype_language", "mean_final_token", "max_activation", "activation_frequency"])
