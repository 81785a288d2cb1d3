"""Queries on sparse features: encoding, selectivity, alignment, reconstruction, edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetlens.functions.settle import settle
from facetlens.operators import codes as C, geometry as G, means as M
from facetlens.plans.geometry_queries import K_SQL, directions, explode_vec, r_cols, variant_means
from facetlens.plans.registry import query
from facetlens.plans.sqlviews import R, TOP_N, metric_sql
from facetlens.plans.views import RESID_KEYS, TOP_K

SEL = ["mean_a", "mean_b", "freq_a", "freq_b", "mean_nonzero_a", "mean_nonzero_b", "diff_mean", "cohens_d", "auc"]
ALN = ["decoder_norm", "cosine_with_direction", "signed_dot"]
STEER_IDS = [3, 17, 40]
RECON_KS = [5, 10, 20]
#: The fixture's weights are small; this makes several blocks of them.
BLOCK_BYTES = 8 << 10


def rsql(cols):
    return ", ".join(f"{R(c)} AS {c}" for c in cols)


def _settled(v, name, build):
    return v.memo(name, lambda: settle(build(), name))


def selectivity(v):
    return _settled(v, "selectivity", lambda: C.contrast_feature_selectivity(v.codes, v.layer_meta, v.contrasts, v.dec_weights, TOP_N))


def alignment(v):
    return _settled(v, "alignment", lambda: C.decoder_alignment(v.dec_weights, directions(v)))


def joined(v):
    return _settled(v, "joined", lambda: C.zscore_combined(C.selectivity_alignment_join(selectivity(v), alignment(v))))


def candidates(v):
    return C.intervention_candidates(joined(v), 5)


@query(
    "linear_relu_topk",
    f"""SELECT layer, row_id, feature_id, {R('activation')} AS activation FROM (
 SELECT *, row_number() OVER (PARTITION BY layer, row_id ORDER BY activation DESC, feature_id) AS rn FROM v_pre_centred) WHERE rn <= {TOP_K} AND activation > 0""",
)
def linear_relu_topk(v):
    """Encoded in many blocks, with a decoder bias."""
    arrays = C.linear_relu_topk(v.vectors, v.enc_weights, TOP_K, v.dec_bias, BLOCK_BYTES)
    return r_cols(C.codes_to_long(arrays), ["activation"])


@query(
    "codes_to_long",
    f"""SELECT layer, row_id, rn - 1 AS slot, feature_id, {R('activation')} AS activation FROM (
 SELECT *, row_number() OVER (PARTITION BY layer, row_id ORDER BY activation DESC, feature_id) AS rn FROM v_codes)""",
)
def codes_to_long(v):
    slots = v.code_arrays.select("layer", "row_id", F.posexplode(F.arrays_zip("indices", "values")).alias("slot", "z"))
    long = slots.select("layer", "row_id", "slot", F.col("z.indices").alias("feature_id"), F.col("z.values").alias("activation"))
    return r_cols(long.filter("activation > 0"), ["activation"])


@query("linear_relu_selected", f"SELECT layer, row_id, feature_id, {R('activation')} AS activation FROM v_pre_centred WHERE feature_id IN (3, 17, 40)")
def linear_relu_selected(v):
    return r_cols(C.linear_relu_selected(v.vectors, v.enc_weights, STEER_IDS, v.dec_bias), ["activation"])


@query(
    "feature_stats",
    f"""WITH n AS (SELECT count(*) AS n FROM v_meta), s AS (SELECT DISTINCT layer, feature_id FROM v_pre)
SELECT s.layer, s.feature_id, count(c.activation) AS activation_count, {R('count(c.activation) / any_value(n.n)')} AS activation_frequency,
 {R('coalesce(avg(c.activation), 0)')} AS mean_activation_nonzero, {R('coalesce(sum(c.activation), 0) / any_value(n.n)')} AS mean_activation_all,
 {R('coalesce(max(c.activation), 0)')} AS max_activation, {R('coalesce(quantile_cont(c.activation, 0.95), 0)')} AS p95_activation, {R('coalesce(quantile_cont(c.activation, 0.99), 0)')} AS p99_activation
FROM s CROSS JOIN n LEFT JOIN v_codes c USING (layer, feature_id) GROUP BY s.layer, s.feature_id""",
)
def feature_stats(v):
    n = v.layer_meta.groupBy("layer").agg(F.count(F.lit(1)).alias("n_rows"))
    out = C.feature_stats(v.codes, v.dec_weights, n)
    return r_cols(out, [c for c in out.columns if c not in ("layer", "feature_id", "activation_count")])


@query(
    "feature_group_summary",
    f"""SELECT d.layer, m.entity, d.feature_id, {R('sum(activation)')} AS sum_activation, count(*) FILTER (WHERE activation > 0) AS nonzero,
 {R('coalesce(avg(activation) FILTER (WHERE activation > 0), 0)')} AS mean_nonzero, {R('avg(activation)')} AS mean, {R('avg((activation > 0)::INT)')} AS freq, count(*) AS n
FROM v_dense d JOIN v_meta m USING (row_id) GROUP BY d.layer, m.entity, d.feature_id""",
)
def feature_group_summary(v):
    out = C.feature_group_summary(v.codes, v.layer_meta, ["entity"], v.dec_weights)
    return r_cols(out, ["sum_activation", "mean_nonzero", "mean", "freq"])


@query(
    "full_outer_stats",
    f"""WITH g AS (SELECT c.layer, c.feature_id, sum(activation) FILTER (WHERE entity = 'g0') AS s_a, count(*) FILTER (WHERE entity = 'g0') AS nz_a,
  sum(activation) FILTER (WHERE entity = 'g3') AS s_b, count(*) FILTER (WHERE entity = 'g3') AS nz_b FROM v_codes c JOIN v_meta USING (row_id) GROUP BY ALL)
SELECT layer, feature_id, {R('coalesce(s_a, 0)')} AS s_a, nz_a, {R('coalesce(s_b, 0)')} AS s_b, nz_b FROM g WHERE nz_a + nz_b > 0""",
)
def full_outer_stats(v):
    sums = C.group_feature_sums(v.codes, v.layer_meta, ["entity"])
    pick = lambda e: sums.filter(F.col("entity") == e)
    out = C.full_outer_stats(pick("g0"), pick("g3"), ["layer", "feature_id"], ["s", "nz"])
    return r_cols(out, ["s_a", "s_b"])


@query(
    "contrast_feature_selectivity",
    f"SELECT layer, contrast_name, axis, entity_a, entity_b, feature_id, {rsql(SEL)}, n_a, n_b, rank_abs_d, rank_auc, rank_abs_diff FROM v_sel",
)
def contrast_feature_selectivity(v):
    return r_cols(selectivity(v), SEL)


ESEL = ["mean_entity", "mean_other_same_axis", "diff_mean", "cohens_d", "auc", "freq_entity", "freq_other"]


def entity_selectivity(v):
    return _settled(v, "entity-selectivity", lambda: C.entity_feature_selectivity(v.codes, v.layer_meta, v.dec_weights, TOP_N))


@query("entity_feature_selectivity", f"SELECT layer, axis, entity, canonical_label, feature_id, {rsql(ESEL)}, n_entity, n_other FROM v_esel")
def entity_feature_selectivity(v):
    return r_cols(entity_selectivity(v), ESEL)


@query("decoder_alignment", f"SELECT {K_SQL}, feature_id, {rsql(ALN)} FROM v_align")
def decoder_alignment(v):
    return r_cols(alignment(v), ALN)


@query(
    "alignment_ranks",
    f"""SELECT layer, resid, contrast_name, feature_id, rank() OVER (w ORDER BY abs(cosine_with_direction) DESC) AS abs_cosine_rank,
 rank() OVER (w ORDER BY cosine_with_direction DESC) AS positive_rank, rank() OVER (w ORDER BY cosine_with_direction) AS negative_rank
FROM (SELECT layer, resid, contrast_name, feature_id, {R('cosine_with_direction')} AS cosine_with_direction FROM v_align) WINDOW w AS (PARTITION BY layer, resid, contrast_name)""",
)
def alignment_ranks(v):
    """Cosines are rounded first so that equal decoder rows tie in both engines."""
    a = C.alignment_ranks(r_cols(alignment(v), ["cosine_with_direction"]))
    return a.select(*RESID_KEYS, "contrast_name", "feature_id", "abs_cosine_rank", "positive_rank", "negative_rank")


@query(
    "alignment_top_union",
    f"""SELECT layer, resid, contrast_name, feature_id, cosine_with_direction FROM (SELECT *,
  row_number() OVER (PARTITION BY layer, resid, contrast_name ORDER BY abs(cosine_with_direction) DESC, feature_id) AS a,
  row_number() OVER (PARTITION BY layer, resid, contrast_name ORDER BY cosine_with_direction DESC, feature_id) AS b,
  row_number() OVER (PARTITION BY layer, resid, contrast_name ORDER BY cosine_with_direction, feature_id) AS c
 FROM (SELECT layer, resid, contrast_name, feature_id, {R('cosine_with_direction')} AS cosine_with_direction FROM v_align)) WHERE least(a, b, c) <= 10""",
)
def alignment_top_union(v):
    a = r_cols(alignment(v), ["cosine_with_direction"])
    return C.alignment_top_union(a, 10).select(*RESID_KEYS, "contrast_name", "feature_id", "cosine_with_direction")


@query("selectivity_alignment_join", f"SELECT {K_SQL}, feature_id, {rsql(['cohens_d', 'auc', *ALN])} FROM v_sa")
def selectivity_alignment_join(v):
    out = C.selectivity_alignment_join(selectivity(v), alignment(v))
    return r_cols(out.select(*RESID_KEYS, *G.CONTRAST, "feature_id", "cohens_d", "auc", *ALN), ["cohens_d", "auc", *ALN])


@query("zscore_combined", f"SELECT layer, resid, contrast_name, feature_id, {R('combined_score')} AS combined_score FROM v_joined")
def zscore_combined(v):
    return r_cols(joined(v).select(*RESID_KEYS, "contrast_name", "feature_id", "combined_score"), ["combined_score"])


CAND = ["mean_activation_a", "mean_activation_b", "decoder_cosine", "cohens_d", "auc", "combined_score"]


@query(
    "intervention_candidates",
    f"SELECT layer, resid, contrast_name, axis, entity_a, entity_b, feature_id, direction_side, {rsql(CAND)}, '{C.CANDIDATE_ADVICE}' AS recommended_intervention, '{C.CANDIDATE_NOTE}' AS notes FROM v_cand",
)
def intervention_candidates(v):
    return r_cols(candidates(v), CAND)


_HASH = "md5(concat_ws(':', '0', contrast_name, feature_id))"


@query(
    "direction_reconstruction",
    f"""WITH ord AS (
 SELECT layer, resid, contrast_name, feature_id, 'decoder_alignment' AS selection_method, row_number() OVER (PARTITION BY layer, resid, contrast_name ORDER BY abs(cosine_with_direction) DESC, feature_id) AS rn FROM (SELECT * REPLACE ({R('cosine_with_direction')} AS cosine_with_direction) FROM v_align)
 UNION ALL SELECT layer, resid, contrast_name, feature_id, 'selectivity', row_number() OVER (PARTITION BY layer, resid, contrast_name ORDER BY abs(cohens_d) DESC NULLS LAST, feature_id) FROM v_joined
 UNION ALL SELECT layer, resid, contrast_name, feature_id, 'combined_score', row_number() OVER (PARTITION BY layer, resid, contrast_name ORDER BY combined_score DESC NULLS LAST, feature_id) FROM v_joined
 UNION ALL SELECT layer, resid, contrast_name, feature_id, 'random_baseline', row_number() OVER (PARTITION BY layer, resid, contrast_name ORDER BY {_HASH}, feature_id) FROM v_align),
nd AS (SELECT feature_id, pos, w / greatest(sqrt(sum(w * w) OVER (PARTITION BY feature_id)), 1e-12) AS u FROM v_wdec),
sel AS (SELECT o.*, k.k FROM ord o JOIN (VALUES (5), (10), (20)) k(k) ON o.rn <= k.k),
co AS (SELECT s.layer, s.resid, s.contrast_name, s.selection_method, s.k, s.feature_id, sum(n.u * d.d) AS c FROM sel s JOIN nd n USING (feature_id) JOIN v_dir d ON d.layer = s.layer AND d.resid = s.resid AND d.contrast_name = s.contrast_name AND d.pos = n.pos GROUP BY ALL),
rc AS (SELECT co.layer, co.resid, co.contrast_name, co.selection_method, co.k, n.pos, sum(co.c * n.u) AS r, count(*) AS nf FROM co JOIN nd n USING (feature_id) GROUP BY ALL),
ru AS (SELECT r.*, d.d, d.axis, d.entity_a, d.entity_b, sqrt(sum(r * r) OVER (PARTITION BY layer, resid, contrast_name, selection_method, k)) AS nr FROM rc r JOIN v_dir d USING (layer, resid, contrast_name, pos)),
hd AS (SELECT layer, resid, contrast_name, axis, entity_a, entity_b, selection_method, k, any_value(nf) AS n_features, sum(d * r / nr) AS cosf, any_value(nr * nr) AS fr FROM ru GROUP BY layer, resid, contrast_name, axis, entity_a, entity_b, selection_method, k),
sc AS (SELECT r.layer, r.resid, u.contrast_name, u.selection_method, u.k, r.row_id, r.entity = u.entity_a AS is_a, sum((r.x - g.gm) * u.r / u.nr) AS score
 FROM v_resid r JOIN v_gm g USING (layer, resid, pos) JOIN ru u ON u.layer = r.layer AND u.resid = r.resid AND u.pos = r.pos AND (r.entity = u.entity_a OR r.entity = u.entity_b) GROUP BY ALL),
mt AS ({metric_sql('sc', 'layer, resid, contrast_name, selection_method, k')}),
fs AS (SELECT r.layer, r.resid, d.contrast_name, r.row_id, r.entity = d.entity_a AS is_a, sum((r.x - g.gm) * d.d) AS score
 FROM v_resid r JOIN v_gm g USING (layer, resid, pos) JOIN v_dir d ON d.layer = r.layer AND d.resid = r.resid AND d.pos = r.pos AND (r.entity = d.entity_a OR r.entity = d.entity_b) GROUP BY ALL),
fm AS ({metric_sql('fs', 'layer, resid, contrast_name')})
SELECT hd.layer, hd.resid, hd.contrast_name, hd.axis, hd.entity_a, hd.entity_b, hd.selection_method, hd.k, hd.n_features, {R('cosf')} AS cosine_with_full_direction, {R('fr')} AS fraction_norm_captured, {R('mt.auc')} AS auc, {R('mt.cohens_d')} AS cohens_d, {R('fm.auc')} AS full_direction_auc, {R('fm.cohens_d')} AS full_direction_cohens_d
FROM hd LEFT JOIN mt USING (layer, resid, contrast_name, selection_method, k) LEFT JOIN fm ON fm.layer = hd.layer AND fm.resid = hd.resid AND fm.contrast_name = hd.contrast_name""",
)
def direction_reconstruction(v):
    vm = variant_means(v, extra=())
    d = directions(v)
    # Rounded cosines keep equal decoder rows tied, so the feature id decides.
    a = r_cols(C.decoder_alignment(v.dec_weights, d), ["cosine_with_direction"])
    out = C.direction_reconstruction(vm, d, v.dec_weights, a, joined(v), RECON_KS)
    return r_cols(out, ["cosine_with_full_direction", "fraction_norm_captured", "auc", "cohens_d", "full_direction_auc", "full_direction_cohens_d"])


@query(
    "dense_top_features",
    f"""WITH t AS (SELECT layer, feature_id, row_number() OVER (PARTITION BY layer ORDER BY count(*) DESC, feature_id) AS col FROM v_codes GROUP BY layer, feature_id)
SELECT t.layer, m.row_id, t.col - 1 AS col, t.feature_id, {R('coalesce(c.activation, 0)')} AS activation FROM v_meta m CROSS JOIN t LEFT JOIN v_codes c ON c.layer = t.layer AND c.row_id = m.row_id AND c.feature_id = t.feature_id WHERE t.col <= 16""",
)
def dense_top_features(v):
    d = C.dense_top_features(v.codes, v.layer_meta, 16)
    z = d.select("layer", "row_id", F.posexplode(F.arrays_zip("feature_ids", "values")).alias("col", "z"))
    return r_cols(z.select("layer", "row_id", "col", F.col("z.feature_ids").alias("feature_id"), F.col("z.values").alias("activation")), ["activation"])


@query("feature_values_for_id", f"SELECT l.layer, m.row_id, m.entity, {R('coalesce(c.activation, 0)')} AS activation FROM v_meta m CROSS JOIN v_layers l LEFT JOIN (SELECT * FROM v_codes WHERE feature_id = 17) c ON c.layer = l.layer AND c.row_id = m.row_id")
def feature_values_for_id(v):
    return r_cols(C.feature_values_for_id(v.codes, v.layer_meta, 17).select("layer", "row_id", "entity", "activation"), ["activation"])


@query(
    "entity_profile",
    f"SELECT d.layer, d.feature_id, m.axis, m.entity, m.canonical_label, {R('avg(activation)')} AS mean_activation, {R('avg((activation > 0)::INT)')} AS active_share FROM v_dense d JOIN v_meta m USING (row_id) GROUP BY ALL",
)
def entity_profile(v):
    return r_cols(profile(v), ["mean_activation", "active_share"])


def profile(v):
    """Zero-filled mean activation and active share of every feature per entity."""
    out = C.feature_group_summary(v.codes, v.layer_meta, ["axis", "entity", "canonical_label"], v.dec_weights)
    return out.select("layer", "feature_id", "axis", "entity", "canonical_label", F.col("mean").alias("mean_activation"), F.col("freq").alias("active_share"))


STEERED = """SELECT layer, row_id, feature_id, sum(activation) AS activation FROM (SELECT * FROM v_codes UNION ALL
 SELECT DISTINCT layer, row_id, f, 0.75::DOUBLE FROM v_codes_rows, (VALUES (3), (17), (40)) t(f)) GROUP BY layer, row_id, feature_id"""
STEERED = STEERED.replace("v_codes_rows", "(SELECT layer, row_id FROM v_vec)")


@query(
    "code_edit",
    f"""SELECT 'ablate' AS edit, layer, row_id, feature_id, {R('activation')} AS activation FROM v_codes WHERE feature_id NOT IN (3, 17, 40)
UNION ALL SELECT 'steer', layer, row_id, feature_id, {R('activation')} FROM ({STEERED})""",
)
def code_edit(v):
    cut = C.ablate_codes(v.codes, STEER_IDS).withColumn("edit", F.lit("ablate"))
    moved = C.steer_codes(v.codes, v.layer_meta, STEER_IDS, 0.75).withColumn("edit", F.lit("steer"))
    return r_cols(cut.unionByName(moved), ["activation"])


@query(
    "code_decode",
    f"""SELECT v.layer, v.row_id, v.pos, {R('coalesce(d.x, 0) + b.c')} AS x FROM v_long v JOIN v_bdec b USING (layer, pos) LEFT JOIN (
 SELECT c.layer, c.row_id, w.pos, sum(c.activation * w.w) AS x FROM v_codes c JOIN v_wdec w USING (feature_id) GROUP BY ALL) d USING (layer, row_id, pos)""",
)
def code_decode(v):
    return explode_vec(C.code_decode(v.codes, v.layer_meta, v.dec_weights, v.dec_bias, BLOCK_BYTES), ["layer", "row_id"], F.col("vec"), "x")


@query(
    "patch_residual",
    f"""SELECT v.layer, v.row_id, v.pos, {R('v.x + d.x')} AS x FROM v_long v JOIN (SELECT pos, sum(0.75::DOUBLE * w) AS x FROM v_wdec WHERE feature_id IN (3, 17, 40) GROUP BY pos) d USING (pos)""",
)
def patch_residual(v):
    """Steering adds alpha times three decoder rows, whatever the codes are."""
    steered = C.steer_codes(v.codes, v.layer_meta, STEER_IDS, 0.75)
    out = C.patch_residual(v.vectors.select("layer", "row_id", "vec"), steered, v.codes, v.dec_weights, BLOCK_BYTES)
    return explode_vec(out, ["layer", "row_id"], F.col("vec"), "x")
