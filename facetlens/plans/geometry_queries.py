"""Queries on labelled vectors: means, contrasts, effect sizes, stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetlens.functions import vec as V
from facetlens.functions.numeric import rounded
from facetlens.functions.settle import settle
from facetlens.operators import effects, geometry as G, means as M
from facetlens.plans.registry import query
from facetlens.plans.sqlviews import R, metric_sql
from facetlens.plans.views import RESID, RESID_KEYS

METRICS = ["auc", "cohens_d", "accuracy_midpoint", "mean_a", "mean_b", "sd_a", "sd_b"]
KEYS = [*RESID_KEYS, *G.CONTRAST]
R_METRICS = ", ".join(f"{R(c)} AS {c}" for c in METRICS)
K_SQL = "layer, resid, contrast_name, axis, entity_a, entity_b"


def r_cols(df, cols, digits=6):
    return df.withColumns({c: rounded(c, digits) for c in cols})


def explode_vec(df, keys, vec, value):
    """Long form (keys, pos, value) with the value rounded."""
    return df.select(*keys, F.posexplode(vec).alias("pos", value)).withColumn(value, rounded(value))


def variant_means(v, cell=("entity",), extra=("axis", "canonical_label")):
    return v.memo((cell, extra), lambda: M.VariantMeans(v.vectors, RESID, list(cell), list(extra)))


def family_means(v):
    return variant_means(v, ("entity", "family"), ())


def directions(v):
    build = lambda: settle(G.contrast_directions(variant_means(v, extra=()).means, v.contrasts, RESID_KEYS), "directions")
    return v.memo("directions", build)


def scores(v, rows):
    vm = variant_means(v, extra=())
    return G.projection_scores(vm, directions(v), rows)


def axis_scores(v):
    return scores(v, "axis")


def endpoint_scores(v):
    return scores(v, "endpoints")


@query("endpoint_metrics", f"SELECT {K_SQL}, {R_METRICS}, n_a, n_b FROM v_metrics")
def endpoint_metrics(v):
    return r_cols(G.layer_endpoint_metrics(variant_means(v, extra=()), v.contrasts), METRICS)


@query("auc", f"SELECT {K_SQL}, {R('auc')} AS auc FROM v_metrics")
def auc(v):
    return r_cols(effects.auc(endpoint_scores(v), KEYS), ["auc"])


@query("cohens_d", f"SELECT {K_SQL}, {R('cohens_d')} AS cohens_d, n_a, n_b FROM v_metrics")
def cohens_d(v):
    return r_cols(effects.cohens_d(endpoint_scores(v), KEYS), ["cohens_d"])


@query("midpoint_accuracy", f"SELECT {K_SQL}, {R('accuracy_midpoint')} AS accuracy_midpoint FROM v_metrics")
def midpoint_accuracy(v):
    return r_cols(effects.midpoint_accuracy(endpoint_scores(v), KEYS), ["accuracy_midpoint"])


@query(
    "group_vector_mean",
    f"""
SELECT 'entity' AS grain, layer, entity AS key_1, '' AS key_2, pos, {R('avg(x)')} AS mean, count(*) AS n FROM v_ml GROUP BY layer, entity, pos
UNION ALL
SELECT 'entity_family', layer, entity, family, pos, {R('avg(x)')}, count(*) FROM v_ml GROUP BY layer, entity, family, pos
UNION ALL
SELECT 'axis', layer, axis, '', pos, {R('avg(x)')}, count(*) FROM v_ml GROUP BY layer, axis, pos""",
)
def group_vector_mean(v):
    """The finest grain is aggregated from rows; the other two are pooled from it."""
    fine = M.group_vector_mean(v.vectors, ["layer", "axis", "entity", "family"])
    out = None
    for grain, k1, k2 in (("entity", "entity", None), ("entity_family", "entity", "family"), ("axis", "axis", None)):
        keys = ["layer", k1] + ([k2] if k2 else [])
        part = M.pooled_mean(fine, keys).select(
            F.lit(grain).alias("grain"), "layer", F.col(k1).alias("key_1"),
            (F.col(k2) if k2 else F.lit("")).alias("key_2"), "mean", "n",
        )
        out = part if out is None else out.unionByName(part)
    return explode_vec(out, ["grain", "layer", "key_1", "key_2", "n"], F.col("mean"), "mean")


@query("global_vector_mean", f"SELECT layer, pos, {R('avg(x)')} AS mean, count(*) AS n FROM v_long GROUP BY layer, pos")
def global_vector_mean(v):
    return explode_vec(M.group_vector_mean(v.vectors, ["layer"]), ["layer", "n"], F.col("mean"), "mean")


FACTORS = ["axis", "entity", "family", "template_id", "required_form"]


@query(
    "variance_decomposition",
    "WITH tot AS (SELECT layer, sum((x - g) * (x - g)) AS ss_total FROM (SELECT layer, x, avg(x) OVER (PARTITION BY layer, pos) AS g FROM v_long) GROUP BY layer),"
    " f AS ("
    + " UNION ALL ".join(
        f"SELECT layer, '{c}' AS factor, count(DISTINCT lev) AS n_groups, sum(n * (m - g) * (m - g)) AS ss_factor FROM (SELECT k.layer, k.lev, k.n, k.m, q.g FROM (SELECT layer, {c} AS lev, pos, count(*) AS n, avg(x) AS m FROM v_ml GROUP BY ALL) k JOIN (SELECT layer, pos, avg(x) AS g FROM v_long GROUP BY ALL) q USING (layer, pos)) GROUP BY layer"
        for c in FACTORS
    )
    + f") SELECT layer, factor, n_groups, {R('ss_factor')} AS ss_factor, {R('ss_total')} AS ss_total, {R('ss_factor / ss_total')} AS eta_squared FROM f JOIN tot USING (layer)",
)
def variance_decomposition(v):
    return r_cols(M.variance_decomposition(v.vectors, FACTORS), ["ss_factor", "ss_total", "eta_squared"])


@query("residualize", f"SELECT layer, resid, row_id, pos, {R('x')} AS x FROM v_resid")
def residualize(v):
    return explode_vec(v.resid_vectors, ["layer", "resid", "row_id"], F.col("vec"), "x")


@query("join_vectors_metadata", f"SELECT layer, row_id, entity, axis, family, template_id, required_form, pos, {R('x')} AS x FROM v_ml")
def join_vectors_metadata(v):
    vec = v.vectors.select("layer", "row_id", "vec")
    joined = vec.join(v.meta, "row_id")
    return explode_vec(joined, ["layer", "row_id", "entity", "axis", "family", "template_id", "required_form"], F.col("vec"), "x")


@query(
    "endpoint_label_join",
    """SELECT c.contrast_name, m.row_id, m.entity, m.axis,
  CASE WHEN m.entity = c.entity_a THEN 'a' WHEN m.entity = c.entity_b THEN 'b' ELSE 'other_same_axis' END AS endpoint
FROM v_meta m JOIN v_contrasts c USING (axis)""",
)
def endpoint_label_join(v):
    return G.tag_endpoints(v.meta, v.contrasts).select("contrast_name", "row_id", "entity", "axis", "endpoint")


@query(
    "contrast_direction",
    f"SELECT {K_SQL}, pos, {R('d')} AS d, false AS sign_flipped FROM v_dir",
)
def contrast_direction(v):
    return explode_vec(directions(v), [*KEYS, "sign_flipped"], F.col("dir"), "d")


@query("projection_scores", f"SELECT layer, resid, contrast_name, row_id, entity, {R('score')} AS score FROM v_scores")
def projection_scores(v):
    return r_cols(axis_scores(v).select(*RESID_KEYS, "contrast_name", "row_id", "entity", "score"), ["score"])


@query(
    "projection_scores_all_rows",
    f"""SELECT r.layer, d.contrast_name, r.row_id, {R('sum((r.x - g.gm) * d.d)')} AS score
FROM v_resid r JOIN v_gm g USING (layer, resid, pos) JOIN v_dir d USING (layer, resid, pos)
WHERE r.resid = 'raw' GROUP BY r.layer, d.contrast_name, r.row_id""",
)
def projection_scores_all_rows(v):
    vm = M.VariantMeans(v.vectors, {"raw": None}, ["entity"])
    s = G.projection_scores(vm, G.contrast_directions(vm.means, v.contrasts, RESID_KEYS), rows="all")
    return r_cols(s.select("layer", "contrast_name", "row_id", "score"), ["score"])


@query(
    "centroid_ordering",
    f"""SELECT layer, resid, contrast_name, axis, entity, {R('m')} AS mean_projection, {R('sd')} AS sd_projection,
 {R('sd / sqrt(n)')} AS se_projection, {R('m - 1.96::DOUBLE * sd / sqrt(n)')} AS ci95_low, {R('m + 1.96::DOUBLE * sd / sqrt(n)')} AS ci95_high, n, is_endpoint
FROM (SELECT layer, resid, contrast_name, axis, entity, avg(score) AS m, stddev_samp(score) AS sd, count(*) AS n,
      bool_or(entity = entity_a OR entity = entity_b) AS is_endpoint FROM v_scores GROUP BY layer, resid, contrast_name, axis, entity)""",
)
def centroid_ordering(v):
    out = G.centroid_ordering(axis_scores(v), RESID_KEYS)
    return r_cols(out, ["mean_projection", "sd_projection", "se_projection", "ci95_low", "ci95_high"])


STAB_SQL = """
WITH cell AS (SELECT layer, entity, axis, family, pos, avg(x) AS m FROM v_ml GROUP BY ALL),
g AS (SELECT layer, pos, avg(x) AS g FROM v_long GROUP BY ALL),
fs AS (SELECT a.layer, a.axis, a.entity, a.family AS family_a, b.family AS family_b,
  sum(a.m * b.m) / nullif(sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m)), 0) AS raw_cosine,
  sum((a.m - g.g) * (b.m - g.g)) / nullif(sqrt(sum((a.m - g.g) ** 2)) * sqrt(sum((b.m - g.g) ** 2)), 0) AS centered_cosine
 FROM cell a JOIN cell b ON a.layer = b.layer AND a.entity = b.entity AND a.pos = b.pos AND a.family < b.family
 JOIN g ON g.layer = a.layer AND g.pos = a.pos GROUP BY a.layer, a.axis, a.entity, a.family, b.family)
"""


@query("family_stability", f"{STAB_SQL} SELECT layer, axis, entity, family_a, family_b, {R('raw_cosine')} AS raw_cosine, {R('centered_cosine')} AS centered_cosine FROM fs")
def family_stability(v):
    return r_cols(G.family_stability(v.vectors, ["layer"]), ["raw_cosine", "centered_cosine"])


@query(
    "family_stability_summary",
    f"{STAB_SQL} SELECT layer, axis, {R('avg(centered_cosine)')} AS mean_cosine, {R('quantile_cont(centered_cosine, 0.5)')} AS median_cosine, {R('stddev_samp(centered_cosine)')} AS sd_cosine, count(centered_cosine) AS n_pairs FROM fs GROUP BY layer, axis",
)
def family_stability_summary(v):
    out = G.family_stability_summary(G.family_stability(v.vectors, ["layer"]), ["layer"])
    return r_cols(out, ["mean_cosine", "median_cosine", "sd_cosine"])


@query(
    "centroid_distances",
    f"""WITH p AS (SELECT a.layer, a.resid, a.axis, a.entity AS entity_i, b.entity AS entity_j,
   sum(a.m * b.m) / (greatest(sqrt(sum(a.m * a.m)), 1e-12) * greatest(sqrt(sum(b.m * b.m)), 1e-12)) AS cs, sqrt(sum((a.m - b.m) ** 2)) AS e
 FROM v_em a JOIN v_em b USING (layer, resid, axis, pos) GROUP BY a.layer, a.resid, a.axis, a.entity, b.entity)
SELECT layer, resid, axis, entity_i, entity_j, {R('cs')} AS cosine_similarity, {R('1 - cs')} AS cosine_distance, {R('e')} AS euclidean_distance FROM p""",
)
def centroid_distances(v):
    m = variant_means(v, extra=("axis",)).means
    return r_cols(G.centroid_distances(m, RESID_KEYS), ["cosine_similarity", "cosine_distance", "euclidean_distance"])


COS_SQL = """WITH dc AS (SELECT a.layer, a.resid, a.contrast_name AS contrast_i, b.contrast_name AS contrast_j, a.axis AS axis_i, b.axis AS axis_j,
  a.axis = b.axis AS same_axis, sum(a.d * b.d) AS cosine
 FROM v_dir a JOIN v_dir b USING (layer, resid, pos) GROUP BY a.layer, a.resid, a.contrast_name, b.contrast_name, a.axis, b.axis)
"""


@query("direction_cosines", f"{COS_SQL} SELECT layer, resid, contrast_i, contrast_j, axis_i, axis_j, same_axis, {R('cosine')} AS cosine FROM dc")
def direction_cosines(v):
    return r_cols(G.direction_cosines(directions(v), RESID_KEYS), ["cosine"])


@query(
    "direction_cosine_matrix",
    f"{COS_SQL} SELECT layer, resid, contrast_i, "
    + ", ".join(f"{R(f'''max(cosine) FILTER (WHERE contrast_j = '{c}')''')} AS {c}" for c in ("g0_vs_g3", "g3_vs_g6", "g6_vs_g9", "g1_vs_g4", "g4_vs_g7", "g2_vs_g5"))
    + " FROM dc GROUP BY layer, resid, contrast_i",
)
def direction_cosine_matrix(v):
    names = ["g0_vs_g3", "g3_vs_g6", "g6_vs_g9", "g1_vs_g4", "g4_vs_g7", "g2_vs_g5"]
    c = G.direction_cosines(directions(v), RESID_KEYS)
    return r_cols(c.groupBy(*RESID_KEYS, "contrast_i").pivot("contrast_j", names).agg(F.max("cosine")), names)


@query("pairwise_contrasts", "SELECT a.layer, a.resid, a.contrast_name AS contrast_i, b.contrast_name AS contrast_j, a.axis = b.axis AS same_axis FROM (SELECT DISTINCT layer, resid, contrast_name, axis FROM v_dir) a JOIN (SELECT DISTINCT layer, resid, contrast_name, axis FROM v_dir) b USING (layer, resid)")
def pairwise_contrasts(v):
    return G.direction_cosines(directions(v), RESID_KEYS).select(*RESID_KEYS, "contrast_i", "contrast_j", "same_axis")


@query("cosine_pair_summary", f"{COS_SQL} SELECT layer, resid, same_axis, {R('avg(abs(cosine))')} AS mean_abs_cosine, count(*) AS n_pairs FROM dc WHERE contrast_i < contrast_j GROUP BY layer, resid, same_axis")
def cosine_pair_summary(v):
    return r_cols(G.cosine_pair_summary(G.direction_cosines(directions(v), RESID_KEYS), RESID_KEYS), ["mean_abs_cosine"])


@query("cosine_top_pairs", f"{COS_SQL} SELECT layer, resid, contrast_i, contrast_j, axis_i, axis_j, same_axis, {R('cosine')} AS cosine FROM dc WHERE contrast_i < contrast_j ORDER BY abs(cosine) DESC LIMIT 200")
def cosine_top_pairs(v):
    return r_cols(G.top_cosine_pairs(G.direction_cosines(directions(v), RESID_KEYS)), ["cosine"])


@query(
    "layer_stability",
    f"""WITH nx AS (SELECT layer, lead(layer) OVER (ORDER BY layer) AS next_layer FROM v_layers),
 base AS (SELECT DISTINCT resid, contrast_name, axis, d.layer, next_layer FROM v_dir d JOIN nx USING (layer)),
 dots AS (SELECT a.layer AS la, b.layer AS lb, a.resid, a.contrast_name, sum(a.d * b.d) AS dp FROM v_dir a JOIN v_dir b USING (resid, contrast_name, pos) GROUP BY a.layer, b.layer, a.resid, a.contrast_name)
SELECT s.resid, s.contrast_name, s.axis, s.layer, s.next_layer, {R('x.dp')} AS adjacent_cosine, 24 AS reference_layer, {R('y.dp')} AS reference_cosine
FROM base s LEFT JOIN dots x ON x.la = s.layer AND x.lb = s.next_layer AND x.resid = s.resid AND x.contrast_name = s.contrast_name
LEFT JOIN dots y ON y.la = s.layer AND y.lb = 24 AND y.resid = s.resid AND y.contrast_name = s.contrast_name""",
)
def layer_stability(v):
    d = directions(v)
    out = G.layer_stability(d, v.vectors.select("layer"), 24, ["resid", "contrast_name"])
    return r_cols(out, ["adjacent_cosine", "reference_cosine"])


PLANES = [("ax0", "g0_vs_g3", "g6_vs_g9"), ("ax1", "g1_vs_g4", "g4_vs_g7")]
PLANE_SQL = f"""WITH sp AS (SELECT * FROM (VALUES {', '.join(str(p) for p in PLANES)}) t(axis, c1, c2)),
 pd AS (SELECT a.layer, a.resid, sp.axis, sp.c1, sp.c2, a.pos, a.d AS d1, b.d AS d2, sum(a.d * b.d) OVER (PARTITION BY a.layer, a.resid, sp.axis) AS dd
   FROM sp JOIN v_dir a ON a.contrast_name = sp.c1 JOIN v_dir b ON b.contrast_name = sp.c2 AND b.layer = a.layer AND b.resid = a.resid AND b.pos = a.pos),
 pe AS (SELECT *, (d2 - dd * d1) / sqrt(sum((d2 - dd * d1) ** 2) OVER (PARTITION BY layer, resid, axis)) AS e2 FROM pd),
 pz AS (SELECT r.layer, r.resid, r.axis, pe.c1 AS contrast_1, pe.c2 AS contrast_2, r.row_id, r.entity, r.canonical_label,
    sum((r.x - g.gm) * pe.d1) AS z1, sum((r.x - g.gm) * pe.e2) AS z2
   FROM v_resid r JOIN v_gm g USING (layer, resid, pos) JOIN pe ON pe.layer = r.layer AND pe.resid = r.resid AND pe.axis = r.axis AND pe.pos = r.pos GROUP BY ALL)
"""


def _plane(v):
    vm = variant_means(v, extra=())
    d = G.contrast_directions(vm.means, v.contrasts, RESID_KEYS)
    specs = v.spark.createDataFrame(PLANES, "axis string, contrast_1 string, contrast_2 string")
    return G.directional_plane(vm, d, specs)


@query("directional_plane", f"{PLANE_SQL} SELECT layer, resid, axis, contrast_1, contrast_2, row_id, entity, canonical_label, {R('z1')} AS z1, {R('z2')} AS z2 FROM pz")
def directional_plane(v):
    return r_cols(_plane(v), ["z1", "z2"])


@query("directional_plane_centroids", f"{PLANE_SQL} SELECT layer, resid, axis, contrast_1, contrast_2, canonical_label, {R('avg(z1)')} AS z1, {R('avg(z2)')} AS z2, count(*) AS n FROM pz GROUP BY layer, resid, axis, contrast_1, contrast_2, canonical_label")
def directional_plane_centroids(v):
    return r_cols(G.plane_centroids(_plane(v), RESID_KEYS), ["z1", "z2"])


CROSS_SQL = """WITH ca AS (SELECT e.layer, e.resid, d.contrast_name, d.axis AS contrast_axis, e.axis AS projected_axis, e.entity, e.canonical_label,
   sum((e.m - g.gm) * d.d) AS s FROM v_em e JOIN v_gm g USING (layer, resid, pos) JOIN v_dir d USING (layer, resid, pos)
   GROUP BY e.layer, e.resid, d.contrast_name, d.axis, e.axis, e.entity, e.canonical_label)
"""


def _cross(v):
    vm = variant_means(v)
    return G.cross_axis_projection(vm.means, G.contrast_directions(vm.means, v.contrasts, RESID_KEYS), vm.overall)


@query("cross_axis_projection", f"{CROSS_SQL} SELECT layer, resid, contrast_name, contrast_axis, projected_axis, entity, canonical_label, {R('s')} AS projection_score FROM ca")
def cross_axis_projection(v):
    return r_cols(_cross(v), ["projection_score"])


@query(
    "cross_axis_projection_summary",
    f"""{CROSS_SQL} SELECT layer, resid, contrast_name, contrast_axis, projected_axis, {R('avg(s)')} AS mean_projection, {R('stddev_samp(s)')} AS sd_projection,
 {R('max(s) - min(s)')} AS range_projection, arg_max(entity, s) AS max_entity, {R('max(s)')} AS max_score, arg_min(entity, s) AS min_entity, {R('min(s)')} AS min_score
FROM ca GROUP BY layer, resid, contrast_name, contrast_axis, projected_axis""",
)
def cross_axis_projection_summary(v):
    out = G.cross_axis_summary(_cross(v), RESID_KEYS)
    return r_cols(out, ["mean_projection", "sd_projection", "range_projection", "max_score", "min_score"])


HOLD_VIEW = """WITH fam AS (SELECT DISTINCT family FROM v_meta),
 tr AS (SELECT r.layer, r.resid, f.family AS held, r.entity, r.pos, avg(r.x) AS m, count(*) AS n FROM v_resid r JOIN fam f ON r.family <> f.family GROUP BY ALL),
 hd AS (SELECT a.layer, a.resid, a.held, c.contrast_name, c.axis, c.entity_a, c.entity_b, a.pos, a.m - b.m AS d, a.n AS n_train_a, b.n AS n_train_b
   FROM v_contrasts c JOIN tr a ON a.entity = c.entity_a JOIN tr b ON b.entity = c.entity_b AND a.layer = b.layer AND a.resid = b.resid AND a.held = b.held AND a.pos = b.pos),
 hn AS (SELECT *, d / sqrt(sum(d * d) OVER (PARTITION BY layer, resid, held, contrast_name)) AS u FROM hd),
 tm AS (SELECT r.layer, r.resid, f.family AS held, r.pos, avg(r.x) AS m FROM v_resid r JOIN fam f ON r.family <> f.family GROUP BY ALL),
 hs AS (SELECT r.layer, r.resid, h.contrast_name, h.axis, h.entity_a, h.entity_b, h.held AS heldout_family, h.n_train_a, h.n_train_b, r.row_id, r.entity = h.entity_a AS is_a,
    sum((r.x - tm.m) * h.u) AS score, sum((r.x - g.gm) * h.u) AS gscore
   FROM v_resid r JOIN hn h ON h.layer = r.layer AND h.resid = r.resid AND h.held = r.family AND h.pos = r.pos AND (r.entity = h.entity_a OR r.entity = h.entity_b)
   JOIN tm ON tm.layer = r.layer AND tm.resid = r.resid AND tm.held = r.family AND tm.pos = r.pos
   JOIN v_gm g ON g.layer = r.layer AND g.resid = r.resid AND g.pos = r.pos GROUP BY ALL)
"""
HK = "layer, resid, contrast_name, axis, entity_a, entity_b, heldout_family"


@query("family_holdout", f"{HOLD_VIEW}, hm AS ({metric_sql('hs', HK)}) SELECT {HK}, {R_METRICS}, n_a, n_b FROM hm WHERE n_a > 0 AND n_b > 0")
def family_holdout(v):
    return r_cols(G.family_holdout(family_means(v), v.contrasts), METRICS)


@query(
    "family_holdout_global_flipped",
    f"{HOLD_VIEW}, hm AS ({metric_sql('(SELECT * REPLACE (gscore AS score) FROM hs)', HK)}) SELECT {HK}, {R('CASE WHEN mean_a < mean_b THEN 1 - auc ELSE auc END')} AS auc, {R('abs(cohens_d)')} AS cohens_d, {R('mean_a')} AS mean_a, {R('mean_b')} AS mean_b, n_a, n_b FROM hm WHERE n_a > 0 AND n_b > 0",
)
def family_holdout_global_flipped(v):
    out = G.family_holdout(family_means(v), v.contrasts, center="global", flip_eval=True)
    cols = ["auc", "cohens_d", "mean_a", "mean_b"]
    return r_cols(out.select(*KEYS, "heldout_family", *cols, "n_a", "n_b"), cols)


@query(
    "holdout_summary",
    f"""{HOLD_VIEW}, hm AS ({metric_sql('hs', HK)}), q AS (SELECT layer, resid, avg(auc) AS m, stddev_samp(auc) AS s, count(auc) AS n FROM hm WHERE n_a > 0 AND n_b > 0 GROUP BY layer, resid)
SELECT layer, resid, {R('m')} AS mean_auc, {R('s')} AS sd_auc, {R('greatest(0, m - coalesce(s, 0))')} AS low, {R('least(1, m + coalesce(s, 0))')} AS high, n FROM q""",
)
def holdout_summary(v):
    h = G.family_holdout(family_means(v), v.contrasts)
    return r_cols(G.holdout_summary(h, RESID_KEYS), ["mean_auc", "sd_auc", "low", "high"])


TRANSFER_VIEW = HOLD_VIEW + """, cell AS (SELECT layer, resid, entity, family, pos, avg(x) AS m, count(*) AS n FROM v_resid GROUP BY ALL),
 od AS (SELECT a.layer, a.resid, a.family AS train_family, c.contrast_name, c.axis, c.entity_a, c.entity_b, a.pos, a.m - b.m AS d, a.n AS n_train_a, b.n AS n_train_b
  FROM v_contrasts c JOIN cell a ON a.entity = c.entity_a JOIN cell b ON b.entity = c.entity_b AND a.layer = b.layer AND a.resid = b.resid AND a.family = b.family AND a.pos = b.pos),
 oo AS (SELECT *, d / sqrt(sum(d * d) OVER (PARTITION BY layer, resid, train_family, contrast_name)) AS u FROM od),
 ts AS (SELECT r.layer, r.resid, h.contrast_name, h.axis, h.entity_a, h.entity_b, h.train_family, r.family AS test_family, h.n_train_a, h.n_train_b, r.row_id, r.entity = h.entity_a AS is_a, sum((r.x - g.gm) * h.u) AS score
   FROM v_resid r JOIN oo h ON h.layer = r.layer AND h.resid = r.resid AND h.pos = r.pos AND (r.entity = h.entity_a OR r.entity = h.entity_b)
   JOIN v_gm g ON g.layer = r.layer AND g.resid = r.resid AND g.pos = r.pos GROUP BY ALL
  UNION ALL SELECT layer, resid, contrast_name, axis, entity_a, entity_b, 'all_except_' || heldout_family, heldout_family, n_train_a, n_train_b, row_id, is_a, gscore FROM hs),
 tm2 AS (""" + metric_sql("ts", "layer, resid, contrast_name, axis, entity_a, entity_b, train_family, test_family, n_train_a, n_train_b") + ")"


@query("family_transfer", f"{TRANSFER_VIEW} SELECT {K_SQL}, train_family, test_family, {R('auc')} AS auc, {R('cohens_d')} AS cohens_d, n_train_a, n_train_b, n_a AS n_test_a, n_b AS n_test_b FROM tm2")
def family_transfer(v):
    return r_cols(G.family_transfer(family_means(v), v.contrasts), ["auc", "cohens_d"])


@query("offdiag_generalization", f"{TRANSFER_VIEW} SELECT layer, resid, contrast_name, axis, {R('avg(auc)')} AS mean_offdiag_auc FROM tm2 WHERE train_family NOT LIKE 'all_except_%' AND train_family <> test_family GROUP BY layer, resid, contrast_name, axis")
def offdiag_generalization(v):
    out = G.offdiag_generalization(G.family_transfer(family_means(v), v.contrasts), RESID_KEYS)
    return r_cols(out, ["mean_offdiag_auc"])


FAMS = [f"fam{i}" for i in range(5)]


@query(
    "transfer_pivot",
    f"{TRANSFER_VIEW} SELECT layer, resid, contrast_name, train_family, "
    + ", ".join(f"{R(f'''avg(auc) FILTER (WHERE test_family = '{f}')''')} AS {f}" for f in FAMS)
    + " FROM tm2 WHERE train_family NOT LIKE 'all_except_%' GROUP BY layer, resid, contrast_name, train_family",
)
def transfer_pivot(v):
    t = G.family_transfer(family_means(v), v.contrasts).filter(~F.col("train_family").startswith("all_except_"))
    return r_cols(t.groupBy(*RESID_KEYS, "contrast_name", "train_family").pivot("test_family", FAMS).agg(F.avg("auc")), FAMS)


HIST_KEYS = [*RESID_KEYS, "contrast_name", "entity"]
SPAN_SQL = "SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, count(*) OVER w AS n, stddev_samp(score) OVER w AS sd FROM v_scores WINDOW w AS (PARTITION BY layer, resid, contrast_name, entity)"


@query(
    "projection_histogram",
    f"""WITH s AS ({SPAN_SQL}), b AS (SELECT *, CASE WHEN hi > lo THEN least(floor((score - lo) / ((hi - lo) / 35))::INT, 34) ELSE 0 END AS bin FROM s)
SELECT layer, resid, contrast_name, entity, bin, {R('any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 35')} AS bin_left, count(*) AS n_rows,
  {R('CASE WHEN any_value(hi) > any_value(lo) THEN count(*) / (any_value(n) * ((any_value(hi) - any_value(lo)) / 35)) END')} AS density
FROM b GROUP BY layer, resid, contrast_name, entity, bin""",
)
def projection_histogram(v):
    return r_cols(G.projection_histogram(axis_scores(v), HIST_KEYS), ["bin_left", "density"])


@query(
    "projection_kde",
    f"""WITH s AS ({SPAN_SQL}), k AS (SELECT *, sd * pow(n, -0.2) AS h FROM s WHERE sd > 0),
 g AS (SELECT layer, resid, contrast_name, entity, i AS grid_idx, lo + i * ((hi - lo) / 49) AS gx, score, h, n FROM k, (SELECT unnest(range(0, 50)) AS i))
SELECT layer, resid, contrast_name, entity, grid_idx::INT AS grid_idx, {R('any_value(gx)')} AS grid_x, {R('sum(exp(-0.5 * ((score - gx) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi()))')} AS density
FROM g GROUP BY layer, resid, contrast_name, entity, grid_idx""",
)
def projection_kde(v):
    return r_cols(G.projection_kde(axis_scores(v), HIST_KEYS), ["grid_x", "density"])


@query(
    "standardize",
    f"""SELECT layer, row_id, pos, {R('CASE WHEN sd > 0 THEN (x - m) / sd ELSE x - m END')} AS x FROM (
 SELECT layer, row_id, pos, x, avg(x) OVER (PARTITION BY layer, pos) AS m, stddev_pop(x) OVER (PARTITION BY layer, pos) AS sd FROM v_long)""",
)
def standardize(v):
    return explode_vec(M.standardize(v.vectors), ["layer", "row_id"], F.col("vec"), "x")


@query(
    "drop_degenerate_layers",
    f"""WITH z AS (SELECT layer, x FROM v_long UNION ALL SELECT 0, 0.25::DOUBLE FROM v_long WHERE layer = 8)
SELECT layer, {R('var_pop(x)')} AS variance, false AS has_non_finite, var_pop(x) > 1e-8 AS keep FROM z GROUP BY layer""",
)
def drop_degenerate_layers(v):
    flat = v.vectors.filter("layer = 8").select(
        F.lit(0).alias("layer"), "row_id", F.transform("vec", lambda x: F.lit(0.25)).alias("vec")
    )
    return r_cols(M.degenerate_layers(v.vectors.select("layer", "row_id", "vec").unionByName(flat)), ["variance"])


@query(
    "vector_math",
    f"""WITH e AS (SELECT layer, entity, pos, avg(x) AS m FROM v_ml GROUP BY ALL), q AS (SELECT v.layer, v.row_id, v.pos, v.x, e.m FROM v_ml v JOIN e USING (layer, entity, pos))
SELECT layer, row_id, {R('sum(x * m)')} AS dot, {R('sqrt(sum(x * x))')} AS norm, {R('sum(x * m) / nullif(sqrt(sum(x * x)) * sqrt(sum(m * m)), 0)')} AS cosine,
 {R('sqrt(sum((x - m) ** 2))')} AS distance, {R('sqrt(sum((2.5 * x) ** 2))')} AS scaled_norm, NULL::DOUBLE AS zero_cosine FROM q GROUP BY layer, row_id""",
)
def vector_math(v):
    m = M.group_vector_mean(v.vectors, ["layer", "entity"]).select("layer", "entity", "mean")
    from facetlens.functions.joins import spread_join

    j = spread_join(v.vectors, m, ["layer", "entity"], spread_by=["row_id"])
    zero = F.transform("vec", lambda x: F.lit(0.0))
    out = j.select(
        "layer", "row_id", V.dot("vec", "mean").alias("dot"), V.norm("vec").alias("norm"), V.cosine("vec", "mean").alias("cosine"),
        V.norm(V.sub("vec", "mean")).alias("distance"), V.norm(V.scale("vec", 2.5)).alias("scaled_norm"), V.cosine("vec", zero).alias("zero_cosine"),
    )
    return r_cols(out, ["dot", "norm", "cosine", "distance", "scaled_norm"])
