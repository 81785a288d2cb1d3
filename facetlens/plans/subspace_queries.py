"""Queries on the shared subspace, principal components and probes.

Decompositions and iterative fits have no SQL form; their invariants are tested instead.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from facetlens.functions import vec as V
from facetlens.functions.settle import settle
from facetlens.operators import probes as P, subspace as S
from facetlens.plans.geometry_queries import directions, r_cols, variant_means
from facetlens.plans.registry import query
from facetlens.plans.sqlviews import R
from facetlens.plans.views import DIM, RESID_KEYS

PCS = [1, 2, 3, 4, 5, 6]


def spectrum(v):
    return v.memo("spectrum", lambda: settle(S.cumulative_explained(S.shared_subspace_svd(directions(v))), "spectrum"))


def decomposition(v):
    build = lambda: S.subspace_decomposition(variant_means(v, extra=()), directions(v), spectrum(v))
    return v.memo("decomposition", lambda: settle(build(), "decomposition"))


def layer_pca(v, k=8):
    return v.memo(("pca", k), lambda: S.pca(v.vectors, k))


@query("shared_subspace_svd")
def shared_subspace_svd(v):
    cols = ["singular_value", "explained_variance_ratio"]
    out = spectrum(v).select(*RESID_KEYS, "component", *cols, F.posexplode("vec").alias("pos", "x"))
    return r_cols(out, [*cols, "x"])


@query("cumulative_explained")
def cumulative_explained(v):
    cols = ["explained_variance_ratio", "cumulative_explained_variance"]
    return r_cols(spectrum(v).select(*RESID_KEYS, "component", *cols), cols)


@query("contrast_loadings")
def contrast_loadings(v):
    return r_cols(S.contrast_loadings(directions(v), spectrum(v)), ["loading", "abs_loading"])


DEC = ["component_norm", "fraction_norm", "cosine_with_full", "auc", "cohens_d", "accuracy_midpoint", "mean_a", "mean_b", "sd_a", "sd_b"]


@query("subspace_decomposition")
def subspace_decomposition(v):
    return r_cols(decomposition(v).drop("dir"), DEC)


@query("axis_sharedness")
def axis_sharedness(v):
    out = S.axis_sharedness(decomposition(v))
    return r_cols(out, [c for c in out.columns if c.startswith(("mean_", "median_"))])


@query("decomposition_curves")
def decomposition_curves(v):
    return r_cols(S.decomposition_curves(decomposition(v)), ["mean_fraction_shared"])


@query("component_auc_at_max_k")
def component_auc_at_max_k(v):
    return r_cols(S.component_auc_at_max_k(decomposition(v)), ["mean_auc"])


@query("loading_pivots")
def loading_pivots(v):
    a, b = S.loading_pivots(S.contrast_loadings(directions(v), spectrum(v)), PCS)
    named = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), *RESID_KEYS, F.col(key).alias("key"), *[F.col(str(p)).alias(f"pc{p}") for p in PCS])
    return r_cols(named(a, "contrast", "contrast_name").unionByName(named(b, "axis", "axis")), [f"pc{p}" for p in PCS])


@query("projection_rank_per_pc")
def projection_rank_per_pc(v):
    vm = variant_means(v)
    return r_cols(S.projection_rank_per_pc(vm.means, vm.overall, spectrum(v), 3), ["projection_score"])


@query("pca")
def pca(v):
    s, _ = layer_pca(v)
    return r_cols(s.select("layer", "row_id", F.posexplode("pcs").alias("component", "score")), ["score"])


@query("pca_explained")
def pca_explained(v):
    out = S.cumulative_explained(layer_pca(v)[1], ["layer"])
    return r_cols(out, ["explained_variance_ratio", "cumulative_explained_variance"])


@query("pca_group_centroids")
def pca_group_centroids(v):
    return r_cols(S.pca_group_centroids(layer_pca(v)[0], ["entity"]), ["mean_score"])


# What does not depend on the choice of a basis: all components of every layer, against the scaled vectors.
Z_SQL = f"""z AS (SELECT layer, row_id, pos, CASE WHEN sd > 1e-12 THEN (x - m) / sd ELSE 0 END AS z
 FROM (SELECT *, avg(x) OVER w AS m, stddev_pop(x) OVER w AS sd FROM v_long WINDOW w AS (PARTITION BY layer, pos)))"""


@query("pca_row_norms", f"WITH {Z_SQL} SELECT layer, row_id, {R('sum(z * z)')} AS squared_norm, count(*) AS components FROM z GROUP BY layer, row_id")
def pca_row_norms(v):
    """A row's scores on all components have the norm of its scaled vector."""
    s = layer_pca(v, DIM)[0]
    return r_cols(s.select("layer", "row_id", V.sq_norm("pcs").alias("squared_norm"), F.size("pcs").cast("long").alias("components")), ["squared_norm"])


@query(
    "pca_spectrum_moments",
    f"""WITH {Z_SQL}, c AS (SELECT a.layer, a.pos AS i, b.pos AS j, sum(a.z * b.z) AS c FROM z a JOIN z b USING (layer, row_id) GROUP BY a.layer, a.pos, b.pos),
 t AS (SELECT layer, sum(c) AS trace FROM c WHERE i = j GROUP BY layer)
SELECT layer, {R('sum((c / trace) ** 2)')} AS ratios_squared, {R('1.0')} AS ratios FROM c JOIN t USING (layer) GROUP BY layer""",
)
def pca_spectrum_moments(v):
    """The explained ratios add up to 1, their squares to the squared norm of the correlation matrix over its squared trace."""
    r = layer_pca(v, DIM)[1].groupBy("layer").agg(F.sum(F.pow("explained_variance_ratio", F.lit(2.0))).alias("ratios_squared"), F.sum("explained_variance_ratio").alias("ratios"))
    return r_cols(r, ["ratios_squared", "ratios"])


@query(
    "pca_centroid_distances",
    f"""WITH {Z_SQL}, m AS (SELECT layer, entity, pos, avg(z) AS m, count(*) AS n FROM z JOIN v_meta USING (row_id) GROUP BY layer, entity, pos)
SELECT a.layer, a.entity AS entity_a, b.entity AS entity_b, any_value(a.n) AS n_a, {R('sum((a.m - b.m) ** 2)')} AS squared_distance
FROM m a JOIN m b ON a.layer = b.layer AND a.pos = b.pos AND a.entity < b.entity GROUP BY a.layer, a.entity, b.entity""",
)
def pca_centroid_distances(v):
    """Distances of group centroids on all components are those of the scaled vectors."""
    c = S.pca_group_centroids(layer_pca(v, DIM)[0], ["entity"])
    side = lambda x: c.select("layer", "component", F.col("entity").alias(f"entity_{x}"), F.col("n").alias(f"n_{x}"), F.col("mean_score").alias(f"m_{x}"))
    pairs = side("a").join(side("b"), ["layer", "component"]).filter("entity_a < entity_b")
    gap = F.col("m_a") - F.col("m_b")
    return r_cols(pairs.groupBy("layer", "entity_a", "entity_b").agg(F.max("n_a").alias("n_a"), F.sum(gap * gap).alias("squared_distance")), ["squared_distance"])


@query("probe_features")
def probe_features(v):
    f = v.memo("probe-features", lambda: P.probe_features(v.vectors, 8))
    return r_cols(f.select("layer", "row_id", "axis", "family", F.posexplode("pcs").alias("component", "x")), ["x"])


TASKS = [
    P.Task("axis_by_family", "axis", "family"), P.Task("axis_by_template", "axis", "template_id"), P.Task("entity_by_template", "entity", "template_id"),
    *[P.Task(f"entity_in_{x}_by_template", "entity", "template_id", f"axis = '{x}'") for x in ("ax0", "ax1", "ax2")],
    P.Task("family_by_entity", "family", "entity"), P.Task("form_by_entity", "required_form", "entity"),
]


def probes(v):
    """Every task on every layer."""
    f = v.memo("probe-features", lambda: P.probe_features(v.vectors, 8))
    return v.memo("probes", lambda: settle(P.grouped_probe(f, TASKS, 3), "probes"))


SCORES = ["accuracy_mean", "accuracy_sd", "macro_f1_mean", "macro_f1_sd"]


@query("grouped_probe")
def grouped_probe(v):
    return r_cols(probes(v), SCORES)


@query(
    "probe_sizes",
    "WITH t AS (SELECT l.layer, m.*, u FROM v_meta m, v_layers l, (SELECT unnest(["
    + ", ".join(f"{{'split_type': '{t.name}', 'label': '{t.label}', 'only': '{t.where.split(chr(39))[1] if chr(39) in t.where else ''}'}}" for t in TASKS)
    + """]) AS u)) SELECT layer, u.split_type, count(DISTINCT CASE u.label WHEN 'axis' THEN axis WHEN 'entity' THEN entity WHEN 'family' THEN family ELSE required_form END) AS n_classes, count(*) AS n_samples
FROM t WHERE u.only = '' OR axis = u.only GROUP BY layer, u.split_type""",
)
def probe_sizes(v):
    """What each probe was fitted on: classes and rows."""
    return probes(v).select("layer", "split_type", "n_classes", "n_samples")


@query("probe_score_summary")
def probe_score_summary(v):
    return r_cols(P.probe_score_summary(probes(v), ["layer", "split_type"]), ["macro_f1"])
