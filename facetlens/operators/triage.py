"""Feature triage: evidence per (layer, feature), scores, roles, ordering and reports.

Inputs are feature-level metric tables, so sizes follow the feature dictionary and the
contrast list. NULL means missing evidence until the scores, which state their defaults.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from facetlens.functions import constants as K
from facetlens.functions.numeric import clip01, null_safe_mean, safe_ratio
from facetlens.operators.grid import priority_number
from facetlens.operators.tokens import normalized_entropy

FEATURE = ["layer", "feature_id"]


def union_sources(*tables: DataFrame) -> DataFrame:
    """Concatenate tables with different columns; what a table lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def signal_metrics(joined: DataFrame, alignment: DataFrame, candidates: DataFrame) -> DataFrame:
    """Over all sources: distinct contrasts / axes / entities, extreme metrics, top contrasts."""
    src = union_sources(joined, candidates, alignment).filter("layer IS NOT NULL AND feature_id IS NOT NULL")
    d, cos = F.abs("cohens_d"), F.abs("cosine_with_direction")
    # Largest |d| (or |cosine|) wins, ties go to the first contrast name.
    top = lambda col, metric: F.min_by(col, F.when(metric.isNotNull(), F.struct(-metric, F.coalesce("contrast_name", F.lit("")))))
    main = src.groupBy(*FEATURE).agg(
        F.countDistinct("contrast_name").alias("n_contrasts_seen"),
        F.countDistinct("axis").alias("n_axes_seen"),
        F.max(d).alias("max_abs_cohens_d"),
        F.max(F.abs(F.col("auc") - 0.5)).alias("max_auc_distance_from_0_5"),
        F.max(cos).alias("max_abs_decoder_cosine"),
        F.avg(cos).alias("mean_abs_decoder_cosine"),
        F.max("combined_score").alias("max_combined_score"),
        top("contrast_name", d).alias("top_contrast_by_selectivity"),
        top("contrast_name", cos).alias("top_contrast_by_decoder_alignment"),
        F.coalesce(top("axis", d), F.mode("axis", True), F.lit("")).alias("signal_top_axis"),
    )
    ids = F.explode(F.array("entity_a", "entity_b"))
    entities = src.select(*FEATURE, ids.alias("e")).filter("e IS NOT NULL").groupBy(*FEATURE).agg(
        F.countDistinct("e").alias("n_entities_seen")
    )
    per = src.filter("contrast_name IS NOT NULL").groupBy(*FEATURE, "contrast_name").agg(F.max(d).alias("_d"), F.max(cos).alias("_c"))
    lists = per
    for key, out in (("_d", "top_contrasts_by_selectivity"), ("_c", "top_contrasts_by_alignment")):
        w = Window.partitionBy(*FEATURE).orderBy(F.desc_nulls_last(key), "contrast_name")
        lists = lists.withColumn(f"_r{out}", F.row_number().over(w))
    pack = lambda out: F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col(f"_r{out}") <= 10, F.struct(F.col(f"_r{out}").alias("r"), F.col("contrast_name").alias("c"))))),
            lambda s: s["c"],
        ), ";",
    ).alias(out)
    names = lists.groupBy(*FEATURE).agg(pack("top_contrasts_by_selectivity"), pack("top_contrasts_by_alignment"))
    return main.join(entities, FEATURE, "left").join(names, FEATURE, "left").na.fill(0, ["n_entities_seen"])


def top_membership(joined: DataFrame, candidates: DataFrame, top_n: int) -> DataFrame:
    """(layer, feature, contrast, axis, membership_type): top N of each ranking per contrast."""
    src = union_sources(joined, candidates).filter("layer IS NOT NULL AND feature_id IS NOT NULL AND contrast_name IS NOT NULL")
    part = ["layer", "contrast_name"]
    axis = src.groupBy(*part).agg(F.coalesce(F.min("axis"), F.lit("")).alias("axis"))
    best = src.groupBy(*part, "feature_id").agg(
        F.max(F.abs("cohens_d")).alias("abs_cohens_d"),
        F.max(F.abs("cosine_with_direction")).alias("abs_decoder_cosine"),
        F.max("combined_score").alias("combined_score"),
    )
    long = best.unpivot([*part, "feature_id"], ["abs_cohens_d", "abs_decoder_cosine", "combined_score"], "membership_type", "_v")
    w = Window.partitionBy(*part, "membership_type").orderBy(F.desc_nulls_last("_v"), "feature_id")
    top = long.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top_n)
    return top.join(axis, part).select(*FEATURE, "contrast_name", "axis", "membership_type").distinct()


def membership_counts(membership: DataFrame) -> DataFrame:
    return membership.groupBy(*FEATURE).agg(
        F.countDistinct("contrast_name").alias("n_contrasts_where_top_feature"),
        F.countDistinct("axis").alias("n_axes_where_top_feature"),
        F.array_join(F.array_sort(F.collect_set("axis")), ";").alias("membership_axes"),
    )


def significant4(v: Column) -> Column:
    """Four significant digits as text without trailing zeros."""
    scale = F.pow(F.lit(10.0), 3 - F.floor(F.log10(v)))
    text = F.format_string("%.10f", F.round(v * scale) / scale)
    return F.when(v > 0, F.regexp_replace(text, r"\.?0+$", "")).otherwise(F.lit("0"))


def entity_specificity(selectivity: DataFrame) -> DataFrame:
    """How concentrated a feature's (clipped) mean activation is over entities and axes."""
    v = F.greatest(F.coalesce("mean_entity", F.lit(0.0)), F.lit(0.0))
    w = Window.partitionBy(*FEATURE).orderBy(F.desc("_v"), "entity")
    ranked = selectivity.withColumn("_v", v).withColumn("_rn", F.row_number().over(w))
    at = lambda n, c: F.max(F.when(F.col("_rn") == n, F.col(c)))
    top_axis = F.max(F.when(F.col("_rn") == 1, F.col("axis"))).over(Window.partitionBy(*FEATURE))
    ranked = ranked.withColumn("_same", (F.col("axis") == top_axis).cast("double"))
    names = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("_rn") <= 8, F.struct("_rn", "entity", "canonical_label", "_v")))),
        lambda s: F.concat(s["entity"], F.lit(":"), s["canonical_label"], F.lit(":"), significant4(s["_v"])),
    )
    positive = F.when(F.col("_v") > 0, F.col("_v"))
    entropy = F.when(F.col("_k") > 1, (F.ln("_total") - F.col("_wl") / F.col("_total")) / F.ln(F.col("_k").cast("double"))).otherwise(F.lit(0.0))
    g = ranked.groupBy(*FEATURE).agg(
        at(1, "entity").alias("top_entity"), at(1, "canonical_label").alias("top_entity_label"), at(1, "axis").alias("top_axis"),
        at(1, "_v").alias("top_entity_mean_activation"), F.coalesce(at(2, "_v"), at(1, "_v")).alias("second_entity_mean_activation"),
        F.sum("_v").alias("_total"),
        F.avg(F.when(F.col("_rn") <= 10, F.col("_same"))).alias("top_axis_fraction"),
        F.sum(positive * F.ln(positive)).alias("_wl"), F.count(positive).alias("_k"),
        F.array_join(names, ";").alias("top_entities_by_activation"),
    )
    axes = ranked.filter("_v > 0").groupBy(*FEATURE, "axis").agg(F.count(F.lit(1)).alias("c"))
    axis_h = normalized_entropy(axes, FEATURE, "c", "axis_entropy")
    return g.join(axis_h, FEATURE, "left").select(
        *FEATURE, "top_entity", "top_entity_label", "top_axis", "top_entity_mean_activation", "second_entity_mean_activation",
        safe_ratio(F.col("top_entity_mean_activation"), F.col("second_entity_mean_activation")).alias("entity_specificity_ratio"),
        safe_ratio(F.col("top_entity_mean_activation"), F.col("_total")).alias("top_entity_share"),
        "top_axis_fraction", F.coalesce("axis_entropy", F.lit(0.0)).alias("axis_entropy"), entropy.alias("entity_entropy"), "top_entities_by_activation",
    )


#: Words of which one occurs in the name of a column that can stand in for the loadings (fixed values).
LOADING_WORDS = ["loading", "shared", "projection", "variance", "score"]


def loading_column(df: DataFrame) -> str | None:
    """``abs_loading``, or else the first numeric column whose name holds one of ``LOADING_WORDS``."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in FEATURE and any(w in f.name.lower() for w in LOADING_WORDS)]
    return "abs_loading" if "abs_loading" in numeric else next(iter(numeric), None)


def shared_loading_score(tables: list[DataFrame], by_feature: bool | None = None) -> DataFrame:
    """The absolute loading (``loading_column``) over its global maximum: max per (layer, feature), or mean per layer.

    ``by_feature`` None: per feature where any row names one. Tables without a layer give one mean over
    all; without a usable column there are no rows.
    """
    src = union_sources(*tables)
    column = loading_column(src)
    if column is None:
        return src.sparkSession.createDataFrame([], "layer int, shared_pc_loading_score double")
    src = src.withColumn("_s", F.abs(F.col(column).cast("double")))
    top = src.agg(F.max("_s").alias("m")).select("m").scalar()
    score = F.col("_s") / F.when(top > 0, top).otherwise(F.lit(1.0))
    if by_feature is None:
        by_feature = set(FEATURE) <= set(src.columns) and not src.filter("layer IS NOT NULL AND feature_id IS NOT NULL").isEmpty()
    if by_feature:
        return src.filter("layer IS NOT NULL AND feature_id IS NOT NULL").groupBy(*FEATURE).agg(F.max(score).alias("shared_pc_loading_score"))
    keys = ["layer"] if "layer" in src.columns else []
    return src.groupBy(*keys).agg(F.avg(score).alias("shared_pc_loading_score"))


def feature_key_spine(*tables: DataFrame) -> DataFrame:
    """Every (layer, feature) of any table, with all tables left-joined to it."""
    keys = reduce(DataFrame.unionByName, [t.select(*FEATURE) for t in tables]).distinct()
    return reduce(lambda acc, t: acc.join(t, FEATURE, "left"), tables, keys)


def triage_scores(spine: DataFrame, shared: DataFrame) -> DataFrame:
    """Specificity, sharedness, artifact, polysemanticity and cross-axis scores in [0, 1]."""
    df = spine.join(shared, FEATURE, "left")
    have = set(df.columns)
    # An absent column counts as 0 whatever a row's missing value counts as.
    c = lambda name, default=0.0: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(0.0)
    # A column that is missing in a row leaves the score undefined, which clips to 0.
    raw = lambda name: F.col(name).cast("double") if name in have else F.lit(0.0)
    cap = lambda x: F.when(x.isNotNull(), F.least(F.lit(1.0), x))
    breadth = F.when(raw("n_axes_where_top_feature").isNotNull(), F.greatest(raw("n_axes_where_top_feature"), F.lit(1.0)))
    specificity = (
        (F.lit(1.0) - cap((breadth - 1) / 4)) * 0.6 + c("top_axis_fraction") * 0.2 + cap(raw("max_abs_cohens_d") / 2) * 0.2
    )
    shared_score = (
        cap(raw("n_axes_where_top_feature") / 5) * 0.5 + cap(raw("n_contrasts_where_top_feature") / 10) * 0.3
        + F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("shared_pc_loading_score"))) * 0.2
    )
    artifact = (
        c("fraction_top_tokens_template_words") * 0.4 + (1 - c("family_entropy", 1.0)) * 0.3
        + (1 - c("template_entropy", 1.0)) * 0.2 + (1 - c("span_localization_score")) * 0.1
    )
    poly = c("axis_entropy") * 0.35 + c("entity_entropy") * 0.35 + c("token_entropy") * 0.2 + (1 - c("top_axis_fraction")) * 0.1
    cross = F.coalesce(raw("cross_axis_activation_score"), raw("axis_entropy"))
    return df.withColumns({
        "shared_pc_loading_score": c("shared_pc_loading_score"),
        "contrast_specificity_score": clip01(specificity),
        "sharedness_score": clip01(shared_score),
        "template_artifact_score": clip01(artifact),
        "polysemanticity_score": clip01(poly),
        "cross_axis_activation_score": clip01(cross),
    })


@dataclass(frozen=True)
class Thresholds:
    min_abs_d: float = 0.5
    min_abs_cosine: float = 0.03
    span_local: float = 0.7
    final_integrated: float = 0.7
    max_artifact: float = 0.5
    min_specificity: float = 0.5
    min_shared: float = 0.5


def triage_roles(scored: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """First matching role rule per feature, with confidence, keep flag, priority, reason."""
    have = set(scored.columns)
    n = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in have else F.lit(0.0)
    base = scored.withColumns({
        "_d": n("max_abs_cohens_d"), "_cos": n("max_abs_decoder_cosine"), "_art": n("template_artifact_score"),
        "_span": n("span_localization_score"), "_final": n("final_token_integration_score"), "_shared": n("sharedness_score"),
        "_spec": n("contrast_specificity_score"), "_axes": n("n_axes_where_top_feature"), "_poly": n("polysemanticity_score"),
    })
    base = base.withColumns({
        "_nd": clip01(F.col("_d") / max(t.min_abs_d * 2, 1e-9)), "_nc": clip01(F.col("_cos") / max(t.min_abs_cosine * 4, 1e-9)),
    })
    d, cos, art = F.col("_d"), F.col("_cos"), F.col("_art")
    clean = 1 - art
    strong = d >= t.min_abs_d
    rules = [
        ("low_signal", (d < t.min_abs_d) & (cos < t.min_abs_cosine), clip01(1 - F.greatest("_nd", "_nc")), F.lit(False)),
        ("template_or_syntax_artifact", art >= t.max_artifact, art, F.lit(False)),
        ("identity_token_local", (F.col("_span") >= t.span_local) & strong, null_safe_mean([F.col("_span"), F.col("_nd"), clean]), F.lit(True)),
        ("sentence_final_integrated", (F.col("_final") >= t.final_integrated) & strong, null_safe_mean([F.col("_final"), F.col("_nd"), clean]), F.lit(True)),
        ("shared_social_feature", (F.col("_shared") >= t.min_shared) & (F.col("_axes") >= 3), F.col("_shared"), F.lit(True)),
        (
            "contrast_specific_identity", (F.col("_spec") >= t.min_specificity) & strong & (cos >= t.min_abs_cosine),
            null_safe_mean([F.col("_spec"), F.col("_nd"), F.col("_nc"), clean]), F.lit(True),
        ),
    ]
    chain = lambda pick, last: reduce(lambda acc, r: acc.when(r[1], pick(r)), rules[1:], F.when(rules[0][1], pick(rules[0]))).otherwise(last)
    role = chain(lambda r: F.lit(r[0]), F.lit("polysemantic_or_unclear"))
    confidence = clip01(chain(lambda r: r[2], F.col("_poly")))
    keep = chain(lambda r: r[3], F.lit(False)) & strong & (art < t.max_artifact)
    out = base.withColumns({"provisional_role": role, "role_confidence": confidence, "keep_for_intervention": keep})
    high = F.col("keep_for_intervention") & (F.col("role_confidence") >= 0.7) & (d >= t.min_abs_d * 1.5)
    out = out.withColumn(
        "intervention_priority",
        F.when(high, F.lit("high")).when(F.col("keep_for_intervention"), F.lit("medium")).otherwise(F.lit("low")),
    )
    top_axis = F.coalesce("top_axis", F.lit("0")) if "top_axis" in have else F.lit("")
    # A number pattern rounds by the exact binary value, as C-style formatting does.
    fixed = lambda c, digits: F.call_function("format_number", F.col(c), F.lit("0." + "0" * digits))
    reason = F.concat(
        "provisional_role", F.lit(": span="), fixed("_span", 2), F.lit(", final="), fixed("_final", 2), F.lit(", artifact="), fixed("_art", 2),
        F.lit(", shared="), fixed("_shared", 2), F.lit(", specificity="), fixed("_spec", 2), F.lit(", max|d|="), fixed("_d", 2),
        F.lit(", max|cos|="), fixed("_cos", 3), F.lit(", top_axis="), top_axis, F.lit("."),
    )
    return out.withColumn("reason", reason).drop(*[x for x in out.columns if x.startswith("_")])


def triage_order(triage: DataFrame) -> DataFrame:
    return triage.orderBy(
        F.desc("keep_for_intervention"), priority_number(F.col("intervention_priority")), F.desc("role_confidence"),
        F.desc_nulls_last("max_abs_cohens_d"), *FEATURE,
    )


def triage_summary(triage: DataFrame) -> DataFrame:
    return triage.groupBy(F.col("provisional_role").alias("role")).agg(
        F.count("feature_id").alias("n_features"),
        F.avg("role_confidence").alias("mean_confidence"),
        F.count_if("keep_for_intervention").alias("n_keep_for_intervention"),
        F.avg("max_abs_cohens_d").alias("mean_max_abs_d"),
        F.avg("max_abs_decoder_cosine").alias("mean_max_abs_decoder_cosine"),
        F.avg("template_artifact_score").alias("mean_template_artifact_score"),
    )


def role_counts(triage: DataFrame) -> DataFrame:
    return triage.groupBy("layer", "provisional_role").agg(
        F.count("feature_id").alias("n_features"), F.count_if("keep_for_intervention").alias("n_keep_for_intervention")
    )


def role_axis_pivot(triage: DataFrame) -> DataFrame:
    return triage.groupBy("top_axis").pivot("provisional_role", K.ROLE_ORDER).agg(F.count(F.lit(1))).na.fill(0)


VERDICT = [
    "provisional_role", "role_confidence", "keep_for_intervention", "intervention_priority", "reason",
    "template_artifact_score", "sharedness_score", "contrast_specificity_score",
]


def candidate_triage_join(candidates: DataFrame, triage: DataFrame) -> DataFrame:
    """Candidates with their verdicts; a candidate without one is not kept."""
    out = candidates.join(triage.select(*FEATURE, *VERDICT), FEATURE, "left")
    return out.withColumn("keep_for_intervention", F.coalesce("keep_for_intervention", F.lit(False)))


def kept_per_contrast(candidates_triaged: DataFrame) -> DataFrame:
    return candidates_triaged.filter("keep_for_intervention").groupBy("contrast_name").agg(F.countDistinct("feature_id").alias("n_kept"))


def _first(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order, "feature_id")
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).select(*FEATURE)


def selected_features(
    candidates: DataFrame, joined: DataFrame, entity: DataFrame, top_contrast: int, top_entity: int, explicit: list[int] | None = None
) -> DataFrame:
    """Distinct union of the leading features by five contrast criteria and one per entity."""
    if explicit:
        layers = union_sources(candidates.select("layer"), joined.select("layer"), entity.select("layer")).distinct()
        return layers.withColumn("feature_id", F.explode(F.array(*[F.lit(f) for f in sorted(set(explicit))])))
    by_contrast = ["layer", "contrast_name"]
    combined = [F.desc_nulls_last("combined_score")]
    parts = [
        _first(candidates, by_contrast, combined, top_contrast),
        _first(joined, by_contrast, combined, top_contrast),
        _first(joined, by_contrast, [F.desc_nulls_last("cosine_with_direction")], top_contrast),
        _first(joined, by_contrast, [F.asc_nulls_last("cosine_with_direction")], top_contrast),
        _first(joined, by_contrast, [F.abs("cohens_d").desc_nulls_last()], top_contrast),
        _first(entity, ["layer", "entity"], [F.abs("cohens_d").desc_nulls_last()], top_entity),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def kept_features(triage: DataFrame, roles: list[str] | None, max_per_layer: int | None) -> DataFrame:
    """Kept rows of the wanted roles, best row per (layer, feature), in priority order."""
    rows = triage.filter("keep_for_intervention")
    if roles is not None:
        rows = rows.filter(F.col("provisional_role").isin(roles))
    order = [
        priority_number(F.col("intervention_priority")), F.desc_nulls_last("role_confidence"), F.desc_nulls_last("max_abs_cohens_d"),
        F.desc_nulls_last("combined_score"), F.col("contrast_name"), F.col("feature_id"),
    ]
    one = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*FEATURE).orderBy(*order))).filter("_rn = 1")
    one = one.withColumn("rank", F.row_number().over(Window.partitionBy("layer").orderBy(*order))).drop("_rn")
    return one if max_per_layer is None else one.filter(F.col("rank") <= max_per_layer)


def rare_prompt_selection(values: DataFrame, meta: DataFrame, features: DataFrame, max_prompts: int) -> DataFrame:
    """Strongest prompts per feature: positive activations if it has any, else whatever it has."""
    w = Window.partitionBy(*FEATURE)
    rows = values.join(features, FEATURE, "left_semi")
    # Positive rows sort before others, and others stay only where there is no positive row.
    order = w.orderBy(F.desc("activation"), "row_id")
    top = rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= max_prompts)
    best = F.max("activation").over(w)
    top = top.withColumn("_best", best).filter((F.col("activation") > 0) | (F.col("_best") <= 0))
    return top.select(*FEATURE, "row_id", "activation").join(meta, ["layer", "row_id"])


def feature_auto_label(profiles: DataFrame, localization: DataFrame) -> DataFrame:
    """Axis label if the ten strongest entities share an axis, else the strongest entity."""
    w = Window.partitionBy(*FEATURE).orderBy(F.desc("mean_activation"), "entity")
    top = profiles.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 10")
    g = top.groupBy(*FEATURE).agg(
        F.mode("axis", True).alias("top_axis"), F.min_by("canonical_label", "_rn").alias("top_entity"),
        F.max("mean_activation").alias("_best"), F.collect_list("axis").alias("_axes"),
    )
    share = F.size(F.filter("_axes", lambda a: a == F.col("top_axis"))) / F.size("_axes")
    local = localization.groupBy(*FEATURE).agg(
        F.avg((F.col("feature_localization_type") == "identity_span_local").cast("double")).alias("_local")
    )
    label = (
        F.when((F.col("_best") > 0) & (share >= 0.7), F.concat(F.replace("top_axis", F.lit("_"), F.lit(" ")), F.lit(" feature")))
        .when(F.col("_best") > 0, F.concat("top_entity", F.lit("-selective feature")))
        .when(F.col("_local") > 0.5, F.lit("identity-token-local feature"))
        .otherwise(F.lit("mixed/polysemantic feature"))
    )
    return g.join(local, FEATURE, "left").select(*FEATURE, label.alias("auto_label"), "top_axis", "top_entity")
