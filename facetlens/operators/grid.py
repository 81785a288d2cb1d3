"""Prompt grid, experiment grid, controls and feature sets."""

from __future__ import annotations

from itertools import count
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlens.functions import text as T
from facetlens.functions.constants import PRIORITY_ORDER
from facetlens.functions import vec as V
from facetlens.functions.hashing import counter_hashes, job_key, normal_values, seeded_hash
from facetlens.functions.joins import spread_join


def prompt_grid(templates: DataFrame, forms: DataFrame, form_columns: list[str]) -> DataFrame:
    """One prompt per template and entity that has the form the template asks for.

    Forms are unpivoted, so each template meets only its own form column by an equi-join.
    The few form names are hot keys, hence the salted join. A template asking for a form
    column that does not exist is an error.
    """
    known = set(form_columns) & set(forms.columns)
    asked = templates.select(T.clean_text(F.col("required_form")).alias("f")).distinct()
    missing = [r.f for r in asked.filter(~F.col("f").isin(*known)).limit(20).collect()]
    if missing:
        raise ValueError(f"templates require form columns that do not exist: {missing}")
    ids = ["entity", "axis", "canonical_label", "entity_notes"]
    long = forms.select(*ids, *[T.clean_text(F.col(c)).alias(c) for c in sorted(known)]).unpivot(
        ids, sorted(known), "required_form", "form_used"
    ).filter("form_used <> ''")
    t = templates.select(
        *[T.clean_text(F.col(c)).alias(c) for c in ("template_id", "family", "template_text", "required_form", "number")],
        T.clean_text(F.col("notes")).alias("template_notes"),
    )
    text = T.sentence_case(F.replace(F.col("template_text"), F.lit("{form}"), F.col("form_used")))
    out = spread_join(long, t, ["required_form"], spread_by=["entity"])
    return out.select(
        F.concat("template_id", F.lit("__"), "entity").alias("prompt_id"), "template_id", "family", "template_text",
        "required_form", "form_used", "number", "entity", "axis", "canonical_label", text.alias("prompt"),
        "template_notes", "entity_notes",
    )


def lint_prompts(prompts: DataFrame) -> DataFrame:
    return prompts.filter(T.has_bad_pattern(F.col("prompt")))


def value_counts_report(prompts: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n) for each listed column, in one aggregation."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return prompts.select(F.explode(pairs).alias("_p")).groupBy("_p.field", "_p.value").agg(F.count(F.lit(1)).alias("n"))


# ---- feature sets ----------------------------------------------------------------
def priority_number(c: Column) -> Column:
    out = F.lit(9)
    for name, n in PRIORITY_ORDER.items():
        out = F.when(c == name, F.lit(n)).otherwise(out)
    return out


def priority_order() -> list[Column]:
    return [
        priority_number(F.col("intervention_priority")), F.desc_nulls_last("role_confidence"),
        F.desc_nulls_last("max_abs_cohens_d"), F.desc_nulls_last("combined_score"),
    ]


NEGATIVE_SIDES = ["negative", "minus", "b", "identity_b", "-1"]  # fixed values


def feature_sign(side: Column, metrics: list[Column]) -> Column:
    """-1 if the side text says so or any listed metric is negative, else +1."""
    out = F.when(F.lower(F.coalesce(side, F.lit(""))).isin(NEGATIVE_SIDES), F.lit(-1.0))
    for m in metrics:
        out = out.when(m < 0, F.lit(-1.0))
    return out.otherwise(F.lit(1.0))


def feature_set_axis(contrast: Column, *fallbacks: Column) -> Column:
    first = F.nullif(T.axis_from_contrast(contrast), F.lit(""))
    return F.coalesce(first, *[F.nullif(f, F.lit("")) for f in fallbacks], F.lit(""))


def feature_sets(triage: DataFrame, top_ks: list[int], artifact_top: int = 20) -> DataFrame:
    """Per-feature, per-contrast top-k, role-bundle and artifact-control feature sets.

    ``triage`` has layer, feature_id, contrast_name, top_axis, provisional_role,
    keep_for_intervention, sign and the priority columns. Members are arrays in priority
    order (ties by contrast and feature id). A role bundle holds all kept features of its
    (layer, axis, role), a number bounded by the feature dictionary.
    """
    order = [*priority_order(), F.col("contrast_name"), F.col("feature_id")]
    kept = triage.filter("keep_for_intervention")
    layer2 = lambda: F.lpad(F.col("layer").cast("string"), 2, "0")

    def members(df: DataFrame, keys: list[str], limit: Column | None) -> DataFrame:
        ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        if limit is not None:
            ranked = ranked.filter(F.col("_rn") <= limit)
        packed = F.array_sort(F.collect_list(F.struct("_rn", "feature_id", "sign", "provisional_role", "top_axis")))
        return ranked.groupBy(*keys).agg(packed.alias("_m")).select(
            *keys, F.col("_m.feature_id").alias("feature_ids"), F.col("_m.sign").alias("signs"),
            F.col("_m.provisional_role").alias("roles"), F.get(F.col("_m.top_axis"), 0).alias("_first_axis"),
        )

    out_cols = ["layer", "mode", "set_id", "feature_ids", "signs", "roles", "contrast_name", "axis", "control_type"]
    single = kept.withColumn(
        "_rn", F.row_number().over(Window.partitionBy("layer", "feature_id").orderBy(*order))
    ).filter("_rn = 1").select(
        "layer", F.lit("per_feature").alias("mode"),
        F.concat(F.lit("L"), layer2(), F.lit("_feature_"), F.lpad(F.col("feature_id").cast("string"), 5, "0")).alias("set_id"),
        F.array("feature_id").alias("feature_ids"), F.array("sign").alias("signs"), F.array("provisional_role").alias("roles"),
        F.coalesce("contrast_name", F.lit("")).alias("contrast_name"),
        feature_set_axis(F.col("contrast_name"), F.col("top_axis")).alias("axis"), F.lit("kept_feature").alias("control_type"),
    )
    # One row per k the row may enter, for its own role and for all roles together.
    named = kept.filter(F.col("contrast_name").isNotNull())
    grid = named.withColumn("k", F.explode(F.array(*[F.lit(k) for k in top_ks]))).withColumn(
        "_bundle", F.explode(F.array(F.col("provisional_role"), F.lit("combined")))
    )
    topk = members(grid, ["layer", "contrast_name", "_bundle", "k"], F.col("k")).select(
        "layer", F.lit("per_contrast_topk").alias("mode"),
        F.concat(F.lit("L"), layer2(), F.lit("_"), "contrast_name", F.lit("_"), "_bundle", F.lit("_top"), F.col("k").cast("string")).alias("set_id"),
        "feature_ids", "signs", "roles", "contrast_name",
        feature_set_axis(F.col("contrast_name"), F.col("_first_axis")).alias("axis"), F.lit("kept_feature").alias("control_type"),
    )
    bundle = members(kept.filter("top_axis <> ''"), ["layer", "top_axis", "provisional_role"], None).select(
        "layer", F.lit("role_bundle").alias("mode"),
        F.concat(F.lit("L"), layer2(), F.lit("_"), "top_axis", F.lit("_"), "provisional_role", F.lit("_bundle")).alias("set_id"),
        "feature_ids", "signs", "roles", F.lit("").alias("contrast_name"), F.col("top_axis").alias("axis"),
        F.lit("kept_feature").alias("control_type"),
    )
    artifacts = triage.filter("provisional_role = 'template_or_syntax_artifact'")
    control = members(artifacts, ["layer"], F.lit(artifact_top)).select(
        "layer", F.lit("control_bundle").alias("mode"),
        F.concat(F.lit("L"), layer2(), F.lit(f"_template_artifact_control_top{artifact_top}")).alias("set_id"),
        "feature_ids", "signs", "roles", F.lit("").alias("contrast_name"),
        F.coalesce("_first_axis", F.lit("")).alias("axis"), F.lit("template_artifact_features").alias("control_type"),
    )
    parts = [p.select(*out_cols) for p in (single, topk, bundle, control)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def feature_set_vector(sets: DataFrame, decoder: DataFrame, normalize: bool = True) -> DataFrame:
    """(layer, set_id, vec): unit length signed mean of the set's (normalised) decoder rows."""
    from facetlens.operators.means import mean_vector

    members = sets.select("layer", "set_id", F.explode(F.arrays_zip("feature_ids", "signs")).alias("_m")).select(
        "layer", "set_id", F.col("_m.feature_ids").alias("feature_id"), F.col("_m.signs").alias("sign")
    )
    w = V.scale("w", F.lit(1.0) / F.greatest(V.norm("w"), F.lit(1e-9))) if normalize else F.col("w")
    rows = members.join(decoder.select("layer", "feature_id", w.alias("_w")), ["layer", "feature_id"])
    mean = rows.withColumn("_w", V.scale("_w", F.col("sign"))).groupBy("layer", "set_id").agg(mean_vector("_w").alias("_m"))
    return mean.select("layer", "set_id", V.scale("_m", F.lit(1.0) / F.greatest(V.norm("_m"), F.lit(1e-9))).alias("vec"))


# ---- experiment grid ----------------------------------------------------------------
def axis_match_filter(sets: DataFrame, items: DataFrame, mode: str = "matched_only") -> DataFrame:
    """Feature sets whose axis occurs among the items; mode ``all`` keeps every set."""
    if mode == "all":
        return sets
    axes = items.filter("axis_mapped <> ''").select(F.col("axis_mapped").alias("axis")).distinct()
    return sets.join(axes, "axis", "left_semi")


def eligible_counts(sets: DataFrame, items: DataFrame) -> DataFrame:
    n = items.groupBy(F.col("axis_mapped").alias("axis")).agg(F.count(F.lit(1)).alias("eligible_items"))
    return sets.join(n, "axis", "left").withColumn("eligible_items", F.coalesce("eligible_items", F.lit(0)))


def experiment_grid(
    items: DataFrame, sets: DataFrame, alphas: list[float], positions: list[str], modes: list[str], scoring: str,
    axis_match: str = "matched_only",
) -> DataFrame:
    """Items x matching feature sets x alphas x positions x modes, with job keys.

    Items meet sets by an equi-join on the axis, salted because an axis can hold a large
    share of the items; the parameter lists are exploded arrays. ``axis_match="all"`` gives every item every
    set, off its axis too: the items are dealt by the salt alone, and the sets (bounded by the feature
    dictionary) go to every salt. The sets' ``axis`` stays beside ``axis_mapped`` then.
    """
    if axis_match not in ("matched_only", "all"):
        raise ValueError(f"axis_match: {axis_match!r}")
    arr = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    params = (
        sets.withColumn("alpha", arr([float(a) for a in alphas])).withColumn("intervention_position", arr(positions))
        .withColumn("intervention_mode", arr(modes))
    )
    if axis_match == "all":
        parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = spread_join(items, params, [], spread_by=["item_uid"], salts=parts)
    else:
        pairs = spread_join(items, params.withColumnRenamed("axis", "axis_mapped"), ["axis_mapped"], spread_by=["item_uid"])
    key = job_key(
        F.col("item_uid"), F.col("layer"), F.col("set_id"), F.col("alpha"), F.col("intervention_position"),
        F.col("intervention_mode"), F.lit(scoring),
    )
    return pairs.withColumn("job_id", key)


CONTROLS = ["sign_flip", "random_direction_norm_matched", "random_feature_matched"]  # fixed values


def random_directions(rows: DataFrame, seed: str, width: int, out: str = "vec") -> DataFrame:
    """``rows`` with a unit vector of ``width`` normal values, NULL where the seed is.

    The values follow from the 32-bit seed and their place alone, so a direction is the same
    in every engine and for any partitioning; its length is that of a feature set's vector.
    """
    drawn = rows.withColumn("_h", F.when(F.col(seed).isNotNull(), counter_hashes(F.col(seed), 2 * width)))
    drawn = drawn.withColumn("_z", F.when(F.col(seed).isNotNull(), normal_values(F.col("_h"), width)))
    return drawn.withColumn(out, V.scale("_z", F.lit(1.0) / F.greatest(V.norm("_z"), F.lit(1e-9)))).drop("_h", "_z")


def control_rows(items: DataFrame, sets: DataFrame, alphas: list[float], scoring: str, n_features: int, width: int | None = None) -> DataFrame:
    """Sign-flip, random-direction and random-feature controls per item, set and alpha.

    With ``width`` random directions have their unit vector of that width in ``vec``; the vectors of
    the other controls follow from their features and signs (``feature_set_vector``).

    The seed is read from a hash of the job key. Random features are the first values of a seeded
    permutation (a * i + b modulo the least prime from the dictionary size on) inside the
    dictionary: distinct by construction, for any set size, free of partitioning effects.
    """
    prime = next(p for p in count(max(n_features, 2)) if all(p % d for d in range(2, isqrt(p) + 1)))
    base = experiment_grid(items, sets, alphas, ["final_prompt_token"], ["add_vector"], scoring).drop("job_id")
    rows = base.withColumn("control_type", F.explode(F.array(*[F.lit(c) for c in CONTROLS])))
    key = job_key(
        F.col("item_uid"), F.col("layer"), F.col("set_id"), F.col("alpha"), F.col("intervention_position"),
        F.col("control_type"), F.lit(scoring),
    )
    rows = rows.withColumn("job_id", key).withColumn(
        "seed", F.conv(F.substring(F.sha1("job_id"), 1, 8), 16, 10).cast("bigint")
    )
    size = F.size("feature_ids")
    step, start = F.col("seed") % (prime - 1) + 1, seeded_hash("draw", F.col("job_id")) % prime
    # At most prime - n_features of any distinct values fall outside the dictionary.
    values = F.transform(F.sequence(F.lit(0), size + (prime - n_features - 1)), lambda i: ((step * i + start) % prime).cast("int"))
    drawn = F.slice(F.filter(values, lambda f: f < n_features), 1, size)
    ids = F.when(F.col("control_type") == "random_feature_matched", drawn).otherwise(F.col("feature_ids"))
    signs = F.when(F.col("control_type") == "sign_flip", F.transform("signs", lambda s: -s)).otherwise(F.col("signs"))
    rows = rows.withColumn("feature_ids", ids).withColumn("signs", signs)
    if width is None:
        return rows
    own = F.when(F.col("control_type") == "random_direction_norm_matched", F.col("seed"))
    return random_directions(rows.withColumn("_own", own), "_own", width).drop("_own")


def pending(jobs: DataFrame, done: DataFrame, key: str = "job_id") -> DataFrame:
    """Jobs whose key is not among the finished ones."""
    return jobs.join(done.select(key).distinct(), key, "left_anti")


def control_type_of(set_control: Column, set_axis: Column, item_axis: Column) -> Column:
    """Ordinary sets applied off their axis are labelled as wrong-axis controls."""
    matched = (item_axis != "") & (set_axis != "") & (item_axis == set_axis)
    return F.when((set_control == "kept_feature") & ~F.coalesce(matched, F.lit(False)), F.lit("wrong_axis_features")).otherwise(set_control)
