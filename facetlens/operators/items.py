"""Benchmark items: alias resolution, answer roles, contrast matching, preparation reports.

Labels repeat heavily across items, so everything that depends on a label alone (normal
form, components, entity) is computed once per distinct label and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetlens.functions import constants as K
from facetlens.functions import text as T
from facetlens.functions.joins import spread_join
from facetlens.functions.settle import settle

UNKNOWN_NORMS = K.UNKNOWN_ALIASES


def manual_aliases(spark: SparkSession) -> DataFrame:
    rows = [(k, v, i) for i, (k, v) in enumerate(K.MANUAL_ALIASES.items())]
    return spark.createDataFrame(rows, "alias_text string, entity string, pos int")


def alias_table(forms: DataFrame, manual: DataFrame, columns: list[str], order_col: str) -> DataFrame:
    """(alias, compact, entity, first_ord): normalised alias to entity.

    All form columns and the ``;`` aliases of a row count; a later row overwrites an
    earlier one and manual entries come last. ``first_ord`` is where the alias first
    appeared.
    """
    texts = [F.struct(F.lit(i).alias("pos"), F.col(c).cast("string").alias("t")) for i, c in enumerate(columns)]
    extra = F.transform(
        F.split(F.coalesce(F.col("aliases"), F.lit("")), ";"),
        lambda a, i: F.struct((F.lit(len(columns)) + i).alias("pos"), a.alias("t")),
    )
    from_forms = forms.select(
        "entity", F.col(order_col).alias("_row"), F.explode(F.concat(F.array(*texts), extra)).alias("_t")
    ).filter(T.strip(F.coalesce(F.col("_t.t"), F.lit(""))) != "").select(
        T.norm_text(F.col("_t.t")).alias("alias"), "entity",
        F.struct(F.lit(0).alias("src"), F.col("_row").cast("bigint").alias("row"), F.col("_t.pos").cast("bigint").alias("pos")).alias("ord"),
    )
    by_hand = manual.select(
        T.norm_text(F.col("alias_text")).alias("alias"), "entity",
        F.struct(F.lit(1).alias("src"), F.lit(0).cast("bigint").alias("row"), F.col("pos").cast("bigint").alias("pos")).alias("ord"),
    )
    return from_forms.unionByName(by_hand).groupBy("alias").agg(
        F.max_by("entity", "ord").alias("entity"), F.min("ord").alias("first_ord")
    ).withColumn("compact", F.replace("alias", F.lit(" "), F.lit("")))


def resolve_labels(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct labels to (label, norm, entity, status, components, component_ids).

    Stages: unknown list, exact alias, compact alias (earliest alias wins), first
    component with an alias, else unmapped.
    """
    base = labels.select("label").distinct().withColumn("norm", T.norm_text(F.col("label"))).withColumn(
        "components", T.label_components(F.col("label"))
    ).withColumn("_squeezed", F.replace("norm", F.lit(" "), F.lit("")))
    exact = aliases.select(F.col("alias").alias("norm"), F.col("entity").alias("_exact"))
    compact = aliases.groupBy("compact").agg(F.min_by("entity", F.struct("first_ord", "alias")).alias("_compact")).withColumnRenamed(
        "compact", "_squeezed"
    )
    parts = base.select("label", F.posexplode("components").alias("_pos", "alias")).join(
        aliases.select("alias", "entity"), "alias"
    ).groupBy("label").agg(
        F.min_by("entity", "_pos").alias("_component"), F.array_sort(F.collect_set("entity")).alias("component_ids")
    )
    joined = base.join(exact, "norm", "left").join(compact, "_squeezed", "left").join(parts, "label", "left")
    unknown = F.col("norm").isin(UNKNOWN_NORMS)
    empty = F.array().cast("array<string>")
    return joined.select(
        "label",
        F.when(unknown, F.lit("unknown")).otherwise(F.col("norm")).alias("norm"),
        F.when(unknown, F.lit("unknown")).otherwise(F.coalesce("_exact", "_compact", "_component", F.lit(""))).alias("entity"),
        F.when(unknown, F.lit("unknown")).when(F.col("_exact").isNotNull() | F.col("_compact").isNotNull(), F.lit("alias"))
        .when(F.col("_component").isNotNull(), F.lit("component_alias")).otherwise(F.lit("unmapped")).alias("status"),
        "components", F.coalesce("component_ids", empty).alias("component_ids"),
        T.norm_text(F.col("label")).isin(UNKNOWN_NORMS).alias("is_unknown_text"),
    )


def _candidates(answer: Column) -> Column:
    pool = F.concat(F.array(answer["entity"]), F.array_sort(answer["component_ids"]))
    return F.filter(pool, lambda c: (c != "") & (c != "unknown"))


def assign_answer_roles(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """Unknown / stereotyped / non-stereotyped answer per item, with target entities.

    ``items`` needs item_uid, answer_labels and answer_texts (3 each, in order) and
    stereotyped_groups. Adds the three indices and target / non-target label and entity.
    """
    mentions = items.select(
        "item_uid",
        F.explode(
            F.concat(
                F.transform("answer_labels", lambda l, i: F.struct(F.lit("label").alias("kind"), i.alias("idx"), l.alias("label"))),
                F.transform("answer_texts", lambda l, i: F.struct(F.lit("text").alias("kind"), i.alias("idx"), l.alias("label"))),
                F.transform("stereotyped_groups", lambda l, i: F.struct(F.lit("stereo").alias("kind"), i.alias("idx"), l.alias("label"))),
            )
        ).alias("_m"),
    ).select("item_uid", "_m.kind", "_m.idx", "_m.label")
    resolved = settle(resolve_labels(mentions, aliases), "labels")
    found = spread_join(mentions, resolved, ["label"], spread_by=["item_uid"])
    packed = found.groupBy("item_uid").agg(
        F.array_sort(
            F.collect_list(F.struct("kind", "idx", "label", "norm", "entity", "components", "component_ids", "is_unknown_text"))
        ).alias("_all")
    )
    kind = lambda k: F.filter("_all", lambda m: m["kind"] == k)
    p = packed.select("item_uid", kind("label").alias("_labels"), kind("text").alias("_texts"), kind("stereo").alias("_stereo"))
    p = p.withColumn("_norms", F.transform("_stereo", lambda s: T.norm_text(s["label"]))).withColumn(
        "_ids",
        F.array_distinct(F.concat(
            F.filter(F.transform("_stereo", lambda s: s["entity"]), lambda e: e != ""),
            F.flatten(F.transform("_stereo", lambda s: s["component_ids"])),
        )),
    )
    answer = F.zip_with(
        "_labels", "_texts",
        lambda l, t: F.struct(
            l["idx"].alias("idx"), l["label"].alias("label"), l["entity"].alias("entity"),
            F.array_union(l["component_ids"], t["component_ids"]).alias("component_ids"),
            ((l["entity"] == "unknown") | t["is_unknown_text"]).alias("is_unknown"),
            (
                F.array_contains(F.col("_norms"), l["norm"])
                | F.array_contains(F.col("_ids"), l["entity"])
                | F.arrays_overlap(F.array_union(l["component_ids"], t["component_ids"]), F.col("_ids"))
                | F.arrays_overlap(F.array_union(l["components"], t["components"]), F.col("_norms"))
            ).alias("is_stereo"),
        ),
    )
    p = p.withColumn("_answers", answer)
    first = lambda cond: F.get(F.filter("_answers", cond), 0)
    p = p.withColumns({
        "_unknown": first(lambda a: a["is_unknown"]),
        "_target": first(lambda a: a["is_stereo"] & ~a["is_unknown"]),
        "_other": first(lambda a: ~a["is_stereo"] & ~a["is_unknown"]),
    })
    t_cands = F.coalesce(_candidates(F.col("_target")), F.array().cast("array<string>"))
    p = p.withColumn("_tc", t_cands).withColumn("_oc", F.coalesce(_candidates(F.col("_other")), F.array().cast("array<string>")))
    target = F.coalesce(F.get(F.filter("_tc", lambda c: F.array_contains(F.col("_ids"), c)), 0), F.get("_tc", 0), F.lit(""))
    p = p.withColumn("target_entity", target).withColumn("_axis", T.entity_axis(F.col("target_entity")))
    other = F.coalesce(
        F.when(F.col("_axis") != "", F.get(F.filter("_oc", lambda c: T.entity_axis(c) == F.col("_axis")), 0)), F.get("_oc", 0), F.lit("")
    )
    roles = p.select(
        "item_uid",
        F.col("_unknown.idx").alias("unknown_answer_idx"),
        F.col("_target.idx").alias("stereotyped_answer_idx"),
        F.col("_other.idx").alias("nonstereotyped_answer_idx"),
        F.coalesce("_target.label", F.lit("")).alias("target_label"), "target_entity",
        F.coalesce("_other.label", F.lit("")).alias("nontarget_label"), other.alias("nontarget_entity"),
    )
    return items.join(settle(roles, "roles"), "item_uid")


def component_overlap(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Intersection, union and overlap flag of two entity-id arrays."""
    return pairs.withColumns({
        "shared_ids": F.array_sort(F.array_intersect(left, right)),
        "all_ids": F.array_sort(F.array_union(left, right)),
        "overlaps": F.arrays_overlap(left, right),
    })


def distinct_contrast_axes(triage: DataFrame, axis_cols: list[str], order_col: str) -> DataFrame:
    """One row per x_vs_y contrast: first non-blank axis in ``order_col`` order."""
    left, right = T.contrast_sides(F.col("contrast_name"))
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order_col))) for c in axis_cols]
    return triage.filter(left.isNotNull()).groupBy("contrast_name").agg(
        F.coalesce(*first, F.lit("")).alias("axis")
    ).select("contrast_name", left.alias("entity_a"), right.alias("entity_b"), "axis")


def match_contrast(items: DataFrame, contrasts: DataFrame) -> DataFrame:
    """Contrast of each item: exact pair, else same-axis touching either entity, else same axis.

    Matching runs on the distinct (target, non-target, axis) triples; ties take the first
    contrast name.
    """
    keys = ["target_entity", "nontarget_entity", "axis_mapped"]
    triples = items.select(*keys).distinct().filter("target_entity <> '' AND nontarget_entity <> ''")
    pair = lambda a, b: F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    named = contrasts.withColumn("_pair", pair("entity_a", "entity_b"))
    exact = (
        triples.withColumn("_pair", pair("target_entity", "nontarget_entity"))
        .join(named.groupBy("_pair").agg(F.min("contrast_name").alias("_exact")), "_pair", "left").drop("_pair")
    )
    touches = (
        (F.col("entity_a") == F.col("target_entity")) | (F.col("entity_b") == F.col("target_entity"))
        | (F.col("entity_a") == F.col("nontarget_entity")) | (F.col("entity_b") == F.col("nontarget_entity"))
    )
    near = triples.join(contrasts.withColumnRenamed("axis", "axis_mapped"), "axis_mapped").groupBy(*keys).agg(
        F.min_by("contrast_name", F.struct(~touches, "contrast_name")).alias("_near")
    )
    found = exact.join(near, keys, "left").select(
        *keys, F.coalesce("_exact", "_near", F.lit("")).alias("mapped_contrast_name"),
        F.when(F.col("_exact").isNotNull(), F.lit("exact")).when(F.col("_near").isNotNull(), F.lit("fallback_axis"))
        .otherwise(F.lit("unmapped")).alias("mapped_contrast_confidence"),
    )
    out = spread_join(items, found, keys, spread_by=["item_uid"], how="left")
    return out.withColumns({
        "mapped_contrast_name": F.coalesce("mapped_contrast_name", F.lit("")),
        "mapped_contrast_confidence": F.coalesce("mapped_contrast_confidence", F.lit("unmapped")),
    })


def prepare_items(raw: DataFrame, aliases: DataFrame, contrasts: DataFrame) -> DataFrame:
    """Raw items to prepared items: axis, prompt, roles, contrast, notes."""
    answers = [F.col(f"ans{i}") for i in range(3)]
    base = raw.withColumns({
        "axis_mapped": T.axis_from_category(F.col("category_raw")),
        "prompt": T.item_prompt(F.col("context"), F.col("question"), answers),
        "polarity_role": F.concat_ws("_", "context_condition", "question_polarity"),
    })
    out = match_contrast(assign_answer_roles(base, aliases), contrasts)
    notes = F.array_compact(F.array(
        F.when(F.col("unknown_answer_idx").isNull(), F.lit("missing_unknown_answer")),
        F.when(F.col("stereotyped_answer_idx").isNull(), F.lit("missing_stereotyped_answer")),
        F.when(F.col("mapped_contrast_confidence") == "unmapped", F.lit("unmapped_contrast")),
    ))
    return out.withColumn("notes", F.array_join(notes, ";"))


MAPPED = ["exact", "alias", "fallback_axis"]  # fixed values


def prepare_summary(items: DataFrame) -> DataFrame:
    """(metric, value): counts by category / context / polarity, found and mapped shares."""
    counts = items.groupBy("category_raw", "context_condition", "question_polarity").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("n_"), F.concat_ws("_", "category_raw", "context_condition", "question_polarity")).alias("metric"),
        F.col("n").cast("double").alias("value"),
    )
    confidence = items.groupBy("mapped_contrast_confidence").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("mapping_confidence_"), "mapped_contrast_confidence").alias("metric"), F.col("n").cast("double").alias("value")
    )
    share = lambda c: F.avg(c.cast("double"))
    shares = items.agg(
        share(F.col("unknown_answer_idx").isNotNull()).alias("fraction_unknown_answer_found"),
        share(F.col("stereotyped_answer_idx").isNotNull()).alias("fraction_stereotyped_answer_found"),
        share(F.col("mapped_contrast_confidence").isin(MAPPED)).alias("fraction_mapped_to_contrast"),
    )
    shares = shares.unpivot([], shares.columns, "metric", "value")
    return counts.unionByName(confidence).unionByName(shares)


def mapping_diagnostics(items: DataFrame) -> DataFrame:
    return items.filter("notes <> ''")


def top_unmapped_pairs(items: DataFrame, n: int = 20) -> DataFrame:
    bad = items.filter(F.col("notes").contains("unmapped_contrast"))
    return bad.groupBy("target_label", "nontarget_label").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "target_label", "nontarget_label"
    ).limit(n)
