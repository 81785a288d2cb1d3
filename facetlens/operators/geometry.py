"""Contrast directions and what is measured along them.

Directions come from group means, never from row rescans: leave-one-family-out and
family-to-family directions are differences of additive (entity, family) sums.
Rows meet directions through one packed array per key, so a vector is read once however
many contrasts there are. The packed array is bounded by the contrast list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetlens.functions import vec as V
from facetlens.functions.joins import spread_join
from facetlens.functions.settle import settle
from facetlens.operators.effects import endpoint_metrics
from facetlens.operators.means import VariantMeans, group_vector_mean, pooled_mean

KEYS = ["layer", "resid"]
CONTRAST = ["contrast_name", "axis", "entity_a", "entity_b"]


def valid_contrasts(contrasts: DataFrame, entities: DataFrame) -> DataFrame:
    """Contrasts whose two endpoints both occur in ``entities``."""
    present = entities.select("entity").distinct()
    a = present.withColumnRenamed("entity", "entity_a")
    b = present.withColumnRenamed("entity", "entity_b")
    return contrasts.join(a, "entity_a", "left_semi").join(b, "entity_b", "left_semi")


def _endpoint_pairs(means: DataFrame, contrasts: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Contrasts joined twice to a per-entity table; columns get suffixes _a and _b."""
    side = lambda s: means.select(
        *keys, F.col("entity").alias(f"entity_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in cols]
    )
    return side("a").join(contrasts, "entity_a").join(side("b"), [*keys, "entity_b"])


def contrast_directions(entity_means: DataFrame, contrasts: DataFrame, keys: list[str]) -> DataFrame:
    """Unit difference of the endpoint means, one row per (keys, contrast).

    The mean score of a never falls below that of b (their gap is the norm of the
    difference), so ``sign_flipped`` is always false. Equal means give no direction.
    """
    pairs = _endpoint_pairs(entity_means, contrasts, keys, ["mean", "n"])
    return (
        pairs.withColumn("dir", V.normalize(V.sub("mean_a", "mean_b")))
        .filter(F.col("dir").isNotNull())
        .select(*keys, *CONTRAST, "dir", F.lit(False).alias("sign_flipped"))
    )


def with_offsets(
    directions: DataFrame, centers: DataFrame, shifts: DataFrame, center_keys: list[str], dir_col: str = "dir", out: str = "offsets"
) -> DataFrame:
    """Add ``out``: a map from residualization group to the score offset of a direction.

    A residualized, centred score is x . d - (center - shift of the group) . d, so raw
    vectors can be scored under any variant with one lookup and no copy of the vector.
    The map holds one number per group of the variant.
    """
    ids = [c for c in directions.columns if c != dir_col]
    base = directions.join(centers.select(*center_keys, F.col("mean").alias("_center")), center_keys)
    base = base.join(shifts, ["layer", "resid"]).withColumn("_off", V.dot(V.sub("_center", "shift"), dir_col))
    return base.groupBy(*ids).agg(
        F.first(dir_col).alias(dir_col),
        F.map_from_entries(F.collect_list(F.struct("level", "_off"))).alias(out),
    )


def pack_directions(directions: DataFrame, pack_keys: list[str], extra: list[str] = []) -> DataFrame:
    """(pack_keys, dirs): all directions (with offsets) of a key in one array."""
    item = F.struct("resid", *CONTRAST, *extra, "dir", "offsets")
    return directions.groupBy(*pack_keys).agg(F.collect_list(item).alias("dirs"))


EVERY = lambda d: F.lit(True)


def by_endpoint(directions: DataFrame) -> DataFrame:
    """Each direction once per endpoint, so a row is joined only to those of its own entity."""
    return directions.withColumn("entity", F.explode(F.array("entity_a", "entity_b")))


def _score_rows(
    vm: VariantMeans, rows: DataFrame, packed: DataFrame, pack_keys: list[str], keep, out: list[str], carry: list[str]
) -> DataFrame:
    joined = spread_join(rows, packed, pack_keys, spread_by=["row_id"])
    hits = F.transform(
        F.filter("dirs", keep),
        lambda d: F.struct(
            *[d[c].alias(c) for c in ["resid", *out]],
            (V.dot(F.col("vec"), d["dir"]) - F.element_at(d["offsets"], vm.level_column(d["resid"]))).alias("score"),
        ),
    )
    return joined.select(*carry, F.explode(hits).alias("_h")).select(
        *carry, *[F.col(f"_h.{c}").alias(c) for c in ["resid", *out, "score"]]
    )


def projection_scores(vm: VariantMeans, directions: DataFrame, rows: str = "axis") -> DataFrame:
    """(x - mean) . direction per row, variant and contrast, from the raw vectors.

    ``rows``: ``all`` scores every row, ``axis`` the rows on the contrast's axis, and
    ``endpoints`` only rows of the two entities (adds ``is_a``).
    """
    placed = with_offsets(directions, vm.overall, vm.shifts, ["layer"])
    if rows == "all":
        keys = ["layer"]
    elif rows == "axis":
        keys, placed = ["layer", "row_axis"], placed.withColumn("row_axis", F.col("axis"))
    elif rows == "endpoints":
        keys, placed = ["layer", "entity"], by_endpoint(placed)
    else:
        raise ValueError(f"unknown rows mode {rows!r}")
    src = vm.vectors.withColumnRenamed("axis", "row_axis")
    out = _score_rows(vm, src, pack_directions(placed, keys), keys, EVERY, CONTRAST, ["layer", "row_id", "entity", "row_axis"])
    if rows == "endpoints":
        out = out.withColumn("is_a", F.col("entity") == F.col("entity_a"))
    return out


def endpoint_component_metrics(vm: VariantMeans, directions: DataFrame, extra: list[str]) -> DataFrame:
    """Endpoint metrics of several directions per contrast, told apart by ``extra`` columns.

    Scores carry a direction's number, and its names come back to the metrics: a scored row is
    a few numbers instead of all names. Numbers follow the contrast list, not the rows.
    """
    ids = [*KEYS, *CONTRAST, *extra]
    numbered = settle(directions.withColumn("number", F.dense_rank().over(Window.orderBy(*ids))), "directions")
    placed = by_endpoint(with_offsets(numbered, vm.overall, vm.shifts, ["layer"])).withColumn("is_a", F.col("entity") == F.col("entity_a"))
    pack = ["layer", "entity"]
    out = ["number", "is_a"]
    scores = _score_rows(vm, vm.vectors.drop("axis"), pack_directions(placed, pack, out), pack, EVERY, out, ["row_id"]).drop("resid")
    return numbered.select("number", *ids).distinct().join(endpoint_metrics(scores, ["number"]), "number").drop("number")


def tag_endpoints(vectors: DataFrame, contrasts: DataFrame, spread_by: list[str] = ["row_id"]) -> DataFrame:
    """Rows on a contrast's axis, tagged a / b / other_same_axis."""
    joined = spread_join(vectors, contrasts, ["axis"], spread_by=spread_by)
    return joined.withColumn(
        "endpoint",
        F.when(F.col("entity") == F.col("entity_a"), F.lit("a"))
        .when(F.col("entity") == F.col("entity_b"), F.lit("b"))
        .otherwise(F.lit("other_same_axis")),
    )


def layer_endpoint_metrics(vm: VariantMeans, contrasts: DataFrame) -> DataFrame:
    """Group means -> directions -> endpoint scores -> metrics, per (layer, variant, contrast)."""
    dirs = contrast_directions(vm.means, contrasts, KEYS)
    return endpoint_metrics(projection_scores(vm, dirs, rows="endpoints"), [*KEYS, *CONTRAST])


def _family_pairs(cells: DataFrame, contrasts: DataFrame) -> DataFrame:
    """Per contrast and family: in-family and all-family sums of both endpoints.

    ``cells`` holds (entity, family) means and counts, which stand for additive sums.
    """
    own = cells.select(
        *KEYS, "entity", "family", V.scale("mean", F.col("n").cast("double")).alias("sum_own"), F.col("n").alias("n_own")
    )
    total = pooled_mean(cells, [*KEYS, "entity"]).select(
        *KEYS, "entity", V.scale("mean", F.col("n").cast("double")).alias("sum_all"), F.col("n").alias("n_all")
    )
    fams = cells.select(*KEYS, "family").distinct()
    grid = total.join(fams, KEYS).join(own, [*KEYS, "entity", "family"], "left")
    zero = F.transform("sum_all", lambda x: F.lit(0.0))
    grid = grid.withColumn("sum_own", F.coalesce("sum_own", zero)).withColumn("n_own", F.coalesce("n_own", F.lit(0)))
    return _endpoint_pairs(grid, contrasts, [*KEYS, "family"], ["sum_all", "n_all", "sum_own", "n_own"])


def _mean_gap(sum_a, n_a, sum_b, n_b):
    return V.sub(V.scale(sum_a, F.lit(1.0) / n_a), V.scale(sum_b, F.lit(1.0) / n_b))


def _except_family(pairs: DataFrame) -> DataFrame:
    """Directions from every family but one (the held-out family)."""
    n_a, n_b = F.col("n_all_a") - F.col("n_own_a"), F.col("n_all_b") - F.col("n_own_b")
    usable = pairs.filter((n_a > 0) & (n_b > 0))
    gap = _mean_gap(V.sub("sum_all_a", "sum_own_a"), n_a, V.sub("sum_all_b", "sum_own_b"), n_b)
    return usable.select(
        *KEYS, "family", *CONTRAST, V.normalize(gap).alias("dir"), n_a.alias("n_train_a"), n_b.alias("n_train_b")
    ).filter(F.col("dir").isNotNull())


def family_holdout(
    vm: VariantMeans, contrasts: DataFrame, center: str = "train", flip_eval: bool = False
) -> DataFrame:
    """Direction from the other families, scored on the held-out family's endpoints.

    ``vm`` must have cells (entity, family). ``center`` picks the mean removed before
    scoring (``train`` or ``global``); it shifts scores only. ``flip_eval`` turns a
    reversed held-out order around, which looks at the held-out labels; off by default.
    """
    cells = vm.means
    dirs = _except_family(_family_pairs(cells, contrasts)).drop("n_train_a", "n_train_b")
    if center == "train":
        fam = pooled_mean(cells, [*KEYS, "family"]).withColumnRenamed("mean", "fmean").withColumnRenamed("n", "fn")
        rest = F.col("n") - F.col("fn")
        gap = V.sub(V.scale("mean", F.col("n").cast("double")), V.scale("fmean", F.col("fn").cast("double")))
        centers = fam.join(vm.overall, "layer").filter(rest > 0).select(
            *KEYS, "family", V.scale(gap, F.lit(1.0) / rest).alias("mean")
        )
        placed = with_offsets(dirs, centers, vm.shifts, [*KEYS, "family"])
    elif center == "global":
        placed = with_offsets(dirs, vm.overall, vm.shifts, ["layer"])
    else:
        raise ValueError(f"unknown center {center!r}")
    pack = ["layer", "family", "entity"]
    scores = _score_rows(
        vm, vm.vectors.drop("axis"), pack_directions(by_endpoint(placed), pack), pack, EVERY, CONTRAST, [*pack, "row_id"]
    ).withColumn("is_a", F.col("entity") == F.col("entity_a"))
    m = endpoint_metrics(scores, [*KEYS, *CONTRAST, "family"])
    m = m.filter((F.col("n_a") > 0) & (F.col("n_b") > 0)).withColumnRenamed("family", "heldout_family")
    if flip_eval:
        # Negating every score mirrors the AUC and the effect size.
        rev = F.col("mean_a") < F.col("mean_b")
        m = m.withColumn("auc", F.when(rev, 1 - F.col("auc")).otherwise(F.col("auc"))).withColumn(
            "cohens_d", F.when(rev, -F.col("cohens_d")).otherwise(F.col("cohens_d"))
        )
    return m


def family_transfer(vm: VariantMeans, contrasts: DataFrame) -> DataFrame:
    """Train on one family (or all but one), test on each family: AUC, d and counts.

    A direction trained on one family is tested on every family; one trained on all but
    one is tested on that one, so it is offered to the rows of its held-out family only.
    """
    pairs = _family_pairs(vm.means, contrasts)
    extra = ["train_family", "test_only", "n_train_a", "n_train_b"]
    gap = _mean_gap(F.col("sum_own_a"), F.col("n_own_a"), F.col("sum_own_b"), F.col("n_own_b"))
    one = pairs.filter((F.col("n_own_a") > 0) & (F.col("n_own_b") > 0)).select(
        *KEYS, *CONTRAST, F.col("family").alias("train_family"), F.lit("").alias("test_only"),
        V.normalize(gap).alias("dir"), F.col("n_own_a").alias("n_train_a"), F.col("n_own_b").alias("n_train_b"),
    ).filter(F.col("dir").isNotNull())
    rest = _except_family(pairs).select(
        *KEYS, *CONTRAST, F.concat(F.lit("all_except_"), F.col("family")).alias("train_family"),
        F.col("family").alias("test_only"), "dir", "n_train_a", "n_train_b",
    )
    placed = with_offsets(one.unionByName(rest), vm.overall, vm.shifts, ["layer"])
    pack = ["layer", "entity"]
    keep = lambda d: (d["test_only"] == "") | (d["test_only"] == F.col("family"))
    scores = _score_rows(
        vm, vm.vectors.drop("axis"), pack_directions(by_endpoint(placed), pack, extra), pack, keep, [*CONTRAST, *extra],
        [*pack, "family", "row_id"],
    ).withColumn("is_a", F.col("entity") == F.col("entity_a"))
    m = endpoint_metrics(scores, [*KEYS, *CONTRAST, "train_family", "n_train_a", "n_train_b", "family"])
    return m.select(
        *KEYS, *CONTRAST, "train_family", F.col("family").alias("test_family"), "auc", "cohens_d",
        "n_train_a", "n_train_b", F.col("n_a").alias("n_test_a"), F.col("n_b").alias("n_test_b"),
    )


def offdiag_generalization(transfer: DataFrame, keys: list[str]) -> DataFrame:
    """Mean AUC where train and test family differ, without the all-but-one rows."""
    cross = transfer.filter(
        ~F.col("train_family").startswith("all_except_") & (F.col("train_family") != F.col("test_family"))
    )
    return cross.groupBy(*keys, "contrast_name", "axis").agg(F.avg("auc").alias("mean_offdiag_auc"))


def direction_cosines(directions: DataFrame, keys: list[str]) -> DataFrame:
    """Dot product of every ordered pair of unit directions of a key."""
    side = lambda s: directions.select(
        *keys, F.col("contrast_name").alias(f"contrast_{s}"), F.col("axis").alias(f"axis_{s}"), F.col("dir").alias(f"_d{s}")
    )
    return side("i").join(side("j"), keys).select(
        *keys, "contrast_i", "contrast_j", "axis_i", "axis_j",
        (F.col("axis_i") == F.col("axis_j")).alias("same_axis"),
        V.dot("_di", "_dj").alias("cosine"),
    )


def cosine_pair_summary(cosines: DataFrame, keys: list[str]) -> DataFrame:
    """Mean abs cosine of unordered pairs, same axis against different axis."""
    upper = cosines.filter(F.col("contrast_i") < F.col("contrast_j"))
    return upper.groupBy(*keys, "same_axis").agg(
        F.avg(F.abs("cosine")).alias("mean_abs_cosine"), F.count(F.lit(1)).alias("n_pairs")
    )


def top_cosine_pairs(cosines: DataFrame, n: int = 200) -> DataFrame:
    upper = cosines.filter(F.col("contrast_i") < F.col("contrast_j"))
    return upper.orderBy(
        F.abs("cosine").desc(), *[F.col(c) for c in cosines.columns if c not in ("cosine", "same_axis")]
    ).limit(n)


def centroid_distances(entity_means: DataFrame, keys: list[str]) -> DataFrame:
    """Cosine and Euclidean distance of all ordered centroid pairs on an axis."""
    side = lambda s: entity_means.select(
        *keys, "axis", F.col("entity").alias(f"entity_{s}"), F.col("mean").alias(f"_m{s}")
    )
    floor = F.lit(1e-12)
    cos = V.dot("_mi", "_mj") / (F.greatest(V.norm("_mi"), floor) * F.greatest(V.norm("_mj"), floor))
    many = entity_means.groupBy(*keys, "axis").agg(F.count(F.lit(1)).alias("_k")).filter("_k >= 2").drop("_k")
    return (
        side("i").join(side("j"), [*keys, "axis"]).join(many, [*keys, "axis"], "left_semi")
        .select(*keys, "axis", "entity_i", "entity_j", cos.alias("cosine_similarity"),
                (F.lit(1.0) - cos).alias("cosine_distance"), V.distance("_mi", "_mj").alias("euclidean_distance"))
    )


def family_stability(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Raw and centred cosine of an entity's family means, for each family pair."""
    cells = group_vector_mean(vectors, [*keys, "axis", "entity", "family"])
    overall = pooled_mean(cells, keys).select(*keys, F.col("mean").alias("_g"))
    side = lambda s: cells.select(
        *keys, "axis", "entity", F.col("family").alias(f"family_{s}"), F.col("mean").alias(f"_m{s}")
    )
    pairs = side("a").join(side("b"), [*keys, "axis", "entity"]).filter("family_a < family_b")
    return pairs.join(overall, keys).select(
        *keys, "axis", "entity", "family_a", "family_b",
        V.cosine("_ma", "_mb").alias("raw_cosine"),
        V.cosine(V.sub("_ma", "_g"), V.sub("_mb", "_g")).alias("centered_cosine"),
    )


def family_stability_summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys, "axis").agg(
        F.avg("centered_cosine").alias("mean_cosine"),
        F.percentile("centered_cosine", 0.5).alias("median_cosine"),
        F.stddev_samp("centered_cosine").alias("sd_cosine"),
        F.count("centered_cosine").alias("n_pairs"),
    )


def centroid_ordering(axis_scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per entity on the contrast axis: mean projection, spread, normal 95% interval."""
    g = axis_scores.groupBy(*keys, *CONTRAST, "entity").agg(
        F.avg("score").alias("mean_projection"),
        F.stddev_samp("score").alias("sd_projection"),
        F.count(F.lit(1)).alias("n"),
    )
    se = F.col("sd_projection") / F.sqrt("n")
    return g.select(
        *keys, "contrast_name", "axis", "entity", "mean_projection", "sd_projection",
        se.alias("se_projection"),
        (F.col("mean_projection") - F.lit(1.96) * se).alias("ci95_low"),
        (F.col("mean_projection") + F.lit(1.96) * se).alias("ci95_high"),
        "n",
        ((F.col("entity") == F.col("entity_a")) | (F.col("entity") == F.col("entity_b"))).alias("is_endpoint"),
    )


def layer_stability(directions: DataFrame, layers: DataFrame, reference: int, keys: list[str]) -> DataFrame:
    """Cosine with the next layer of the run and with the reference layer.

    "Next" is the next layer of ``layers`` even where this contrast has no direction
    there, so the successor comes from the layer list. If the run lacks ``reference``
    its last layer is used.
    """
    # The layer list is a handful of rows, one per model layer.
    everything = Window.partitionBy(F.lit(1))
    is_ref = F.when(F.col("layer") == reference, F.col("layer"))
    spine = layers.select("layer").distinct().select(
        "layer",
        F.lead("layer").over(everything.orderBy("layer")).alias("next_layer"),
        F.coalesce(F.max(is_ref).over(everything), F.max("layer").over(everything)).alias("reference_layer"),
    )
    base = directions.join(spine, "layer")
    nxt = directions.select(F.col("layer").alias("next_layer"), *keys, F.col("dir").alias("_next"))
    rf = directions.select(F.col("layer").alias("reference_layer"), *keys, F.col("dir").alias("_ref"))
    return (
        base.join(nxt, ["next_layer", *keys], "left")
        .join(rf, ["reference_layer", *keys], "left")
        .select(*keys, "axis", "layer", "next_layer", V.dot("dir", "_next").alias("adjacent_cosine"),
                "reference_layer", V.dot("dir", "_ref").alias("reference_cosine"))
    )


def directional_plane(vm: VariantMeans, directions: DataFrame, plane_specs: DataFrame) -> DataFrame:
    """Coordinates of axis rows in the plane spanned by two contrast directions.

    ``plane_specs``: (axis, contrast_1, contrast_2). The second direction is made
    orthogonal to the first; parallel pairs give no plane.
    """
    side = lambda i: directions.select(
        *KEYS, F.col("contrast_name").alias(f"contrast_{i}"), F.col("dir").alias(f"_d{i}")
    )
    planes = plane_specs.join(side(1), "contrast_1").join(side(2), [*KEYS, "contrast_2"])
    rest = V.sub("_d2", V.scale("_d1", V.dot("_d1", "_d2")))
    planes = planes.withColumn("_e2", V.normalize(rest, 1e-12)).filter(F.col("_e2").isNotNull()).drop("_d2")
    planes = with_offsets(planes, vm.overall, vm.shifts, ["layer"], "_d1", "_o1")
    planes = with_offsets(planes, vm.overall, vm.shifts, ["layer"], "_e2", "_o2")
    packed = planes.groupBy("layer", "axis").agg(
        F.collect_list(F.struct("resid", "contrast_1", "contrast_2", "_d1", "_e2", "_o1", "_o2")).alias("planes")
    )
    joined = spread_join(vm.vectors, packed, ["layer", "axis"], spread_by=["row_id"])
    level = lambda p: vm.level_column(p["resid"])
    coords = F.transform(
        "planes",
        lambda p: F.struct(
            p["resid"].alias("resid"), p["contrast_1"].alias("contrast_1"), p["contrast_2"].alias("contrast_2"),
            (V.dot(F.col("vec"), p["_d1"]) - F.element_at(p["_o1"], level(p))).alias("z1"),
            (V.dot(F.col("vec"), p["_e2"]) - F.element_at(p["_o2"], level(p))).alias("z2"),
        ),
    )
    return joined.select("layer", "axis", "row_id", "entity", "canonical_label", F.explode(coords).alias("_c")).select(
        "layer", "_c.resid", "axis", "_c.contrast_1", "_c.contrast_2", "row_id", "entity", "canonical_label", "_c.z1", "_c.z2"
    )


def plane_centroids(plane: DataFrame, keys: list[str]) -> DataFrame:
    return plane.groupBy(*keys, "axis", "contrast_1", "contrast_2", "canonical_label").agg(
        F.avg("z1").alias("z1"), F.avg("z2").alias("z2"), F.count(F.lit(1)).alias("n")
    )


def cross_axis_projection(entity_means: DataFrame, directions: DataFrame, overall: DataFrame) -> DataFrame:
    """Every entity centroid scored on every contrast direction of the same variant."""
    d = directions.join(overall.select("layer", F.col("mean").alias("_o")), "layer").select(
        *KEYS, "contrast_name", F.col("axis").alias("contrast_axis"), "dir", "_o"
    )
    return entity_means.withColumnRenamed("axis", "projected_axis").join(d, KEYS).select(
        *KEYS, "contrast_name", "contrast_axis", "projected_axis", "entity", "canonical_label",
        V.dot(V.sub("mean", "_o"), "dir").alias("projection_score"),
    )


def cross_axis_summary(long: DataFrame, keys: list[str]) -> DataFrame:
    """Per projected axis: mean, sd, range and the extreme entities (ties by entity)."""
    return long.groupBy(*keys, "contrast_name", "contrast_axis", "projected_axis").agg(
        F.avg("projection_score").alias("mean_projection"),
        F.stddev_samp("projection_score").alias("sd_projection"),
        (F.max("projection_score") - F.min("projection_score")).alias("range_projection"),
        F.min_by("entity", F.struct(-F.col("projection_score"), F.col("entity"))).alias("max_entity"),
        F.max("projection_score").alias("max_score"),
        F.min_by("entity", F.struct(F.col("projection_score"), F.col("entity"))).alias("min_entity"),
        F.min("projection_score").alias("min_score"),
    )


def holdout_summary(holdout: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and sd of held-out AUC with error bars clipped to [0, 1]."""
    g = holdout.groupBy(*keys).agg(
        F.avg("auc").alias("mean_auc"), F.stddev_samp("auc").alias("sd_auc"), F.count("auc").alias("n")
    )
    sd = F.coalesce("sd_auc", F.lit(0.0))
    return g.select(
        *keys, "mean_auc", "sd_auc",
        F.greatest(F.lit(0.0), F.col("mean_auc") - sd).alias("low"),
        F.least(F.lit(1.0), F.col("mean_auc") + sd).alias("high"),
        "n",
    )


def projection_histogram(scores: DataFrame, keys: list[str], bins: int = 35) -> DataFrame:
    """Equal-width bins per key, density normalised; the maximum falls in the last bin."""
    span = scores.groupBy(*keys).agg(
        F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.count("score").alias("_n")
    )
    joined = spread_join(scores, span, keys, spread_by=["row_id"])
    width = (F.col("_hi") - F.col("_lo")) / bins
    raw = F.floor((F.col("score") - F.col("_lo")) / F.when(width > 0, width)).cast("int")
    bin_id = F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1))
    return (
        joined.withColumn("bin", bin_id)
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_n").alias("_n"))
        .select(
            *keys, "bin",
            (F.col("_lo") + F.col("bin") * width).alias("bin_left"),
            "n_rows",
            F.when(width > 0, F.col("n_rows") / (F.col("_n") * width)).alias("density"),
        )
    )


def projection_kde(scores: DataFrame, keys: list[str], points: int = 50) -> DataFrame:
    """Gaussian kernel density on an even grid over each key's range.

    Bandwidth is sd * n^(-1/5) (Scott's rule). The grid travels as an array next to each
    row and is exploded before a partial aggregation per (keys, grid point), so a row adds
    to ``points`` running sums inside its own task and only those sums are shuffled.
    """
    stats = scores.groupBy(*keys).agg(
        F.min("score").alias("_lo"), F.max("score").alias("_hi"),
        F.count("score").alias("_n"), F.stddev_samp("score").alias("_sd"),
    )
    stats = stats.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).filter(F.col("_h") > 0)
    joined = spread_join(scores, stats, keys, spread_by=["row_id"])
    step = (F.col("_hi") - F.col("_lo")) / F.lit(points - 1)
    g = joined.select(*keys, "score", "_h", "_n", "_lo", step.alias("_step"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("grid_idx"))
    at = F.col("_lo") + F.col("grid_idx") * F.col("_step")
    z = (F.col("score") - at) / F.col("_h")
    return (
        g.withColumn("_k", F.exp(F.lit(-0.5) * z * z))
        .groupBy(*keys, "grid_idx")
        .agg(F.sum("_k").alias("_k"), F.first("_h").alias("_h"), F.first("_n").alias("_n"),
             F.first("_lo").alias("_lo"), F.first("_step").alias("_step"))
        .select(*keys, "grid_idx", at.alias("grid_x"),
                (F.col("_k") / (F.col("_n") * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi()))).alias("density"))
    )
