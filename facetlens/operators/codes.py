"""Sparse features: encoding, statistics, selectivity, decoder alignment, reconstruction.

Codes are long: (layer, row_id, feature_id, activation > 0). A row without an entry for a
feature counts as an activation of zero everywhere below; zeros are never materialised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlens.functions import vec as V
from facetlens.functions.blocks import BLOCK_BYTES, PRODUCT_BYTES, MatrixBlocks, layer_chunks, matrix, matrix_blocks
from facetlens.functions.hashing import seeded_order
from facetlens.functions.joins import spread_join
from facetlens.functions.numeric import cohens_d_from_moments
from facetlens.operators import geometry as G
from facetlens.operators.effects import auc_from_counts
from facetlens.operators.means import VariantMeans, mean_vector
from facetlens.operators.quantiles import exact_percentiles

CODE_SCHEMA = "layer int, row_id bigint, indices array<int>, values array<double>"


# ---- encoding -----------------------------------------------------------------
def _first_k(acts: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Top k per row by (activation desc, feature id asc), ids and activations; ``ids`` is ascending."""
    n = acts.shape[1]
    if n <= 4 * k:
        order = np.argsort(-acts, axis=1, kind="stable")[:, :k]
        return ids[order], np.take_along_axis(acts, order, axis=1)
    least = np.partition(acts, n - k, axis=1)[:, n - k, None]
    chosen = acts >= least
    # Where more than k reach the k-th value, the smaller ids are meant: those rows are sorted whole.
    tied = np.flatnonzero(chosen.sum(axis=1) > k)
    columns = np.empty((len(acts), k), np.int64)
    plain = np.ones(len(acts), bool)
    plain[tied] = False
    columns[plain] = np.nonzero(chosen[plain])[1].reshape(-1, k)
    columns[tied] = np.argsort(-acts[tied], axis=1, kind="stable")[:, :k]
    values = np.take_along_axis(acts, columns, axis=1)
    order = np.lexsort((columns, -values), axis=1)
    return ids[np.take_along_axis(columns, order, axis=1)], np.take_along_axis(values, order, axis=1)


def _merge_k(best: tuple[np.ndarray, np.ndarray] | None, more: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The top k of two results of ``_first_k`` over disjoint features."""
    if best is None:
        return more
    ids, values = (np.concatenate(x, axis=1) for x in zip(best, more))
    order = np.lexsort((ids, -values), axis=1)[:, :k]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(values, order, axis=1)


def _activations(m: np.ndarray, w: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """relu(m w + b) for as many rows at a time as the bound on a product allows."""
    step = max(1, PRODUCT_BYTES // (8 * len(w)))
    for at in range(0, len(m), step):
        rows = slice(at, at + step)
        yield rows, np.maximum(m[rows] @ w.T + b, 0.0)


def with_decoder_bias(weights: DataFrame, decoder_bias: DataFrame | None) -> DataFrame:
    """Weights whose bias takes in the centring of the input: relu((x - c) w + b) = relu(x w + (b - c w)).

    ``decoder_bias`` is (layer, vec), one vector c a layer; layers without one are not centred.
    """
    if decoder_bias is None:
        return weights
    shift = decoder_bias.select("layer", F.col("vec").alias("_c"))
    return weights.join(shift, "layer", "left").withColumn("b", F.col("b") - F.coalesce(V.dot("w", "_c"), F.lit(0.0))).drop("_c")


def _with_ids(weights: DataFrame, decoder_bias: DataFrame | None = None) -> DataFrame:
    return with_decoder_bias(weights, decoder_bias).withColumnRenamed("feature_id", "id")


def _known(layer: int, store: MatrixBlocks) -> int:
    if layer not in store.width:
        raise ValueError(f"no weights for layer {layer}")
    return layer


def _vector_rows(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("layer").cast("int").alias("layer"), F.col("row_id").cast("bigint").alias("row_id"), "vec")


def linear_relu_topk(vectors: DataFrame, weights: DataFrame, k: int, decoder_bias: DataFrame | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(layer, row_id, indices, values): the k largest relu((x - decoder bias) . w + b) per vector.

    The weights, of the size of the model, lie in blocks in the shared folder. Vectors are encoded
    where they lie: a chunk of them meets one block after the other, and each row keeps its
    best k so far, a state that merges over blocks. Nothing is shuffled or broadcast, whatever the size.
    """
    store = matrix_blocks(_with_ids(weights, decoder_bias), "encoder", block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for layer, part in layer_chunks(batches):
            m, best = matrix(part.column("vec")), None
            for ids, w, b in store.blocks(_known(layer, store)):
                found = [_first_k(acts, ids, k) for _, acts in _activations(m, w, b)]
                best = _merge_k(best, tuple(np.concatenate(x) for x in zip(*found)), k)
            n, width = best[0].shape
            offsets = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x, t).ravel())) for x, t in zip(best, (np.int32, np.float64))]
            yield pa.RecordBatch.from_arrays([part.column("layer"), part.column("row_id"), *lists], ["layer", "row_id", "indices", "values"])

    return _vector_rows(vectors).mapInArrow(run, CODE_SCHEMA)


def linear_relu_selected(vectors: DataFrame, weights: DataFrame, feature_ids: list[int], decoder_bias: DataFrame | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(layer, row_id, feature_id, activation) for a chosen feature list of any length, zeros included."""
    chosen = with_decoder_bias(weights, decoder_bias).filter(F.col("feature_id").isin(list(feature_ids)))
    store = matrix_blocks(chosen.withColumnRenamed("feature_id", "id"), "selected-features", block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for layer, part in layer_chunks(batches):
            m, rows = matrix(part.column("vec")), part.column("row_id").to_numpy()
            for ids, w, b in store.blocks(layer):
                for at, acts in _activations(m, w, b):
                    n = acts.size
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, layer, np.int32)), pa.array(np.repeat(rows[at], len(ids))), pa.array(np.tile(ids, len(acts)).astype(np.int32)), pa.array(acts.ravel())],
                        ["layer", "row_id", "feature_id", "activation"],
                    )

    return _vector_rows(vectors).mapInArrow(run, "layer int, row_id bigint, feature_id int, activation double")


def codes_to_long(arrays: DataFrame, positive_only: bool = True) -> DataFrame:
    """(indices, values) arrays to one row per entry, keeping activation > 0."""
    keys = [c for c in arrays.columns if c not in ("indices", "values")]
    out = arrays.select(*keys, F.explode(F.arrays_zip("indices", "values")).alias("_z")).select(
        *keys, F.col("_z.indices").alias("feature_id"), F.col("_z.values").alias("activation")
    )
    return out.filter("activation > 0") if positive_only else out


# ---- statistics -----------------------------------------------------------------
def feature_stats(codes: DataFrame, features: DataFrame, row_counts: DataFrame) -> DataFrame:
    """Per (layer, feature), never-active ones included: counts, means, max, p95, p99."""
    agg = codes.groupBy("layer", "feature_id").agg(
        F.count(F.lit(1)).alias("c"), F.sum("activation").alias("s"), F.max("activation").alias("m")
    )
    q = exact_percentiles(codes, ["layer", "feature_id"], "activation", {"p95_activation": 0.95, "p99_activation": 0.99})
    joined = (
        features.select("layer", "feature_id").join(row_counts, "layer")
        .join(agg, ["layer", "feature_id"], "left").join(q, ["layer", "feature_id"], "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    n = F.greatest(F.col("n_rows"), F.lit(1))
    return joined.select(
        "layer", "feature_id",
        F.coalesce("c", F.lit(0)).alias("activation_count"),
        (F.coalesce("c", F.lit(0)) / n).alias("activation_frequency"),
        F.coalesce(F.col("s") / F.col("c"), F.lit(0.0)).alias("mean_activation_nonzero"),
        (zero("s") / n).alias("mean_activation_all"),
        zero("m").alias("max_activation"),
        zero("p95_activation").alias("p95_activation"),
        zero("p99_activation").alias("p99_activation"),
    )


def group_feature_sums(codes: DataFrame, meta: DataFrame, group: list[str]) -> DataFrame:
    """(layer, group, feature_id, s, q, nz): sum, sum of squares, nonzero count."""
    return codes.join(meta.select("layer", "row_id", *group), ["layer", "row_id"]).groupBy(
        "layer", *group, "feature_id"
    ).agg(
        F.sum("activation").alias("s"),
        F.sum(F.col("activation") * F.col("activation")).alias("q"),
        F.count(F.lit(1)).alias("nz"),
    )


def feature_group_summary(codes: DataFrame, meta: DataFrame, group: list[str], features: DataFrame) -> DataFrame:
    """Per group and feature, zero-filled: sum, nonzero count, means, frequency."""
    sums = group_feature_sums(codes, meta, group)
    size = meta.groupBy("layer", *group).agg(F.count(F.lit(1)).alias("n"))
    full = size.join(features.select("layer", "feature_id"), "layer").join(sums, ["layer", *group, "feature_id"], "left")
    s, nz = F.coalesce("s", F.lit(0.0)), F.coalesce("nz", F.lit(0))
    return full.select(
        "layer", *group, "feature_id", s.alias("sum_activation"), nz.alias("nonzero"),
        F.coalesce(F.col("s") / F.col("nz"), F.lit(0.0)).alias("mean_nonzero"),
        (s / F.col("n")).alias("mean"), (nz / F.col("n")).alias("freq"), "n",
    )


def full_outer_stats(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Outer join of two statistics tables, columns suffixed _a / _b, missing counted as 0."""
    side = lambda df, s: df.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in cols])
    return side(a, "a").join(side(b, "b"), keys, "full_outer").na.fill(0)


def _moments(side: str) -> tuple[Column, Column]:
    """Mean and sample variance with implicit zeros, from s, q and the group size n."""
    n, s, q = F.col(f"n_{side}"), F.col(f"s_{side}"), F.col(f"q_{side}")
    mean = s / n
    var = F.when(n > 1, (q - n * mean * mean) / (n - 1))
    # A sparse group with one repeated value leaves rounding residue; treat it as no spread.
    return mean, F.when(var > F.lit(1e-15) * q, var).otherwise(F.when(var.isNotNull(), F.lit(0.0)))


def _min_rank(col: Column, w) -> Column:
    return F.when(col.isNotNull(), F.rank().over(w.orderBy(col.desc_nulls_last())))


def _zero_filled_auc(positive: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """AUC per candidate; rows without an entry form one tie block at zero."""
    zeros = candidates.select(
        *keys, F.lit(0.0).alias("score"), (F.col("n_a") - F.col("nz_a")).alias("c_a"), (F.col("n_b") - F.col("nz_b")).alias("c_b")
    ).filter("c_a + c_b > 0")
    return auc_from_counts(positive.unionByName(zeros), keys, blocks=8)


def contrast_feature_selectivity(
    codes: DataFrame, meta: DataFrame, contrasts: DataFrame, features: DataFrame, top_n: int
) -> DataFrame:
    """Features ranked by how well they separate the two endpoints of each contrast.

    Means come from one pass of entity sums. The 5 * top_n features with the largest mean
    gap go on to the exact effect size and AUC, both in closed form over implicit zeros.
    """
    sums = group_feature_sums(codes, meta, ["entity"])
    size = meta.groupBy("layer", "entity").agg(F.count(F.lit(1)).alias("n"))
    side = lambda df, x, cols: df.select("layer", F.col("entity").alias(f"entity_{x}"), *cols)
    pairs = (
        side(size, "a", [F.col("n").alias("n_a")]).join(contrasts, "entity_a")
        .join(side(size, "b", [F.col("n").alias("n_b")]), ["layer", "entity_b"])
        .join(features.select("layer", "feature_id"), "layer")
    )
    for x in ("a", "b"):
        stats = side(sums, x, ["feature_id", *[F.col(c).alias(f"{c}_{x}") for c in ("s", "q", "nz")]])
        pairs = pairs.join(stats, ["layer", f"entity_{x}", "feature_id"], "left")
    pairs = pairs.na.fill(0, [f"{c}_{x}" for c in ("s", "q", "nz") for x in ("a", "b")])
    (mean_a, var_a), (mean_b, var_b) = _moments("a"), _moments("b")
    pairs = pairs.withColumns({"mean_a": mean_a, "mean_b": mean_b, "diff_mean": mean_a - mean_b})
    w = Window.partitionBy("layer", "contrast_name")
    gap = F.abs("diff_mean").desc()
    cand = pairs.withColumn("_rn", F.row_number().over(w.orderBy(gap, "feature_id"))).filter(F.col("_rn") <= 5 * top_n)
    cand = cand.withColumn(
        "cohens_d", cohens_d_from_moments(F.col("mean_a"), F.col("mean_b"), var_a, var_b, F.col("n_a"), F.col("n_b"))
    )
    keys = ["layer", "contrast_name", "feature_id"]
    wanted = cand.select(
        "layer", "contrast_name", "feature_id",
        F.explode(F.array(F.struct(F.col("entity_a").alias("entity"), F.lit(True).alias("is_a")),
                          F.struct(F.col("entity_b").alias("entity"), F.lit(False).alias("is_a")))).alias("_e"),
    ).select(*keys, "_e.entity", "_e.is_a")
    labelled = codes.join(meta.select("layer", "row_id", "entity"), ["layer", "row_id"])
    positive = (
        spread_join(labelled, wanted, ["layer", "feature_id", "entity"], spread_by=["row_id"])
        .groupBy(*keys, F.col("activation").alias("score"))
        .agg(F.count_if("is_a").alias("c_a"), F.count_if(~F.col("is_a")).alias("c_b"))
    )
    scored = cand.join(_zero_filled_auc(positive, cand, keys), keys)
    scored = scored.withColumns(
        {
            "rank_abs_d": _min_rank(F.abs("cohens_d"), w),
            "rank_auc": _min_rank(F.abs(F.col("auc") - 0.5), w),
            "rank_abs_diff": _min_rank(F.abs("diff_mean"), w),
        }
    )
    final = w.orderBy(F.asc_nulls_last("rank_abs_d"), F.asc_nulls_last("rank_auc"), "rank_abs_diff", "feature_id")
    freq = lambda x: F.col(f"nz_{x}") / F.col(f"n_{x}")
    nonzero = lambda x: F.coalesce(F.try_divide(F.col(f"s_{x}"), F.col(f"nz_{x}")), F.lit(0.0))
    return scored.withColumn("_rn", F.row_number().over(final)).filter(F.col("_rn") <= top_n).select(
        "layer", "contrast_name", "axis", "entity_a", "entity_b", "feature_id", "mean_a", "mean_b",
        freq("a").alias("freq_a"), freq("b").alias("freq_b"), nonzero("a").alias("mean_nonzero_a"), nonzero("b").alias("mean_nonzero_b"),
        "diff_mean", "cohens_d", "auc", "n_a", "n_b", "rank_abs_d", "rank_auc", "rank_abs_diff",
    )


def entity_feature_selectivity(codes: DataFrame, meta: DataFrame, features: DataFrame, top_n: int) -> DataFrame:
    """Features that set an entity apart from the rest of its axis.

    The rest is the axis total minus the entity, so entities are never rescanned.
    """
    ent = ["axis", "entity", "canonical_label"]
    sums = group_feature_sums(codes, meta, ent)
    size = meta.groupBy("layer", *ent).agg(F.count(F.lit(1)).alias("n"))
    axis_sums = sums.groupBy("layer", "axis", "feature_id").agg(*[F.sum(c).alias(f"t{c}") for c in ("s", "q", "nz")])
    axis_size = size.groupBy("layer", "axis").agg(F.sum("n").alias("tn"))
    full = (
        size.join(axis_size, ["layer", "axis"]).filter("tn > n")
        .join(features.select("layer", "feature_id"), "layer")
        .join(sums, ["layer", *ent, "feature_id"], "left")
        .join(axis_sums, ["layer", "axis", "feature_id"], "left")
        .na.fill(0, ["s", "q", "nz", "ts", "tq", "tnz"])
    )
    full = full.select(
        "layer", *ent, "feature_id", F.col("n").alias("n_a"), (F.col("tn") - F.col("n")).alias("n_b"),
        *[F.col(c).alias(f"{c}_a") for c in ("s", "q", "nz")],
        *[(F.col(f"t{c}") - F.col(c)).alias(f"{c}_b") for c in ("s", "q", "nz")],
    )
    (mean_a, var_a), (mean_b, var_b) = _moments("a"), _moments("b")
    full = full.withColumns({"mean_a": mean_a, "mean_b": mean_b, "diff_mean": mean_a - mean_b})
    w = Window.partitionBy("layer", "entity")
    cand = full.withColumn("_rn", F.row_number().over(w.orderBy(F.abs("diff_mean").desc(), "feature_id"))).filter(
        F.col("_rn") <= 3 * top_n
    )
    cand = cand.withColumn(
        "cohens_d", cohens_d_from_moments(F.col("mean_a"), F.col("mean_b"), var_a, var_b, F.col("n_a"), F.col("n_b"))
    )
    keys = ["layer", "entity", "feature_id"]
    counts = (
        codes.join(meta.select("layer", "row_id", "axis", F.col("entity").alias("_owner")), ["layer", "row_id"])
        .groupBy("layer", "axis", "feature_id", F.col("activation").alias("score"), "_owner")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    is_a = F.col("_owner") == F.col("entity")
    positive = (
        spread_join(counts, cand.select(*keys, "axis"), ["layer", "axis", "feature_id"], spread_by=["score"])
        .groupBy(*keys, "score")
        .agg(F.sum(F.when(is_a, F.col("c")).otherwise(0)).alias("c_a"), F.sum(F.when(is_a, 0).otherwise(F.col("c"))).alias("c_b"))
    )
    scored = cand.join(_zero_filled_auc(positive, cand, keys), keys)
    final = w.orderBy(F.abs("cohens_d").desc_nulls_last(), "feature_id")
    return scored.withColumn("_rn", F.row_number().over(final)).filter(F.col("_rn") <= top_n).select(
        "layer", *ent, "feature_id", F.col("mean_a").alias("mean_entity"), F.col("mean_b").alias("mean_other_same_axis"),
        "diff_mean", "cohens_d", "auc", (F.col("nz_a") / F.col("n_a")).alias("freq_entity"),
        (F.col("nz_b") / F.col("n_b")).alias("freq_other"), F.col("n_a").alias("n_entity"), F.col("n_b").alias("n_other"),
    )


# ---- decoder alignment and reconstruction ------------------------------------
def decoder_alignment(decoder: DataFrame, directions: DataFrame) -> DataFrame:
    """Norm, cosine and signed dot of every decoder row with every direction of its layer."""
    dw = decoder.select("layer", "feature_id", F.col("w").alias("_w"), V.norm("w").alias("decoder_norm"))
    return directions.select(*G.KEYS, *G.CONTRAST, "dir").join(dw, "layer").withColumn("signed_dot", V.dot("_w", "dir")).select(
        *G.KEYS, *G.CONTRAST, "feature_id", "decoder_norm",
        (F.col("signed_dot") / F.greatest(F.col("decoder_norm"), F.lit(1e-12))).alias("cosine_with_direction"), "signed_dot",
    )


def alignment_ranks(alignment: DataFrame) -> DataFrame:
    """Min-ranks by abs cosine, cosine descending and ascending, within each contrast."""
    w = Window.partitionBy(*G.KEYS, "contrast_name")
    c = F.col("cosine_with_direction")
    return alignment.withColumns(
        {
            "abs_cosine_rank": F.rank().over(w.orderBy(F.abs(c).desc())),
            "positive_rank": F.rank().over(w.orderBy(c.desc())),
            "negative_rank": F.rank().over(w.orderBy(c.asc())),
        }
    )


def alignment_top_union(alignment: DataFrame, n: int) -> DataFrame:
    """Features among the first n of any of the three orderings (ties by feature id)."""
    w = Window.partitionBy(*G.KEYS, "contrast_name")
    c = F.col("cosine_with_direction")
    first = F.least(
        F.row_number().over(w.orderBy(F.abs(c).desc(), "feature_id")),
        F.row_number().over(w.orderBy(c.desc(), "feature_id")),
        F.row_number().over(w.orderBy(c.asc(), "feature_id")),
    )
    return alignment.withColumn("_best", first).filter(F.col("_best") <= n).drop("_best")


JOIN_KEYS = ["layer", "contrast_name", "axis", "entity_a", "entity_b", "feature_id"]


def selectivity_alignment_join(selectivity: DataFrame, alignment: DataFrame) -> DataFrame:
    cols = ["resid", "decoder_norm", "cosine_with_direction", "signed_dot"]
    return selectivity.join(alignment.select(*JOIN_KEYS, *cols), JOIN_KEYS, "left")


def zscore(col: Column, w) -> Column:
    """Population z-score inside a window; 0 where the spread is 0."""
    sd = F.stddev_pop(col).over(w)
    return F.when(sd > 0, (col - F.avg(col).over(w)) / F.when(sd > 0, sd)).otherwise(F.when(col.isNotNull(), F.lit(0.0)))


def zscore_combined(joined: DataFrame) -> DataFrame:
    """Sum of the z-scores of |d|, |cosine| and |AUC - 0.5| over the contrast's selected rows."""
    w = Window.partitionBy(*G.KEYS, "contrast_name")
    score = (
        zscore(F.abs("cohens_d"), w) + zscore(F.abs("cosine_with_direction"), w) + zscore(F.abs(F.col("auc") - 0.5), w)
    )
    return joined.withColumn("combined_score", score)


# Fixed values (text the candidate table must carry).
CANDIDATE_ADVICE = "ablate"
CANDIDATE_NOTE = "Candidate only; validate with model-forward BBQ intervention before causal claims."


def intervention_candidates(joined: DataFrame, top_n: int) -> DataFrame:
    w = Window.partitionBy(*G.KEYS, "contrast_name").orderBy(F.desc_nulls_last("combined_score"), "feature_id")
    side = F.when(F.col("diff_mean") >= 0, F.lit("identity_a_positive")).otherwise(F.lit("identity_b_positive"))
    return joined.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top_n).select(
        *G.KEYS, "contrast_name", "axis", "entity_a", "entity_b", "feature_id", side.alias("direction_side"),
        F.col("mean_a").alias("mean_activation_a"), F.col("mean_b").alias("mean_activation_b"),
        F.col("cosine_with_direction").alias("decoder_cosine"), "cohens_d", "auc", "combined_score",
        F.lit(CANDIDATE_ADVICE).alias("recommended_intervention"), F.lit(CANDIDATE_NOTE).alias("notes"),
    )


def direction_reconstruction(
    vm: VariantMeans, directions: DataFrame, decoder: DataFrame, alignment: DataFrame, joined: DataFrame, ks: list[int], seed: int = 0
) -> DataFrame:
    """Rebuild each direction from its first k decoder rows under four orderings.

    Coefficients are dots with the unit decoder rows. Orderings: |cosine|, |d|, combined
    score, and a seeded random order as the baseline.
    """
    part = [*G.KEYS, "contrast_name"]
    base = alignment.select(*part, "feature_id", "cosine_with_direction")
    ordered = [
        ("decoder_alignment", base, F.abs("cosine_with_direction").desc()),
        ("selectivity", joined, F.abs("cohens_d").desc_nulls_last()),
        ("combined_score", joined, F.desc_nulls_last("combined_score")),
        ("random_baseline", base, seeded_order(seed, F.col("contrast_name"), F.col("feature_id"))),
    ]
    picks = None
    for method, src, key in ordered:
        w = Window.partitionBy(*part).orderBy(key, "feature_id")
        p = src.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max(ks)).select(
            *part, "feature_id", "_rn", F.lit(method).alias("selection_method")
        )
        picks = p if picks is None else picks.unionByName(p)
    unit = decoder.select("layer", "feature_id", V.scale("w", F.lit(1.0) / F.greatest(V.norm("w"), F.lit(1e-12))).alias("_u"))
    terms = (
        picks.join(unit, ["layer", "feature_id"])
        .join(directions.select(*part, "axis", "entity_a", "entity_b", "dir"), part)
        .withColumn("_term", V.scale("_u", V.dot("_u", "dir")))
        .withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("_rn"))))
    )
    group = [*G.KEYS, *G.CONTRAST, "selection_method", "k"]
    built = terms.groupBy(*group).agg(
        mean_vector("_term").alias("_m"), F.count(F.lit(1)).alias("n_features"), F.first("dir").alias("_full")
    )
    # Lists shorter than k repeat their whole list for the larger k.
    built = built.withColumn("_r", V.scale("_m", F.col("n_features").cast("double"))).withColumn("fraction_norm_captured", V.sq_norm("_r"))
    built = built.withColumn("dir", V.normalize("_r")).withColumn("cosine_with_full_direction", V.dot("_full", "dir"))
    extra = ["selection_method", "k"]
    ready = built.filter(F.col("dir").isNotNull()).select(*group, "dir")
    metrics = G.endpoint_component_metrics(vm, ready, extra).select(*group, "auc", "cohens_d")
    # What the whole direction reaches, beside what its parts reach.
    whole = G.endpoint_component_metrics(vm, directions.select(*G.KEYS, *G.CONTRAST, F.lit("full").alias("part"), "dir"), ["part"])
    whole = whole.select(*G.KEYS, "contrast_name", F.col("auc").alias("full_direction_auc"), F.col("cohens_d").alias("full_direction_cohens_d"))
    out = built.select(*group, "n_features", "cosine_with_full_direction", "fraction_norm_captured").join(metrics, group, "left")
    return out.join(whole, part, "left")


# ---- edits in code space and back ---------------------------------------------
def dense_top_features(codes: DataFrame, rows: DataFrame, top_n: int) -> DataFrame:
    """(layer, row_id, feature_ids, values): zero-filled values of the most frequent features."""
    counts = codes.groupBy("layer", "feature_id").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("layer").orderBy(F.desc("c"), "feature_id")
    top = counts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top_n)
    ids = top.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("_rn", "feature_id"))).alias("_l")).select(
        "layer", F.col("_l.feature_id").alias("feature_ids")
    )
    maps = codes.groupBy("layer", "row_id").agg(F.map_from_entries(F.collect_list(F.struct("feature_id", "activation"))).alias("_m"))
    full = rows.select("layer", "row_id").join(maps, ["layer", "row_id"], "left")
    return spread_join(full, ids, ["layer"], spread_by=["row_id"]).select(
        "layer", "row_id", "feature_ids",
        F.transform("feature_ids", lambda f: F.coalesce(F.try_element_at("_m", f), F.lit(0.0))).alias("values"),
    )


def feature_values_for_id(codes: DataFrame, rows: DataFrame, feature_id: int) -> DataFrame:
    """One feature as a zero-filled column over all rows."""
    one = codes.filter(F.col("feature_id") == feature_id).select("layer", "row_id", "activation")
    return rows.join(one, ["layer", "row_id"], "left").withColumn("activation", F.coalesce("activation", F.lit(0.0)))


def ablate_codes(codes: DataFrame, feature_ids: list[int]) -> DataFrame:
    return codes.filter(~F.col("feature_id").isin(feature_ids))


def steer_codes(codes: DataFrame, rows: DataFrame, feature_ids: list[int], alpha: float) -> DataFrame:
    """Add ``alpha`` to the listed features of every row, inactive ones included."""
    spine = rows.select("layer", "row_id", F.explode(F.array(*[F.lit(f) for f in feature_ids])).alias("feature_id"))
    moved = spine.withColumn("activation", F.lit(float(alpha)))
    return codes.unionByName(moved).groupBy("layer", "row_id", "feature_id").agg(F.sum("activation").alias("activation"))


def _add_codes(m: np.ndarray, rows: np.ndarray, ids: np.ndarray, values: np.ndarray, store: MatrixBlocks, layer: int) -> None:
    """Add to each row of ``m`` its codes times the decoder's rows; ``rows`` is ascending."""
    for own, w, _ in store.blocks(layer):
        place = np.minimum(np.searchsorted(own, ids), len(own) - 1)
        here = np.flatnonzero(own[place] == ids)
        step = max(1, PRODUCT_BYTES // (8 * w.shape[1]))
        for at in range(0, len(here), step):
            e = here[at:at + step]
            first = np.flatnonzero(np.r_[True, rows[e][1:] != rows[e][:-1]])
            m[rows[e][first]] += np.add.reduceat(w[place[e]] * values[e][:, None], first, axis=0)


def _decoded(rows: DataFrame, codes: DataFrame, decoder: DataFrame, bias: float | DataFrame, block_bytes: int) -> DataFrame:
    """``rows`` with ``vec`` = (their vec, if they have one) + codes . decoder + bias.

    What is shuffled are codes as (feature, activation) pairs, and rows once to meet them; the
    products are made in the tasks, from decoder blocks in the shared folder.
    """
    store = matrix_blocks(decoder.select("layer", F.col("feature_id").alias("id"), "w"), "decoder", block_bytes)
    shift = matrix_blocks(bias.select("layer", F.lit(0).alias("id"), F.col("vec").alias("w")), "decoder-bias") if isinstance(bias, DataFrame) else None
    number = 0.0 if shift else float(bias)
    packed = codes.groupBy("layer", "row_id").agg(F.collect_list(F.struct(F.col("feature_id").cast("long").alias("f"), F.col("activation").cast("double").alias("a"))).alias("_codes"))
    full = rows.join(packed, ["layer", "row_id"], "left").filter(F.col("layer").isin(list(store.width)))
    kept = [c for c in rows.columns if c != "vec"]
    full = full.select(*kept, *["vec"] * ("vec" in rows.columns), F.coalesce("_codes.f", F.array().cast("array<bigint>")).alias("_f"), F.coalesce("_codes.a", F.array().cast("array<double>")).alias("_a"))
    schema = full.select(*kept, F.array(F.lit(0.0)).alias("vec")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for layer, part in layer_chunks(batches):
            n, width = part.num_rows, store.width[layer]
            m = matrix(part.column("vec")).copy() if "vec" in part.schema.names else np.zeros((n, width))
            lists = part.column("_f")
            count = np.diff(lists.offsets.to_numpy())
            _add_codes(m, np.repeat(np.arange(n), count), lists.flatten().to_numpy(), part.column("_a").flatten().to_numpy(), store, layer)
            if shift is None:
                m += number
            else:
                for _, c, _ in shift.blocks(layer):
                    m += c.sum(axis=0)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], vec], [*kept, "vec"])

    return full.mapInArrow(run, schema)


def code_decode(codes: DataFrame, rows: DataFrame, decoder: DataFrame, bias: float | DataFrame = 0.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(layer, row_id, vec): codes . decoder + bias; rows without codes give the bias.

    The bias is a number or a table (layer, vec) with one vector a layer. Rows of a layer
    without decoder give nothing; codes of features that the decoder lacks count as zero.
    """
    return _decoded(rows.select("layer", "row_id"), codes, decoder, bias, block_bytes)


def code_difference(edited: DataFrame, original: DataFrame) -> DataFrame:
    both = edited.unionByName(original.withColumn("activation", -F.col("activation")))
    return both.groupBy("layer", "row_id", "feature_id").agg(F.sum("activation").alias("activation")).filter("activation <> 0")


def patch_residual(vectors: DataFrame, edited: DataFrame, original: DataFrame, decoder: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """x + decode(edited) - decode(original), by decoding only the code difference onto x."""
    return _decoded(vectors, code_difference(edited, original), decoder, 0.0, block_bytes)
