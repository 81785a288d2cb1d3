"""Two-group separation metrics: AUC, effect size, midpoint accuracy.

AUC is the Mann-Whitney statistic with half credit for ties. Equal scores are first
collapsed to one row with two counts; rows are then cut into score blocks at approximate
quantiles, so no window ever holds a whole comparison: running counts are taken inside a
block, and block totals (at most ``blocks`` per comparison) are prefixed afterwards.
The result is exact whatever the block edges are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetlens.functions.joins import spread_join
from facetlens.functions.numeric import cohens_d_from_moments


def _cut_points(score: str, blocks: int):
    return F.percentile_approx(score, [i / blocks for i in range(1, blocks)], 20 * blocks)


def rank_counts(dist: DataFrame, keys: list[str], carry: list[str] = [], hit=None) -> DataFrame:
    """Blocked Mann-Whitney numerator from (keys, score, c_a, c_b, _cuts, carry).

    Returns (keys, u, c_a, c_b, hits, carry) where u counts a-over-b wins, ties half.
    """
    hits = F.lit(0) if hit is None else hit
    placed = dist.withColumn("_block", F.size(F.filter("_cuts", lambda c: c < F.col("score")))).drop("_cuts")
    inside = Window.partitionBy(*keys, "_block").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    lower_b = F.coalesce(F.sum("c_b").over(inside), F.lit(0))
    per_block = (
        placed.withColumn("_u", F.col("c_a") * (lower_b + F.col("c_b") / F.lit(2.0)))
        .withColumn("_hits", hits)
        .groupBy(*keys, "_block")
        .agg(
            F.sum("_u").alias("_u"),
            F.sum("c_a").alias("c_a"),
            F.sum("c_b").alias("c_b"),
            F.sum("_hits").alias("_hits"),
            *[F.first(c).alias(c) for c in carry],
        )
    )
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("c_b").over(across), F.lit(0))
    return (
        per_block.withColumn("_u", F.col("_u") + F.col("c_a") * below)
        .groupBy(*keys)
        .agg(
            F.sum("_u").alias("u"),
            F.sum("c_a").alias("c_a"),
            F.sum("c_b").alias("c_b"),
            F.sum("_hits").alias("hits"),
            *[F.first(c).alias(c) for c in carry],
        )
    )


def auc_from_counts(dist: DataFrame, keys: list[str], blocks: int = 16) -> DataFrame:
    """(keys, auc) from score counts (keys, score, c_a, c_b), one row per distinct score."""
    cuts = dist.groupBy(*keys).agg(_cut_points("score", blocks).alias("_cuts"))
    ranked = rank_counts(spread_join(dist, cuts, keys, spread_by=[*keys, "score"]), keys)
    return ranked.select(*keys, _auc().alias("auc"))


def _auc():
    pairs = F.col("c_a").cast("double") * F.col("c_b")
    return F.when(pairs > 0, F.try_divide(F.col("u"), pairs))


def _weighted_moments(side: str):
    """Mean, sample variance and count of ``score`` weighted by the side's counts."""
    c, x = F.col(f"c_{side}"), F.col("score")
    n, total, squares = F.sum(c), F.sum(c * x), F.sum(c * x * x)
    var = F.when(n > 1, F.greatest(F.lit(0.0), (squares - total * total / n) / (n - 1)))
    return [
        F.try_divide(total, n).alias(f"mean_{side}"),
        var.alias(f"var_{side}"),
        n.alias(f"n_{side}"),
    ]


def endpoint_metrics(scores: DataFrame, keys: list[str], blocks: int = 64) -> DataFrame:
    """AUC, effect size, midpoint accuracy, means, sds and counts per ``keys``.

    ``scores`` holds one row per scored vector with ``score`` and ``is_a`` (true for the
    first endpoint, false for the second).
    """
    # Every statistic is taken from the collapsed scores, so the rows are scored once.
    dist = scores.groupBy(*keys, "score").agg(
        F.count_if("is_a").alias("c_a"), F.count_if(~F.col("is_a")).alias("c_b")
    )
    stats = dist.groupBy(*keys).agg(
        *_weighted_moments("a"), *_weighted_moments("b"), _cut_points("score", blocks).alias("_cuts")
    )
    names = ["mean_a", "mean_b", "var_a", "var_b", "n_a", "n_b"]
    joined = spread_join(dist, stats, keys, spread_by=[*keys, "score"])
    midpoint = (F.col("mean_a") + F.col("mean_b")) / F.lit(2.0)
    hit = F.when(F.col("score") >= midpoint, F.col("c_a")).otherwise(F.col("c_b"))
    ranked = rank_counts(joined, keys, carry=names, hit=hit)
    both = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    return ranked.select(
        *keys,
        _auc().alias("auc"),
        cohens_d_from_moments(*[F.col(c) for c in names]).alias("cohens_d"),
        F.when(both, F.col("hits") / (F.col("n_a") + F.col("n_b"))).alias("accuracy_midpoint"),
        "mean_a",
        "mean_b",
        F.sqrt("var_a").alias("sd_a"),
        F.sqrt("var_b").alias("sd_b"),
        "n_a",
        "n_b",
    )


def cohens_d(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cohens_d, n_a, n_b) in one aggregation."""
    a = F.when(F.col("is_a"), F.col("score"))
    b = F.when(~F.col("is_a"), F.col("score"))
    g = scores.groupBy(*keys).agg(
        F.avg(a).alias("mean_a"),
        F.avg(b).alias("mean_b"),
        F.var_samp(a).alias("var_a"),
        F.var_samp(b).alias("var_b"),
        F.count(a).alias("n_a"),
        F.count(b).alias("n_b"),
    )
    d = cohens_d_from_moments(*[F.col(c) for c in ("mean_a", "mean_b", "var_a", "var_b", "n_a", "n_b")])
    return g.select(*keys, d.alias("cohens_d"), "n_a", "n_b")


def auc(scores: DataFrame, keys: list[str], blocks: int = 64) -> DataFrame:
    """(keys, auc) from scored rows; NULL if one class is missing."""
    dist = scores.groupBy(*keys, "score").agg(
        F.count_if("is_a").alias("c_a"), F.count_if(~F.col("is_a")).alias("c_b")
    )
    return auc_from_counts(dist, keys, blocks)


def midpoint_accuracy(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, accuracy_midpoint): share on the right side of the mean of class means."""
    a = F.when(F.col("is_a"), F.col("score"))
    b = F.when(~F.col("is_a"), F.col("score"))
    mid = scores.groupBy(*keys).agg(((F.avg(a) + F.avg(b)) / 2).alias("_mid"))
    joined = spread_join(scores, mid, keys, spread_by=["row_id"])
    hit = F.when(F.col("is_a"), F.col("score") >= F.col("_mid")).otherwise(F.col("score") < F.col("_mid"))
    return joined.groupBy(*keys).agg(F.avg(hit.cast("double")).alias("accuracy_midpoint"))


def macro_f1(predictions: DataFrame, keys: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and unweighted mean of per-class F1 from (label, prediction) rows.

    The confusion table is the only shuffle of row-level data. A class counts when it
    occurs as a label or as a prediction.
    """
    confusion = predictions.groupBy(
        *keys, F.col(label).alias("_l"), F.col(prediction).alias("_p")
    ).agg(F.count(F.lit(1)).alias("_n"))
    sides = confusion.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("_l").alias("cls"), F.col("_n").alias("n_true"), F.lit(0).cast("bigint").alias("n_pred"),
                         F.when(F.col("_l") == F.col("_p"), F.col("_n")).otherwise(F.lit(0)).alias("tp")),
                F.struct(F.col("_p").alias("cls"), F.lit(0).cast("bigint").alias("n_true"), F.col("_n").alias("n_pred"),
                         F.lit(0).cast("bigint").alias("tp")),
            )
        ).alias("s"),
    )
    per_class = sides.groupBy(*keys, F.col("s.cls").alias("cls")).agg(
        F.sum("s.n_true").alias("n_true"), F.sum("s.n_pred").alias("n_pred"), F.sum("s.tp").alias("tp")
    )
    f1 = F.lit(2.0) * F.col("tp") / (F.col("n_true") + F.col("n_pred"))
    return per_class.groupBy(*keys).agg(
        F.avg(f1).alias("macro_f1"),
        (F.sum("tp") / F.sum("n_true").cast("double")).alias("accuracy"),
        F.count_if(F.col("n_true") > 0).alias("n_classes"),
    )
