"""Group means, residualization and variance decomposition of vector tables.

A vector table has one row per (layer, row_id) with ``vec ARRAY<DOUBLE>``. Means use
``Summarizer``: one dense partial sum per group and task, then a merge, so a group that
holds most rows still reduces inside every task before anything is shuffled.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlens.functions import vec as V
from facetlens.functions.joins import spread_join
from facetlens.functions.settle import settle

RAW = "raw"


def mean_vector(vec: str = "vec", weight: str | Column | None = None) -> Column:
    column = array_to_vector(F.col(vec))
    if weight is None:
        return vector_to_array(Summarizer.mean(column))
    w = F.col(weight) if isinstance(weight, str) else weight
    return vector_to_array(Summarizer.mean(column, w))


def group_vector_mean(vectors: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """(keys, mean, n)."""
    return vectors.groupBy(*keys).agg(mean_vector(vec).alias("mean"), F.count(F.lit(1)).alias("n"))


def pooled_mean(group_means: DataFrame, keys: list[str]) -> DataFrame:
    """Mean per ``keys`` from finer group means, weighted by their counts (no rescan)."""
    return group_means.groupBy(*keys).agg(
        mean_vector("mean", F.col("n").cast("double")).alias("mean"), F.sum("n").alias("n")
    )


def residualize(
    vectors: DataFrame, variants: dict[str, str | None], layer_keys: list[str] = ["layer"]
) -> DataFrame:
    """One copy of the rows per variant: x - group mean + global mean, or x for ``None``.

    ``variants`` maps a variant label to the grouping column. All grouped variants share
    one aggregation: rows are unpivoted to (variant, group value) first.
    """
    grouped = {label: col for label, col in variants.items() if col is not None}
    outputs = []
    for label, col in variants.items():
        if col is None:
            outputs.append(vectors.withColumn("resid", F.lit(label)))
    if grouped:
        pairs = F.array(
            *[
                F.struct(F.lit(label).alias("resid"), F.col(col).cast("string").alias("_group"))
                for label, col in grouped.items()
            ]
        )
        stacked = vectors.withColumn("_v", F.explode(pairs)).select(
            *vectors.columns, "_v.resid", "_v._group"
        )
        by_group = group_vector_mean(stacked, [*layer_keys, "resid", "_group"])
        overall = pooled_mean(by_group, [*layer_keys, "resid"]).select(
            *layer_keys, "resid", F.col("mean").alias("_overall")
        )
        shift = by_group.join(overall, [*layer_keys, "resid"]).select(
            *layer_keys, "resid", "_group", V.sub("_overall", "mean").alias("_shift")
        )
        moved = spread_join(
            stacked, shift, [*layer_keys, "resid", "_group"], spread_by=["row_id"]
        ).withColumn("vec", V.add("vec", "_shift"))
        outputs.append(moved.select(*vectors.columns, "resid"))
    return reduce(DataFrame.unionByName, outputs)


def factor_means(
    vectors: DataFrame, factors: dict[str, list[str]], layer_keys: list[str] = ["layer"]
) -> DataFrame:
    """(layer, factor, level, mean, n) for several groupings from one pass over the vectors.

    A factor is named by its key and may combine several columns (joined by ``|``).
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("factor"), level_of(cols).alias("level")) for name, cols in factors.items()])
    stacked = vectors.select(*layer_keys, "vec", F.explode(pairs).alias("_p"))
    return stacked.groupBy(*layer_keys, F.col("_p.factor").alias("factor"), F.col("_p.level").alias("level")).agg(
        mean_vector().alias("mean"), F.count(F.lit(1)).alias("n")
    )


def level_of(cols: list[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


class VariantMeans:
    """Group means of every residualization variant without building residualized rows.

    Residualizing adds one vector per (variant, group) to every row of the group, so the
    mean of any cell moves by the count-weighted mean of those vectors. Two passes cover
    all variants: one over the vectors (``factor_means``) and one, without the vector
    column, that counts rows per (cell, group).

    ``variants`` maps a label to the residualized column, or to None for raw vectors.
    """

    def __init__(self, vectors: DataFrame, variants: dict[str, str | None], cell: list[str], extra: list[str] = []):
        self.vectors = vectors
        self.variants = variants
        self.cell = cell
        self.extra = extra
        factors = {"_cell": cell, **{k: [c] for k, c in variants.items() if c is not None}}
        self._means = settle(factor_means(vectors, factors), "factor-means")

    @cached_property
    def overall(self) -> DataFrame:
        """(layer, mean, n); residualizing leaves it unchanged."""
        return pooled_mean(self._means.filter("factor = '_cell'"), ["layer"])

    @cached_property
    def shifts(self) -> DataFrame:
        """(layer, resid, level, shift): what a row of that group gains; raw gains zero."""
        overall = self.overall.select("layer", F.col("mean").alias("_o"))
        grouped = (
            self._means.filter("factor <> '_cell'").join(overall, "layer")
            .select("layer", F.col("factor").alias("resid"), "level", V.sub("_o", "mean").alias("shift"))
        )
        for label, col in self.variants.items():
            if col is None:
                grouped = grouped.unionByName(
                    overall.select("layer", F.lit(label).alias("resid"), F.lit("").alias("level"),
                                   F.transform("_o", lambda x: F.lit(0.0)).alias("shift"))
                )
        return grouped

    def level_column(self, resid: Column) -> Column:
        """The row's group value under a variant, as used in ``shifts.level``."""
        out = F.lit("")
        for label, col in self.variants.items():
            if col is not None:
                out = F.when(resid == label, F.col(col).cast("string")).otherwise(out)
        return out

    @cached_property
    def means(self) -> DataFrame:
        """(layer, resid, cell columns, extra columns, mean, n)."""
        pairs = F.array(*[
            F.struct(F.lit(label).alias("resid"), (F.lit("") if col is None else F.col(col).cast("string")).alias("level"))
            for label, col in self.variants.items()
        ])
        counts = (
            self.vectors.select("layer", *self.cell, *self.extra, F.explode(pairs).alias("_p"))
            .groupBy("layer", *self.cell, *self.extra, F.col("_p.resid").alias("resid"), F.col("_p.level").alias("level"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        moved = (
            counts.join(self.shifts, ["layer", "resid", "level"])
            .groupBy("layer", "resid", *self.cell, *self.extra)
            .agg(mean_vector("shift", F.col("n").cast("double")).alias("_shift"), F.sum("n").alias("n"))
        )
        raw = self._means.filter("factor = '_cell'").select("layer", F.col("level").alias("_cell"), F.col("mean").alias("_m"))
        return settle(
            moved.withColumn("_cell", level_of(self.cell)).join(raw, ["layer", "_cell"])
            .select("layer", "resid", *self.cell, *self.extra, V.add("_m", "_shift").alias("mean"), "n"),
            "cell-means",
        )


def variance_decomposition(
    vectors: DataFrame, factors: list[str], layer_keys: list[str] = ["layer"]
) -> DataFrame:
    """Between-group and total sum of squares and eta squared for each factor.

    Rows are read once, into cells of all factor values; every factor's group means, the
    global mean and the total then come from the cells. The total is split exactly into
    within-cell scatter (from the element sum of squares) and between-cell scatter.
    """
    cells = vectors.groupBy(*layer_keys, *factors).agg(
        mean_vector().alias("mean"),
        F.count(F.lit(1)).alias("n"),
        F.sum(V.sq_norm("vec")).alias("sum_sq"),
    )
    overall = cells.groupBy(*layer_keys).agg(
        mean_vector("mean", F.col("n").cast("double")).alias("overall"),
        F.sum("n").alias("n_total"),
        F.sum("sum_sq").alias("sum_sq_total"),
    )
    pairs = F.array(
        *[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors]
    )
    levels = (
        cells.withColumn("_p", F.explode(pairs))
        .groupBy(*layer_keys, F.col("_p.factor").alias("factor"), F.col("_p.level").alias("level"))
        .agg(mean_vector("mean", F.col("n").cast("double")).alias("mean"), F.sum("n").alias("n"))
    )
    total = F.col("sum_sq_total") - F.col("n_total") * V.sq_norm("overall")
    gap = V.sub("mean", "overall")
    return (
        levels.join(overall, layer_keys)
        .withColumn("_between", F.col("n") * V.sq_norm(gap))
        .withColumn("_total", total)
        .groupBy(*layer_keys, "factor")
        .agg(
            F.count(F.lit(1)).alias("n_groups"),
            F.sum("_between").alias("ss_factor"),
            F.max("_total").alias("ss_total"),
        )
        .withColumn(
            "eta_squared",
            F.when(F.col("ss_total") > 0, F.try_divide(F.col("ss_factor"), F.col("ss_total"))),
        )
    )


def degenerate_layers(vectors: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Per layer: population variance over all elements, finiteness, keep flag."""
    n = F.size("vec").cast("double")
    per_row = vectors.select(
        "layer",
        n.alias("n"),
        F.aggregate("vec", F.lit(0.0), lambda s, v: s + v).alias("s"),
        V.sq_norm("vec").alias("q"),
        F.exists("vec", lambda v: F.isnan(v) | v.isin(float("inf"), float("-inf")) | v.isNull()).alias("bad"),
    )
    ok = ~F.col("bad")
    return (
        per_row.groupBy("layer")
        .agg(
            F.sum(F.when(ok, F.col("n"))).alias("_n"),
            F.sum(F.when(ok, F.col("s"))).alias("_s"),
            F.sum(F.when(ok, F.col("q"))).alias("_q"),
            F.bool_or("bad").alias("has_non_finite"),
        )
        .select(
            "layer",
            (F.col("_q") / F.col("_n") - F.pow(F.col("_s") / F.col("_n"), F.lit(2.0))).alias("variance"),
            "has_non_finite",
        )
        .withColumn("keep", ~F.col("has_non_finite") & (F.coalesce(F.col("variance"), F.lit(0.0)) > tolerance))
    )


def drop_degenerate_layers(vectors: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    keep = degenerate_layers(vectors, tolerance).filter("keep").select("layer")
    return spread_join(vectors, keep, ["layer"], spread_by=["row_id"], how="left_semi")


def standardize(vectors: DataFrame, layer_keys: list[str] = ["layer"]) -> DataFrame:
    """Column z-scaling with the population sd; constant columns are only centred."""
    column = array_to_vector(F.col("vec"))
    stats = vectors.groupBy(*layer_keys).agg(
        vector_to_array(Summarizer.mean(column)).alias("_mean"),
        vector_to_array(Summarizer.variance(column)).alias("_var"),
        F.count(F.lit(1)).cast("double").alias("_n"),
    )
    # Summarizer.variance is the sample variance.
    to_scale = F.transform(
        "_var",
        lambda v: F.when(v > 0, F.lit(1.0) / F.sqrt(v * (F.col("_n") - 1) / F.col("_n"))).otherwise(F.lit(1.0)),
    )
    stats = stats.select(*layer_keys, "_mean", to_scale.alias("_inv"))
    joined = spread_join(vectors, stats, layer_keys, spread_by=["row_id"])
    scaled = F.zip_with(V.sub("vec", "_mean"), F.col("_inv"), lambda x, k: x * k)
    return joined.withColumn("vec", scaled).drop("_mean", "_inv")
