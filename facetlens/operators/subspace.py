"""Shared subspace of contrast directions, principal components, vector-table edits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetlens.functions import vec as V
from facetlens.functions.blocks import BLOCK_BYTES, PRODUCT_BYTES, layer_chunks, matrix, matrix_blocks
from facetlens.operators import geometry as G
from facetlens.operators.means import VariantMeans

KEYS = G.KEYS
SVD_SCHEMA = "layer int, resid string, component int, singular_value double, explained_variance_ratio double, vec array<double>"


def shared_subspace_svd(directions: DataFrame) -> DataFrame:
    """Spectrum and basis of the stacked unit directions of each (layer, variant).

    A group is one row per contrast of the contrast list, so each decomposition is a small
    matrix; groups with fewer than two directions give nothing. The largest entry of a
    basis vector is made positive.
    """

    def svd(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = ["layer", "resid", "component", "singular_value", "explained_variance_ratio", "vec"]
        if len(pdf) < 2:
            return pd.DataFrame(columns=cols)
        pdf = pdf.sort_values("contrast_name")
        _, s, vt = np.linalg.svd(np.stack(pdf["dir"].to_numpy()), full_matrices=False)
        flip = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
        vt = vt * np.where(flip == 0, 1.0, flip)[:, None]
        power = float((s**2).sum())
        return pd.DataFrame({
            "layer": pdf["layer"].iloc[0], "resid": pdf["resid"].iloc[0], "component": np.arange(1, len(s) + 1),
            "singular_value": s, "explained_variance_ratio": s**2 / power if power > 0 else None, "vec": list(vt),
        })[cols]

    return directions.select(*KEYS, "contrast_name", "dir").groupBy(*KEYS).applyInPandas(svd, SVD_SCHEMA)


def cumulative_explained(spectrum: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return spectrum.withColumn("cumulative_explained_variance", F.sum("explained_variance_ratio").over(w))


def contrast_loadings(directions: DataFrame, basis: DataFrame, n_pcs: int = 10) -> DataFrame:
    b = basis.filter(F.col("component") <= n_pcs).select(*KEYS, F.col("component").alias("pc"), F.col("vec").alias("_b"))
    return directions.join(b, KEYS).withColumn("loading", V.dot("dir", "_b")).select(
        *KEYS, "contrast_name", "axis", "pc", "loading", F.abs("loading").alias("abs_loading")
    )


def _packed_basis(basis: DataFrame) -> DataFrame:
    item = F.array_sort(F.collect_list(F.struct("component", "vec")))
    return basis.groupBy(*KEYS).agg(item.alias("_basis"))


def subspace_decomposition(
    vm: VariantMeans, directions: DataFrame, basis: DataFrame, ks: list[int] = [1, 2, 3, 5, 10], eps: float = 1e-12
) -> DataFrame:
    """Shared and residual part of each direction for each k, with endpoint metrics of all parts.

    ``full`` rows repeat the whole direction for every k. A part shorter than ``eps`` has
    no direction: its metrics and cosine are NULL.
    """
    d = directions.join(_packed_basis(basis), KEYS).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    used = F.slice("_basis", 1, F.col("k"))
    zero = F.transform("dir", lambda x: F.lit(0.0))
    shared = F.aggregate(
        used, zero, lambda acc, b: F.zip_with(acc, V.scale(b["vec"], V.dot(F.col("dir"), b["vec"])), lambda x, y: x + y)
    )
    d = d.withColumn("_shared", shared).withColumn("_rest", V.sub("dir", "_shared"))
    unit = lambda c: V.normalize(F.col(c), eps)
    part = lambda name, vec, length: F.struct(F.lit(name).alias("component_type"), vec.alias("part"), length.alias("component_norm"))
    parts = F.array(
        part("full", F.col("dir"), F.lit(1.0)), part("shared", unit("_shared"), V.norm("_shared")), part("residual", unit("_rest"), V.norm("_rest"))
    )
    long = d.select(*KEYS, *G.CONTRAST, "k", "dir", F.explode(parts).alias("_p")).select(
        *KEYS, *G.CONTRAST, "k", "_p.component_type", "_p.component_norm",
        F.pow("_p.component_norm", F.lit(2.0)).alias("fraction_norm"), V.dot(F.col("dir"), F.col("_p.part")).alias("cosine_with_full"),
        F.col("_p.part").alias("part"),
    )
    # The whole direction is the same for every k: it is scored once.
    long = long.withColumn("_k", F.when(F.col("component_type") != "full", F.col("k")).otherwise(F.lit(0)))
    extra = ["_k", "component_type"]
    ready = long.filter(F.col("part").isNotNull() & ((F.col("_k") > 0) | (F.col("k") == ks[0]))).select(*KEYS, *G.CONTRAST, *extra, F.col("part").alias("dir"))
    m = G.endpoint_component_metrics(vm, ready, extra)
    out = long.drop("part").join(m, [*KEYS, *G.CONTRAST, *extra], "left").drop("_k")
    ids = [*KEYS, *G.CONTRAST, "k", "component_type"]
    return out.select(*ids, *[c for c in out.columns if c not in ids])


def axis_sharedness(decomposition: DataFrame) -> DataFrame:
    """Per (layer, variant, axis, k): means and median over contrasts of shared / residual / full."""
    ids = [*KEYS, "axis", "contrast_name", "k"]
    at = lambda kind, col: F.max(F.when(F.col("component_type") == kind, F.col(col)))
    wide = decomposition.groupBy(*ids).agg(
        at("shared", "fraction_norm").alias("fraction_shared"),
        *[at(kind, col).alias(f"{kind}_{short}") for kind in ("full", "shared", "residual") for col, short in (("auc", "auc"), ("cohens_d", "d"))],
    )
    return wide.groupBy(*KEYS, "axis", "k").agg(
        F.avg("fraction_shared").alias("mean_fraction_shared"),
        F.percentile("fraction_shared", 0.5).alias("median_fraction_shared"),
        *[F.avg(f"{kind}_{short}").alias(f"mean_{kind}_{short}") for kind in ("full", "shared", "residual") for short in ("auc", "d")],
        F.countDistinct("contrast_name").alias("n_contrasts"),
    )


def decomposition_curves(decomposition: DataFrame) -> DataFrame:
    """Mean shared fraction by (layer, variant, k)."""
    return decomposition.filter("component_type = 'shared'").groupBy(*KEYS, "k").agg(F.avg("fraction_norm").alias("mean_fraction_shared"))


def component_auc_at_max_k(decomposition: DataFrame) -> DataFrame:
    top = decomposition.groupBy(*KEYS).agg(F.max("k").alias("k"))
    return decomposition.join(top, [*KEYS, "k"]).groupBy(*KEYS, "component_type").agg(F.avg("auc").alias("mean_auc"))


def projection_rank_per_pc(entity_means: DataFrame, overall: DataFrame, basis: DataFrame, n_pcs: int, edge: int = 20) -> DataFrame:
    """Entity centroids scored on each component, ranked both ways; ``is_top`` / ``is_bottom`` mark the ends."""
    b = basis.filter(F.col("component") <= n_pcs).join(overall.select("layer", F.col("mean").alias("_o")), "layer").select(
        *KEYS, F.col("component").alias("pc"), F.col("vec").alias("_b"), "_o"
    )
    s = entity_means.join(b, KEYS).withColumn("projection_score", V.dot(V.sub("mean", "_o"), "_b"))
    w = Window.partitionBy(*KEYS, "pc")
    return s.select(
        *KEYS, "pc", "entity", "canonical_label", "axis", "projection_score",
        F.row_number().over(w.orderBy(F.desc("projection_score"), "entity")).alias("rank_descending"),
        F.row_number().over(w.orderBy(F.asc("projection_score"), F.desc("entity"))).alias("rank_ascending"),
    ).withColumns({"is_top": F.col("rank_descending") <= edge, "is_bottom": F.col("rank_ascending") <= edge})


def loading_pivots(loadings: DataFrame, pcs: list[int]) -> tuple[DataFrame, DataFrame]:
    """Contrast x component loadings, and axis x component mean absolute loadings."""
    by_contrast = loadings.groupBy(*KEYS, "contrast_name").pivot("pc", pcs).agg(F.avg("loading"))
    by_axis = loadings.groupBy(*KEYS, "axis").pivot("pc", pcs).agg(F.avg("abs_loading"))
    return by_contrast, by_axis


# ---- principal components of the vectors --------------------------------------------
#: Columns of the sketch (all of them in narrower vectors, which makes it exact), and passes that sharpen it.
SKETCH, SHARPEN = 256, 4
#: Rows of a sketch that are summed up in one group, and groups that meet before the driver's last step.
STRIPE, FAN = 256, 16


@dataclass(frozen=True)
class LayerScale:
    """What standardises a layer: means, factors (0 for constant columns), row count, sum of squares after scaling."""

    mean: np.ndarray
    factor: np.ndarray
    n: int

    @property
    def power(self) -> float:
        return float(self.n * (self.factor > 0).sum())

    def apply(self, m: np.ndarray) -> np.ndarray:
        return (np.where(np.isfinite(m), m, 0.0) - self.mean) * self.factor


def layer_scales(vectors: DataFrame) -> dict[int, LayerScale]:
    """Of every layer, two vectors of the model's width; entries that are not finite count as 0."""
    clean = F.transform("vec", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))
    column = array_to_vector(clean)
    stats = vectors.groupBy("layer").agg(
        vector_to_array(Summarizer.mean(column)).alias("mean"), vector_to_array(Summarizer.variance(column)).alias("var"), F.count(F.lit(1)).alias("n"))
    out = {}
    for r in stats.collect():
        # The sample variance, of which rounding may leave a rest in constant columns.
        mean, var = np.array(r["mean"]), np.array(r["var"]) * (r["n"] - 1) / max(1, r["n"])
        alive = var > 1e-24 * np.maximum(1.0, mean**2)
        out[int(r["layer"])] = LayerScale(mean, np.where(alive, 1 / np.sqrt(np.where(alive, var, 1.0)), 0.0), int(r["n"]))
    return out


def _per_task(vectors: DataFrame, scales: dict[int, LayerScale], step, finish) -> DataFrame:
    """(layer, part, fan, m): ``step`` folds scaled chunks into a state per layer, ``finish`` cuts it into matrices."""

    def run(batches):
        states: dict[int, np.ndarray] = {}
        for layer, part in layer_chunks(batches):
            states[layer] = step(layer, states.get(layer), scales[layer].apply(matrix(part.column("vec"))))
        fan = TaskContext.get().partitionId() % FAN
        for layer, state in states.items():
            for at, m in finish(state):
                yield pa.RecordBatch.from_arrays([pa.array([layer], pa.int32()), pa.array([at], pa.int32()), pa.array([fan], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["layer", "part", "fan", "m"])

    return vectors.select(F.col("layer").cast("int").alias("layer"), "vec").mapInArrow(run, "layer int, part int, fan int, m binary")


def _met(parts: DataFrame, width: dict[int, int], merge) -> dict[tuple[int, int], np.ndarray]:
    """The matrices of all tasks merged in a tree: by (layer, part, fan) on the executors, then FAN of them here."""

    def meet(table: pa.Table) -> pa.Table:
        layer = table["layer"][0].as_py()
        whole = merge([np.frombuffer(m.as_py()).reshape(-1, width[layer]) for m in table["m"]])
        return pa.table([table["layer"].slice(0, 1), table["part"].slice(0, 1), table["fan"].slice(0, 1), pa.array([np.ascontiguousarray(whole).tobytes()], pa.binary())], ["layer", "part", "fan", "m"])

    out: dict[tuple[int, int], list[np.ndarray]] = {}
    for r in parts.groupBy("layer", "part", "fan").applyInArrow(meet, "layer int, part int, fan int, m binary").orderBy("layer", "part", "fan").collect():
        out.setdefault((r["layer"], r["part"]), []).append(np.frombuffer(r["m"]).reshape(-1, width[r["layer"]]))
    return {k: merge(v) for k, v in out.items()}


def _triangle(parts: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(parts), mode="r")


def range_basis(vectors: DataFrame, scales: dict[int, LayerScale], width: int, passes: int = SHARPEN, seed: int = 0) -> dict[int, np.ndarray]:
    """Of every layer, an orthonormal basis (d x width) near the span of the leading components.

    Randomized range finder: Z'Z is applied to a random matrix, a pass over all layers at a time. Layers
    that are no wider than the sketch have the whole space and need no pass.
    """
    rng = np.random.default_rng(seed)
    basis = {k: np.eye(len(s.mean)) if len(s.mean) <= width else np.linalg.qr(rng.normal(size=(len(s.mean), width)))[0] for k, s in sorted(scales.items())}
    wide = [k for k, q in basis.items() if q.shape[0] > q.shape[1]]
    for _ in range(passes if wide else 0):
        now = {k: basis[k] for k in wide}
        shared = vectors.sparkSession.sparkContext.broadcast(now)

        def step(layer, state, z):
            w = z.T @ (z @ shared.value[layer])
            return w if state is None else state + w

        cut = lambda w: ((at, np.ascontiguousarray(w[at:at + STRIPE])) for at in range(0, len(w), STRIPE))
        sums = _met(_per_task(vectors.filter(F.col("layer").isin(wide)), scales, step, cut), {k: q.shape[1] for k, q in now.items()}, lambda parts: np.sum(parts, axis=0))
        for k in wide:
            basis[k] = np.linalg.qr(np.vstack([sums[key] for key in sorted(sums) if key[0] == k]))[0]
        shared.destroy()
    return basis


def pca(vectors: DataFrame, k: int, sketch: int = SKETCH, passes: int = SHARPEN) -> tuple[DataFrame, DataFrame]:
    """Scaled PCA of every layer: (row scores ``pcs`` beside all columns but ``vec``, explained ratios).

    All layers go through the same passes, for vectors of any width: the driver and a task hold matrices of
    width x sketch only. Rows are projected on the range of the leading components; the
    projections' triangular factor is made by a tree of tall and skinny QR steps, batch by batch, task by
    task, and its singular values and vectors give the components. Where a layer is no
    wider than the sketch this is exact. Constant columns count as 0, as do entries that
    are not finite. The largest loading of a component is made positive. A layer without variance gives
    zeros.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = vectors.sparkSession
    scales = layer_scales(vectors)
    basis = range_basis(vectors, scales, max(sketch, k), passes)
    shared = spark.sparkContext.broadcast(basis)

    def step(layer, state, z):
        y = z @ shared.value[layer]
        return _triangle([y] if state is None else [state, y])

    triangles = _met(_per_task(vectors, scales, step, lambda r: [(0, np.ascontiguousarray(r))]), {x: q.shape[1] for x, q in basis.items()}, _triangle)
    shared.destroy()
    loads, ratios = {}, []
    for (layer, _), r in sorted(triangles.items()):
        _, s, vt = np.linalg.svd(r, full_matrices=False)
        keep, power = min(k, len(s)), scales[layer].power
        load = basis[layer] @ vt[:keep].T
        sign = np.sign(load[np.abs(load).argmax(axis=0), np.arange(keep)])
        loads[layer] = load * np.where(sign == 0, 1.0, sign) * (power > 0)
        ratios += [(layer, i + 1, float(s[i] ** 2 / power) if power > 0 else 0.0) for i in range(keep)]
    found = spark.sparkContext.broadcast(loads)
    kept = [c for c in vectors.columns if c != "vec"]

    def project(batches):
        for layer, part in layer_chunks(batches):
            p = scales[layer].apply(matrix(part.column("vec"))) @ found.value[layer]
            pcs = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pcs], [*kept, "pcs"])

    scores = vectors.mapInArrow(project, vectors.select(*kept, F.array(F.lit(0.0)).alias("pcs")).schema)
    return scores, spark.createDataFrame(ratios, "layer int, component int, explained_variance_ratio double")


def pca_group_centroids(scores: DataFrame, group: list[str]) -> DataFrame:
    long = scores.select("layer", *group, F.posexplode("pcs").alias("_i", "_v"))
    return long.groupBy("layer", *group, (F.col("_i") + 1).alias("component")).agg(F.avg("_v").alias("mean_score"), F.count(F.lit(1)).alias("n"))


# ---- vector-table edits and rankings ---------------------------------------------------
def vector_edit(vectors: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply edits (layer, row_id, edit_vec, alpha, mode) to the listed rows.

    ``add_vector`` adds alpha * v; ``ablate_projection`` removes alpha * (x . u) u for the
    unit vector u of v.
    """
    j = vectors.join(edits, ["layer", "row_id"], "left")
    unit = V.scale("edit_vec", F.lit(1.0) / F.greatest(V.norm("edit_vec"), F.lit(1e-9)))
    j = j.withColumn("_u", unit)
    ablated = V.sub("vec", V.scale("_u", F.col("alpha") * V.dot("vec", "_u")))
    added = V.add("vec", V.scale("edit_vec", F.col("alpha")))
    out = F.when(F.col("edit_vec").isNull(), F.col("vec")).when(F.col("mode") == "ablate_projection", ablated).otherwise(added)
    return j.withColumn("vec", out).drop("_u", "edit_vec", "alpha", "mode")


class Extremes:
    """The n largest and n smallest products of each query of a block with the rows met so far.

    A state of queries x 2n entries that merges with any other of the same queries.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, n: int):
        self.ids, self.q, self.n, self.met = ids, q, n, 0
        self.norm = np.linalg.norm(q, axis=1)
        # Both sides as largest values: of the product, and of its negative.
        self.best = np.full((2, len(ids), n), -np.inf)
        self.rows = np.zeros((2, len(ids), n), np.int64)

    def meet(self, m: np.ndarray, rows: np.ndarray, norm: np.ndarray) -> None:
        """``norm`` falls along the rows, so |q| |x| of a stretch's first row bounds the products from there on."""
        step = max(1, PRODUCT_BYTES // (8 * len(self.ids)))
        for at in range(0, len(m), step):
            bound = self.norm * norm[at] * (1 + 1e-9)
            live = np.flatnonzero(bound >= self.best[:, :, -1].min(axis=0))
            if len(live) == 0:
                return
            here = slice(at, at + step)
            score = self.q[live] @ m[here].T
            self.met += score.size
            for side, sign in enumerate((1.0, -1.0)):
                least = self.best[side, live, -1]
                for i in np.flatnonzero((sign * score >= least[:, None]).any(axis=1)):
                    own = np.flatnonzero(sign * score[i] >= least[i])
                    values = np.concatenate([self.best[side, live[i]], sign * score[i, own]])
                    ids = np.concatenate([self.rows[side, live[i]], rows[here][own]])
                    first = np.lexsort((ids, -values))[: self.n]
                    self.best[side, live[i]], self.rows[side, live[i]] = values[first], ids[first]

    def result(self, layer: int) -> pa.RecordBatch:
        side, query, place = np.nonzero(np.isfinite(self.best))
        sign = np.where(side == 0, 1.0, -1.0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(side), layer, np.int32)), pa.array(self.ids[query]), pa.array(self.rows[side, query, place]),
                pa.array(sign * self.best[side, query, place]), pa.array(np.array(["top", "bottom"])[side]),
            ],
            ["layer", "query_id", "row_id", "score", "side"],
        )


def inner_product_extremes(queries: DataFrame, rows: DataFrame, n: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each query (layer, query_id, q): the n rows with the largest and smallest dot products, ranked; ties by row_id.

    Exact maximum inner product search. Queries lie in blocks in the shared folder; a task takes
    its rows by falling norm, multiplies them with a block at a time and keeps the n best of either
    side so far. By Cauchy-Schwarz a query is left out as soon as no later row of a chunk can
    reach its n-th best. Only 2n rows a query and task are shuffled.
    """
    store = matrix_blocks(queries.select("layer", F.col("query_id").alias("id"), F.col("q").alias("w")), "queries", block_bytes)

    def run(batches):
        states: dict[tuple[int, int], Extremes] = {}
        for layer, part in layer_chunks(batches):
            m, ids = matrix(part.column("vec")), part.column("row_id").to_numpy()
            norm = np.linalg.norm(m, axis=1)
            order = np.argsort(-norm, kind="stable")
            m, ids, norm = m[order], ids[order], norm[order]
            for block, (own, q, _) in enumerate(store.blocks(layer)):
                if (layer, block) not in states:
                    states[layer, block] = Extremes(own.copy(), q.copy(), n)
                states[layer, block].meet(m, ids, norm)
        for (layer, _), state in states.items():
            yield state.result(layer)

    found = rows.select(F.col("layer").cast("int").alias("layer"), F.col("row_id").cast("bigint").alias("row_id"), "vec").filter("vec IS NOT NULL")
    found = found.mapInArrow(run, "layer int, query_id bigint, row_id bigint, score double, side string")
    key = F.when(F.col("side") == "top", -F.col("score")).otherwise(F.col("score"))
    w = Window.partitionBy("layer", "query_id", "side").orderBy(key, "row_id")
    ids = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    kind = queries.schema["query_id"].dataType
    return ids.select("layer", F.col("query_id").cast(kind).alias("query_id"), "row_id", "score", "rank", "side")
