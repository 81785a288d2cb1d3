"""Grouped linear probes: balanced multinomial logistic regression under group folds.

All models, one per (layer, task, fold), are fitted together: a pass over the rows gives loss and gradient of
every model at its own trial point, and the driver, which holds the models only, takes one quasi-Newton
step of each. So the number of passes is that of the slowest single fit, whatever the number of models.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlens.functions.blocks import layer_chunks, matrix
from facetlens.functions.joins import spread_join
from facetlens.functions.settle import settle
from facetlens.operators.effects import macro_f1
from facetlens.operators.sampling import group_kfold
from facetlens.operators.subspace import layer_scales, pca


def probe_features(vectors: DataFrame, dims: int) -> DataFrame:
    """Standardised vectors of every layer reduced to ``dims`` principal components.

    Layers with entries that are not finite, or without variance, are left out.
    """
    odd = vectors.filter(F.exists("vec", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).select("layer").distinct().collect()
    flat = [layer for layer, s in layer_scales(vectors).items() if s.power == 0]
    usable = vectors.filter(~F.col("layer").isin([*flat, *(r["layer"] for r in odd)]))
    return settle(pca(usable, dims)[0], "probe-features")


@dataclass(frozen=True)
class Task:
    """Predict ``label``, with whole groups held out; ``where``: a condition on the rows that take part."""

    name: str
    label: str
    group: str
    where: str = "true"


def _rows(features: DataFrame, tasks: list[Task], folds: int) -> tuple[DataFrame, list[list[str]]]:
    """(layer, row_id, x, ys, folds) with one entry a task, -1 for none, and the classes of each task."""
    rows, classes = features, []
    for i, t in enumerate(tasks):
        own = features.filter(t.where).filter(F.col(t.label).isNotNull() & F.col(t.group).isNotNull())
        # Labels and groups are model-side lists: classes, templates, entities.
        classes.append(sorted(str(r[0]) for r in own.select(t.label).distinct().collect()))
        deal = group_kfold(own, t.group, folds).select(F.col(t.group).alias(f"_g{i}"), F.col("fold").alias(f"_f{i}"))
        rows = spread_join(rows.withColumn(f"_g{i}", F.when(F.expr(t.where), F.col(t.group))), deal, [f"_g{i}"], spread_by=["row_id"], how="left")
        names = F.array(*[F.lit(c) for c in classes[i]]) if classes[i] else F.array().cast("array<string>")
        rows = rows.withColumn(f"_y{i}", F.when(F.col(f"_f{i}").isNotNull(), F.coalesce(F.array_position(names, F.col(t.label).cast("string")), F.lit(0)) - 1).otherwise(-1))
    every = range(len(tasks))
    out = rows.select(
        F.col("layer").cast("int").alias("layer"), F.col("row_id").cast("bigint").alias("row_id"), F.col("pcs").alias("x"), F.array(*[F.col(f"_y{i}").cast("int") for i in every]).alias("ys"),
        F.array(*[F.coalesce(F.col(f"_f{i}"), F.lit(-1)).cast("int") for i in every]).alias("folds"),
    )
    return settle(out, "probe-rows"), classes


@dataclass
class Model:
    """One (layer, task, fold): class weights, the point, and what a limited-memory quasi-Newton step remembers."""

    weights: np.ndarray  # of each class; 0 for classes that the training rows lack
    point: np.ndarray
    total: float
    value: float = np.inf
    slope: np.ndarray | None = None
    way: np.ndarray | None = None
    length: float = 1.0
    past: deque = field(default_factory=lambda: deque(maxlen=10))
    done: bool = False

    @property
    def trial(self) -> np.ndarray:
        return self.point if self.way is None else self.point + self.length * self.way

    def _direction(self) -> np.ndarray:
        q, a = self.slope.copy(), []
        for s, y in reversed(self.past):
            a.append((s @ q) / (s @ y))
            q -= a[-1] * y
        if self.past:
            s, y = self.past[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.abs(q).sum())
        for (s, y), alpha in zip(self.past, reversed(a)):
            q += (alpha - (y @ q) / (s @ y)) * s
        return -q

    def take(self, value: float, slope: np.ndarray, tolerance: float) -> None:
        """Loss and gradient at the trial point: accept it, or go back half the way."""
        at = self.trial
        if self.way is not None and value > self.value + 1e-4 * self.length * (self.slope @ self.way):
            self.length /= 2
            self.done = self.length < 1e-10
            return
        if self.way is not None:
            s, y = at - self.point, slope - self.slope
            if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
                self.past.append((s, y))
        self.point, self.value, self.slope, self.length = at, value, slope, 1.0
        self.done = bool(np.abs(slope).max() <= tolerance * self.total)
        self.way = self._direction()


def _softmax(x: np.ndarray, w: np.ndarray, weights: np.ndarray) -> np.ndarray:
    scores = x @ w.T
    scores[:, weights == 0] = -np.inf
    scores -= scores.max(axis=1, keepdims=True)
    e = np.exp(scores)
    return e / e.sum(axis=1, keepdims=True)


def _with_one(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = matrix(part.column("x"))
    lists = lambda c: part.column(c).flatten().to_numpy().reshape(len(x), -1)
    return np.hstack([x, np.ones((len(x), 1))]), lists("ys"), lists("folds")


def _evaluate(rows: DataFrame, models: dict[tuple[int, int, int], Model]) -> dict[tuple[int, int, int], tuple[float, np.ndarray]]:
    """Weighted cross entropy and its gradient of every model at its trial point, from one pass."""
    asked = rows.sparkSession.sparkContext.broadcast({k: (m.trial.reshape(len(m.weights), -1), m.weights) for k, m in models.items() if not m.done})

    def run(batches):
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for layer, part in layer_chunks(batches, 4 << 20):
            x, ys, folds = _with_one(part)
            for key, (w, weights) in asked.value.items():
                if key[0] != layer:
                    continue
                train = np.flatnonzero((ys[:, key[1]] >= 0) & (folds[:, key[1]] != key[2]))
                y, own = ys[train, key[1]], x[train]
                p, c = _softmax(own, w, weights), weights[y]
                loss = -(c * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()
                p[np.arange(len(y)), y] -= 1
                found = np.concatenate([[loss], ((p * c[:, None]).T @ own).ravel()])
                sums[key] = sums[key] + found if key in sums else found
        for key, s in sums.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in key], pa.array([s.tobytes()], pa.binary())], ["layer", "task", "fold", "m"])

    def add(table: pa.Table) -> pa.Table:
        whole = np.sum([np.frombuffer(m.as_py()) for m in table["m"]], axis=0)
        return pa.table([table[c].slice(0, 1) for c in ("layer", "task", "fold")] + [pa.array([whole.tobytes()], pa.binary())], ["layer", "task", "fold", "m"])

    schema = "layer int, task int, fold int, m binary"
    found = rows.mapInArrow(run, schema).groupBy("layer", "task", "fold").applyInArrow(add, schema).collect()
    asked.destroy()
    out = {}
    for r in found:
        s = np.frombuffer(r["m"])
        out[r["layer"], r["task"], r["fold"]] = float(s[0]), s[1:]
    return out


def _models(rows: DataFrame, classes: list[list[str]]) -> dict[tuple[int, int, int], Model]:
    """A model for every fold whose train and test rows have two classes and whose train rows vary."""
    long = rows.select("layer", "x", F.posexplode(F.arrays_zip("ys", "folds")).alias("task", "z")).filter("z.ys >= 0")
    long = long.select("layer", "task", F.col("z.folds").alias("fold"), F.col("z.ys").alias("y"), array_to_vector("x").alias("x"))
    stats = long.groupBy("layer", "task", "fold", "y").agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.min(F.col("x"))).alias("low"), vector_to_array(Summarizer.max(F.col("x"))).alias("high")).collect()
    by: dict[tuple[int, int], list] = {}
    for r in stats:
        by.setdefault((r["layer"], r["task"]), []).append(r)
    out = {}
    for (layer, task), all_rows in sorted(by.items()):
        for fold in sorted({r["fold"] for r in all_rows}):
            train, test = [r for r in all_rows if r["fold"] != fold], [r for r in all_rows if r["fold"] == fold]
            n = np.zeros(len(classes[task]))
            for r in train:
                n[r["y"]] += r["n"]
            if (n > 0).sum() < 2 or len({r["y"] for r in test}) < 2:
                continue
            if (np.min([r["low"] for r in train], axis=0) == np.max([r["high"] for r in train], axis=0)).all():
                continue
            weights = np.where(n > 0, n.sum() / ((n > 0).sum() * np.maximum(n, 1)), 0)
            out[layer, task, fold] = Model(weights, np.zeros(len(n) * (len(train[0]["low"]) + 1)), float(n.sum()))
    return out


def cross_validated_predictions(features: DataFrame, tasks: list[Task], folds: int, max_passes: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """(layer, task, row_id, fold, label, prediction) from a balanced probe for each layer, task and fold.

    No group is in both train and test. Folds whose train or test part has fewer than two
    classes, or whose train rows do not vary, are skipped. The penalty is the usual one with C = 1, on all
    but the intercepts.
    """
    rows, classes = _rows(features, tasks, folds)
    models = _models(rows, classes)
    for _ in range(max_passes):
        if all(m.done for m in models.values()):
            break
        for key, (loss, slope) in _evaluate(rows, models).items():
            m = models[key]
            w = m.trial.reshape(len(m.weights), -1).copy()
            w[:, -1] = 0
            m.take(loss + 0.5 * float((w * w).sum()), slope + w.ravel(), tolerance)
    fitted = {k: (m.point.reshape(len(m.weights), -1), m.weights) for k, m in models.items()}
    shared = rows.sparkSession.sparkContext.broadcast(fitted)

    def predict(batches):
        for layer, part in layer_chunks(batches):
            x, ys, held = _with_one(part)
            for (own, task, fold), (w, weights) in shared.value.items():
                at = np.flatnonzero((ys[:, task] >= 0) & (held[:, task] == fold))
                if own == layer and len(at):
                    n = len(at)
                    numbers = [np.full(n, v, np.int32) for v in (layer, task, fold)]
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(v) for v in numbers], part.column("row_id").take(pa.array(at)), pa.array(ys[at, task].astype(np.float64)), pa.array(_softmax(x[at], w, weights).argmax(axis=1).astype(np.float64))],
                        ["layer", "task", "fold", "row_id", "label", "prediction"],
                    )

    found = rows.mapInArrow(predict, "layer int, task int, fold int, row_id bigint, label double, prediction double")
    names = F.array(*[F.lit(t.name) for t in tasks])
    return found.withColumn("task", F.get(names, F.col("task")))


def grouped_probe(features: DataFrame, tasks: list[Task], folds: int) -> DataFrame:
    """Per layer and task: classes, samples, and mean and sd over folds of accuracy and macro F1."""
    per = macro_f1(cross_validated_predictions(features, tasks, folds), ["layer", "task", "fold"])
    scores = per.groupBy("layer", "task").agg(
        F.avg("accuracy").alias("accuracy_mean"), F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)).alias("accuracy_sd"),
        F.avg("macro_f1").alias("macro_f1_mean"), F.coalesce(F.stddev_samp("macro_f1"), F.lit(0.0)).alias("macro_f1_sd"),
        F.count(F.lit(1)).alias("n_folds"),
    )
    sizes = [
        features.filter(t.where).filter(F.col(t.label).isNotNull() & F.col(t.group).isNotNull()).groupBy(F.col("layer").cast("int").alias("layer"))
        .agg(F.countDistinct(t.label).alias("n_classes"), F.count(F.lit(1)).alias("n_samples")).withColumn("task", F.lit(t.name))
        for t in tasks
    ]
    return reduce(DataFrame.unionByName, sizes).join(scores, ["layer", "task"]).withColumnRenamed("task", "split_type")


def probe_score_summary(probes: DataFrame, keys: list[str]) -> DataFrame:
    return probes.groupBy(*keys).agg(F.avg("macro_f1_mean").alias("macro_f1"), F.count(F.lit(1)).alias("n"))
