"""Hard negatives by threshold joins whose thresholds are lowered until every window is filled.

Vectors are scaled to whole numbers (``floor(256 x)``), and a score is the inner product. First every anchor
looks for its best rows of the same label, the positives; then each (anchor, positive) looks for the
best rows of other labels whose score lies between a share of the positive's and the positive's own.

Both are joins "all rows with a score of at least t", done for falling t. An anchor whose windows are filled
by rows found so far is finished, as no row below its threshold can precede them; the others go on with
a lower one. The last round of positives has t = 0 (a positive below 0 admits no negative), that of
negatives the lower end of the window, so results are whole whatever the vectors.

In a join, rows and anchors come in blocks, dealt by (cell of rows, group of anchors), both of bounded size:
a stated query set against all rows.
Inside a pair of blocks the search follows L2AP: with p_j(x) the norm of the components before j, a row's
components before the first j with p_j(x) |q| >= t are left out of the inverted index, since they cannot
reach t by themselves; rows that are left out wholly are never met. Scores are summed up from the last
component on, several components at a time for all rows and anchors of the blocks; in between, a pair goes
as soon as its sum plus p_j(q) p_j(x) stays below t. Survivors get the left-out components added, so their
scores are exact. Each pair of blocks returns at most a window's length of rows for each window.

Rows with a null label, a null vector or a null or non-finite component take no part. Shorter vectors count
as filled up with zeros; an empty vector scores 0. Repeated rows are rows of their own (so are repeated
anchors, which then return repeated rows). A null vec_id is no anchor, and last among equal scores.
Scores beyond the long range are cut to its ends. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlens.llm.common import stage

#: Rows and anchors of a block, and of a task: every cell of rows meets every group of anchors.
BLOCK_ROWS, BLOCK_ANCHORS, CELL_ROWS, GROUP_ANCHORS = 2048, 256, 1 << 15, 1 << 16
#: Components summed up between two looks at the bounds.
STEP = 8
#: Thresholds for positives as shares of |anchor| times the largest norm, and for negatives of the positive's score.
POSITIVE_SHARES, NEGATIVE_SHARES = (0.7, 0.45, 0.3, 0.15, 0.0), (0.95, 0.0)
LARGEST = (1 << 63) - 1


def scaled(rows: DataFrame, factor: int = 256) -> DataFrame:
    """rid, vec_id, label, vec (array of whole doubles), norm of the rows that take part."""
    ok = rows["label"].isNotNull() & rows["embedding"].isNotNull() & F.forall(rows["embedding"], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(rows["embedding"], lambda x: F.floor(x.cast("double") * factor).cast("double"))
    return rows.where(F.coalesce(ok, F.lit(False))).select(
        F.monotonically_increasing_id().alias("rid"), rows["vec_id"].cast("long").alias("vec_id"), rows["label"].cast("long").alias("label"), whole.alias("vec"),
    ).withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    off = column.offsets.to_numpy().astype(np.int64)
    size, flat = np.diff(off), column.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]]
    out = np.zeros((len(column), int(size.max()) if len(column) else 0))
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def _packed(m: np.ndarray) -> tuple[bytes, str]:
    """The matrix in the narrowest of three number types."""
    top = np.abs(m).max() if m.size else 0
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return m.astype(kind).tobytes(), kind


def _blocks(rows: DataFrame, size: int, more: list[str]) -> DataFrame:
    """One row a block: n, kind, vecs, and ``more`` as arrays; rows come in the order they have."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        serial = 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                vecs, kind = _packed(_matrix(part.column(part.schema.get_field_index("vec"))))
                lists = [pa.array([part.column(part.schema.get_field_index(c)).to_pylist()], pa.list_(part.schema.field(c).type)) for c in more]
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() << 32 | serial]), pa.array([part.num_rows]), pa.array([kind]), pa.array([vecs], pa.binary()), *lists], ["block", "n", "kind", "vecs", *more])
                serial += 1

    return rows.select("vec", *more).mapInArrow(run, "block long, n long, kind string, vecs binary, " + ", ".join(f"{c} array<{fields[c]}>" for c in more))


class Side:
    """A block's vectors with the norms of their beginnings."""

    def __init__(self, n: int, kind: str, vecs: bytes, width: int):
        m = np.frombuffer(vecs, kind).reshape(n, -1).astype(np.float64)
        self.m = np.zeros((n, width))
        self.m[:, : m.shape[1]] = m
        # The largest component of the block keeps squares within range; norms are only bounds.
        top = max(1.0, float(np.abs(self.m).max(initial=0)))
        before = np.zeros((n, width + 1))
        np.cumsum((self.m / top) ** 2, axis=1, out=before[:, 1:])
        self.before = np.sqrt(before) * top


def pairs_above(q: Side, x: Side, t: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs with a score of at least the anchor's ``t``, of those that ``wanted`` holds."""
    width, slack = q.m.shape[1], 1 + 1e-9
    # A row's components before ``first`` cannot reach any anchor's threshold by themselves.
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(t > 0, t / np.maximum(q.before[:, -1], 1e-300), 0).min(initial=np.inf)
    first = (x.before[:, 1:] * slack < least).sum(axis=1)
    # Posting lists: by the place where rows begin, so that the list of a component is a stretch of rows.
    order = np.argsort(first, kind="stable")
    order = order[first[order] < width] if least > 0 else order
    starts, rows = first[order], x.m[order]
    a, r = np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros((len(q.m), len(order)))
    indexed = np.where(np.arange(width) >= starts[:, None], rows, 0)
    # Sums and norms are rounded; a bound is taken a little too high rather than too low.
    limit = t[:, None] - 1e-9 * np.abs(t[:, None]) - 1e-10 * q.before[:, -1:] * x.before[:, -1].max(initial=0) - 1e-6
    open_ = np.ones(total.shape, bool) if wanted is None else wanted[:, order]
    for high in range(width, 0, -STEP):
        low = max(0, high - STEP)
        # Only rows that begin before ``high`` are in these lists.
        upto = int(np.searchsorted(starts, high, "left"))
        live = np.flatnonzero(open_[:, :upto].any(axis=0))
        if len(live) == 0:
            break
        if len(live) < upto // 2:
            total[:, live] += q.m[:, low:high] @ indexed[live, low:high].T
        else:
            total[:, :upto] += q.m[:, low:high] @ indexed[:upto, low:high].T
        # What is left of a row: the components before ``low``, or before its begin inside these lists.
        through = int(np.searchsorted(starts, low, "right"))
        open_[:, :through] &= total[:, :through] + q.before[:, low, None] * x.before[order[:through], low] * slack >= limit
        if upto > through:
            begin = starts[through:upto]
            open_[:, through:upto] &= total[:, through:upto] + q.before[:, begin] * x.before[order[through:upto], begin] * slack >= limit
    a, r = np.nonzero(open_)
    if len(a) == 0:
        return a, r, np.zeros(0, np.int64)
    r = order[r]
    score = _exact(q.m, x.m, a, r)
    keep = score >= t[a]
    return a[keep], r[keep], score[keep]


def _exact(q: np.ndarray, x: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers without rounding."""
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), 1 << 16):
        left, right = q[a[at:at + (1 << 16)]], x[r[at:at + (1 << 16)]]
        if reach < 1 << 53:
            out[at:at + (1 << 16)] = np.einsum("ij,ij->i", left, right).astype(np.int64)
        else:
            out[at:at + (1 << 16)] = [max(-LARGEST - 1, min(LARGEST, sum(int(u) * int(v) for u, v in zip(b, c)))) for b, c in zip(left, right)]
    return out


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows of each group by falling score, then rising id."""
    order = np.lexsort((ids, -score, group))
    first = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[rank < k]


def _join(rows: DataFrame, anchors: DataFrame, key: Column, more: list[str], cells: int, find, schema: str) -> DataFrame:
    """``find(rows block with anchors block)`` for all blocks.

    Anchors with like thresholds (``key``) stand in the same blocks: one index serves all of a block.
    """
    n = anchors.count()
    groups = max(1, -(-n // GROUP_ANCHORS))
    dealt = anchors.withColumn("__key", key).repartitionByRange(max(1, -(-n // BLOCK_ANCHORS)), "__key", "rid").sortWithinPartitions("__key", "rid")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = _blocks(dealt, BLOCK_ANCHORS, more).withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("cell", spread(cells))
    # Blocks are far larger than Spark takes them for, and anchors go to every cell: never by way of the driver.
    both = rows.withColumn("group", spread(groups)).alias("x").join(sent.hint("merge").alias("q"), ["cell", "group"])
    both = both.select(*[F.col(f"x.{c}").alias(f"x_{c}") for c in ("n", "kind", "vecs", "rid", "vec_id", "label")], *[F.col(f"q.{c}").alias(f"q_{c}") for c in ("n", "kind", "vecs", *more)])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
                found = find(row)
                if found is not None and found.num_rows:
                    yield found

    return both.mapInArrow(run, schema)


def _sides(row: dict) -> tuple[Side, Side]:
    width = max(len(row[f"{s}_vecs"]) // np.dtype(row[f"{s}_kind"]).itemsize // row[f"{s}_n"] for s in "qx")
    return tuple(Side(row[f"{s}_n"], row[f"{s}_kind"], row[f"{s}_vecs"], width) for s in "qx")


def _ids(values: list) -> np.ndarray:
    # A null id comes last among equal scores.
    return np.array([LARGEST if v is None else v for v in values], np.int64)


def _positives(k: int):
    def find(row):
        q, x = _sides(row)
        labels = np.array(row["q_label"], np.int64)[:, None] == np.array(row["x_label"], np.int64)
        rid, own, ids = np.array(row["x_rid"], np.int64), np.array(row["q_rid"], np.int64), _ids(row["x_vec_id"])
        a, r, score = pairs_above(q, x, np.array(row["q_t"], np.float64), labels & (own[:, None] != rid))
        take = best(a, score, ids[r], k)
        a, r = a[take], r[take]
        return pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(rid[r]), pa.array([row["x_vec_id"][i] for i in r], pa.int64()), pa.array(score[take])], ["anchor_rid", "rid", "id", "score"])

    return find


def _negatives(k: int, floor: int):
    """Of each window, the first k rows with floor * p <= 100 * score <= 100 * p; anchors come once a window list."""

    def find(row):
        q, x = _sides(row)
        other = np.array(row["q_label"], np.int64)[:, None] != np.array(row["x_label"], np.int64)
        a, r, score = pairs_above(q, x, np.array(row["q_t"], np.float64), other)
        ids, own = _ids(row["x_vec_id"]), row["q_rid"]
        out = [[], [], [], []]
        begin = np.searchsorted(a, np.arange(len(own) + 1))
        for i in np.unique(a):
            here = slice(begin[i], begin[i + 1])
            s, rows = score[here], r[here]
            order = np.lexsort((ids[rows], -s))
            s, rows = s[order], rows[order]
            for p in row["q_windows"][i]:
                # Scores fall along the order: a window is a stretch of it.
                lo = int(np.searchsorted(-s, -p, "left"))
                least = -(-floor * p // 100)
                hi = min(lo + k, int(np.searchsorted(-s, -least, "right")))
                for j in range(lo, hi):
                    for column, value in zip(out, (own[i], p, row["x_vec_id"][rows[j]], int(s[j]))):
                        column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["anchor_rid", "window", "id", "score"])

    return find


def _first(rows: DataFrame, group: list[str], k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor, k_positives: int = 5, k_negatives: int = 5, floor: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, embedding, label; ``is_anchor``: a condition on the column vec_id.
    """
    base = stage(scaled(rows), "negatives-rows")
    size = base.agg(F.count(F.lit(1)), F.max("norm")).first()
    n, largest = int(size[0]), float(size[1] or 0)
    cells = max(1, -(-n // CELL_ROWS), min(-(-n // BLOCK_ROWS), int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    blocks = _blocks(base, BLOCK_ROWS, ["rid", "vec_id", "label"])
    blocks = stage(blocks.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int")), "negatives-blocks")
    # Anchors keep what a block of them needs; a null id is none.
    anchors = stage(base.where(F.coalesce(is_anchor, F.lit(False))).select("rid", "vec_id", "label", "vec", "norm"), "negatives-anchors")

    # ---- positives
    left, chosen = anchors, None
    for share in POSITIVE_SHARES:
        t = left.withColumn("t", F.col("norm") * (share * largest))
        found = _join(blocks, t, F.col("label"), ["rid", "label", "t"], cells, _positives(k_positives), "anchor_rid long, rid long, id long, score long")
        found = _first(found, ["anchor_rid"], k_positives)
        filled = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("anchor_rid")))
        filled = stage(filled.where(F.col("n") == k_positives) if share else filled, "negatives-positives")
        chosen = filled if chosen is None else chosen.unionByName(filled)
        if share:
            left = stage(left.join(filled.select(F.col("anchor_rid").alias("rid")).distinct(), "rid", "left_anti"), "negatives-left")
            if left.isEmpty():
                break
    pairs = chosen.where("score >= 0").join(anchors.select(F.col("rid").alias("anchor_rid"), F.col("vec_id").alias("anchor_id")), "anchor_rid")
    pairs = stage(pairs.select("anchor_rid", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("window")), "negatives-pairs")

    # ---- negatives: a window is (anchor, positive score); positives with the same score share it
    windows, done = pairs.select("anchor_rid", "window").distinct(), None
    for share in NEGATIVE_SHARES:
        lists = windows.groupBy(F.col("anchor_rid").alias("rid")).agg(F.collect_set("window").alias("windows"))
        t = anchors.hint("merge").join(lists, "rid").withColumn("t", F.greatest(F.array_min("windows") * ((share or floor / 100) * (1 - 1e-12)) - 1, F.lit(0.0)))
        low = round(share * 100) or floor
        found = _join(blocks, t, F.col("t") / F.greatest("norm", F.lit(1.0)), ["rid", "label", "t", "windows"], cells, _negatives(k_negatives, low), "anchor_rid long, window long, id long, score long")
        found = _first(found, ["anchor_rid", "window"], k_negatives)
        filled = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("anchor_rid", "window")))
        filled = stage(filled.where(F.col("n") == k_negatives) if share else filled, "negatives-found")
        done = filled if done is None else done.unionByName(filled)
        if share:
            windows = stage(windows.join(filled.select("anchor_rid", "window").distinct(), ["anchor_rid", "window"], "left_anti"), "negatives-windows")
            if windows.isEmpty():
                break
    return pairs.join(done, ["anchor_rid", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("window").alias("positive_score"), F.col("score").alias("negative_score"))


def relabelled(rows: DataFrame) -> DataFrame:
    """vec_id, embedding and label, with (label + 1) % 10 where 7 divides the id."""
    label = rows["label"].cast("long")
    return rows.select("vec_id", "embedding", F.when(rows["vec_id"] % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))


#: The same rows by DuckDB, for vectors of one length.
SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.rid, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT rid, anchor_id, id, score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, id) AS r FROM scores WHERE same QUALIFY r <= 5
), negatives AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.rid, p.r ORDER BY s.score DESC, s.id) AS rank
  FROM positives p JOIN scores s ON s.rid = p.rid AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""
