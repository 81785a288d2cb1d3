"""A Merkle manifest of a table, and its audit by a recursive query that climbs from every leaf.

A row's leaf digest covers its fields; leaves are numbered by id inside their group (a language), every
two neighbours become a node, and the roots of all groups, ordered by group, form one more tree. Digests
are lowercase hex SHA-256 texts, inputs are concatenated, the last run of a level may hold one node.

Built levels are stored as node rows linked to a parent: a node's row holds its siblings up to the next
stored level and the key of the node there. Levels are stored every ``stride`` levels (1: each of them),
so one grouped job builds ``stride`` levels out of at most 2^stride nodes and one step of the recursive
query climbs as many. The query starts from the row of every leaf with the digest to be checked, appends
the siblings, folds the digest with them, and goes on with the parent's row up to the root. Rows hold
digests as 32 bytes; they are hashed as hex texts.

A node high in a tree is met by all leaves below it. Its row is repeated once per ``SALT_ROWS`` leaves
below (counts that the build measured), and leaves choose a copy by their number.

Leaves with the same id are ordered by digest, so repeated rows get neighbouring places; a null id comes
before all others, a null group is a group of its own and the first one. A lone leaf is its group's
root. Without any sibling the proof is the digest of the empty text. An empty table gives no rows.
Null fields count as ``-``; texts are digested whole. Extra columns are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlens.llm.common import small_batches, stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels climbed at a time; a group of 2^STRIDE digests is held at once.
STRIDE = 10
#: Leaves that one copy of a node row is meant for.
SALT_ROWS = 4096
#: The tree of all groups' roots.
TOP = -1


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``place`` (part and position), and per (group, part): ``first`` place, rows ``before`` it, ``n`` of the group.

    A row's number in its group is place - first + before. Rows are dealt by ranges of group, order
    and a running number, so neither a large group nor repeated rows meet in one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order, "__tie")]
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = stage(dealt.drop("__tie").withColumn("place", F.monotonically_increasing_id()), name)
    totals = placed.groupBy(*group, F.shiftright("place", 33).alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    whole = Window.partitionBy(*group)
    before = F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return placed, totals.withColumns({"before": F.coalesce(before, F.lit(0)), "n": F.sum("rows").over(whole)})


@dataclass
class Manifest:
    """leaves: the lowest node rows, with id, leaf, claimed, spot (number in the group), home and copy (key of the
    group's root); nodes: the rows above; subroots: the groups' roots; root; height: levels above the groups' roots."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None
    height: int


def _copies(below: Column) -> Column:
    return F.ceil(below / SALT_ROWS)


def _height(n: Column) -> Column:
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _blocks(nodes: DataFrame, level: int, stride: int, carried: list[str]) -> DataFrame:
    """tree, block, height, below, items, levels: digests of each level from ``level`` on, of blocks of 2^stride nodes, and ``carried`` of each node."""
    own = ", ".join(f"x.{c}" for c in ["digest", *carried])
    blocks = nodes.groupBy("tree", F.shiftright("idx", stride).alias("block")).agg(
        F.expr(f"transform(sort_array(collect_list(struct({', '.join(['idx', 'digest', *carried])}))), x -> struct({own}))").alias("items"),
        F.max("height").alias("height"), F.sum("below").alias("below"),
    )
    steps = f"least({stride}, height - {level})"
    up = "transform(sequence(0, (size(element_at(a, -1)) - 1) div 2), i -> sha2(concat(element_at(a, -1)[2 * i], coalesce(get(element_at(a, -1), 2 * i + 1), '')), 256))"
    levels = F.expr(f"aggregate(sequence(1, {steps}), array(items.digest), (a, j) -> concat(a, array({up})))")
    return blocks.withColumn("levels", levels).withColumns({"grown": F.size("levels") - 1, "goal": F.element_at(F.element_at("levels", -1), 1)})


def _linked(blocks: DataFrame, level: int, stride: int, top: bool, carried: list[str]) -> DataFrame:
    """Node rows of the lowest level of ``blocks``: key, ``carried``, siblings up to the next stored level, key of the parent."""
    into_top = (F.col("grown") + level == F.col("height")) & F.lit(not top)
    own = "".join(f", items[i].{c} AS {c}" for c in carried) + ", unhex(items[i].digest) AS digest" * bool(carried)
    row = f"struct(i{own}, transform(sequence(0, grown - 1), j -> unhex(get(levels[j], shiftright(i, j) ^ 1))) AS siblings)"
    return blocks.select(
        "tree", "block", "below", "grown", into_top.alias("into_top"), F.explode(F.expr(f"transform(sequence(0, size(items) - 1), i -> {row})")).alias("node"),
    ).select(
        "tree", F.lit(level).cast("long").alias("level"), (F.shiftleft("block", stride) + F.col("node.i")).alias("idx"), *[F.col(f"node.{c}") for c in [*carried, *["digest"] * bool(carried)]], "node.siblings",
        F.when(F.col("into_top"), F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("ptree"),
        F.when(F.col("into_top"), 0).otherwise(level + F.col("grown")).cast("long").alias("plevel"),
        F.when(F.col("into_top"), F.col("tree")).otherwise(F.col("block")).cast("long").alias("pidx"), _copies(F.col("below")).alias("psalts"),
    )


def _grow(nodes: DataFrame, level: int, stride: int, top: bool, tallest: int, carried: list[str]) -> tuple[list[DataFrame], DataFrame | None]:
    """Node rows by stored level, and the finished roots (tree, digest, below); ``nodes``: tree, idx, digest, height, below, carried."""
    made, roots = [], None
    while level < tallest:
        blocks = stage(_blocks(nodes.where(F.col("height") > level), level, stride, carried), "merkle-levels")
        linked = _linked(blocks, level, stride, top, carried)
        if not carried:
            # A node row has as many copies as leaves below it ask for.
            copies = nodes.where(F.col("height") > level).select("tree", "idx", F.explode(F.sequence(F.lit(0).cast("long"), _copies(F.col("below")) - 1)).alias("salt"))
            linked = linked.join(copies, ["tree", "idx"])
        made.append(linked)
        ends = F.col("grown") + level == F.col("height")
        done = blocks.where(ends).select("tree", F.col("goal").alias("digest"), "below")
        roots = done if roots is None else roots.unionByName(done)
        nodes, carried = blocks.where(~ends).select("tree", F.col("block").alias("idx"), F.col("goal").alias("digest"), "height", "below"), []
        level += stride
    return made, roots


_ROW = "tree long, level long, idx long, siblings array<binary>, ptree long, plevel long, pidx long, psalts long"


def build(rows: DataFrame, group: str = "lang", order: str = "doc_id", claimed: str = "claimed", stride: int = STRIDE) -> Manifest:
    """The manifest of ``rows``, which have the columns ``group``, ``order``, ``leaf`` and ``claimed`` (hex digests)."""
    spark = rows.sparkSession
    rows = rows.select(F.col(group).alias("in"), F.col(order).alias("id"), F.unhex("leaf").alias("leaf"), F.unhex(F.nullif(F.col(claimed), F.col("leaf"))).alias("claimed"))
    placed, totals = numbered(rows, ["in"], ["id", "leaf"], "merkle-leaves")
    groups, spans = numbered(totals.select("in", "n").distinct(), [], ["in"], "merkle-groups")
    ranks = groups.alias("g").join(spans.alias("s"), F.shiftright("g.place", 33) == F.col("s.part")).select(
        F.col("g.in").alias("__in"), F.col("g.n").alias("size"), (F.col("g.place") - F.col("s.first") + F.col("s.before")).alias("tree"))
    known = totals.join(ranks, F.col("in").eqNullSafe(F.col("__in"))).select("__in", "part", "first", "before", "size", "tree")
    leaves = stage(
        placed.join(known, (F.shiftright("place", 33) == F.col("part")) & F.col("in").eqNullSafe(F.col("__in")))
        .select("id", "leaf", "claimed", (F.col("place") - F.col("first") + F.col("before")).alias("idx"), "tree", "size"), "merkle-numbered")
    trees, largest = (int(x or 0) for x in ranks.agg(F.count(F.lit(1)), F.max("size")).first())
    one, hexed = F.lit(1).cast("long"), F.lower(F.hex("leaf"))
    low = leaves.select("tree", "idx", hexed.alias("digest"), _height(F.col("size")).alias("height"), one.alias("below"), "id", "claimed", "size")
    made, roots = _grow(low, 0, stride, False, max(largest - 1, 0).bit_length(), ["id", "claimed", "size"])
    # A lone leaf is its group's root already.
    lone = leaves.where("size = 1")
    subroots = lone.select("tree", hexed.alias("digest"), one.alias("below"))
    subroots = stage(subroots if roots is None else subroots.unionByName(roots), "merkle-subroots")
    height = max(trees - 1, 0).bit_length()
    upper = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest", F.lit(height).alias("height"), "below")
    above, last = _grow(upper, 0, stride, True, height, [])
    root = (subroots if last is None else last).select("digest").first()
    rows = lone.select(
        "id", "leaf", "claimed", F.col("idx").alias("spot"), F.col("tree").alias("home"), F.lit(0).cast("long").alias("copy"), F.expr("CAST(array() AS array<binary>)").alias("siblings"),
        F.lit(TOP).cast("long").alias("ptree"), F.lit(0).cast("long").alias("plevel"), F.col("tree").alias("pidx"), one.alias("psalts"))
    if made:
        rows = rows.unionByName(made[0].select(
            "id", F.col("digest").alias("leaf"), "claimed", F.col("idx").alias("spot"), F.col("tree").alias("home"), F.pmod("idx", _copies(F.col("size"))).alias("copy"), "siblings", "ptree", "plevel", "pidx", "psalts"))
    nodes = spark.createDataFrame([], _ROW + ", salt long")
    for part in (*made[1:], *above):
        nodes = nodes.unionByName(part)
    heads = subroots.select(F.col("tree").alias("home"), F.explode(F.sequence(F.lit(0).cast("long"), _copies(F.col("below")) - 1)).alias("copy"), F.col("digest").alias("subroot"))
    return Manifest(rows, stage(nodes, "merkle-nodes"), heads, root[0] if root else None, height)


def _fold(idx: str, siblings: str, digest: str) -> str:
    """SQL: ``digest`` of node number ``idx`` hashed with its siblings, level by level."""
    own, other = "lower(hex(h))", f"lower(hex({siblings}[j]))"
    pair = f"CASE WHEN shiftright({idx}, j) & 1 = 1 THEN concat({other}, {own}) ELSE concat({own}, coalesce({other}, '')) END"
    return f"CASE WHEN size({siblings}) = 0 THEN {digest} ELSE aggregate(sequence(0, size({siblings}) - 1), {digest}, (h, j) -> unhex(sha2({pair}, 256))) END"


def _append(proof: str, siblings: str) -> str:
    return f"aggregate({siblings}, {proof}, (p, s) -> concat(p, coalesce(s, X'')))"


# The default ends a recursive query at a million rows; LIMIT ALL lifts that, as the tree's levels bound it.
_CLIMB = f"""
WITH RECURSIVE climb(id, leaf, folded, proof, spot, home, copy, tree, level, idx, salt) AS (
  SELECT id, leaf, {_fold('spot', 'siblings', 'coalesce(claimed, leaf)')}, {_append("X''", 'siblings')}, spot, home, copy, ptree, plevel, pidx, pmod(spot, psalts) FROM {{leaves}}
  UNION ALL
  SELECT c.id, c.leaf, {_fold('c.idx', 'n.siblings', 'c.folded')}, {_append('c.proof', 'n.siblings')}, c.spot, c.home, c.copy, n.ptree, n.plevel, n.pidx, pmod(c.spot, n.psalts)
  FROM climb c JOIN {{nodes}} n ON c.tree = n.tree AND c.level = n.level AND c.idx = n.idx AND c.salt = n.salt
  WHERE NOT (c.tree = -1 AND c.level = {{height}})
)
SELECT id, lower(hex(leaf)) AS leaf, sha2(lower(hex(proof)), 256) AS proof_sha256, lower(hex(folded)) AS folded, home, copy
FROM (SELECT * FROM climb LIMIT ALL) WHERE tree = -1 AND level = {{height}}
"""


def climb(manifest: Manifest) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256 (of all siblings), folded: the root recomputed from the claimed digest."""
    found = manifest.leaves.sparkSession.sql(_CLIMB, leaves=manifest.leaves, nodes=manifest.nodes, height=manifest.height)
    return found.join(manifest.subroots, ["home", "copy"]).select("id", "leaf", "subroot", F.lit(manifest.root).cast("string").alias("root"), "proof_sha256", "folded")


def audit(docs: DataFrame, changed: Column | None = None, stride: int = STRIDE) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs``.

    Where ``changed`` holds, the leaf to be checked is that of the row with n_chars + 1.
    """
    small_batches(docs.sparkSession)
    values = {c: docs[c] for c in FIELDS}
    leaf = row_digest([*values.values()])
    other = row_digest([v.cast("decimal(38,0)") + 1 if c == "n_chars" else v for c, v in values.items()])
    wrong = F.lit(False) if changed is None else F.coalesce(changed, F.lit(False))
    rows = stage(docs.select(docs["doc_id"], docs["lang"], leaf.alias("leaf"), F.when(wrong, other).alias("claimed")), "merkle-digests")
    return climb(build(rows, stride=stride)).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def seventh(doc_id: Column) -> Column:
    """Whether 7 divides the unsigned CRC-32 of the id's decimal text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0


def _sql_field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


_SQL_LEAF = "sha256({})"
_SQL_CRC = (
    "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), "
    "lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)

#: The same rows by DuckDB.
SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, sha256({' || '.join(_sql_field(c) for c in FIELDS)}) AS leaf,
    sha256({' || '.join(_sql_field('n_chars + 1' if c == 'n_chars' else c) for c in FIELDS)}) AS other, coalesce({_SQL_CRC} % 7 = 0, false) AS wrong
  FROM documents
), ranked AS (
  SELECT rid, doc_id, leaf, CASE WHEN wrong THEN other ELSE leaf END AS claimed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree
  FROM hashed
), nodes AS (
  SELECT tree, 0 AS level, idx, leaf AS digest, n FROM ranked
  UNION ALL
  SELECT tree, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 2
), tops AS (
  SELECT 0 AS level, tree AS idx, digest, count(*) OVER () AS n FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, idx // 2
), climb AS (
  SELECT rid, tree, 0 AS level, idx, '' AS proof, claimed AS folded FROM ranked
  UNION ALL
  SELECT c.rid, c.tree, c.level + 1, c.idx // 2, c.proof || coalesce(s.digest, ''),
    sha256(CASE WHEN c.idx % 2 = 1 THEN s.digest || c.folded ELSE c.folded || coalesce(s.digest, '') END)
  FROM climb c JOIN nodes m ON m.tree = c.tree AND m.level = c.level AND m.idx = c.idx AND m.n > 1
  LEFT JOIN nodes s ON s.tree = c.tree AND s.level = c.level AND s.idx = xor(c.idx, 1)
), ended AS (
  SELECT c.rid, c.tree, c.proof, c.folded, m.digest AS subroot FROM climb c JOIN nodes m ON m.tree = c.tree AND m.level = c.level AND m.idx = c.idx AND m.n = 1
), further AS (
  SELECT rid, 0 AS level, tree AS idx, proof, folded FROM ended
  UNION ALL
  SELECT c.rid, c.level + 1, c.idx // 2, c.proof || coalesce(s.digest, ''),
    sha256(CASE WHEN c.idx % 2 = 1 THEN s.digest || c.folded ELSE c.folded || coalesce(s.digest, '') END)
  FROM further c JOIN tops m ON m.level = c.level AND m.idx = c.idx AND m.n > 1
  LEFT JOIN tops s ON s.level = c.level AND s.idx = xor(c.idx, 1)
)
SELECT r.doc_id, r.leaf, e.subroot, m.digest AS root, sha256(f.proof) AS proof_sha256, f.folded AS folded_root, f.folded = m.digest AS verified
FROM ranked r JOIN ended e USING (rid) JOIN further f USING (rid) JOIN tops m ON m.level = f.level AND m.idx = f.idx AND m.n = 1
"""
