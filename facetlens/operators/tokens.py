"""Token activation tables: spans, ranks, localization and per-feature summaries.

A token table has one row per (layer, feature_id, prompt_id, token_idx) with offsets,
text, activation and flags. Aggregations go to (feature, prompt) first and to the feature
afterwards, so a feature that fires on most tokens is reduced inside each task.

The same table may come as token lists: a row per (layer, prompt_id), or per part of a prompt, whose
``feature_id`` is a list, as are its token columns; its activations are listed feature by feature (all tokens of
the first, then of the second), its final activations have an entry a feature. Texts and labels are there once for all
features, and a task sums lists up without making rows of them. ``TokenLists`` are lists that are made in that task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from facetlens.functions import constants as K
from facetlens.functions import text as T
from facetlens.functions.joins import spread_join
from facetlens.functions.numeric import clip01, safe_ratio
from facetlens.functions.settle import settle
from facetlens.operators.quantiles import exact_medians

FEATURE = ["layer", "feature_id"]
ACT = "token_feature_activation"
RANKS = ["token_rank_within_prompt", "feature_rank_within_prompt", "is_top_token_for_feature"]
RANKED_BY = [*FEATURE, "prompt_id", "token_idx", "token_start_char", "token_end_char", ACT]


def content_only(tokens: DataFrame) -> DataFrame:
    """Without zero-width and ``<|...|>`` tokens."""
    return tokens.filter(
        (F.coalesce("token_end_char", F.lit(0)) > F.coalesce("token_start_char", F.lit(0)))
        # Hardly a token gets as far as the pattern.
        & ~F.coalesce(F.col("token_str").contains("<|") & F.col("token_str").rlike(r"<\|.*\|>"), F.lit(False))
    )


#: Terms of one automaton, and characters of terms whose automata a task keeps.
AUTOMATON_TERMS, KEPT_CHARS = 20_000, 1 << 20


class TermFinder:
    """Aho-Corasick automata of term lists, kept for the lists that come again."""

    def __init__(self):
        self.known: dict[tuple[str, ...], list] = {}
        self.chars = 0

    def automata(self, terms: tuple[str, ...]) -> list:
        if terms not in self.known:
            made = []
            for at in range(0, len(terms), AUTOMATON_TERMS):
                a = ahocorasick.Automaton()
                for t in terms[at:at + AUTOMATON_TERMS]:
                    a.add_word(t, t)
                a.make_automaton()
                made.append(a)
            if self.chars > KEPT_CHARS:
                self.known.clear()
                self.chars = 0
            self.known[terms] = made
            self.chars += sum(map(len, terms))
        return self.known[terms]

    def spans(self, text: str, terms: tuple[str, ...]) -> list[tuple[str, int, int]]:
        """(term, start, end) of the leftmost non-overlapping occurrences of each term, in one pass a group of terms."""
        out, upto = [], {}
        for a in self.automata(terms):
            for last, term in a.iter(text):
                start = last + 1 - len(term)
                if start >= upto.get(term, 0):
                    out.append((term, start, last + 1))
                    upto[term] = last + 1
        return out


def all_term_spans(prompts: DataFrame, key: str, text: str, terms: str) -> DataFrame:
    """(key, term, start, end): non-overlapping, case-insensitive occurrences of each term.

    Every text is read once by the automaton of its own terms, in the task that has it; nothing is
    shuffled. ``key`` names a text. Null texts, null and blank terms give nothing; a term
    listed twice counts once.
    """
    own = F.array_distinct(F.filter(F.transform(F.col(terms), lambda t: F.lower(T.strip(t))), lambda t: t != ""))
    rows = prompts.select(key, F.lower(F.col(text)).alias("_p"), own.alias("_t")).filter("_p IS NOT NULL AND size(_t) > 0")
    schema = prompts.select(key, F.lit("").alias("term"), F.lit(0).alias("start_char"), F.lit(0).alias("end_char")).schema

    def run(batches):
        finder = TermFinder()
        for batch in batches:
            found, of = [], []
            for i, (p, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                spans = finder.spans(p, tuple(sorted(t)))
                found += spans
                of += [i] * len(spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32())],
                [key, "term", "start_char", "end_char"],
            )

    return rows.mapInArrow(run, schema)


def overlaps(start: Column, end: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (end > s["start"]) & (start < s["end"]))


def token_span_overlap(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Token rows with ``in_span``: whether any span of the same key overlaps the token.

    Spans of a text become sorted disjoint stretches first (touching or overlapping ones
    merge), so a token needs only the last stretch that starts before its end.
    """
    w = Window.partitionBy(key).orderBy("start_char", "end_char")
    reach = F.max("end_char").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.coalesce((F.col("start_char") > reach).cast("int"), F.lit(1)))
    merged = marked.withColumn("_g", F.sum("_new").over(w)).groupBy(key, "_g").agg(
        F.min("start_char").alias("s"), F.max("end_char").alias("e")
    )
    # Tokens and stretches in one order per text: a stretch starting at s precedes tokens ending after s.
    events = merged.select(
        key, F.col("s").alias("_at"), F.lit(1).alias("_kind"), F.col("e").alias("_e"),
        F.lit(None).cast("int").alias("token_idx"), F.lit(None).cast("int").alias("token_start_char"), F.lit(None).cast("int").alias("token_end_char"),
    ).unionByName(
        tokens.select(key, F.col("token_end_char").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("int").alias("_e"),
                      "token_idx", "token_start_char", "token_end_char")
    )
    walk = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("_reach", F.max("_e").over(walk)).filter("_kind = 0").select(
        key, "token_idx", "token_start_char", "token_end_char",
        F.coalesce(F.col("token_start_char") < F.col("_reach"), F.lit(False)).alias("in_span"),
    )


def token_positions(tokens: DataFrame, spans: DataFrame, key: str, every: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, position, token_idx): last token overlapping each span kind, else the final one.

    ``tokens``: key, token_idx and offsets. ``spans``: key, position, start_char, end_char;
    a listed position without a span falls back to the final content token. ``every`` names positions that
    take all tokens overlapping any span of the listed kinds, one row each, with the same
    fallback. A text without content tokens has its last token at all positions.
    """
    is_content = F.col("token_end_char") > F.col("token_start_char")
    content = tokens.filter(is_content)
    final = tokens.groupBy(key).agg(F.coalesce(F.max(F.when(is_content, F.col("token_idx"))), F.max("token_idx")).alias("_final"))
    met = spans.filter("start_char IS NOT NULL").join(content, key).filter(
        (F.col("token_end_char") > F.col("start_char")) & (F.col("token_start_char") < F.col("end_char"))
    ).select(key, "position", "token_idx")
    hit = met.groupBy(key, "position").agg(F.max("token_idx").alias("_last"))
    named = spans.select(key, "position").distinct().join(final, key).join(hit, [key, "position"], "left").select(
        key, "position", F.coalesce("_last", "_final").alias("token_idx")
    )
    out = named.unionByName(final.select(key, F.lit("final_prompt_token").alias("position"), F.col("_final").alias("token_idx")))
    if every:
        kinds: dict[str, list[str]] = {}
        for name, members in every.items():
            for kind in members:
                kinds.setdefault(kind, []).append(name)
        names = F.explode(F.create_map(*[x for kind, n in kinds.items() for x in (F.lit(kind), F.array(*[F.lit(v) for v in n]))])[F.col("position")])
        asked = spans.select(key, names.alias("position")).distinct()
        tokens_of = met.select(key, names.alias("position"), "token_idx").distinct()
        whole = asked.join(final, key).join(tokens_of, [key, "position"], "left").select(key, "position", F.coalesce("token_idx", "_final").alias("token_idx"))
        out = out.unionByName(whole)
    return out


def token_ranks(tokens: DataFrame | TokenLists, columns: list[str] | None = None) -> DataFrame:
    """Rank among the content tokens of a prompt (-1 otherwise), ordinal rank, top flag; beside ``columns`` of the tokens, or all.

    Lists that tasks make are ranked there; prompts that come in several lists, or as rows, are put together first.
    """
    columns = columns or [c for c in tokens.columns if c not in RANKS]
    if isinstance(tokens, TokenLists):
        return _list_ranks(tokens, columns).unionByName(token_ranks(tokens.rest, columns))
    if is_lists(tokens):
        tokens = _list_rows(tokens, list(dict.fromkeys([*columns, *RANKED_BY])))
    # One order of a prompt's rows gives both ranks: among content tokens, it is their number so far.
    order = Window.partitionBy(*FEATURE, "prompt_id").orderBy(F.col(ACT).desc(), F.col("token_idx"))
    content = F.coalesce(F.col("token_end_char") > F.col("token_start_char"), F.lit(False))
    so_far = F.sum(content.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rank = F.when(content, so_far.cast("int")).otherwise(F.lit(-1))
    return tokens.select(*columns, rank.alias(RANKS[0]), F.row_number().over(order).alias(RANKS[1]), (rank == 1).alias(RANKS[2]))


def localization_label(span_max: Column, final: Column, overall: Column, outside: Column | None = None) -> Column:
    """Where a feature fires in a prompt, by 0.7 of its maximum there."""
    on = overall > 0
    out = F.when(on & (span_max >= F.lit(0.7) * overall), F.lit("identity_span_local")).when(
        on & (final >= F.lit(0.7) * overall), F.lit("final_token_integrated")
    )
    rest = on if outside is None else on & outside
    return out.when(rest, F.lit("template_context")).otherwise(F.lit("diffuse_or_unclear"))


FINAL = "final_token_feature_activation"


def _row_parts(tokens: DataFrame, labels: list[str], filled: bool) -> DataFrame:
    """(prompt, feature, labels): what ``prompt_activation`` puts together, of token rows."""
    act = F.coalesce(ACT, F.lit(0.0))
    # The final activation of a part of the prompt's rows, and where it stands.
    if FINAL in tokens.columns:
        final, at = (F.max(F.coalesce(FINAL, F.lit(0.0))), F.lit(0)) if filled else (F.min_by(FINAL, "token_idx"), F.min("token_idx"))
    else:
        final, at = (F.max_by(act, "token_idx"), F.max("token_idx")) if filled else (F.max(F.lit(0.0)), F.lit(0))
    in_span = F.coalesce("is_entity_span_token", F.lit(False))
    best = F.max_by(F.struct("token_idx", "token_str", in_span.alias("in_span")), F.struct(act, -F.col("token_idx")))
    # Labels are keys at first, since a prompt hardly has several: the least string of every token's would cost more than all the rest.
    # Strings in the state make tasks sort their rows; with the prompt in front, rows in text order are nearly sorted.
    return content_rows(tokens).groupBy("prompt_id", *FEATURE, *labels).agg(
        F.max(act).alias("_max"), final.alias("_final"), at.alias("_at"), best.alias("_best"),
        F.max(F.when(in_span, act)).alias("_span_max"), F.sum(F.when(in_span, act)).alias("_span_sum"), F.count(F.when(in_span, act)).alias("_span_n"),
    )


Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class TokenLists:
    """Token lists that tasks make of the batches of ``source``, where they are read; ``rest``: a table of further ones.

    ``schema`` names the columns that ``make`` gives; ``rest`` has them too. A prompt of ``source`` is one list and
    not in ``rest``, where prompts may come in parts; the features of a list differ.
    """

    source: DataFrame
    make: Callable[[Batches], Batches]
    schema: StructType
    rest: DataFrame

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def map_made(self, columns: list[str], run: Callable[[Batches], Batches], schema: StructType) -> DataFrame:
        make = self.make
        return self.source.mapInArrow(lambda batches: run(b.select(columns) for b in make(batches)), schema)

    def map_lists(self, columns: list[str], run: Callable[[Batches], Batches], schema: StructType) -> DataFrame:
        return self.map_made(columns, run, schema).unionByName(self.rest.select(*columns).mapInArrow(run, schema))


def is_lists(tokens: DataFrame | TokenLists) -> bool:
    return isinstance(tokens.schema["feature_id"].dataType, ArrayType)


def _map_lists(tokens: DataFrame | TokenLists, columns: list[str], run: Callable[[Batches], Batches], schema: StructType) -> DataFrame:
    """``run`` over the lists' columns that the sums of content tokens need, and ``columns``."""
    kept = ["is_special_token"] if "is_special_token" in tokens.columns else ["token_start_char", "token_end_char"]
    columns = [*FEATURE, "token_idx", "token_str", "is_entity_span_token", ACT, *kept, *columns]
    if isinstance(tokens, TokenLists):
        return tokens.map_lists(columns, run, schema)
    return tokens.select(*columns).mapInArrow(run, schema)


#: Rows of token lists whose activations a task looks at at a time, and tokens whose equal ones it sums up.
LIST_ROWS, LIST_TOKENS = 1024, 1 << 20


def _schema(tokens: DataFrame | TokenLists, **columns: str | None) -> StructType:
    """Nullable columns of the given types; without one, of the type the lists have."""
    known = {f.name: f.dataType for f in tokens.schema.fields} | {"feature_id": tokens.schema["feature_id"].dataType.elementType}
    return StructType([StructField(c, known[c] if t is None else DataType.fromDDL(t)) for c, t in columns.items()])


def _feature_tokens(part: pa.RecordBatch, content: bool):
    """Of each (feature, token) of some lists in their order: segment (a row's feature), token, activation; and the row of each segment."""
    n, m = (part.column(c).value_lengths().fill_null(0).to_numpy().astype(np.int64) for c in ("token_idx", "feature_id"))
    row = np.repeat(np.arange(len(n)), m)
    size = n[row]
    seg = np.repeat(np.arange(len(row)), size)
    token = np.arange(len(seg)) - np.repeat(np.cumsum(size) - size - (np.cumsum(n) - n)[row], size)
    act = part.column(ACT).flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
    if len(act) != len(seg):
        raise ValueError("token lists need an activation a feature and token")
    if content:
        keep = _content(part)[token]
        seg, token, act = seg[keep], token[keep], act[keep]
    return seg, token, act, row


def _flags(column: pa.Array) -> np.ndarray:
    return column.flatten().fill_null(False).to_numpy(zero_copy_only=False)


def _content(part: pa.RecordBatch) -> np.ndarray:
    if "is_special_token" in part.schema.names:
        return ~_flags(part.column("is_special_token"))
    return pc.greater(part.column("token_end_char").flatten(), part.column("token_start_char").flatten()).fill_null(False).to_numpy(zero_copy_only=False)


#: Token rows that a task makes of lists at a time, and rows of the batches it gives.
ROWS_AT_ONCE, ROWS_GIVEN = 1 << 20, 1 << 16


def _row_schema(tokens: DataFrame | TokenLists, columns: list[str]) -> StructType:
    known = {f.name: f.dataType for f in tokens.schema.fields}
    return StructType([StructField(c, known[c].elementType if isinstance(known[c], ArrayType) else known[c]) for c in columns])


def _token_rows(batches: Batches, columns: list[str], more: Callable[..., list[pa.Array]], names: list[str]) -> Batches:
    """The token rows that lists stand for: ``columns``, and what ``more`` has of (lists, segment and token of each row)."""
    for batch in batches:
        n, m = (batch.column(c).value_lengths().fill_null(0).to_numpy().astype(np.int64) for c in ("token_idx", "feature_id"))
        ends, at = np.cumsum(n * m), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + ROWS_AT_ONCE, "right")))
            part, at = batch.slice(at, to - at), to
            seg, token, _, row = _feature_tokens(part, False)
            found = []
            for c in columns:
                x = part.column(c)
                if not pa.types.is_list(x.type):
                    x = x.take(pa.array(row[seg]))
                elif c != ACT:
                    x = x.flatten().take(pa.array(seg if c in ("feature_id", FINAL) else token))
                else:
                    x = x.flatten()
                found.append(x.cast(pa.string()) if c == "token_str" else x)
            out = pa.RecordBatch.from_arrays([*found, *more(part, seg, token)], names)
            for low in range(0, out.num_rows, ROWS_GIVEN):
                yield out.slice(low, ROWS_GIVEN)


def _list_rows(lists: DataFrame, columns: list[str]) -> DataFrame:
    """The token rows of token lists."""
    return lists.select(*columns).mapInArrow(lambda batches: _token_rows(batches, columns, lambda *_: [], columns), _row_schema(lists, columns))


def _list_ranks(tokens: TokenLists, columns: list[str]) -> DataFrame:
    """``token_ranks`` of the prompts of ``source``, where their lists are made."""
    schema = StructType([*_row_schema(tokens, columns), *[StructField(c, DataType.fromDDL(t)) for c, t in zip(RANKS, ("int", "int", "boolean"))]])

    def ranks(part, seg, token):
        act, idx = part.column(ACT).flatten(), part.column("token_idx").flatten().cast(pa.int64())
        null, act = act.is_null().to_numpy(zero_copy_only=False), act.fill_null(0.0).to_numpy(zero_copy_only=False)
        idx = idx.fill_null(np.iinfo(np.int64).min).to_numpy()[token]
        # As in Spark, a NaN is the largest value and a missing one comes last.
        nan = np.isnan(act)
        order = np.lexsort((idx, np.where(nan, 0.0, -act), *[~nan] * int(nan.any()), *[null] * int(null.any()), seg))
        first = np.searchsorted(seg, seg, "left")
        ordinal = np.empty(len(seg), np.int64)
        ordinal[order] = np.arange(1, len(seg) + 1)
        content = pc.greater(part.column("token_end_char").flatten(), part.column("token_start_char").flatten()).fill_null(False).to_numpy(zero_copy_only=False)[token]
        upto = np.r_[0, np.cumsum(content[order])]
        rank = np.where(content, upto[ordinal] - upto[first], -1)
        return [pa.array(rank, pa.int32()), pa.array(ordinal - first, pa.int32()), pa.array(rank == 1)]

    return tokens.map_made(list(dict.fromkeys([*columns, *RANKED_BY])), lambda batches: _token_rows(batches, columns, ranks, schema.names), schema)


def _list_parts(tokens: DataFrame, labels: list[str], filled: bool) -> DataFrame:
    """What ``_row_parts`` gives, of token lists, a row per list and feature with content tokens."""
    has_final = FINAL in tokens.columns
    keys = ["prompt_id", *FEATURE, *labels]
    schema = _schema(
        tokens, **dict.fromkeys(keys), _max="double", _final="double", _at="int", _best="struct<token_idx: int, token_str: string, in_span: boolean>",
        _span_max="double", _span_sum="double", _span_n="bigint",
    )

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, LIST_ROWS):
                part = batch.slice(at, LIST_ROWS)
                seg, token, act, row = _feature_tokens(part, True)
                if not len(seg):
                    continue
                cut = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
                width = np.diff(np.r_[cut, len(seg)])
                own = seg[cut]
                idx = part.column("token_idx").flatten().to_numpy()[token].astype(np.int64)
                inside = _flags(part.column("is_entity_span_token"))
                # As in Spark, a NaN is the largest value.
                top = np.maximum.reduceat(act, cut)
                hit = (act == np.repeat(top, width)) | np.isnan(act)
                first = np.minimum.reduceat(np.where(hit, idx, np.iinfo(np.int64).max), cut)
                places = np.flatnonzero(hit & (idx == np.repeat(first, width)))
                best = token[places[np.r_[True, seg[places][1:] != seg[places][:-1]]]]
                span = inside[token]
                span_n = np.add.reduceat(span.astype(np.int64), cut)
                span_max = pa.array(np.maximum.reduceat(np.where(span, act, -np.inf), cut), mask=span_n == 0)
                span_sum = np.add.reduceat(np.where(span, act, 0.0), cut)
                where = np.zeros(len(own), np.int64)
                if has_final:
                    final = part.column(FINAL).flatten().take(pa.array(own))
                    final, where = (final.fill_null(0.0), where) if filled else (final, np.minimum.reduceat(idx, cut))
                elif filled:
                    where = np.maximum.reduceat(idx, cut)
                    last = np.flatnonzero(idx == np.repeat(where, width))
                    final = pa.array(act[last[np.r_[True, seg[last][1:] != seg[last][:-1]]]])
                else:
                    final = pa.array(np.zeros(len(own)))
                rows = pa.array(row[own])
                chosen = pa.StructArray.from_arrays(
                    [pa.array(first, pa.int32()), part.column("token_str").flatten().take(pa.array(best)).cast(pa.string()), pa.array(inside[best])], ["token_idx", "token_str", "in_span"])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("prompt_id").take(rows), part.column("layer").take(rows), part.column("feature_id").flatten().take(pa.array(own)),
                        *[part.column(c).take(rows) for c in labels], pa.array(top), final, pa.array(where, pa.int32()), chosen, span_max, pa.array(span_sum), pa.array(span_n),
                    ],
                    schema.names,
                )

    return _map_lists(tokens, ["prompt_id", *labels, *[FINAL] * has_final], run, schema)


PROMPT_LABELS = ["family", "template_id", "axis", "entity"]


def prompt_activation(tokens: DataFrame, labels: list[str] = PROMPT_LABELS, filled: bool = True) -> DataFrame:
    """(feature, prompt): max, final, span max and mean, arg-max token, label columns.

    The final activation is its column with 0 for missing values, or the last token's where
    the column is absent. Without ``filled`` it is the first token's value as it stands, NULL
    included, and 0 where the column is absent.
    """
    # How the final activations of a prompt's parts go together.
    whole = F.max("_final") if filled == (FINAL in tokens.columns) else F.min_by("_final", "_at") if FINAL in tokens.columns else F.max_by("_final", "_at")
    parts = _list_parts(tokens, labels, filled) if is_lists(tokens) else _row_parts(tokens, labels, filled)
    return parts.groupBy("prompt_id", *FEATURE).agg(
        F.max("_max").alias("max_token_activation"),
        whole.alias("final_token_activation"),
        F.coalesce(F.max("_span_max"), F.lit(0.0)).alias("max_span_activation"),
        F.coalesce(F.try_divide(F.sum("_span_sum"), F.sum("_span_n")), F.lit(0.0)).alias("mean_span_activation"),
        F.max_by("_best", F.struct("_max", -F.col("_best.token_idx"))).alias("_best"),
        *[F.min(c).alias(c) for c in labels],
    ).select(
        *FEATURE, "prompt_id", "max_token_activation", "final_token_activation", "max_span_activation", "mean_span_activation", *labels,
        F.col("_best.token_idx").alias("token_idx_of_max"), F.col("_best.token_str").alias("token_str_of_max"),
        F.col("_best.in_span").alias("max_inside_span"),
    )


TOKEN_FLAGS = ["is_special_token", "is_entity_span_token"]


def token_input(tokens: DataFrame) -> DataFrame:
    """A token table as read (``read_token_tables``) in the form the operators take.

    Flags become booleans; without prompt ids a feature is one prompt, without texts they are
    empty, without span flags nothing is inside a span.
    """
    out = tokens.withColumnRenamed("is_identity_span_token", "is_entity_span_token")
    defaults = {"prompt_id": F.lit(0), "token_str": F.lit(""), "is_entity_span_token": F.lit(False), **{c: F.lit("") for c in PROMPT_LABELS}}
    out = out.withColumns({c: x for c, x in defaults.items() if c not in out.columns})
    return out.withColumns({c: T.parse_bool(F.col(c)) for c in TOKEN_FLAGS if c in out.columns})


def content_rows(tokens: DataFrame) -> DataFrame:
    if "is_special_token" in tokens.columns:
        return tokens.filter(~F.coalesce("is_special_token", F.lit(False)))
    return tokens.filter("token_end_char > token_start_char")


def token_totals(tokens: DataFrame, content: bool = False) -> DataFrame:
    """(feature, token_norm): summed activation and share inside the entity span; of ``content`` tokens only, or of all."""
    if is_lists(tokens):
        # Dealt by word before its features part, so that all of them are summed up in one place.
        words = _list_totals(tokens, content).withColumn("token_norm", T.token_norm(F.col("token_str"))).repartition("token_norm")
        long = words.select("layer", "token_norm", "_sum", "_inside", "_n", F.posexplode("feature_id").alias("_at", "feature_id"))
        sums = long.select(*FEATURE, "token_norm", *[F.get(c, F.col("_at")).alias(c) for c in ("_sum", "_inside", "_n")]).groupBy(*FEATURE, "token_norm")
        return sums.agg(F.sum("_sum").alias("activation"), (F.sum("_inside") / F.sum("_n")).alias("span_fraction"))
    return (content_rows(tokens) if content else tokens).groupBy(*FEATURE, T.token_norm(F.col("token_str")).alias("token_norm")).agg(
        F.sum(F.coalesce(ACT, F.lit(0.0))).alias("activation"),
        F.avg(F.coalesce("is_entity_span_token", F.lit(False)).cast("double")).alias("span_fraction"),
    )


def _gathered(batches: Batches, tokens: int) -> Batches:
    """Batches of token lists in one, up to about so many tokens."""
    parts, size = [], 0
    for batch in batches:
        parts.append(batch)
        size += len(batch.column("token_idx").flatten())
        if size >= tokens:
            yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            parts, size = [], 0
    if size:
        yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _list_totals(tokens: DataFrame | TokenLists, content: bool) -> DataFrame:
    """(layer, token as it stands): lists of features and of their sums, over LIST_TOKENS tokens of a task."""
    schema = _schema(tokens, layer=None, token_str="string", feature_id=None, _sum="double", _inside="bigint", _n="bigint")
    schema = StructType([f if f.name in ("layer", "token_str") else StructField(f.name, ArrayType(f.dataType)) for f in schema.fields])

    def run(batches):
        for part in _gathered(batches, LIST_TOKENS):
            seg, token, act, row = _feature_tokens(part, content)
            if not len(seg):
                continue
            words = part.column("token_str").flatten().dictionary_encode(null_encoding="encode")
            layers, features = part.column("layer").dictionary_encode(null_encoding="encode"), part.column("feature_id").flatten().dictionary_encode(null_encoding="encode")
            # Equal (word, layer, feature) have one number, in this order.
            n_layers, n_features = len(layers.dictionary), len(features.dictionary)
            of_segment = layers.indices.to_numpy().astype(np.int64)[row] * n_features + features.indices.to_numpy()
            number = words.indices.to_numpy().astype(np.int64)[token] * (n_layers * n_features) + of_segment[seg]
            met, at = None, number
            if len(words.dictionary) * n_layers * n_features > 8 * len(number):
                met, at = np.unique(number, return_inverse=True)
            n = np.bincount(at)
            there = np.flatnonzero(n)
            inside = np.bincount(at, _flags(part.column("is_entity_span_token"))[token])[there].astype(np.int64)
            total = np.bincount(at, act)[there]
            met = there if met is None else met
            own = met // n_features
            cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            upto = pa.array(np.r_[cut, len(own)], pa.int32())
            lists = [features.dictionary.take(pa.array(met % n_features)), pa.array(total), pa.array(inside), pa.array(n[there])]
            yield pa.RecordBatch.from_arrays(
                [layers.dictionary.take(pa.array(own[cut] % n_layers)), words.dictionary.take(pa.array(own[cut] // n_layers)).cast(pa.string()), *[pa.ListArray.from_arrays(upto, x) for x in lists]],
                schema.names,
            )

    return _map_lists(tokens, [], run, schema)


def _entropy(values: Column) -> Column:
    """Shannon entropy of the positive entries of an array over ln(count); 0 below two."""
    v = F.filter(values, lambda x: x > 0)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    h = F.aggregate(v, F.lit(0.0), lambda s, x: s - (x / total) * F.ln(x / total))
    return F.when(F.size(v) > 1, h / F.ln(F.size(v).cast("double"))).otherwise(F.lit(0.0))


def top_token_metrics(totals: DataFrame) -> DataFrame:
    """Top-30 token string, template-word share of the top 20, span share, token entropy."""
    w = Window.partitionBy(*FEATURE).orderBy(F.desc("activation"), "token_norm")
    top = totals.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 30")
    first20 = F.col("_rn") <= 20
    return top.groupBy(*FEATURE).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_rn", "token_norm"))), lambda s: s["token_norm"]), ";"
        ).alias("top_token_strings"),
        F.avg(F.when(first20, F.col("token_norm").isin(K.TEMPLATE_WORDS).cast("double"))).alias("fraction_top_tokens_template_words"),
        F.avg(F.when(first20, F.col("span_fraction"))).alias("top_token_span_fraction"),
        _entropy(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "activation"))), lambda s: s["activation"])).alias("token_entropy"),
    )


def normalized_entropy(counts: DataFrame, keys: list[str], weight: str, out: str) -> DataFrame:
    """Entropy of positive ``weight`` per key over ln(number of entries); 0 below two.

    Uses H = ln T - sum(w ln w) / T, so one aggregation is enough.
    """
    w = F.when(F.col(weight) > 0, F.col(weight).cast("double"))
    g = counts.groupBy(*keys).agg(F.sum(w).alias("_t"), F.sum(w * F.ln(w)).alias("_wl"), F.count(w).alias("_k"))
    h = F.ln("_t") - F.col("_wl") / F.col("_t")
    return g.select(*keys, F.when(F.col("_k") > 1, h / F.ln(F.col("_k").cast("double"))).otherwise(F.lit(0.0)).alias(out))


def _label_entropies(prompts: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Categorical entropy per feature for several label columns, in one aggregation."""
    pairs = F.array(*[F.struct(F.lit(out).alias("m"), F.col(c).cast("string").alias("v")) for c, out in labels.items()])
    counts = prompts.select(*FEATURE, F.explode(pairs).alias("_p")).filter("_p.v IS NOT NULL").groupBy(
        *FEATURE, F.col("_p.m").alias("m"), F.col("_p.v").alias("v")
    ).agg(F.count(F.lit(1)).alias("c"))
    long = normalized_entropy(counts, [*FEATURE, "m"], "c", "h")
    top = counts.groupBy(*FEATURE, "m").agg((F.max("c") / F.sum("c")).alias("top_share"))
    outs = list(labels.values())
    return long.join(top, [*FEATURE, "m"]).groupBy(*FEATURE).agg(
        *[F.max(F.when(F.col("m") == o, F.col("h"))).alias(o) for o in outs],
        F.max(F.when(F.col("m") == outs[0], F.col("top_share"))).alias("fraction_top_prompts_single_family"),
    )


def token_localization(tokens: DataFrame) -> DataFrame:
    """Per (layer, feature): localization scores, entropies, top tokens and a label."""
    prompts = settle(
        prompt_activation(tokens).withColumns({
            "span_ratio": safe_ratio(F.col("max_span_activation"), F.col("max_token_activation")),
            "final_ratio": safe_ratio(F.col("final_token_activation"), F.col("max_token_activation")),
        }),
        "prompt-activation",
    )
    medians = exact_medians(prompts, FEATURE, {
        "final_token_activation": "final_token_activation", "max_span_activation": "max_span_activation",
        "mean_span_activation": "mean_span_activation", "span_ratio": "span_localization_score",
        "final_ratio": "final_token_integration_score",
    })
    base = prompts.groupBy(*FEATURE).agg(
        F.max("max_token_activation").alias("max_token_activation"),
        F.avg("span_ratio").alias("span_localization_score_mean"),
        F.avg(F.col("max_inside_span").cast("double")).alias("fraction_top_tokens_inside_span"),
    )
    entropies = _label_entropies(prompts, {"family": "family_entropy", "template_id": "template_entropy", "axis": "cross_axis_activation_score"})
    tops = top_token_metrics(token_totals(tokens, content=True))
    out = base.join(medians, FEATURE).join(entropies, FEATURE).join(tops, FEATURE)
    for c in ("span_localization_score", "span_localization_score_mean", "final_token_integration_score"):
        out = out.withColumn(c, clip01(F.col(c)))
    label = (
        F.when(F.col("span_localization_score") >= 0.7, F.lit("identity_span_local"))
        .when(F.col("final_token_integration_score") >= 0.7, F.lit("final_token_integrated"))
        .when(F.col("fraction_top_tokens_template_words") >= 0.5, F.lit("template_context"))
        .otherwise(F.lit("diffuse_or_unclear"))
    )
    return out.withColumn("feature_localization_type", label)


def top_token_fallback(tokens: DataFrame) -> DataFrame:
    """Token-share metrics alone, for sources that have only a top-token table."""
    return top_token_metrics(token_totals(tokens)).select(
        *FEATURE, "top_token_strings", "fraction_top_tokens_template_words", "token_entropy"
    )


def localization_share(prompt_labels: DataFrame) -> DataFrame:
    """Share of prompts per localization label; one label per (feature, prompt)."""
    one = prompt_labels.groupBy(*FEATURE, "prompt_id").agg(F.min("feature_localization_type").alias("localization_type"))
    n = one.groupBy(*FEATURE, "localization_type").agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*FEATURE))
    return n.select(*FEATURE, "localization_type", (F.col("_n") / total).alias("share"))


def exemplar_prompts(prompts: DataFrame, top_n: int) -> DataFrame:
    """Top prompts per feature by their maximum, with the label of each."""
    w = Window.partitionBy(*FEATURE).orderBy(F.desc("max_token_activation"), F.desc("final_token_activation"), "prompt_id")
    label = localization_label(F.col("max_span_activation"), F.col("final_token_activation"), F.col("max_token_activation"))
    return prompts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n).withColumn("feature_localization_type", label)


def top_k_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per key; Spark limits each group inside every task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def span_top_tokens(tokens: DataFrame, top_n: int) -> DataFrame:
    inside = content_rows(tokens).filter("is_entity_span_token")
    return top_k_per_group(inside, FEATURE, [F.col(ACT).desc(), F.col("prompt_id"), F.col("token_idx")], top_n)


# ---- item token tables (role flags) ----------------------------------------------
FLAGS = {
    "target_identity": "is_target_token",
    "nontarget_identity": "is_nontarget_token",
    "stereotype_language": "is_stereotype_language_token",
    "final_token": "is_final_prompt_token",
}


def token_role() -> Column:
    return (
        F.when(F.col("is_target_token"), F.lit("target_identity"))
        .when(F.col("is_nontarget_token"), F.lit("nontarget_identity"))
        .when(F.col("is_stereotype_language_token"), F.lit("stereotype_language"))
        .when(F.col("is_answer_option_token"), F.lit("answer_option"))
        .when(F.col("is_final_prompt_token"), F.lit("final_token"))
        .otherwise(F.lit("other_context"))
    )


def flag_means() -> list[Column]:
    """Mean activation where each role flag is set, NULL if it never is."""
    return [F.avg(F.when(F.col(flag), F.col("feature_activation"))).alias(f"mean_{name}") for name, flag in FLAGS.items()]


# Behaviour labels in the order that wins ties.
BEHAVIORS = {
    "target_identity": "target_identity_local",
    "nontarget_identity": "nontarget_identity_local",
    "stereotype_language": "stereotype_language_local",
    "final_token": "final_token_integrated",
}


def role_behavior(item_tokens: DataFrame) -> DataFrame:
    """Role with the largest flag-conditioned mean if it is at least 1.25 of the overall mean."""
    g = content_only(item_tokens).groupBy(*FEATURE).agg(*flag_means(), F.avg("feature_activation").alias("overall_mean"))
    g = g.na.fill(0.0)
    options = F.array(*[
        F.struct(F.col(f"mean_{name}").alias("v"), F.lit(-i).alias("p"), F.lit(label).alias("l"))
        for i, (name, label) in enumerate(BEHAVIORS.items())
    ])
    best = F.array_max(options)
    keep = (best["v"] > 0) & (best["v"] >= F.col("overall_mean") * 1.25)
    return g.withColumn("behavior_role", F.when(keep, best["l"]).otherwise(F.lit("mixed_or_unclear")))


def token_feature_summary(item_tokens: DataFrame, n_items: DataFrame) -> DataFrame:
    """Flag means, mean of per-item maxima, share of items active, JSON maps by condition.

    ``n_items``: one row with the number of prepared items.
    """
    means = item_tokens.groupBy(*FEATURE).agg(*flag_means())
    per_item = item_tokens.groupBy(*FEATURE, "item_uid").agg(F.max("feature_activation").alias("_m")).groupBy(*FEATURE).agg(
        F.avg("_m").alias("max_activation_per_prompt"), F.count(F.lit(1)).alias("_active")
    )
    out = means.join(per_item, FEATURE)
    for col in ("context_condition", "question_polarity", "category_raw"):
        by = item_tokens.groupBy(*FEATURE, col).agg(F.avg("feature_activation").alias("_v"))
        out = out.join(group_map(by, FEATURE, col, "_v", f"activation_by_{col}"), FEATURE)
    total = F.greatest(n_items.select(F.col("n")).scalar(), F.lit(1))
    return out.withColumn("fraction_prompts_active", F.col("_active") / total).drop("_active")


def group_map(long: DataFrame, keys: list[str], name: str, value: str, out: str, digits: int = 6) -> DataFrame:
    """One JSON object per key: group name to rounded value, names sorted."""
    v = F.round(F.col(value), digits) + F.lit(0.0)
    return long.groupBy(*keys).agg(T.json_map(F.collect_list(F.struct(F.col(name), v.alias("v")))).alias(out))


def activation_breakdowns(item_tokens: DataFrame, conditions: list[str]) -> DataFrame:
    """(feature, condition, value, mean activation) for several condition columns at once."""
    pairs = F.array(*[F.struct(F.lit(c).alias("condition"), F.col(c).alias("value")) for c in conditions])
    return content_only(item_tokens).select(*FEATURE, "feature_activation", F.explode(pairs).alias("_p")).groupBy(
        *FEATURE, "_p.condition", "_p.value"
    ).agg(F.avg("feature_activation").alias("mean_activation"))


def feature_card_index(item_tokens: DataFrame, feature_meta: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per feature: role, contrast, axis, flag means, behaviour, max, frequency."""
    return role_behavior(item_tokens).drop("overall_mean").join(feature_meta, FEATURE, "left").join(
        stats.select(*FEATURE, "max_activation", "activation_frequency"), FEATURE, "left"
    )


def scan_probe_join(item_tokens: DataFrame, items: DataFrame, top_n: int) -> DataFrame:
    """Top token rows per feature with the text and labels of their item."""
    top = top_k_per_group(
        content_only(item_tokens), FEATURE, [F.desc("feature_activation"), F.col("item_uid"), F.col("token_idx")], top_n
    )
    return top.withColumn("token_role", token_role()).join(items, "item_uid", "left")
