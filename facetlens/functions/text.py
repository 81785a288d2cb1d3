"""String, JSON and array rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetlens.functions import constants as K


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    entries = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*entries), key)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def clean_text(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def sentence_case(c: Column) -> Column:
    s = strip(c)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))


BAD_PATTERN_REGEX = r"(?i)\b(?:" + "|".join(K.BAD_PATTERNS) + r")\b"


def has_bad_pattern(c: Column) -> Column:
    return c.rlike(BAD_PATTERN_REGEX)


def norm_text(c: Column) -> Column:
    """Lower case, every run of other characters to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def axis_from_category(c: Column) -> Column:
    key = F.replace(norm_text(c), F.lit(" "), F.lit("_"))
    return F.coalesce(_lookup(K.AXIS_MAP, key), key)


def entity_axis(entity: Column) -> Column:
    """Axis of an entity id; an unlisted prefix is its own axis, no prefix gives ''."""
    prefix = F.split_part(entity, F.lit("_"), F.lit(1))
    return F.when(
        F.instr(entity, "_") > 0, F.coalesce(_lookup(K.AXIS_PREFIX_MAP, prefix), prefix)
    ).otherwise(F.lit(""))


def axis_from_prefix(entity: Column) -> Column:
    """Axis by prefix table only; anything else gives ''."""
    return F.coalesce(_lookup(K.AXIS_PREFIX_MAP, F.split_part(entity, F.lit("_"), F.lit(1))), F.lit(""))


def contrast_sides(name: Column) -> tuple[Column, Column]:
    """x_vs_y to (x, y); NULL when the separator is missing."""
    ok = F.instr(name, "_vs_") > 0
    parts = F.split(name, "_vs_", 2)
    return F.when(ok, parts[0]), F.when(ok, parts[1])


def axis_from_contrast(name: Column) -> Column:
    left, _ = contrast_sides(name)
    return F.coalesce(axis_from_prefix(left), F.lit(""))


def label_components(label: Column) -> Column:
    """Ordered distinct parts of a compound label such as F-Black or lowSES-Hispanic."""
    raw = clean_text(label)
    pieces = F.concat(F.array(raw), F.split(raw, "[-_/+]"))
    normed = F.filter(F.transform(pieces, norm_text), lambda s: s != "")
    with_compact = F.flatten(
        F.transform(normed, lambda s: F.array(s, F.replace(s, F.lit(" "), F.lit(""))))
    )
    expand = lambda s: F.coalesce(_lookup(K.COMPONENT_EXPANSIONS, s), s)
    return F.array_distinct(F.concat(with_compact, F.transform(with_compact, expand)))


def item_prompt(context: Column, question: Column, answers: list[Column]) -> Column:
    parts = [F.lit("Context:\n"), context, F.lit("\n\nQuestion:\n"), question, F.lit("\n\nAnswer choices:\n")]
    for letter, a in zip("ABC", answers):
        parts += [F.lit(f"{letter}. "), a, F.lit("\n")]
    return F.concat(*parts, F.lit("\nAnswer:"))


def pick_by_index(values: list[Column], idx: Column) -> Column:
    """values[idx] for idx in 0..n-1, NULL otherwise."""
    out = F.when(idx == 0, values[0])
    for i, v in enumerate(values[1:], start=1):
        out = out.when(idx == i, v)
    return out


def answer_label(idx: Column, answers: list[Column]) -> Column:
    letter = F.when(idx.between(0, 2), F.char(F.lit(65) + idx)).otherwise(idx.cast("string"))
    text = F.coalesce(pick_by_index(answers, idx), F.lit(""))
    return F.when(idx.isNull(), F.lit("not identified")).otherwise(F.concat(letter, F.lit(". "), text))


def item_line(category: Column, example: Column, question: Column, context: Column, polarity: Column) -> Column:
    s = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(
        F.lit("Category: "), s(category), F.lit(" | Example ID: "), s(example), F.lit(" | Question index: "), s(question),
        F.lit(" | Context: "), s(context), F.lit(" | Polarity: "), s(polarity),
    )


def parse_json_list(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def first_of(a: Column) -> Column:
    return F.coalesce(F.get(a, 0), F.lit(""))


def readable_join(a: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(a)), ", ")


def alpha_label(alpha: Column) -> Column:
    """Signed compact number text: +0.5, -3."""
    digits = F.regexp_replace(F.abs(alpha).cast("string"), r"\.0$", "")
    return F.concat(F.when(alpha >= 0, F.lit("+")).otherwise(F.lit("-")), digits)


def direction_label(alpha: Column) -> Column:
    return F.when(alpha > 0, F.lit("amplify_feature_direction")).otherwise(F.lit("suppress_feature_direction"))


def parse_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def token_norm(c: Column) -> Column:
    return F.translate(F.lower(strip(c)), K.SUBWORD_MARKERS.lower() + K.SUBWORD_MARKERS, "")


def content_terms(question: Column, extra_stopwords: list[str] = []) -> Column:
    words = F.regexp_extract_all(F.lower(question), F.lit("([a-z][a-z'-]+)"), 1)
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(K.STOPWORDS + list(extra_stopwords)))


WORD_GAP = r"[^\p{L}\p{N}]+"


def entity_span(prompt: Column, form: Column) -> Column:
    """struct(start, end, status) of a form in a prompt.

    Case-insensitive match first; else a match after punctuation runs become spaces, whose
    offsets count the characters of the prompt without white space.
    """
    at = F.position(F.lower(form), F.lower(prompt))
    blank = F.coalesce(strip(form), F.lit("")) == ""
    norm_prompt = F.regexp_replace(F.lower(prompt), WORD_GAP, " ")
    norm_form = F.trim(F.regexp_replace(F.lower(form), WORD_GAP, " "))
    norm_at = F.when(norm_form != "", F.position(norm_form, norm_prompt)).otherwise(F.lit(0))
    squeeze = lambda c: F.regexp_replace(c, r"\s+", "")
    prefix = squeeze(F.substr(norm_prompt, F.lit(1), norm_at - 1))
    compact = squeeze(norm_form)
    found = F.position(F.concat(prefix, compact), squeeze(F.lower(prompt))) > 0
    start = F.length(prefix)
    exact = ~blank & (at > 0)
    normalized = ~blank & (norm_at > 0)
    return F.struct(
        F.when(exact, at - 1).when(normalized & found, start).cast("int").alias("start"),
        F.when(exact, at - 1 + F.length(form)).when(normalized & found, start + F.length(compact)).cast("int").alias("end"),
        F.when(exact, F.lit("exact")).when(normalized, F.lit("normalized")).otherwise(F.lit("failed")).alias("status"),
    )


def section_spans(prompt: Column, context: Column, question: Column, answers: list[Column]) -> Column:
    """array<struct<name, start, end>> of the sections that occur in the prompt."""
    named = [("context", context), ("question", question)]
    named += [(f"ans{i}", F.concat(F.lit(f"{'ABC'[i]}. "), a)) for i, a in enumerate(answers)]
    spans = [
        F.struct(
            F.lit(n).alias("name"),
            (F.position(t, prompt) - 1).cast("int").alias("start"),
            (F.position(t, prompt) - 1 + F.length(t)).cast("int").alias("end"),
        )
        for n, t in named
    ]
    return F.filter(F.array(*spans), lambda s: s["start"] >= 0)


def json_map(pairs: Column) -> Column:
    """One JSON object from an array of (key, value) structs, keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(pairs)))
