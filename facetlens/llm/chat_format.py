"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is a list of parts. Text parts are escaped; image, audio and document parts become
placeholders ``<image>``, ``<audio>``, ``<document>`` in order, each recorded as an attachment with its
reference and the tokens it expands to. A turn is written ``<turn>role\\ntext</turn>\\n``; every control
string starts with ``<``, and inside texts ``\\`` is written ``\\b`` and ``<`` is written ``\\l``, so that no
text can hold one and the change can be undone. The loss mask has for each turn the span of its text
if the assistant speaks, else null.

Null texts, roles and parts count as empty. Turns with equal numbers are ordered by role, then text;
repeated rows stay. A null conv_id is a conversation of its own. An empty table gives no row. One
conversation becomes one value, since its digest covers all its turns; the work on texts is done
row by row before turns are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of an attachment by its kind: for a tile of an image, a second of audio, a page of a document.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 1024}
PART = "struct<kind string, text string, ref string, units int>"
OPEN, CLOSE = "<turn>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _line(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _role(line: Column) -> Column:
    return unescape(F.replace(line, F.lit("\\n"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """A text as the one part of its turn."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).alias("units")))


def flatten_parts(parts: Column) -> Column:
    """struct(body, attachments): the escaped text with placeholders, and what they stand for."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    is_file = lambda p: p["kind"].isin(*UNIT_TOKENS)
    body = F.array_join(F.transform(parts, lambda p: F.when(is_file(p), F.concat(F.lit("<"), p["kind"], F.lit(">"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))), "")
    tokens = lambda p: F.coalesce(p["units"], F.lit(1)) * F.coalesce(*[F.when(p["kind"] == k, F.lit(n)) for k, n in UNIT_TOKENS.items()])
    files = F.transform(F.filter(parts, is_file), lambda p, i: F.struct(i.alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    return F.struct(body.alias("body"), files.alias("attachments"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask, attachments, expanded_tokens of rows (conv_id, turn, role, parts)."""
    turns = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), flatten_parts(F.col("parts")).alias("flat"),
    ).select(
        "conv_id", F.struct("turn", "role", F.col("flat.body").alias("body"), F.col("flat.attachments").alias("attachments")).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    piece = lambda t: F.concat(F.lit(OPEN), _line(t["role"]), F.lit("\n"), t["body"], F.lit(CLOSE))
    # A span counts from the beginning of its turn.
    span = lambda t: F.when(t["role"] == "assistant", F.struct((F.length(_line(t["role"])) + len(OPEN) + 1).alias("begin"), F.length(t["body"]).alias("length")))
    files = F.flatten(F.transform("turns", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(i.alias("turn"), a["place"].alias("place"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return whole.select(
        "conv_id", F.array_join(F.transform("turns", piece), "").alias("formatted"), F.transform("turns", span).alias("loss_mask"), files.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text, loss_text) found in the formatted text and under its mask."""
    pieces = F.split(F.col("formatted"), CLOSE)
    # What follows the last close is empty, and has no entry in the mask.
    pairs = F.slice(F.arrays_zip(pieces.alias("piece"), F.col("loss_mask").alias("span")), 1, F.size("loss_mask"))

    def turn(p: Column) -> Column:
        inside = F.substr(p["piece"], F.lit(len(OPEN) + 1))
        role = F.substring_index(inside, "\n", 1)
        return F.struct(
            _role(role).alias("role"), unescape(F.substr(inside, F.length(role) + 2)).alias("text"),
            F.when(p["span"].isNotNull(), unescape(F.substr(p["piece"], p["span"]["begin"] + 1, p["span"]["length"]))).alias("loss_text"),
        )

    return formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.transform(pairs, turn).alias("turns"))


def digest(conversations: DataFrame) -> DataFrame:
    """What is read back from the formatted rows of a table (conv_id, turn, role, text)."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text_parts(F.col("text").cast("string")).alias("parts"))
    own = read_back(format_conversations(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: F.coalesce(t["loss_text"], F.lit(""))), "")
    return own.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"), "formatted_chars").select(
        "conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


#: The digest as SQL over ``conversations`` and one more conversation.
SQL = r"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, coalesce(role, '') AS who, coalesce(text, '') AS said FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), sized AS (
  SELECT *, replace(replace(said, '\', '\b'), '<', '\l') AS body, replace(replace(replace(who, '\', '\b'), '<', '\l'), chr(10), '\n') AS head FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(who || chr(10) || said || chr(10), '' ORDER BY turn NULLS FIRST, who, body)) AS turns_sha256,
  CAST(sum(CASE WHEN who = 'assistant' THEN length(said) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN who = 'assistant' THEN said ELSE '' END, '' ORDER BY turn NULLS FIRST, who, body)) AS loss_sha256,
  CAST(sum(6 + length(head) + 1 + length(body) + 8) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
