"""Working tables derived from the star-schema test tables.

Every view is computed by Spark from the given parquet tables (all rows, whole texts), so
the registered queries grow with them. Contrast lists, weight tables and parameter lists
are the small model-side inputs; they are built from rules. ``sqlviews`` states the same
definitions in SQL.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetlens.functions.settle import settle
from facetlens.operators import codes, experiment, grid, items
from facetlens.operators.means import residualize
from facetlens.operators.tokens import TokenLists

LAYERS = [8, 16, 24]
RESID = {"raw": None, "family": "family", "template": "template_id", "form": "required_form"}
N_FEATURES = 96
TOP_K = 8
DIM = 64

CONTRASTS = [
    ("g0_vs_g3", "ax0", "g0", "g3"),
    ("g3_vs_g6", "ax0", "g3", "g6"),
    ("g6_vs_g9", "ax0", "g6", "g9"),
    ("g1_vs_g4", "ax1", "g1", "g4"),
    ("g4_vs_g7", "ax1", "g4", "g7"),
    ("g2_vs_g5", "ax2", "g2", "g5"),
    ("g0_vs_g99", "ax0", "g0", "g99"),
]
CONTRAST_SCHEMA = "contrast_name string, axis string, entity_a string, entity_b string"
RESID_KEYS = ["layer", "resid"]

TOKEN_FEATURES = [3, 17, 40]
RESULT_ALPHAS = [-1.0, -0.5, 0.5, 1.0, 2.0]
RESULT_POSITIONS = ["final_prompt_token", "target_identity_last_token"]
RESULT_SET_COLS = ["set_no", "feature_set_id", "layer", "feature_roles_json", "feature_contrast_name", "set_axis", "set_control"]
RESULT_SETS = [
    (0, "L08_feature_00003", 8, '["identity_token_local"]', "race_black_vs_race_white", "race_ethnicity", "kept_feature"),
    (1, "L16_age_bundle", 16, '["shared_social_feature", "low_signal"]', "", "age", "kept_feature"),
    (2, "L24_low_top3", 24, '["contrast_specific_identity"]', "ses_low_income_vs_ses_rich", "socioeconomic_status", "kept_feature"),
    (3, "L24_template_artifact_control_top20", 24, '["template_or_syntax_artifact"]', "", "", "template_artifact_features"),
    (4, "L16_gender_role", 16, "not json", "", "gender_identity", "kept_feature"),
    (5, "L08_feature_00040", 8, "[]", "sexuality_gay_vs_sexuality_straight", "sexual_orientation", "kept_feature"),
]
FORM_COLUMNS = ["adj_form", "noun_form", "plural_noun_form", "with_form"]
ITEM_CATEGORIES = ["Race_ethnicity", "SES", "Gender_identity", "Race_x_SES", "Age", "Sexual_orientation"]
ITEM_LABELS = [
    "unknown", "Black", "F-Black", "lowSES-Hispanic", "Muslim", "zzz-unmapped", "nonOld", "gay",
    "old", "White", "M-White", "highSES", "Af rican", "F", "straight", "poor",
]
ITEM_CONTRASTS = [
    (f"{a}_vs_{b}", a, b, axis)
    for a, b, axis in [
        ("race_black", "race_white", "race_ethnicity"),
        ("race_hispanic", "race_white", "race_ethnicity"),
        ("sexuality_gay", "sexuality_straight", "sexual_orientation"),
        ("age_old", "age_nonold", "age"),
        ("ses_low_income", "ses_high_socioeconomic_status", "socioeconomic_status"),
        ("gender_man", "gender_woman", "gender_identity"),
    ]
]


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


class Views:
    """Lazily built working tables of one input folder.

    Within a session the same object is reused, so an intermediate table that one query
    has settled serves the next. ``forget`` starts afresh (the bench does so every time).
    """

    _open: dict[tuple[str, str], "Views"] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Views":
        key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
        if key not in cls._open:
            cls._open[key] = cls(spark, sf_dir)
        return cls._open[key]

    @classmethod
    def forget(cls) -> None:
        cls._open.clear()

    def memo(self, key, build):
        """``build()`` once per ``key``."""
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._memo: dict = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self) -> int:
        """Partitions for a small table whose rows are about to multiply."""
        return max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    # ---- labelled vectors -------------------------------------------------
    @cached_property
    def meta(self) -> DataFrame:
        return _label_rows(self.table("embeddings"))

    @cached_property
    def vectors(self) -> DataFrame:
        """(layer, row_id, vec) with labels; the three layers are scaled copies."""
        src = self.table("embeddings").withColumn(
            "layer", F.explode(F.array(*[F.lit(x) for x in LAYERS]))
        )
        factor = lambda i: F.lit(1.0) + F.col("layer") * F.lit(0.01) * ((i % 3) - 1)
        vec = F.transform("embedding", lambda x, i: x.cast("double") * factor(i))
        return _label_rows(src.withColumn("vec", vec), "layer", "vec")

    @cached_property
    def resid_vectors(self) -> DataFrame:
        return residualize(self.vectors, RESID)

    @cached_property
    def contrasts(self) -> DataFrame:
        return self.spark.createDataFrame(CONTRASTS, CONTRAST_SCHEMA)

    # ---- sparse features ----------------------------------------------------
    @cached_property
    def enc_weights(self) -> DataFrame:
        """(layer, feature_id, w, b) from the fixture rule."""
        return self._weights(
            F.transform(_positions(), lambda i: ((i * 31 + F.col("feature_id") * 17) % 23 - 11) / F.lit(11.0)).alias("w"),
            (((F.col("feature_id") % 5) - 2) * F.lit(0.01)).alias("b"),
        )

    @cached_property
    def dec_weights(self) -> DataFrame:
        return self._weights(
            F.transform(_positions(), lambda i: ((F.col("feature_id") * 13 + i * 7) % 19 - 9) / F.lit(9.0)).alias("w")
        )

    @cached_property
    def dec_bias(self) -> DataFrame:
        """(layer, vec): a decoder bias that is not zero, from the fixture rule."""
        layers = self.spark.createDataFrame([(x,) for x in LAYERS], "layer int")
        return layers.select("layer", F.transform(_positions(), lambda i: ((i * 5 + F.col("layer")) % 7 - 3) / F.lit(20.0)).alias("vec"))

    def _weights(self, *cols: Column) -> DataFrame:
        ids = self.spark.range(N_FEATURES).select(F.col("id").cast("int").alias("feature_id"))
        layers = F.explode(F.array(*[F.lit(x) for x in LAYERS])).alias("layer")
        return ids.select(layers, "feature_id", *cols)

    @cached_property
    def code_arrays(self) -> DataFrame:
        """(layer, row_id, indices, values): the top-k codes of each vector."""
        return settle(codes.linear_relu_topk(self.vectors, self.enc_weights, TOP_K), "codes")

    @cached_property
    def codes(self) -> DataFrame:
        """(layer, row_id, feature_id, activation), positive only."""
        return codes.codes_to_long(self.code_arrays)

    @cached_property
    def layer_meta(self) -> DataFrame:
        """Label rows repeated per layer (no vector column is read)."""
        return self.vectors.drop("vec")

    # ---- prompts and items ----------------------------------------------------
    @cached_property
    def forms(self) -> DataFrame:
        """Wide entity forms from the suppliers: blanks, NULLs, padded text, shared aliases."""
        k = F.col("s_suppkey")
        n = self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
        src = self.table("supplier").join(n, "s_nationkey")
        ks = _s(k)
        return src.select(
            F.concat(F.lit("grp_"), ks).alias("entity"),
            F.concat(F.lit("ax"), _s(k % 3)).alias("axis"),
            F.concat(F.lit("Group "), ks).alias("canonical_label"),
            F.concat(F.lower("n_name"), F.lit(" "), ks).alias("adj_form"),
            F.when(k % 4 != 0, F.concat(F.lit("a member of group "), ks)).alias("noun_form"),
            F.when(k % 7 == 0, F.lit("   ")).otherwise(F.concat(F.lit("members "), ks)).alias("plural_noun_form"),
            F.when(k % 5 == 0, F.lit("NA")).when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" with tag "), ks, F.lit(" "))).alias("with_form"),
            F.when(k % 11 == 0, F.lit("")).otherwise(
                F.concat(F.lit("Grp-"), ks, F.lit(";g_"), ks, F.lit("; dup"), _s(F.floor(k / 2)))
            ).alias("aliases"),
            k.alias("source_order"),
            F.col("s_name").alias("entity_notes"),
        )

    @cached_property
    def templates(self) -> DataFrame:
        """Templates from the distinct part names and types; some trigger the lint."""
        src = self.table("part").select("p_name", "p_type").distinct()
        name, kind = F.col("p_name"), F.col("p_type")
        return src.select(
            F.concat(F.replace(name, F.lit(" "), F.lit("_")), F.lit("_"), kind).alias("template_id"),
            F.lower(kind).alias("family"),
            F.when((kind == "PROMO") & name.startswith("red"), F.concat(F.lit("one a "), name, F.lit(" has is {form}.")))
            .otherwise(F.concat(F.lit("the "), name, F.lit(" is {form}."))).alias("template_text"),
            F.get(F.array(*[F.lit(f) for f in FORM_COLUMNS]), F.length(name) % 4).alias("required_form"),
            F.lit("singular").alias("number"),
            F.concat(F.lit(" "), kind).alias("notes"),
        )

    @cached_property
    def manual(self) -> DataFrame:
        return items.manual_aliases(self.spark)

    @cached_property
    def aliases(self) -> DataFrame:
        return items.alias_table(self.forms, self.manual, ["entity", "canonical_label", *FORM_COLUMNS], "source_order")

    @cached_property
    def raw_items(self) -> DataFrame:
        """One answer-choice item per document; its whole text is the context."""
        d = F.col("doc_id")
        pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), (i % len(xs)).cast("int"))
        label = lambda j: F.when((F.lit(j) == 2) & (d % 3 == 0), F.lit("unknown")).when(
            (F.lit(j) == 1) & (d % 13 == 0), F.concat(F.lit("g_"), _s(d % 90))
        ).otherwise(pick(ITEM_LABELS, d * 3 + j * 5 + F.floor(d / 16)))
        text = lambda l: F.when(l == "unknown", F.lit("Not enough information")).otherwise(F.concat(F.lit("The "), l, F.lit(" person")))
        labels = [label(j) for j in range(3)]
        stereo = F.when(d % 5 == 4, F.array(F.lit("Jewish"))).when(
            d % 4 == 0, F.array(labels[0], pick(ITEM_LABELS, d * 11))
        ).otherwise(F.array(labels[0]))
        cat = pick(ITEM_CATEGORIES, d)
        ctx = F.when(d % 2 == 0, F.lit("ambig")).otherwise(F.lit("disambig"))
        pol = F.when(F.floor(d / 2) % 2 == 0, F.lit("neg")).otherwise(F.lit("nonneg"))
        return self.table("documents").select(
            F.concat_ws(":", F.lower(cat), _s(d), _s(d % 7), ctx, pol, F.col("source")).alias("item_uid"),
            d.alias("example_id"), (d % 7).alias("question_index"), cat.alias("category_raw"),
            ctx.alias("context_condition"), pol.alias("question_polarity"), F.col("text").alias("context"),
            F.concat(F.lit("Who is likely the "), F.col("source"), F.lit(" speaker of "), F.col("lang"), F.lit(" words that don't end?")).alias("question"),
            *[text(x).alias(f"ans{j}") for j, x in enumerate(labels)],
            F.when(d % 17 != 0, (d % 3).cast("int")).alias("correct_answer_idx"),
            F.array(*labels).alias("answer_labels"), F.array(*[text(x) for x in labels]).alias("answer_texts"),
            stereo.alias("stereotyped_groups"), F.col("source").alias("source_file"), d.alias("doc_id"),
        )

    @cached_property
    def item_contrasts(self) -> DataFrame:
        return self.spark.createDataFrame(ITEM_CONTRASTS, "contrast_name string, entity_a string, entity_b string, axis string")

    @cached_property
    def prepared(self) -> DataFrame:
        return settle(items.prepare_items(self.raw_items, self.aliases, self.item_contrasts), "prepared")

    @cached_property
    def results(self) -> DataFrame:
        """Scored experiment rows: every item x set x alpha x position."""
        d = F.col("doc_id")
        sets = F.array(*[
            F.struct(*[F.lit(x).alias(n) for n, x in zip(RESULT_SET_COLS, row)]) for row in RESULT_SETS
        ])
        arr = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
        keep = [
            "item_uid", "doc_id", "axis_mapped", "category_raw", "context_condition", "question_polarity", "mapped_contrast_name",
            "stereotyped_answer_idx", "nonstereotyped_answer_idx", "unknown_answer_idx", "correct_answer_idx",
        ]
        # Scores need no text: items are written without their contexts and prompts. An item turns
        # into dozens of rows, so the narrow items are spread out first.
        narrow = settle(items.prepare_items(self.raw_items, self.aliases, self.item_contrasts).select(*keep), "scored-items")
        spread = narrow.repartition(self.spread(), "item_uid")
        r = spread.select(*keep, F.explode(sets).alias("_s")).select(*keep, "_s.*")
        r = r.withColumn("alpha", arr(RESULT_ALPHAS)).withColumn("intervention_position", arr(RESULT_POSITIONS))
        s = F.col("set_no")
        base = lambda j: -((d * 37 + s * 11 + j * 53) % 997) / F.lit(100.0)
        move = lambda j: F.col("alpha") * (((d + s * 5 + j * 3) % 7) - 3) / F.lit(10.0)
        r = r.withColumns({f"ans{j}_logprob_base": base(j) for j in range(3)})
        r = r.withColumns({f"ans{j}_logprob_intervened": F.col(f"ans{j}_logprob_base") + move(j) for j in range(3)})
        r = r.withColumn("control_type", grid.control_type_of(F.col("set_control"), F.col("set_axis"), F.col("axis_mapped")))
        return experiment.choice_metrics(r.withColumn("feature_set_mode", F.lit("fixture")))

    @cached_property
    def labelled_results(self) -> DataFrame:
        return settle(experiment.experiment_labels(self.results), "results")

    def labelled(self, cols: list[str], once: bool = False) -> DataFrame:
        """Some columns of the labelled results; written, unless they are read only ``once``."""
        out = experiment.experiment_labels(self.results).select(*dict.fromkeys(cols))
        return out if once else settle(out, "results")

    # ---- tokens ---------------------------------------------------------------
    @cached_property
    def doc_tokens(self) -> DataFrame:
        """Every token of every document with offsets, a zero-width special token first."""
        return self._doc_tokens([])

    def _doc_tokens(self, carry: list[str]) -> DataFrame:
        return _text_tokens(self._labelled_docs(carry), "prompt_id", "text", carry)

    def _labelled_docs(self, carry: list[str]) -> DataFrame:
        d = F.col("prompt_id")
        labels = {
            "entity": F.concat(F.lit("g"), _s(d % 10)), "axis": F.concat(F.lit("ax"), _s(d % 3)),
            "family": F.concat(F.lit("fam"), _s(d % 5)), "template_id": F.concat(F.lit("t"), _s(d % 25)),
        }
        docs = self.table("documents").select(F.col("doc_id").alias("prompt_id"), "text")
        return docs.withColumns({c: labels[c] for c in carry}) if carry else docs

    @cached_property
    def tokens(self) -> DataFrame:
        d, i, f = F.col("prompt_id"), F.col("token_idx"), F.col("feature_id")
        labels = ["entity", "axis", "family", "template_id"]
        t = self._doc_tokens(labels).withColumn("feature_id", _token_features())
        return t.select(
            F.lit(24).alias("layer"), "feature_id", "prompt_id", "token_idx", "token_str", "token_start_char", "token_end_char",
            _token_activation(d).alias("token_feature_activation"),
            (F.col("token_end_char") <= F.col("token_start_char")).alias("is_special_token"),
            i.between(3, 5).alias("is_entity_span_token"),
            F.when(d % 3 != 0, ((d * 7 + f * 29) % 97) / F.lit(100.0)).alias("final_token_feature_activation"),
            *labels,
        )

    @cached_property
    def token_lists(self) -> TokenLists:
        """The rows of ``tokens`` as token lists: one a text, made where the text lies."""
        labels = ["entity", "axis", "family", "template_id"]
        return _text_token_lists(self._labelled_docs(labels), "prompt_id", "text", labels)

    @cached_property
    def item_tokens(self) -> DataFrame:
        """Positive token activations of items; item columns travel with the text, no join."""
        src = self.raw_items.withColumn("_last", F.size(F.split("context", " ")))
        carry = ["doc_id", "_last", "context_condition", "question_polarity", "category_raw"]
        i = F.col("token_idx")
        t = _text_tokens(src, "item_uid", "context", carry).withColumn("feature_id", _token_features())
        act = _token_activation(F.col("doc_id"))
        return t.withColumn("feature_activation", act).filter("feature_activation > 0").select(
            F.lit(24).alias("layer"), "feature_id", "item_uid", "token_idx", "token_str", "token_start_char", "token_end_char", "feature_activation",
            (i % 11 == 2).alias("is_target_token"), (i % 13 == 3).alias("is_nontarget_token"),
            (i % 7 == 1).alias("is_stereotype_language_token"), (i % 17 == 5).alias("is_answer_option_token"),
            (i == F.col("_last")).alias("is_final_prompt_token"), "context_condition", "question_polarity", "category_raw",
        )


#: Characters of text in a part; their tokens are multiplied by features.
TEXT_CHARS = 4 << 20
BEGIN = "<|begin_of_text|>"


def _text_tokens(src: DataFrame, key: str, text: str, carry: list[str]) -> DataFrame:
    """Space-separated tokens of a text with character offsets, after a special token.

    The texts are dealt into parts of about TEXT_CHARS, and offsets are summed up where a text lies: its
    tokens are neither shuffled nor sorted for them, and what a task makes of its part stays in memory. Texts
    that share a key go on in one another's offsets: those alone are numbered by a window.
    """
    once, many = _dealt_texts(src, key, text, carry)
    schema = once.drop(text).withColumns({"_tokens": F.array(F.lit("")), "_starts": F.array(F.lit(0))}).schema
    placed = once.mapInArrow(_with_starts, schema).select(key, *carry, "_tokens", F.posexplode("_starts").alias("token_idx", "token_start_char"))
    placed = placed.select(key, *carry, "token_idx", F.get("_tokens", "token_idx").alias("token_str"), "token_start_char")
    return placed.unionByName(many).withColumn("token_end_char", _token_end())


def _token_end() -> Column:
    return F.when(F.col("token_idx") == 0, F.col("token_start_char")).otherwise(F.col("token_start_char") + F.length("token_str"))


def _dealt_texts(src: DataFrame, key: str, text: str, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """Texts with a key of their own, in parts of about TEXT_CHARS, and the numbered token rows of those that share one."""
    size = src.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    parts = max(src.sparkSession.sparkContext.defaultParallelism, -(-size // TEXT_CHARS))
    tokens = F.concat(F.array(F.lit(BEGIN)), F.split(text, " "))
    twice = settle(src.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key"), "repeated-keys")
    same = F.col(key).eqNullSafe(F.col("_key"))

    once = src.select(key, *carry, text).join(twice, same, "left_anti").filter(F.col(text).isNotNull()).repartition(parts, key)

    many = src.select(key, *carry, text).join(twice, same, "left_semi").select(key, *carry, F.posexplode(tokens).alias("token_idx", "token_str"))
    width = F.when(F.col("token_idx") == 0, F.lit(0)).otherwise(F.length("token_str") + 1)
    w = Window.partitionBy(key).orderBy("token_idx").rowsBetween(Window.unboundedPreceding, -1)
    return once, many.withColumn("token_start_char", F.coalesce(F.sum(width).over(w), F.lit(0)).cast("int"))


#: Columns of token lists: by token, by feature and token (all tokens of the first feature, then of the second), by feature.
LISTS = {
    "token_idx": "int", "token_str": "string", "token_start_char": "int", "token_end_char": "int",
    "is_special_token": "boolean", "is_entity_span_token": "boolean",
    "token_feature_activation": "double", "feature_id": "int", "final_token_feature_activation": "double",
}


def _text_token_lists(src: DataFrame, key: str, text: str, carry: list[str]) -> TokenLists:
    """The tokens of ``_text_tokens`` with flags and activations, a list a text; of texts that share a key, every token is a list."""
    once, many = _dealt_texts(src, key, text, carry)
    schema = once.drop(text).withColumns({"layer": F.lit(24), **{c: F.array().cast(f"array<{t}>") for c, t in LISTS.items()}}).schema

    def make(batches):
        m = len(TOKEN_FEATURES)
        for batch in _with_starts(batches):
            words, starts = (batch.column(c).flatten() for c in ("_tokens", "_starts"))
            n = batch.column("_tokens").value_lengths().to_numpy().astype(np.int64)
            upto = np.r_[0, np.cumsum(n)]
            first = np.repeat(upto[:-1], n)
            idx = np.arange(len(words)) - first
            starts = starts.to_numpy()
            ends = starts + np.where(idx == 0, 0, pc.utf8_length(words).to_numpy())
            doc = batch.column(key).fill_null(0).to_numpy().astype(np.int64)
            unknown = batch.column(key).is_null().to_numpy(zero_copy_only=False)
            act, place, step = np.empty(m * len(words)), m * first + idx, np.repeat(n, n)
            base = np.repeat(doc * 7, n) + idx * 13
            for i, f in enumerate(TOKEN_FEATURES):
                act[place + i * step] = np.fmod(base + f * 29, 101) / 100.0
            final = np.fmod(doc[:, None] * 7 + np.array(TOKEN_FEATURES) * 29, 97) / 100.0
            by_feature = pa.array(np.arange(0, m * len(n) + 1, m), pa.int32())
            by_token = [
                pa.array(idx, pa.int32()), words, pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(ends <= starts), pa.array((idx >= 3) & (idx <= 5)),
            ]
            lists = [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), x) for x in by_token]
            lists.append(pa.ListArray.from_arrays(pa.array(m * upto, pa.int32()), pa.array(act, mask=np.repeat(unknown, m * n))))
            lists.append(pa.ListArray.from_arrays(by_feature, pa.array(np.tile(TOKEN_FEATURES, len(n)), pa.int32())))
            lists.append(pa.ListArray.from_arrays(by_feature, pa.array(final.ravel(), mask=np.repeat(unknown | (np.fmod(doc, 3) == 0), m))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(np.full(len(n), 24), pa.int32()), *lists], schema.names)

    d, t = F.col(key), F.col("token_idx")
    many = many.withColumn("token_end_char", _token_end()).withColumns({
        "layer": F.lit(24), "is_special_token": F.col("token_end_char") <= F.col("token_start_char"), "is_entity_span_token": t.between(3, 5),
    })
    by_feature = {
        "token_feature_activation": lambda f: ((d * 7 + t * 13 + f * 29) % 101) / F.lit(100.0), "feature_id": F.lit,
        "final_token_feature_activation": lambda f: F.when(d % 3 != 0, ((d * 7 + f * 29) % 97) / F.lit(100.0)),
    }
    lists = [F.array(*[by_feature[c](f) for f in TOKEN_FEATURES] if c in by_feature else [F.col(c)]).alias(c) for c in LISTS]
    return TokenLists(once, make, schema, many.select(key, *carry, "layer", *lists))


def _with_starts(batches):
    """Batches whose last column, a text, becomes its tokens (the special one and the space-separated ones) and their starts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            text = part.column(part.num_columns - 1)
            tokens = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(BEGIN, text.type), text, pa.scalar(" ", text.type)), " ")
            first = tokens.offsets.to_numpy().astype(np.int64)
            words = tokens.flatten()
            width = pc.utf8_length(words).to_numpy().astype(np.int64) + 1
            first -= first[0]
            # The special token, each text's first, takes no place.
            width[first[:-1]] = 0
            upto = np.r_[0, np.cumsum(width)]
            starts = upto[:-1] - np.repeat(upto[first[:-1]], np.diff(first))
            lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), x) for x in (words, pa.array(starts, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *lists], [*part.schema.names[:-1], "_tokens", "_starts"])


def _token_features() -> Column:
    return F.explode(F.array(*[F.lit(x) for x in TOKEN_FEATURES]))


def _token_activation(doc: Column) -> Column:
    return ((doc * 7 + F.col("token_idx") * 13 + F.col("feature_id") * 29) % 101) / F.lit(100.0)


def _positions() -> Column:
    return F.sequence(F.lit(0), F.lit(DIM - 1))


def _label_rows(df: DataFrame, *extra: str) -> DataFrame:
    v = F.col("vec_id")
    return df.select(
        v.alias("row_id"),
        F.concat(F.lit("g"), _s("label")).alias("entity"),
        F.concat(F.lit("ax"), _s(F.col("label") % 3)).alias("axis"),
        F.concat(F.lit("Group "), _s("label")).alias("canonical_label"),
        F.concat(F.lit("fam"), _s(v % 5)).alias("family"),
        F.concat(F.lit("t"), _s(v % 25)).alias("template_id"),
        F.concat(F.lit("form"), _s(F.floor(v / 5) % 3)).alias("required_form"),
        *extra,
    )
