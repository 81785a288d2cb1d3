"""Readers with explicit schemas, alignment checks, column conformance, writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlens.functions import constants as K
from facetlens.functions.text import norm_text
from facetlens.sources.records import read_csv_ranges

PROMPT_COLUMNS = [
    "prompt_id", "template_id", "family", "template_text", "required_form", "form_used", "number", "entity", "axis",
    "canonical_label", "prompt", "template_notes", "entity_notes",
]
PROMPT_REQUIRED = ["prompt_id", "template_id", "family", "required_form", "entity", "axis", "canonical_label", "prompt"]

ITEM_SCHEMA = T.StructType([
    T.StructField("example_id", T.LongType()),
    T.StructField("question_index", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("context_condition", T.StringType()),
    T.StructField("question_polarity", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("ans0", T.StringType()),
    T.StructField("ans1", T.StringType()),
    T.StructField("ans2", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("answer_info", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("additional_metadata", T.StructType([
        T.StructField("subcategory", T.StringType()),
        T.StructField("stereotyped_groups", T.ArrayType(T.StringType())),
    ])),
])


def read_csv_text(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with every column as text; blanks stay '' and the text NA stays text."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    else:
        reader = reader.option("inferSchema", False)
    return reader.csv(path).na.fill("")


def read_prompt_metadata(spark: SparkSession, path: str, required: list[str] = PROMPT_REQUIRED) -> DataFrame:
    """Prompt table from CSV; missing required columns or blank prompts are errors.

    One large file is read by many tasks, whatever line breaks its quoted fields hold.
    """
    df = read_csv_ranges(spark, path).na.fill("")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"prompt metadata lacks columns {missing}")
    if not df.filter(F.trim("prompt") == "").limit(1).isEmpty():
        raise ValueError("prompt metadata has blank prompts")
    return df


def vector_alignment(vectors: DataFrame, meta: DataFrame, requested: list[int]) -> DataFrame:
    """Per requested layer: presence, row counts both ways, dimension range."""
    spark = vectors.sparkSession
    want = spark.createDataFrame([(x,) for x in requested], "layer int")
    per = vectors.groupBy("layer").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.size("vec")).alias("min_dim"), F.max(F.size("vec")).alias("max_dim")
    )
    ids = vectors.select("layer", "row_id")
    unlabelled = ids.join(meta.select("row_id"), "row_id", "left_anti").groupBy("layer").agg(F.count(F.lit(1)).alias("n_unlabelled"))
    matched = ids.join(meta.select("row_id"), "row_id", "left_semi").groupBy("layer").agg(F.countDistinct("row_id").alias("_m"))
    total = meta.select(F.countDistinct("row_id")).scalar()
    out = want.join(per, "layer", "left").join(unlabelled, "layer", "left").join(matched, "layer", "left")
    return out.select(
        "layer", F.col("n_rows").isNotNull().alias("present"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("n_unlabelled", F.lit(0)).alias("n_unlabelled"),
        F.when(F.col("n_rows").isNotNull(), total - F.coalesce("_m", F.lit(0))).alias("n_missing_vectors"), "min_dim", "max_dim",
    )


def read_vectors_aligned(vectors: DataFrame, meta: DataFrame, requested: list[int]) -> DataFrame:
    """Vectors of the requested layers; a missing layer or differing row sets is an error."""
    report = vector_alignment(vectors, meta, requested)
    bad = report.filter("NOT present OR n_unlabelled > 0 OR n_missing_vectors > 0 OR min_dim <> max_dim").limit(20).collect()
    if bad:
        raise ValueError(f"vectors are not aligned with the metadata: {bad}")
    return vectors.filter(F.col("layer").isin(requested))


def missing_requested(requested: DataFrame, available: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(available.select(key).distinct(), key, "left_anti")


def vector_weight_alignment(vectors: DataFrame, weights: DataFrame, names: DataFrame) -> DataFrame:
    """Vector against weight dimension per layer, with layer / position / width from the name."""
    vd = vectors.groupBy("layer").agg(F.max(F.size("vec")).alias("vector_dim"))
    wd = weights.groupBy("layer").agg(
        F.min(F.size("w")).alias("weight_dim_min"), F.max(F.size("w")).alias("weight_dim"), F.count(F.lit(1)).alias("n_features")
    )
    main = r"L(\d+)([A-Za-z])-(\d+)x"
    alt = r"(?i)layer[_\-.]?(\d+).*?(R|resid|residual).*?(\d+)x"
    group = lambda i: F.coalesce(
        F.nullif(F.regexp_extract("name", main, i), F.lit("")), F.nullif(F.regexp_extract("name", alt, i), F.lit(""))
    )
    pos = group(2)
    parsed = names.select(
        "layer", "name", F.try_to_number(group(1), F.lit("999999")).cast("int").alias("name_layer"),
        F.when(F.lower(pos).isin("resid", "residual"), F.lit("R")).otherwise(F.upper(pos)).alias("name_position"),
        F.try_to_number(group(3), F.lit("999999")).cast("int").alias("name_width"),
    )
    ok = (
        (F.coalesce("name_layer", F.col("layer")) == F.col("layer")) & (F.coalesce("name_position", F.lit("R")) == "R")
        & (F.col("weight_dim") == F.col("vector_dim")) & (F.col("weight_dim_min") == F.col("weight_dim"))
    )
    return parsed.join(vd, "layer", "left").join(wd, "layer", "left").withColumn("passed", F.coalesce(ok, F.lit(False))).withColumn(
        "parse_status", F.when(F.col("name_layer").isNull(), F.lit("failed")).otherwise(F.lit("parsed"))
    )


def read_result_parts(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Union of all ``part_*`` Parquet and CSV outputs of a folder, under one schema."""
    parts = []
    for pattern, reader in (("part_*.parquet", lambda p: spark.read.schema(schema).parquet(p)),
                            ("part_*.csv", lambda p: spark.read.schema(schema).option("header", True).csv(p))):
        path = f"{folder}/{pattern}"
        if _glob_has_files(spark, path):
            parts.append(reader(path))
    if not parts:
        raise FileNotFoundError(f"no result parts in {folder}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _glob_has_files(spark: SparkSession, pattern: str) -> bool:
    """Whether a glob matches anything, asked through Spark's own file source."""
    try:
        return not spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).select("path").limit(1).isEmpty()
    except Exception as e:  # an unmatched glob is reported as a missing path
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def read_items_jsonl(spark: SparkSession, folder: str, categories: list[str] | None = None) -> DataFrame:
    """JSONL items with the source file name; optionally only files of given categories."""
    df = spark.read.schema(ITEM_SCHEMA).json(folder).select("*", F.col("_metadata.file_name").alias("source_file"))
    if categories is None:
        return df
    stem = F.regexp_replace("source_file", r"\.[^.]*$", "")
    norm_stem = F.replace(norm_text(stem), F.lit(" "), F.lit("_"))
    wanted = [F.replace(norm_text(F.lit(c)), F.lit(" "), F.lit("_")) for c in categories]
    return df.filter(norm_stem.isin(wanted))


def read_raw_items(spark: SparkSession, folder: str, categories: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, bad lines) of JSON lines whose fields may be absent or of another kind.

    Lines are read as VARIANT values, so that no schema has to hold for all of them. Items have the input
    columns of ``assign_answer_roles`` and their descriptive fields. Defaults: the file's stem
    as category, a hash of the line as example id, empty texts and lists; an answer's label
    falls back to its text; a label that is no whole number is NULL. Bad lines (line, source_file) are
    those that hold no JSON object; blank lines are neither.
    """
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_name").alias("source_file")).filter(F.trim("value") != "")
    parsed = lines.withColumn("v", F.try_parse_json("value"))
    is_item = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    bad = parsed.filter(~is_item).select(F.col("value").alias("line"), "source_file")
    text = lambda path: F.try_variant_get("v", path, "string")
    stem = F.regexp_replace("source_file", r"\.[^.]*$", "")
    items = parsed.filter(is_item)
    if categories is not None:
        plain = lambda c: F.replace(norm_text(c), F.lit(" "), F.lit("_"))
        items = items.filter(plain(stem).isin([plain(F.lit(c)) for c in categories]))
    info = [F.try_variant_get("v", f"$.answer_info.ans{i}", "array<string>") for i in range(3)]
    answer = [F.coalesce(F.get(a, F.lit(0)), F.lit("")) for a in info]
    label = [F.when(F.size(a) > 1, F.coalesce(F.get(a, F.lit(1)), F.lit(""))).otherwise(t) for a, t in zip(info, answer)]
    groups = F.try_variant_get("v", "$.additional_metadata.stereotyped_groups", "array<string>")
    whole = F.try_variant_get("v", "$.label", "int")
    plain_text = lambda name: F.coalesce(text(f"$.{name}"), F.lit("")).alias(name)
    out = items.select(
        F.coalesce(text("$.example_id"), F.md5("value")).alias("example_id"), plain_text("question_index"), F.coalesce(text("$.category"), stem).alias("category_raw"),
        F.coalesce(text("$.additional_metadata.subcategory"), F.lit("")).alias("subcategory"),
        *[plain_text(c) for c in ("context_condition", "question_polarity", "context", "question", "ans0", "ans1", "ans2")],
        whole.alias("correct_answer_idx"), F.array(*answer).alias("answer_texts"), F.array(*label).alias("answer_labels"),
        F.coalesce(F.filter(groups, lambda g: g.isNotNull()), F.array().cast("array<string>")).alias("stereotyped_groups"), "source_file", stem.alias("_stem"),
    )
    uid = F.concat_ws(":", "_stem", "example_id", "question_index", "context_condition", "question_polarity", "source_file")
    return out.select(uid.alias("item_uid"), *[c for c in out.columns if c != "_stem"]), bad


def conform_columns(df: DataFrame, aliases: dict[str, list[str]] = K.METRIC_ALIASES, numeric: list[str] = K.METRIC_NUMERIC) -> DataFrame:
    """First existing alias becomes the canonical column; numeric columns are coerced, bad text to NULL."""
    out = df.withColumnsRenamed({c: c.strip() for c in df.columns if c != c.strip()})
    for canonical, names in aliases.items():
        if canonical not in out.columns:
            hit = next((n for n in names if n in out.columns), None)
            if hit:
                out = out.withColumnRenamed(hit, canonical)
    casts = {c: F.nullif(F.expr(f"try_cast(`{c}` AS DOUBLE)"), F.lit(float("nan"))) for c in numeric if c in out.columns}
    return out.withColumns(casts) if casts else out


def read_token_tables(spark: SparkSession, parquet: str | None, csv: str | None, layer: int, columns: list[str]) -> DataFrame:
    """Token rows of a layer: Parquet if given, else CSV; the layer column is added if absent."""
    df = spark.read.parquet(parquet) if parquet else read_csv_text(spark, csv)
    df = conform_columns(df, K.TOKEN_ALIASES, K.TOKEN_NUMERIC)
    if "layer" not in df.columns:
        df = df.withColumn("layer", F.lit(float(layer)))
    keep = df.filter(F.expr("try_cast(layer AS INT)") == layer)
    return keep.select(*[c for c in columns if c in keep.columns])


def write_table(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists", csv: bool = False, partition_by: list[str] = []) -> None:
    """Parquet (and CSV) with a fixed column list; an existing output is refused unless ``mode`` says otherwise."""
    out = df.select(*columns)
    out.write.mode(mode).partitionBy(*partition_by).parquet(f"{path}.parquet")
    if csv:
        out.write.mode(mode).option("header", True).csv(f"{path}.csv")


def drop_duplicates_ordered(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order, reduced in every task before the shuffle."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.min_by(whole, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_r"))
    return best.select("_r.*")


__all__ = [
    "conform_columns", "drop_duplicates_ordered", "missing_requested", "read_csv_text", "read_items_jsonl",
    "read_prompt_metadata", "read_result_parts", "read_token_tables", "read_vectors_aligned", "vector_alignment",
    "vector_weight_alignment", "write_table",
]
