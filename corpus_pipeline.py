"""The training-corpus pipeline: five stages over ``documents``.

A stage is ``fn(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``. Texts that stay null, empty tables, repeated rows,
repeated or null ids and extra columns are allowed everywhere: where ids are
null or repeat, rows get numbers of their own for the operators that compare
documents. Nothing here looks at one part of the documents only.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm import jaccard, langid, packing, pii, repeats
from trendspark.llm.queries import PII_KEY, tokenizer_path
from trendspark.session import materialize

ROW = "__row"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 20  # of text that a Python worker is handed at a time, beside one longer row; no result depends on it


def _bounded(spark: SparkSession) -> None:
    """Let Arrow batches be bounded by their bytes: workers keep the memory of
    the largest batch they met, and the stages share their workers."""
    spark.conf.set(BATCH, str(BATCH_BYTES))


def _with_row(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique number a row, rising with doc_id (nulls last):
    the id itself where ids are unique."""
    ids = docs.select(F.col("doc_id").alias("i")).groupBy("i").count()
    if ids.filter("i is null or count > 1").isEmpty():
        return docs.withColumn(ROW, F.col("doc_id"))
    order = [F.col("doc_id").asc_nulls_last(), F.md5(F.coalesce("text", F.lit("")).cast("binary"))]
    rows = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(ROW, F.monotonically_increasing_id())
    return materialize(rows, "pipeline-rows")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts, texts without a letter,
    and those for which no language is likelier than all others together. Where
    no language can be learned, only null texts and texts without a letter go."""
    _bounded(spark)
    trees = langid.learn(docs)
    if not trees.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    rows = langid.with_language(docs.withColumnsRenamed({c: f"__{c}" for c in ("held_out", "lang_pred", "score", "bits_per_byte") if c in docs.columns}), trees=trees)
    kept = rows.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") > 0.5)).drop("held_out", "lang_pred", "score", "bits_per_byte")
    return kept.withColumnsRenamed({f"__{c}": c for c in ("held_out", "lang_pred", "score", "bits_per_byte") if c in docs.columns})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at a similarity
    of 0.8 or more the one of smallest id stays."""
    _bounded(spark)
    rows = _with_row(docs)
    groups = jaccard.near_duplicate_groups(rows.select(F.col(ROW).alias("doc_id"), "text"), words=5, percent=80)
    gone = groups.filter("component_id <> doc_id").select(F.col("doc_id").alias(ROW))
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that occur earlier are cut from texts; a
    character goes if all its bytes go. No document goes; a text may end empty."""
    _bounded(spark)
    rows = _with_row(docs)
    left = repeats.remove_repeats(rows.select(F.col(ROW).alias("doc_id"), "text"), length=100, keep=True)
    left = left.select(F.col("doc_id").alias(ROW), F.col("kept").alias("__kept"))
    other = rows.withColumn("__null", F.col("text").isNull()).drop("text")
    out = other.join(left, ROW).withColumn("text", F.when(~F.col("__null"), F.col("__kept")))
    return _counted(out, docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of the same form."""
    return _counted(pii.pseudonymize(docs, PII_KEY), docs)


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids; see packing.pack for the columns."""
    _bounded(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), size=1024)


STAGES = [("language_id", language), ("ngram_jaccard_join", near_duplicates), ("suffix_array_dedup", repeated_passages),
          ("pii", personal_data), ("packing", pack)]

ORACLE_SQL = None  # language models and tokenizers are not expressible in SQL; run() is tested against brute force (tests/llm/test_pipeline.py)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
