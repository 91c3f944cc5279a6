"""Corpus pipeline over ``documents``: every stage keeps the columns of documents, the last returns packed pieces."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import neardup, packing, quality, repeats, secrets
from curatrix.llm.common import stored, table

#: Bytes of texts that Spark hands to Python at once, and the setting for it. A batch stands several times over in an executor, in the JVM and in each worker,
#: and neither gives all of that memory back between the stages.
BATCH, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Sets the size of batches for the session, unless it has its own: the setting counts when a stage's result is written, which is up to the caller."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH))


def recounted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """Sets n_chars to the length of the changed text."""
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier does not reject (operator 8)."""
    small_batches(spark)
    return quality.accepted(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest doc_id (operator 6).

    The operator keeps a row that repeats as often as it is there; one is kept here, or the next stage would take each for a repeat of the other.
    """
    small_batches(spark)
    kept = neardup.near_duplicates(docs, names=("__class", "__size", "__kept")).where("__kept").select(*docs.columns)
    return kept.dropDuplicates(["doc_id", "text"])


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes that repeat elsewhere (operator 9)."""
    small_batches(spark)
    return recounted(repeats.without_repeats(docs), docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by a mark (operator 5)."""
    found = secrets.secret_spans(docs, into="__found")
    return recounted(found.withColumn("text", secrets.redacted(F.col("text"), F.col("__found"))), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str = public_tokenizers.path("word_bpe_49k.json")) -> DataFrame:
    """One row per packed piece (operator 4)."""
    small_batches(spark)
    with open(path, encoding="utf-8") as spec:
        return packing.pack(docs, spec.read())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("repeats", repeats_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: The stages learn, hash and tokenise: no SQL gives their rows. tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
