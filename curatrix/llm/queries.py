"""Registered queries of the operators: thin calls with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import alignment, bpe, collocations, langid, multi_index, neardup, ngram_lm, packing, quality, repeats, secrets, token_files, vector_dedup
from curatrix.llm.common import table


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return multi_index.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_report(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")) -> DataFrame:
    return bpe.round_trip_report(table(spark, sf_dir, "documents"), bpe.codec(path, public_tokenizers.PATTERN))


def op4_packing(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("word_bpe_49k.json")) -> DataFrame:
    with open(path, encoding="utf-8") as spec:
        return packing.pack(table(spark, sf_dir, "documents"), spec.read())


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_report(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.class_report(table(spark, sf_dir, "documents"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_report(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_50k.json"), model: str = public_tokenizers.path("piece_bpe_32k.model")) -> DataFrame:
    with open(path, encoding="utf-8") as spec, open(model, "rb") as pieces:
        return alignment.alignment_report(table(spark, sf_dir, "documents"), spec.read(), pieces.read())


def op12_token_files(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    with open(path, encoding="utf-8") as spec:
        return token_files.file_report(table(spark, sf_dir, "documents"), spec.read())


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_multi_index, op2_ngram_lm, op3_bpe, op4_packing, op5_secrets, op6_near_duplicates, op7_vector_dedup, op8_quality, op9_repeats, op10_langid, op11_alignment, op12_token_files, op13_collocations)}

#: None of these results can be written in SQL alone; tests/llm compares them with brute force.
ORACLE_SQL: dict[str, str] = {}
