"""The queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskspark.llm import bpe, forest, jaccard, licenses, line_dedup, mixing, pseudonyms, quality, repeats, sql, token_files
from maskspark.llm.shared import spread, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", "text")
    rows = mixing.with_copies(docs, mixing.source_plan(docs))
    taken = (F.col("copies") * F.col("__size")).cast("long").alias("taken")
    return rows.select(F.col("doc_id").cast("long"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(_documents(spark, sf_dir), digest=True)


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymize(_documents(spark, sf_dir).select("doc_id", "text"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    token_files.write(_documents(spark, sf_dir), folder)
    return token_files.read(spark, folder)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_documents(spark, sf_dir))


def op7_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return line_dedup.digests(docs, line_dedup.keep_bitmaps(docs))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "license_id", "license_digest")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality, op2_mixing, op3_repeats, op4_pseudonyms, op5_token_files,
        op6_ngram_jaccard, op7_embedding_forest, op8_line_dedup, op9_bpe, op10_licenses,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": sql.OP2, "op3_repeats": sql.OP3, "op6_ngram_jaccard": sql.OP6, "op8_line_dedup": sql.OP8, "op10_licenses": sql.OP10}
