"""Corpus pipeline: language, exact copies, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the table is written as Parquet and
read again. All but the last stage return the columns of documents and drop rows only: texts in no learned
language, all but the smallest id of equal texts and of each near-copy class, and documents that hold a benchmark item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.llm import byte_bpe, exact_dedup, language_id, ngram_jaccard, queries, template_leaks
from ledgerwatch.llm.common import fresh, written

ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Profiles learned from the rows with a language; a text without letters, or alike to none of them, goes."""
    pred, score = fresh(docs, "lang"), fresh(docs, "score")
    found = language_id.predict(docs, language_id.train(docs), lang_name=pred, score_name=score)
    return found.filter((F.col(pred) != language_id.UNKNOWN) & (F.col(score) > 0)).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return template_leaks.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)"""
    return byte_bpe.digests(docs, *queries.vocabulary())


STAGES = [("language_id", languages), ("exact_dedup", exact_copies), ("ngram_jaccard", near_copies),
          ("benchmark_decontamination", benchmark_leaks), ("byte_bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else written(docs), sf_dir)
    return docs
