"""The corpus pipeline: language ID, near-duplicate removal, decontamination, BPE.

Each stage takes what its predecessor kept.  Stages 1 to 3 drop rows and return
the columns of documents; the last returns token ids and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabsignal.llm import bpe, decontaminate, langid, ngram_join
from tabsignal.llm.common import saved
from tabsignal.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null, without letters, or not in a language of the table."""
    return langid.keep_known(docs, langid.fit(docs))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with five-word Jaccard similarity 0.8 or more."""
    return ngram_join.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its edit budget."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe.digests(bpe.codec(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("bpe_codec", encode_bpe),
]

#: No stage can be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
