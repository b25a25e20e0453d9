"""The corpus pipeline: language ID, near-duplicates, repeated passages, decontamination, byte-level BPE.

Every stage takes the documents its predecessor kept and is stored as Parquet
before the next one reads it. All stages but the last return the columns of
``documents`` (and any others the table has); the last returns the encoded
documents: ids, their number and digests. Decisions are the operators' own:

* a document whose language cannot be determined (no letter, or null) goes;
* of each group of near-duplicates (five-word shingles, similarity 0.8) the
  document with the smallest id stays;
* bytes under 100-byte strings that also start earlier are cut from the texts,
  and ``n_chars`` follows; a document may end up empty, its row stays;
* contaminated documents go.

Nulls in other columns, empty tables and repeated rows behave as the operators
say; of repeated rows one stays.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, decontamination, language_id, near_duplicates, suffix_dedup
from corpusloom.session import materialize, ship_package


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return near_duplicates.keep_one_per_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    # the executors still hold what the earlier stages left
    cut = suffix_dedup.remove_repeats(docs, run_bytes=8 << 20)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontamination.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    # the executors still hold what the earlier stages left; the ids themselves are the result
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_digests(docs, vocabulary, public_tokenizers.PATTERN, cache_bytes=128 << 20, keep_ids=True, keep_codec=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: None: the kernel classifier, the sets of the similarity join and the encoder are not stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
