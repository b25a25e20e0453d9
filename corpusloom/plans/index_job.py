"""Batch indexing: pending files to stored index rows plus an outcome per file."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.chunking import ChunkConfig, chunk
from corpusloom.operators.embedding import embed
from corpusloom.operators.metadata import extract_metadata, to_index_rows

MISSING = "文件不存在"
EMPTY = "解析失败，无文本块"


def index_rows(
    documents: DataFrame, strategy: str = "markdown", cfg: ChunkConfig | None = None, **embed_args
) -> DataFrame:
    """Documents to index rows: metadata, chunks, vectors; one row-wise pass."""
    return to_index_rows(embed(chunk(extract_metadata(documents), strategy, cfg), **embed_args))


def index_outcome(pending: DataFrame, documents: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, status, chunk_count, error_message of every pending file.

    ``rows`` is anything with a row per chunk, best the stored index rows. A
    file that is missing, has no chunk or has a chunk with an ``error_message``
    failed; one file's failure never affects another's rows.
    """
    failed = F.min("error_message") if "error_message" in rows.columns else F.lit(None).cast("string")
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), failed.alias("_failed"))
    read = documents.select("doc_id", F.lit(True).alias("_read"))
    n = F.when(F.col("_failed").isNull(), F.coalesce("chunk_count", F.lit(0))).otherwise(0).cast("bigint")
    return (
        pending.select("doc_id")
        .join(read, "doc_id", "left")
        .join(counts, "doc_id", "left")
        .select(
            "doc_id",
            F.when(n > 0, "indexed").otherwise("failed").alias("status"),
            n.alias("chunk_count"),
            F.when(F.col("_read").isNull(), MISSING).when(F.col("_failed").isNotNull(), F.col("_failed")).when(n == 0, EMPTY).alias("error_message"),
        )
    )


def index_documents(
    pending: DataFrame,
    documents: DataFrame,
    path: str,
    strategy: str = "markdown",
    cfg: ChunkConfig | None = None,
    recreate: bool = False,
    **embed_args,
) -> DataFrame:
    """Index the pending documents into ``path`` and return the outcomes.

    ``pending(doc_id)`` names the files, ``documents(doc_id, text, source,
    path, indexed_at)`` holds those that could be read. A model that fails on a
    text fails that file alone. A run writes its rows to a partition of its own
    and the outcomes, its list of files, beside them under a hidden name; one
    rename shows the list, and with it the run. Until then ``live_rows`` gives
    what it gave before, whatever a killed run has left; from then on it takes
    each file's rows from the newest run that lists it. Nothing is rewritten in
    place; ``remove_superseded`` frees the room later.
    """
    spark = documents.sparkSession
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    wanted = documents.join(pending.select("doc_id"), "doc_id", "left_semi")
    rows = index_rows(wanted, strategy, cfg, error_col="error_message", **embed_args).withColumn("run", F.lit(run))
    rows.write.partitionBy("run").mode("overwrite" if recreate else "append").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    outcome = index_outcome(pending, documents, stored.filter(F.col("run") == run))
    hidden, shown = f"{path}/_files/_new-{run}", f"{path}/_files/run={run}"
    outcome.write.parquet(hidden)
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.rename(*(spark._jvm.org.apache.hadoop.fs.Path(p) for p in (hidden, shown))):
        raise OSError(f"{shown} could not be put in place")
    return spark.read.schema(outcome.schema).parquet(shown)


def _newest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, run, status of the newest run that lists the file."""
    listed = spark.read.parquet(f"{path}/_files").withColumn("run", F.col("run").cast("string"))
    return listed.groupBy("doc_id").agg(F.max_by(F.struct("run", "status"), "run").alias("_last")).select("doc_id", "_last.*")


def live_rows(spark: SparkSession, path: str) -> DataFrame:
    """The index rows that count: each file's rows of the newest run that lists it, if it was indexed there."""
    last = _newest(spark, path).filter("status = 'indexed'").select("doc_id", "run")
    return spark.read.parquet(path).withColumn("run", F.col("run").cast("string")).join(last, ["doc_id", "run"], "left_semi").drop("run", "error_message")


def remove_superseded(spark: SparkSession, path: str) -> list[str]:
    """Delete the row partitions of runs of which no row is live any more; returns the runs."""
    stored = spark.read.parquet(path).select(F.col("run").cast("string").alias("run")).distinct()
    gone = [r["run"] for r in stored.join(_newest(spark, path).filter("status = 'indexed'"), "run", "left_anti").collect()]  # runs, not rows
    listed = {r["run"] for r in spark.read.parquet(f"{path}/_files").select(F.col("run").cast("string").alias("run")).distinct().collect()}
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = sorted(run for run in gone if run in listed)  # a run that is not shown yet may still be written
    for run in gone:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run={run}"), True)
    return gone


def outcome_summary(outcome: DataFrame) -> DataFrame:
    return outcome.groupBy("status").agg(
        F.count("*").alias("files"), F.sum("chunk_count").alias("chunks")
    )
