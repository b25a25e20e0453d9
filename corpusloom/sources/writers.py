"""Sinks: index tables, training files, metrics, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpusloom.operators.contrastive import training_rows


def write_index(rows: DataFrame, path: str, recreate: bool = False, partition_by: list[str] | None = None) -> None:
    """Append index rows; ``recreate`` replaces the collection."""
    writer = rows.write.mode("overwrite" if recreate else "append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def drop_index(spark: SparkSession, path: str) -> bool:
    """Remove a collection; False when there was none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))


def count_index(spark: SparkSession, path: str) -> int:
    try:
        return spark.read.parquet(path).count()
    except AnalysisException:
        return 0


def write_training_jsonl(split_pairs: DataFrame, path: str) -> None:
    """``split=train`` and ``split=val`` folders of JSON lines {query, pos, neg}."""
    rows = split_pairs.select("split", "query", F.array("positive").alias("pos"), F.col("negatives").alias("neg"))
    rows.write.mode("overwrite").partitionBy("split").json(path)


def write_pairs_json(pairs: DataFrame, path: str) -> None:
    pairs.select("query", "positive", "negatives").write.mode("overwrite").json(path)


def read_pairs_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("query string, positive string, negatives array<string>").json(path)
    return rows.withColumn("negatives", F.coalesce("negatives", F.array().cast("array<string>")))


def write_metrics(metrics: DataFrame, path: str, fmt: str = "json") -> None:
    metrics.write.mode("overwrite").format(fmt).save(path)


def write_sessions_json(sessions: DataFrame, path: str, files: int | None = None) -> None:
    """One JSON object per session; bucketed by session so files stay of one size.

    ``sessions(session_id, messages[], summary, context)``.
    """
    spread = sessions.repartition(files, "session_id") if files else sessions
    spread.select("session_id", "messages", "summary", "context").write.mode("overwrite").json(path)


def session_rows(messages: DataFrame, summaries: DataFrame | None = None, contexts: DataFrame | None = None) -> DataFrame:
    """Messages (already limited by ``last_n_messages``) gathered to session objects.

    ``messages`` may have ``timestamp`` (any type that casts to a string) and
    ``metadata`` (a map of strings); without them a message has none.
    ``summaries(session_id, summary)`` and ``contexts(session_id, context)``, a
    map of the session's variables, are joined where given; a session without
    one has no summary and an empty context.
    """
    given = set(messages.columns)
    stamp = F.col("timestamp").cast("string") if "timestamp" in given else F.lit(None).cast("string")
    notes = F.col("metadata").cast("map<string,string>") if "metadata" in given else F.lit(None).cast("map<string,string>")
    # a map has no order, so it travels as text while the messages are sorted
    entry = F.struct("turn", "role", "content", stamp.alias("timestamp"), F.to_json(notes).alias("metadata"))
    rows = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(entry)).alias("_m"))
    rows = rows.select(
        F.col("session_id").cast("string").alias("session_id"),
        F.transform(
            "_m",
            lambda m: F.struct(
                m["role"].alias("role"), m["content"].alias("content"), m["timestamp"].alias("timestamp"),
                F.coalesce(F.from_json(m["metadata"], "map<string,string>"), F.create_map().cast("map<string,string>")).alias("metadata"),
            ),
        ).alias("messages"),
    )
    none = F.create_map().cast("map<string,string>")
    if summaries is None:
        rows = rows.withColumn("summary", F.lit(None).cast("string"))
    else:
        rows = rows.join(summaries.select(F.col("session_id").cast("string"), "summary"), "session_id", "left")
    if contexts is None:
        return rows.withColumn("context", none)
    rows = rows.join(contexts.select(F.col("session_id").cast("string"), "context"), "session_id", "left")
    return rows.withColumn("context", F.coalesce("context", none))


__all__ = [
    "write_index", "read_index", "drop_index", "count_index", "write_training_jsonl", "write_pairs_json",
    "read_pairs_json", "write_metrics", "write_sessions_json", "session_rows", "training_rows",
]


def write_text_files(texts: DataFrame, path: str, suffix: str = ".txt", folders: int = 64) -> int:
    """Every row of ``texts(text)`` as a file of its own, a line break at its end; returns their number.

    The tasks write through Arrow's file systems, since Hadoop's local one
    starts processes for the permissions of each file. Files are named by task
    and row, so a repeated task writes its own files again, and are dealt into
    a fixed number of folders, however many there are.
    """

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        files, root = arrow_path(path)
        task, n = TaskContext.get().partitionId(), 0
        for f in range(folders):
            files.create_dir(f"{root}/{f:03d}")
        for batch in batches:
            for text in batch.column(0).to_pylist():
                with files.open_output_stream(f"{root}/{n % folders:03d}/{task:06d}-{n:08d}{suffix}") as out:
                    out.write(f"{text or ''}\n".encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    return texts.select("text").mapInArrow(write, "files bigint").agg(F.sum("files")).first()[0] or 0


def arrow_path(path: str):
    """Arrow's file system of a folder and its path there; local ones come with or without a scheme."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)
