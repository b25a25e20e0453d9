"""Structured Streaming forms of ingest, de-duplication, entities and memory."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusloom.functions import lexicon as L
from corpusloom.operators.chunking import ChunkConfig
from corpusloom.operators.extraction import extract_entities
from corpusloom.plans.index_job import index_documents
from corpusloom.sources.registry import apply_batch


def dedup_stream(stream: DataFrame, text_col: str, time_col: str, delay: str) -> DataFrame:
    """First arrival of each content hash; repeats within the watermark are dropped."""
    hashed = stream.withColumn("text_sha256", F.sha2(F.col(text_col), 256))
    return hashed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["text_sha256"])


def dedup_stream_stored(
    stream: DataFrame, text_col: str, time_col: str, delay: str, hashes: str, out: str, checkpoint: str, trigger: dict[str, Any] | None = None
):
    """First arrival of each content hash over any span of time; returns the started query.

    State holds the hashes of one ``delay`` only. What is older lies in the
    table ``hashes``: each batch is joined against it where it is stored and
    adds its own new ones. A batch has a folder of its own in ``hashes`` and in
    ``out`` and does not look at its own or later folders, so a replayed batch
    finds and writes the same rows again.
    """
    spark = stream.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        # rows of the batch itself are already unique: the state has seen them
        known = _folders_before(spark, hashes, batch_id)
        fresh = batch if known is None else batch.join(known, "text_sha256", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        spark.read.parquet(f"{out}/batch={batch_id}").select("text_sha256").write.mode("overwrite").parquet(f"{hashes}/batch={batch_id}")

    writer = dedup_stream(stream, text_col, time_col, delay).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _folders_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The hashes that earlier batches have stored."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not batch_id or not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return None
    stored = spark.read.schema("text_sha256 string, batch bigint").parquet(path)
    return stored.filter(F.col("batch") < batch_id).select("text_sha256")


def entity_stream(stream: DataFrame, id_col: str = "doc_id", text_col: str = "text", patterns=None) -> DataFrame:
    """Entities of arriving texts; stateless, the batch operator as it is."""
    return extract_entities(stream, id_col, text_col, patterns)


def ingest_stream(
    stream: DataFrame,
    index_path: str,
    outcome_path: str,
    checkpoint: str,
    strategy: str = "markdown",
    cfg: ChunkConfig | None = None,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    trigger: dict[str, Any] | None = None,
    registry: str | None = None,
    stream_id: str = "ingest",
    now: Column | None = None,
    **embed_args: Any,
):
    """Index arriving documents; returns the started query.

    ``registry`` is the folder of a file registry: a batch's files are set to
    ``indexing`` before and to their outcome after it is indexed, each once per
    (``stream_id``, batch): a replayed batch changes nothing a second time.
    ``on_batch(outcome, batch_id)`` is called after that; ``trigger`` are the
    arguments of the writer's trigger (default: all that is available).

    Each micro-batch writes its own ``batch=<id>`` folder with overwrite, so a
    replay after a failure replaces the same folder: the result is exactly once.
    """

    spark, stamp = stream.sparkSession, F.current_timestamp() if now is None else now

    def note(changes: DataFrame, step: str, batch_id: int) -> None:
        if registry:
            apply_batch(spark, registry, changes.withColumn("id", F.col("id").cast("string")), stamp, f"{stream_id}/{step}", batch_id)

    def run(batch: DataFrame, batch_id: int) -> None:
        note(batch.select(F.col("doc_id").alias("id"), F.lit("indexing").alias("status")).distinct(), "indexing", batch_id)
        target = f"{index_path}/batch={batch_id}"
        outcome = index_documents(batch.select("doc_id"), batch, target, strategy, cfg, recreate=True, **embed_args)
        outcome.write.mode("overwrite").parquet(f"{outcome_path}/batch={batch_id}")
        note(outcome.withColumnRenamed("doc_id", "id"), "outcome", batch_id)
        if on_batch:
            on_batch(outcome, batch_id)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MEMORY_OUT = StructType(
    [
        StructField("session_id", StringType()),
        StructField("n_messages", LongType()),
        StructField("held", LongType()),
        StructField("last_query", StringType()),
        StructField("previous_query", StringType()),
        StructField("summary", StringType()),
    ]
)


class SessionMemory(StatefulProcessor):
    """Per session: held messages, last two user queries, summary; emits the new state.

    Held messages are limited by the summary rule, so the state of one session
    stays small however long it runs. A session idle for ``idle_ms`` ends.
    """

    def __init__(self, threshold: int, max_history: int, topics: list[str], idle_ms: int | None):
        self.threshold, self.keep = threshold, max(1, max_history // 2)
        self.topics, self.idle_ms = topics, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", "turn bigint, role string, content string")
        self.facts = handle.getValueState("facts", "n bigint, last string, previous string, summary string")

    def _summary(self, held: list[tuple]) -> str:
        said = [c for _, role, c in held if role == "user"]
        found = [t for t in self.topics if any(t in c for c in said)]
        return "讨论主题: " + ", ".join(found) if found else f"对话包含 {len(held)} 条消息"

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(m) for m in self.messages.get()]
        n, last, previous, summary = self.facts.get() if self.facts.exists() else (0, None, None, None)
        arrived = pd.concat(list(rows)).sort_values("turn")
        for turn, role, content in zip(arrived["turn"], arrived["role"], arrived["content"]):
            held.append((int(turn), role, content))
            n += 1
            if role == "user":
                last, previous = content, last
            if len(held) > self.threshold:
                summary, held = self._summary(held), held[-self.keep :]
        self.messages.put(held)
        self.facts.update((n, last, previous, summary))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame([[str(key[0]), n, len(held), last, previous, summary]], columns=MEMORY_OUT.names)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.messages.clear()
        self.facts.clear()
        yield pd.DataFrame(columns=MEMORY_OUT.names)

    def close(self) -> None:
        pass


# the runner that initialises stateful processors does not see shipped packages
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def session_memory_stream(
    messages: DataFrame,
    threshold: int = 15,
    max_history: int = 20,
    topics: list[str] | None = None,
    idle_ms: int | None = None,
) -> DataFrame:
    """State of each session after every micro-batch; ``messages(session_id, turn, role, content)``.

    Keyed state of this kind lives in RocksDB; the session is told so if it
    still has another provider.
    """
    messages.sparkSession.conf.set(STATE_PROVIDER, ROCKSDB)
    processor = SessionMemory(threshold, max_history, topics or L.SUMMARY_TOPICS, idle_ms)
    return messages.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=MEMORY_OUT,
        outputMode="Update",
        timeMode="ProcessingTime" if idle_ms else "None",
    )
