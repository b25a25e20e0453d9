"""Multi-step flows: agentic retrieval and the streaming jobs run over whole tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog.answering import SQL_REWRITTEN, SQL_TYPED, sql_assess, sql_entities, sql_scored
from corpusloom.catalog.base import SQL_CLINICAL, SQL_MESSAGES, clinical_documents, derived_messages, derived_queries, query, table
from corpusloom.catalog.ingest import _FIXED
from corpusloom.catalog.retrieval import SQL_BM25, SQL_DENSE, corpus_chunks, document_index
from corpusloom.functions import lexicon as L
from corpusloom.operators.embedding import embed
from corpusloom.plans.agentic import agentic_retrieve
from corpusloom.session import materialize, scratch_path
from corpusloom.sources.registry import commit_registry, latest_version, read_file_registry
from corpusloom.streaming.jobs import dedup_stream, dedup_stream_stored, entity_stream, ingest_stream, session_memory_stream
from corpusloom.streaming.sessions import session_stream


def _sql_pass(n: int, queries: str) -> str:
    """CTEs of one retrieval pass over ``queries(query_id, query, alpha)``: f{n} hits, d{n} verdicts."""
    return f"""all{n} AS (SELECT query_id, chunk_id, d.score AS ds, s.score AS ss
   FROM (SELECT * FROM dense JOIN {queries} USING (query_id) WHERE rank <= 20 AND alpha > 0) d
   FULL JOIN (SELECT * FROM sparse JOIN {queries} USING (query_id) WHERE rank <= 20 AND alpha < 1) s USING (query_id, chunk_id)),
 sc{n} AS (SELECT query_id, chunk_id, round(CASE alpha WHEN 1 THEN ds WHEN 0 THEN ss ELSE
   alpha * coalesce((1 + ds) / 2, 0) + (1 - alpha) * coalesce({2 / math.pi!r}::DOUBLE * atan(ss), 0) END, 9) AS score FROM all{n} JOIN {queries} USING (query_id)),
 f{n} AS (SELECT r.*, text, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc{n} WHERE score IS NOT NULL) r
   JOIN documents ON doc_id = chunk_id WHERE rank <= 10),
 {sql_assess(f'f{n}', queries, str(n))}"""


@query(
    "agentic_retrieve",
    f"""WITH {SQL_REWRITTEN}, told AS (SELECT query_id, std AS query FROM stded), {sql_scored('told')}, {SQL_TYPED},
 q AS (SELECT query_id, query, query_type, CASE query_type WHEN 'vector' THEN 1.0::DOUBLE WHEN 'bm25' THEN 0.0::DOUBLE ELSE 0.7::DOUBLE END AS alpha FROM typed WHERE query_type <> 'direct'),
 {SQL_BM25}, {SQL_DENSE}, {_sql_pass(1, 'q')},
 again AS (SELECT query_id, query, 0.7::DOUBLE AS alpha FROM q JOIN d1 USING (query_id) WHERE decision <> 'sufficient'), {_sql_pass(2, 'again')},
 v AS (SELECT *, 1 AS attempt FROM d1 WHERE decision = 'sufficient' UNION ALL SELECT *, 2 FROM d2),
 h AS (SELECT query_id, count(*) AS hits, max(score) AS best FROM (SELECT f1.* FROM f1 JOIN d1 USING (query_id) WHERE decision = 'sufficient' UNION ALL SELECT * FROM f2) GROUP BY 1)
SELECT t.query_id, query_type, attempt, decision, round(relevance, 6) AS relevance, round(sufficiency, 6) AS sufficiency, hits, h.best AS best FROM typed t LEFT JOIN v USING (query_id) LEFT JOIN h USING (query_id)""",
)
def agentic_retrieve_q(spark: SparkSession, sf: str) -> DataFrame:
    """Every user message as a query against all documents."""
    texts = corpus_chunks(spark, sf)
    corpus = materialize(embed(texts).select("chunk_id", "embedding"), "corpus")
    hits, verdicts = agentic_retrieve(derived_queries(spark, sf), document_index(spark, sf), corpus, texts)
    found = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.max("score").alias("best"))
    return verdicts.join(found, "query_id", "left").select(
        "query_id", "query_type", "attempt", "decision", F.round("relevance", 6).alias("relevance"),
        F.round("sufficiency", 6).alias("sufficiency"), "hits", "best"
    )


def _split_files(df: DataFrame, label: str) -> str:
    """The rows as a folder of files, two for each slot: a stream that takes a file a slot needs two batches."""
    path = scratch_path(df.sparkSession, label)
    df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism).write.parquet(path)
    return path


def _stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", spark.sparkContext.defaultParallelism).parquet(path)


def _store_parts(df: DataFrame, part: Column, label: str) -> str:
    """The rows as one folder of files for each part, written by all tasks."""
    path = scratch_path(df.sparkSession, label)
    df.withColumn("part", part).write.partitionBy("part").parquet(path)
    return path


def _arriving(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream that takes all files which have come to ``path`` since its last run as one batch."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def _feed(spark: SparkSession, stored: str, path: str, run: Callable[[], object]) -> None:
    """Let the parts below ``stored`` come to ``path`` in their order, each followed by a run of the stream.

    A batch is then one part, however many files and tasks have written it.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(stored)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(root)]
    for name in sorted((n for n in names if n.startswith("part=")), key=lambda n: int(n[5:])):
        if not files.rename(*(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{name}") for at in (stored, path))):
            raise OSError(f"{name} could not be moved to {path}")
        run()


def _run(stream: DataFrame, label: str, mode: str = "append", feed: tuple[str, str] | None = None) -> DataFrame:
    """Drive a stream over what is there, or over the parts of ``feed`` (where they lie, where they come to), and read its result table."""
    spark = stream.sparkSession
    out, check = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", check)
    # a stream keeps the number of state partitions it starts with: one per slot here
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    run = lambda: writer.trigger(availableNow=True).start().awaitTermination()
    try:
        _feed(spark, *feed, run) if feed else run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return spark.read.parquet(out).drop("batch")


@query(
    "ingest_stream",
    f"WITH {_FIXED}, n AS (SELECT doc_id, count(*) AS c FROM fixed GROUP BY 1) SELECT doc_id, CASE WHEN c > 0 THEN 'indexed' ELSE 'failed' END AS status, coalesce(c, 0) AS chunk_count FROM documents LEFT JOIN n USING (doc_id)",
)
def ingest_stream_q(spark: SparkSession, sf: str) -> DataFrame:
    """Documents arrive in files; the union of the batches equals one batch run."""
    docs = table(spark, sf, "documents").select(
        "doc_id", "text", "source", F.lit("").alias("path"), F.lit("2024-03-01").alias("indexed_at")
    )
    path = _split_files(docs, "arriving")
    index, outcome, check = (scratch_path(spark, x) for x in ("stream-index", "stream-outcome", "stream-checkpoint"))
    ingest_stream(_stream(spark, path, docs.schema), index, outcome, check, "fixed").awaitTermination()
    return spark.read.parquet(outcome).select("doc_id", "status", "chunk_count")


@query(
    "ingest_stream_registry",
    f"""WITH {_FIXED}, n AS (SELECT doc_id, count(*) AS c FROM fixed GROUP BY 1)
SELECT doc_id::VARCHAR AS id, CASE WHEN c > 0 THEN 'indexed' ELSE 'failed' END AS status, coalesce(c, 0) AS chunk_count,
  CASE WHEN c IS NULL THEN '解析失败，无文本块' END AS error_message, TIMESTAMP '2024-03-01' AS updated_at, 8::BIGINT AS changes FROM documents LEFT JOIN n USING (doc_id)""",
)
def ingest_stream_registry_q(spark: SparkSession, sf: str) -> DataFrame:
    """Registered files are indexed by a stream; then all its batches come a second time, a day later.

    ``changes`` counts the registry's versions after the first: two a batch, none for the replay.
    """
    docs = table(spark, sf, "documents").select(
        "doc_id", "text", "source", F.lit("").alias("path"), F.lit("2024-03-01").alias("indexed_at")
    )
    stored, registry = _store_parts(docs, F.pmod(F.xxhash64("doc_id"), F.lit(4)), "waiting"), scratch_path(spark, "stream-registry")
    day = F.lit("2024-02-01").cast("timestamp")
    files = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("filename"), "path", F.length("text").cast("bigint").alias("size_bytes"),
        F.lit("pending").alias("status"), F.lit(0).cast("bigint").alias("chunk_count"), F.lit(None).cast("string").alias("error_message"),
        day.alias("created_at"), day.alias("updated_at"),
    )
    commit_registry(files, registry)
    for now in ("2024-03-01", "2024-03-02"):
        index, outcome, check = (scratch_path(spark, x) for x in ("stream-index", "stream-outcome", "stream-checkpoint"))
        path = scratch_path(spark, "arriving")
        stream = _arriving(spark, path, docs.schema)
        _feed(spark, stored, path, lambda: ingest_stream(stream, index, outcome, check, "fixed", registry=registry, now=F.lit(now)).awaitTermination())  # noqa: B023
        stored = path
    changes = F.lit(latest_version(spark, registry) - 1).cast("bigint").alias("changes")
    return read_file_registry(spark, registry).select("id", "status", "chunk_count", "error_message", "updated_at", changes)


@query("dedup_stream_stored", "SELECT sha256(text) AS text_sha256 FROM documents GROUP BY 1")
def dedup_stream_stored_q(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in the order of their events, which lie weeks apart; the stream remembers one day."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))
    timed = materialize(table(spark, sf, "documents").select("doc_id", "text").join(e, "doc_id"), "timed")
    ends = timed.agg(F.min("ts").cast("double").alias("low"), F.max("ts").cast("double").alias("high")).first()
    step = max(1.0, (ends["high"] - ends["low"]) / 4)
    quarter = F.least(F.floor((F.col("ts").cast("double") - ends["low"]) / step), F.lit(3))
    path, hashes, out, check = (scratch_path(spark, x) for x in ("arriving", "hashes", "dedup", "dedup-checkpoint"))
    stream = _arriving(spark, path, timed.schema)
    run = lambda: dedup_stream_stored(stream, "text", "ts", "1 day", hashes, out, check).awaitTermination()
    _feed(spark, _store_parts(timed, quarter, "waiting"), path, run)  # a quarter of the time after the other
    return spark.read.parquet(out).select("text_sha256")


@query("dedup_stream", "SELECT sha256(text) AS text_sha256 FROM documents GROUP BY 1")
def dedup_stream_q(spark: SparkSession, sf: str) -> DataFrame:
    """Documents timed by the event of the same number; all lie within the watermark."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))
    timed = table(spark, sf, "documents").select("doc_id", "text").join(e, "doc_id")
    path = _split_files(timed, "timed")
    schema = spark.read.parquet(path).schema
    return _run(dedup_stream(_stream(spark, path, schema), "text", "ts", "400 days"), "dedup").select("text_sha256")


@query(
    "entity_stream",
    f"WITH {SQL_CLINICAL}, {sql_entities('clinical')} SELECT doc_id, entity_type, normalized, start_pos FROM ents",
)
def entity_stream_q(spark: SparkSession, sf: str) -> DataFrame:
    docs = clinical_documents(spark, sf)
    path = _split_files(docs, "clinical")
    found = _run(entity_stream(_stream(spark, path, docs.schema)), "entities")
    return found.select("doc_id", "entity_type", "normalized", F.col("start_pos").cast("bigint").alias("start_pos"))


@query(
    "session_stream",
    """WITH m AS (SELECT conv_id, turn, role, text, TIMESTAMP '2024-01-01' + to_hours(conv_id::INT) + to_minutes(turn::INT) AS ts FROM conversations),
 w AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last, max(turn) OVER (PARTITION BY conv_id, role) AS own FROM m),
 s AS (SELECT conv_id, count(*) AS n, max(ts) AS last_ts, list(DISTINCT role || '=' || own) FILTER (last - own < 3) AS vars,
   string_agg(turn || ':' || role || ':' || text, chr(10) ORDER BY turn) AS said FROM w GROUP BY 1)
SELECT conv_id::VARCHAR AS session_id, CASE WHEN last_ts + INTERVAL 30 MINUTE < (SELECT max(ts) - INTERVAL 630 SECOND FROM m) THEN 'ended' ELSE 'open' END AS event,
  n AS n_messages, last_ts, array_to_string(list_sort(coalesce(vars, [])), ',') AS variables,
  CASE WHEN last_ts + INTERVAL 30 MINUTE < (SELECT max(ts) - INTERVAL 630 SECOND FROM m) THEN md5(said) END AS messages_md5 FROM s""",
)
def session_stream_q(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations an hour apart, a message a minute; every message notes its turn under its role for three minutes."""
    c = table(spark, sf, "conversations")
    ts = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("conv_id").cast("int"), F.col("turn").cast("int"), F.lit(0))
    rows = c.select(F.col("conv_id").alias("session_id"), ts.alias("ts"), "turn", "role", F.col("text").alias("content"), F.create_map("role", F.col("turn").cast("string")).alias("variables"))
    rows = materialize(rows, "timed-messages")
    edges = rows.agg(F.percentile_approx("ts", [0.25, 0.5, 0.75]).alias("e")).first()["e"]
    part = sum((F.col("ts") > F.lit(e)).cast("int") for e in edges)
    path = scratch_path(spark, "sessions-arriving")
    feed = (_store_parts(rows, part, "sessions-waiting"), path)  # a quarter of the messages after the other
    states = _run(session_stream(_arriving(spark, path, rows.schema), "630 seconds", 30 * 60_000, 3 * 60_000), "sessions", "update", feed)
    last = states.groupBy("session_id").agg(F.max_by(F.struct("event", "n_messages", "last_ts", "variables", "messages"), F.struct("batch_id", F.col("event") == "ended")).alias("s"))
    said = F.array_join(F.transform("s.messages", lambda m: F.concat_ws(":", m.turn.cast("string"), m.role, m.content)), "\n")
    live = F.array_sort(F.transform(F.map_entries("s.variables"), lambda v: F.concat_ws("=", v.key, v.value)))
    return last.select("session_id", "s.event", "s.n_messages", "s.last_ts", F.array_join(live, ",").alias("variables"), F.md5(said).alias("messages_md5"))


_TOPICS = ", ".join(f"CASE WHEN t{i} THEN '{t}' END" for i, t in enumerate(L.SUMMARY_TOPICS))


@query(
    "session_memory_stream",
    f"""WITH {SQL_MESSAGES}, n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS p FROM messages),
 l AS (SELECT *, CASE WHEN n > 3 THEN 4 + ((n - 4) // 2) * 2 END AS last FROM n),
 a AS (SELECT session_id, any_value(n) AS n, any_value(last) AS last, count(*) FILTER (p <= last AND p > last - 4) AS seen,
   {', '.join(f"bool_or(p <= last AND p > last - 4 AND role = 'user' AND contains(content, '{t}')) AS t{i}" for i, t in enumerate(L.SUMMARY_TOPICS))},
   max_by(content, turn) FILTER (role = 'user') AS last_query FROM l GROUP BY 1)
SELECT session_id::VARCHAR AS session_id, n AS n_messages, CASE WHEN last IS NULL THEN n ELSE n - last + 2 END AS held, md5(last_query) AS last_md5,
  CASE WHEN last IS NOT NULL THEN CASE WHEN concat_ws(', ', {_TOPICS}) <> '' THEN '讨论主题: ' || concat_ws(', ', {_TOPICS}) ELSE '对话包含 ' || seen || ' 条消息' END END AS summary FROM a""",
)
def session_memory_stream_q(spark: SparkSession, sf: str) -> DataFrame:
    """Messages replayed in turn order, about a quarter of them a batch; the last state of each session."""
    m = derived_messages(spark, sf)
    edges = m.agg(F.percentile_approx("turn", [0.25, 0.5, 0.75]).alias("e")).first()["e"] or []
    part = sum(((F.col("turn") > F.lit(e)).cast("int") for e in edges), F.lit(0))
    path = scratch_path(spark, "messages")
    states = _run(session_memory_stream(_arriving(spark, path, m.schema), threshold=3, max_history=4), "memory", "update", (_store_parts(m, part, "messages-waiting"), path))
    final = states.groupBy("session_id").agg(F.max_by(F.struct("n_messages", "held", "last_query", "summary"), "n_messages").alias("s"))
    return final.select("session_id", "s.n_messages", "s.held", F.md5("s.last_query").alias("last_md5"), "s.summary")
