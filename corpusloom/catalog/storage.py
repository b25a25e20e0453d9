"""Sources and sinks: data derived from the tables is written to the shared scratch folder and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog.base import query, table
from corpusloom.catalog.evaluation import _LONG, _PER, KS, labelled_run
from corpusloom.catalog.ingest import _FIXED
from corpusloom.catalog.training import SQL_PAIRS, _valid
from corpusloom.operators import contrastive as N
from corpusloom.operators import ranking_metrics as M
from corpusloom.operators.chunking import chunk
from corpusloom.operators.conversation import last_n_messages
from corpusloom.operators.metadata import to_index_rows
from corpusloom.session import scratch_path
from corpusloom.sources import readers as R
from corpusloom.sources import registry as G
from corpusloom.sources import writers as W

md5 = F.md5
NOW = dt.datetime(2024, 6, 1)


@query("read_documents", "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents")
def read_documents_q(spark: SparkSession, sf: str) -> DataFrame:
    d = R.read_documents(spark, f"{sf}/documents.parquet")
    return d.select("doc_id", md5("text").alias("text_md5"), "lang", "source", "n_chars")


@query("read_markdown_dir", "SELECT md5(text || chr(10)) AS text_md5, (strlen(text) + 1)::BIGINT AS file_size FROM documents")
def read_markdown_dir_q(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a text file of its own, read back from a fixed number of folders."""
    path = scratch_path(spark, "parsed")
    W.write_text_files(table(spark, sf, "documents"), path)
    files = R.read_markdown_dir(spark, path, "*.txt")
    return files.select(md5("text").alias("text_md5"), "file_size")


def _lines(df: DataFrame, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.json(path)
    return path


@query(
    "read_qa_json",
    """SELECT 'Q ' || doc_id AS question, CASE WHEN doc_id % 3 = 0 THEN lang END AS ground_truth, lang AS language, NULL AS category,
  CASE WHEN doc_id % 2 = 0 THEN md5(text) ELSE '' END AS context, '' AS answer FROM documents""",
)
def read_qa_json_q(spark: SparkSession, sf: str) -> DataFrame:
    """Question cases as JSON arrays, each as large as the writer's part of the table."""
    i = F.col("doc_id")
    case = F.struct(
        F.concat(F.lit("Q "), i.cast("string")).alias("question"), F.when(i % 3 == 0, F.col("lang")).alias("ground_truth"),
        F.col("lang").alias("language"), F.when(i % 2 == 0, md5("text")).alias("context"),
    )
    return R.read_qa_json(spark, _arrays(table(spark, sf, "documents").select(F.to_json(case).alias("value")), "qa"))


def _arrays(elements: DataFrame, label: str) -> str:
    """A folder of JSON arrays: every part of ``elements(value)`` becomes one file, element by element."""

    def bracket(batches):
        import pyarrow as pa

        sign = "["
        for batch in batches:
            values = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"value": [("," if n or sign != "[" else "[") + v for n, v in enumerate(values)]})
            sign = ","
        yield pa.RecordBatch.from_pydict({"value": ["]" if sign != "[" else "[]"]})

    path = scratch_path(elements.sparkSession, label)
    elements.mapInArrow(bracket, "value string").write.text(path)
    return path


@query(
    "read_training_jsonl",
    """SELECT 'q' || doc_id AS query, lang || '|' || source AS pos, CASE WHEN doc_id % 2 = 0 THEN 'n' ELSE '' END AS neg FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0""",
)
def read_training_jsonl_q(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, sf, "documents").select(
        F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("q"), i.cast("string"))).alias("query"),
        F.when(i % 7 != 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>")).alias("pos"),
        F.when(i % 2 == 0, F.array(F.lit("n"))).alias("neg"),
    )
    back = R.read_training_jsonl(spark, _lines(rows, "training"), for_eval=True)
    return back.select("query", F.array_join("pos", "|").alias("pos"), F.array_join("neg", "|").alias("neg"))


@query(
    "read_mirage_json",
    """SELECT CASE WHEN event_type = 'click' THEN 'medqa' WHEN event_type = 'error' THEN 'bioasq' ELSE 'mmlu' END AS dataset, 'Q' || event_id AS question,
  'A:x|B:' || user_id AS options, 'A' AS answer FROM events WHERE event_type IN ('click', 'error', 'view')""",
)
def read_mirage_json_q(spark: SparkSession, sf: str) -> DataFrame:
    """Questions per dataset; a dataset outside the five known names is ignored."""
    e = table(spark, sf, "events")
    name = F.when(F.col("event_type") == "click", "medqa").when(F.col("event_type") == "error", "bioasq").when(F.col("event_type") == "view", "mmlu").otherwise("other")
    item = F.struct(
        F.concat(F.lit("Q"), F.col("event_id").cast("string")).alias("question"),
        F.create_map(F.lit("A"), F.lit("x"), F.lit("B"), F.col("user_id").cast("string")).alias("options"), F.lit("A").alias("answer"),
    )
    path = scratch_path(spark, "mirage")
    sets = e.groupBy(name.alias("name"), (F.col("event_id") % 64).alias("part")).agg(F.collect_list(item).alias("items"))
    sets.repartition(8).select(F.to_json(F.create_map("name", "items")).alias("value"), "part").write.partitionBy("part").option("maxRecordsPerFile", 1).text(path)
    back = R.read_mirage_json(spark, path)
    shown = F.transform("options", lambda o: F.concat(o["key"], F.lit(":"), o["value"]))
    return back.select("dataset", "question", F.array_join(shown, "|").alias("options"), "answer")


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


_SESSIONS = """SELECT conv_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, md5(text) AS content_md5,
  '2024-01-01 00:' || lpad(turn::VARCHAR, 2, '0') AS timestamp, 'by=' || role || '|turn=' || turn AS metadata, 'said=' || n AS context
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE r <= 20"""


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The last messages of every conversation with time and metadata, and how many there were as a context variable."""
    said = _messages(spark, sf)
    turn = F.col("turn").cast("string")
    noted = last_n_messages(said).withColumns({
        "timestamp": F.concat(F.lit("2024-01-01 00:"), F.lpad(turn, 2, "0")), "metadata": F.create_map(F.lit("by"), "role", F.lit("turn"), turn),
    })
    contexts = said.groupBy("session_id").agg(F.create_map(F.lit("said"), F.count("*").cast("string")).alias("context"))
    return W.session_rows(noted, contexts=contexts)


def _shown(rows: DataFrame) -> DataFrame:
    flat = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e.key, e.value))), "|")
    return rows.select("session_id", "turn", "role", md5("content").alias("content_md5"), "timestamp", flat("metadata").alias("metadata"), flat("context").alias("context"))


@query("read_sessions_json", _SESSIONS)
def read_sessions_json_q(spark: SparkSession, sf: str) -> DataFrame:
    """Session objects as JSON lines, in files of the writer's size."""
    objects = _sessions(spark, sf).select(F.to_json(F.struct("session_id", "messages", "summary", "context")).alias("value"))
    path = scratch_path(spark, "sessions")
    objects.write.text(path)
    return _shown(R.read_sessions_json(spark, path, lines=True))


@query("write_sessions_json", _SESSIONS)
def write_sessions_json_q(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "saved-sessions")
    W.write_sessions_json(_sessions(spark, sf), path)
    return _shown(R.read_sessions_json(spark, path, lines=True))


@query(
    "read_pubmed_xml",
    """SELECT doc_id::VARCHAR AS pmid, 'Title ' || lang AS title, 'AIM: aim ' || source || chr(10) || 'body ' || doc_id AS abstract,
  CASE WHEN doc_id % 2 = 0 THEN 'Li Wei|Ng' ELSE 'Li Wei' END AS authors, 'J ' || source AS journal,
  CASE doc_id % 3 WHEN 0 THEN '2020' WHEN 1 THEN '2020-May' ELSE '2020-May-7' END AS pub_date, '10.1/' || doc_id AS doi, 'k1|' || lang AS keywords, 'M1|M2' AS mesh_terms
FROM documents WHERE doc_id % 10 <> 9""",
)
def read_pubmed_xml_q(spark: SparkSession, sf: str) -> DataFrame:
    """An article record per document; a tenth lacks the identifier."""
    i = F.col("doc_id")
    d = table(spark, sf, "documents")

    def val(c):
        return F.struct(c.alias("_VALUE"))

    pub = F.struct(F.lit("2020").alias("Year"), F.when(i % 3 > 0, "May").alias("Month"), F.when(i % 3 == 2, "7").alias("Day"))
    text = F.array(
        F.struct(F.lit("AIM").alias("_Label"), F.concat(F.lit("aim "), "source").alias("_VALUE")),
        F.struct(F.lit(None).cast("string").alias("_Label"), F.concat(F.lit("body "), i.cast("string")).alias("_VALUE")),
    )
    li = F.struct(F.lit("Li").alias("LastName"), F.lit("Wei").alias("ForeName"))
    ng = F.struct(F.lit("Ng").alias("LastName"), F.lit(None).cast("string").alias("ForeName"))
    anon = F.struct(F.lit(None).cast("string").alias("LastName"), F.lit("Anon").alias("ForeName"))
    article = F.struct(
        F.struct(F.concat(F.lit("J "), "source").alias("Title"), F.struct(pub.alias("PubDate")).alias("JournalIssue")).alias("Journal"),
        F.concat(F.lit("Title "), "lang").alias("ArticleTitle"),
        F.struct(text.alias("AbstractText")).alias("Abstract"),
        F.struct(F.when(i % 2 == 0, F.array(li, ng, anon)).otherwise(F.array(li, anon)).alias("Author")).alias("AuthorList"),
    )
    cit = F.struct(
        F.when(i % 10 != 9, val(i.cast("string"))).alias("PMID"), article.alias("Article"),
        F.array(F.struct(F.array(val(F.lit("k1")), val(F.col("lang"))).alias("Keyword"))).alias("KeywordList"),
        F.struct(F.array(*[F.struct(val(F.lit(m)).alias("DescriptorName")) for m in ("M1", "M2")]).alias("MeshHeading")).alias("MeshHeadingList"),
    )
    ids = F.array(
        F.struct(F.lit("pii").alias("_IdType"), F.lit("S1").alias("_VALUE")),
        F.struct(F.lit("doi").alias("_IdType"), F.concat(F.lit("10.1/"), i.cast("string")).alias("_VALUE")),
    )
    rows = d.select(cit.alias("MedlineCitation"), F.struct(F.struct(ids.alias("ArticleId")).alias("ArticleIdList")).alias("PubmedData"))
    path = scratch_path(spark, "pubmed")
    rows.write.format("xml").option("rowTag", "PubmedArticle").option("rootTag", "PubmedArticleSet").save(path)
    a = R.read_pubmed_xml(spark, path)
    lists = {c: F.array_join(c, "|") for c in ("authors", "keywords", "mesh_terms")}
    return a.withColumns(lists)


def registry_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A file registry derived from events: the status follows the event type."""
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "pending").otherwise("indexed")
    return e.select(
        F.md5(F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("filename"),
        F.lit("/p").alias("path"), F.col("user_id").alias("size_bytes"), status.alias("status"), F.lit(0).cast("bigint").alias("chunk_count"),
        F.when(F.col("event_type") == "error", "bad").alias("error_message"),
        F.col("ts").cast("timestamp").alias("created_at"), F.col("ts").cast("timestamp").alias("updated_at"),
    )


_REG = """reg AS (SELECT md5(event_id::VARCHAR) AS id, event_id, 'f' || event_id AS filename, user_id AS size_bytes,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'pending' ELSE 'indexed' END AS status, CASE WHEN event_type = 'error' THEN 'bad' END AS error_message, ts FROM events)"""


@query("read_file_registry", f"WITH {_REG} SELECT id, filename, status, size_bytes, error_message FROM reg WHERE status = 'pending' ORDER BY ts DESC, id")
def read_file_registry_q(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "registry")
    G.commit_registry(registry_rows(spark, sf), path)
    pending = G.all_documents(G.pending_documents(G.read_file_registry(spark, path)))
    return pending.select("id", "filename", "status", "size_bytes", "error_message")


@query("documents_by_id", f"WITH {_REG} SELECT id, filename, status FROM reg WHERE event_id IN (SELECT doc_id FROM documents)")
def documents_by_id_q(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "documents").select(F.md5(F.col("doc_id").cast("string")).alias("id"))
    return G.documents_by_id(registry_rows(spark, sf), ids).select("id", "filename", "status")


@query(
    "upsert_registry",
    f"""WITH {_REG} SELECT id, filename, CASE WHEN event_id % 2 = 0 THEN 'indexed' ELSE status END AS status, CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END AS chunk_count,
  error_message, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-06-01' ELSE ts END AS updated_at FROM reg WHERE event_id % 10 <> 3
UNION ALL SELECT md5('new' || doc_id), 'n' || doc_id, 'pending', 0, NULL, TIMESTAMP '2024-06-01' FROM documents""",
)
def upsert_registry_q(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the files change status, each document arrives as a new file, a tenth is deleted."""
    reg = registry_rows(spark, sf)
    e, d = table(spark, sf, "events"), table(spark, sf, "documents")
    i = F.col("event_id")
    null = F.lit(None).cast("string")
    changed = e.filter(i % 2 == 0).select(
        F.md5(i.cast("string")).alias("id"), F.lit("indexed").alias("status"), i.alias("chunk_count"), null.alias("error_message"), null.alias("filename")
    )
    created = d.select(
        F.md5(F.concat(F.lit("new"), F.col("doc_id").cast("string"))).alias("id"), null.alias("status"), F.lit(None).cast("bigint").alias("chunk_count"),
        null.alias("error_message"), F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("filename"),
    )
    done = G.upsert_registry(reg, changed.unionByName(created), F.lit(NOW))
    gone = e.filter(i % 10 == 3).select(F.md5(i.cast("string")).alias("id"))
    path = scratch_path(spark, "registry")
    G.commit_registry(reg, path)
    G.commit_registry(G.delete_documents(done, gone), path)
    return G.read_file_registry(spark, path).select("id", "filename", "status", "chunk_count", "error_message", "updated_at")


def _index_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    empty = {c: F.lit(None).cast("string") for c in ("path", "title", "year", "doi", "indexed_at")}
    return to_index_rows(chunk(d.withColumns({**empty, "keywords": F.array("lang")}), "fixed"))


@query("write_index", f"WITH {_FIXED} SELECT f.doc_id, chunk_index, md5(f.text) AS original_md5, source FROM fixed f JOIN documents USING (doc_id)")
def write_index_q(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends of complementary halves give the whole collection."""
    path = scratch_path(spark, "index")
    rows = _index_rows(spark, sf)
    W.write_index(rows.filter("doc_id % 2 = 0"), path, recreate=True)
    W.write_index(rows.filter("doc_id % 2 = 1"), path)
    return W.read_index(spark, path).select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), md5("original_text").alias("original_md5"), "source"
    )


@query("count_index", f"WITH {_FIXED} SELECT source, (SELECT count(*) FROM fixed) AS rows_in_index, count(*) AS docs FROM documents GROUP BY source")
def count_index_q(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "index")
    W.write_index(_index_rows(spark, sf), path)
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("docs"))
    return counts.select("source", F.lit(W.count_index(spark, path)).alias("rows_in_index"), "docs")


@query("drop_index", f"WITH {_FIXED} SELECT source, (SELECT count(*) FROM fixed) AS before, 0 AS after, true AS dropped, count(*) AS docs FROM documents GROUP BY source")
def drop_index_q(spark: SparkSession, sf: str) -> DataFrame:
    """Row count before and after the collection is dropped."""
    path = scratch_path(spark, "index")
    W.write_index(_index_rows(spark, sf), path)
    before = W.count_index(spark, path)
    dropped = W.drop_index(spark, path)
    after = W.count_index(spark, path)
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("docs"))
    return counts.select("source", F.lit(before).alias("before"), F.lit(after).alias("after"), F.lit(dropped).alias("dropped"), "docs")


@query(
    "write_training_jsonl",
    f"""WITH {SQL_PAIRS}, o AS (SELECT *, row_number() OVER (ORDER BY md5(pair_id || '|42'), pair_id) - 1 AS p, count(*) OVER () AS n FROM pairs)
SELECT query, md5(positive) AS pos_md5, 3 AS n_neg, CASE WHEN p < floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM o""",
)
def write_training_jsonl_q(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "train")
    W.write_training_jsonl(N.shuffle_split(N.add_random_negatives(_valid(spark, sf)), 0.9), path)
    parts = [R.read_training_jsonl(spark, f"{path}/split={s}").withColumn("split", F.lit(s)) for s in ("train", "val")]
    both = parts[0].unionByName(parts[1])
    return both.select("query", md5(F.get("pos", F.lit(0))).alias("pos_md5"), F.size("neg").alias("n_neg"), "split")


@query("write_pairs_json", f"WITH {SQL_PAIRS} SELECT query, md5(positive) AS positive_md5, 3 AS n_negatives FROM pairs")
def write_pairs_json_q(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "pairs")
    W.write_pairs_json(N.add_random_negatives(_valid(spark, sf)), path)
    back = W.read_pairs_json(spark, path)
    return back.select("query", md5("positive").alias("positive_md5"), F.size("negatives").alias("n_negatives"))


@query("write_metrics", f"{_PER} {_LONG}")
def write_metrics_q(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "metrics")
    W.write_metrics(M.evaluate_run(labelled_run(spark, sf), KS), path)
    return spark.read.schema("metric string, k int, value double").json(path)
