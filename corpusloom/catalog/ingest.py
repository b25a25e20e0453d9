"""Cleaning, metadata, chunking, enrichment, embedding, indexing."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog.base import (
    SQL_MARKED, marked_documents, query, sql_clean, sql_sentences, sql_str, sql_strip, sql_tokens, table,
)
from corpusloom.catalog.chunk_sql import markdown_sql, recursive_sql, semantic_sql
from corpusloom.functions import lexicon as L
from corpusloom.functions import text as T
from corpusloom.operators import embedding as E
from corpusloom.operators.chunking import ChunkConfig, chunk, hashed_sentence_encoder
from corpusloom.operators.enrichment import apply_contexts, build_context_prompts, truncate_document
from corpusloom.operators.metadata import extract_metadata, to_index_rows
from corpusloom.session import scratch_path
from corpusloom.plans.index_job import index_documents, outcome_summary

md5 = F.md5


@query("clean_text", f"SELECT doc_id, md5({sql_clean('text')}) AS text_md5, length({sql_clean('text')})::BIGINT AS n FROM documents")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    c = T.clean_text(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", md5(c).alias("text_md5"), F.length(c).cast("bigint").alias("n"))


# headers that hold every kind of metadata, put before some of the documents
HEADERS = [
    "",
    "A study of glucose control (2021)\nDOI: 10.1234/abc.def-5, keywords: glucose; insulin, diet\n\n",
    "doi:10.5555/x_y.z.\n关键词：血糖；胰岛素，饮食 运动\n摘要 120199\n",
    "http://example.org\nKeywords: one;two , three\n\nIntroduction 1998年\n",
]
_HEADED = f"""headed AS (SELECT doc_id, 'abcdef01_' || source || '.PDF' AS source,
  [{', '.join(sql_str(h) for h in HEADERS)}][doc_id % {len(HEADERS)} + 1] || text AS text FROM documents)"""


@query(
    "extract_metadata",
    rf"""WITH {_HEADED}, h AS (SELECT doc_id, source, substr(text, 1, 2000) AS h FROM headed),
 k AS (SELECT *,
   regexp_extract(h, '\b(10\.\d{{4,}}/[^\s]+)\b', 1) AS d,
   regexp_extract(h, '((?:19|20)\d{{2}})', 1) AS y,
   regexp_extract(h, '(?s)关键词[：:](.*?)(?:\n|摘要|Abstract)', 1) AS kz,
   regexp_extract(h, '(?is)Keywords?[：:](.+?)(?:\n\n|Introduction|Background)', 1) AS ke,
   list_filter(list_transform(string_split(h, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '')[1] AS f
   FROM h),
 l AS (SELECT *,
   list_filter(list_transform(regexp_split_to_array({sql_strip('kz')}, '[;；,，\s]+'), lambda x: {sql_strip('x')}), lambda x: x <> '' AND length(x) < 20) AS lz,
   list_filter(list_transform(regexp_split_to_array({sql_strip('ke')}, '[;,]+'), lambda x: {sql_strip('x')}), lambda x: x <> '' AND length(x) < 50) AS le,
   regexp_replace(regexp_replace(source, '^[a-f0-9]{{8}}_', ''), '(?i)\.pdf$', '') AS stem FROM k)
SELECT doc_id, nullif(rtrim(d, '.,;'), '') AS doi, nullif(y, '') AS year,
  CASE WHEN len(lz) > 0 THEN array_to_string(lz, '|') WHEN len(le) > 0 THEN array_to_string(le, '|') END AS keywords,
  CASE WHEN length(f) > 10 AND length(f) < 150 AND NOT (f LIKE 'http%' OR f LIKE 'doi%' OR f LIKE 'DOI%') THEN f
    WHEN stem <> '' THEN stem END AS title
FROM l""",
)
def extract_metadata_q(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    headed = d.select(
        "doc_id",
        F.concat(F.lit("abcdef01_"), "source", F.lit(".PDF")).alias("source"),
        F.concat(F.get(F.array(*[F.lit(h) for h in HEADERS]), (F.col("doc_id") % len(HEADERS)).cast("int")), "text").alias("text"),
    )
    return extract_metadata(headed).select("doc_id", "doi", "year", F.array_join("keywords", "|").alias("keywords"), "title")


@query(
    "split_sections",
    rf"""WITH {SQL_MARKED}, c AS (SELECT doc_id, {sql_clean('text')} AS t FROM marked),
 p AS (SELECT doc_id, t, string_split(regexp_replace(t, '(?m)^(#{{1,6}})\s+(.+)$', chr(1) || '\1' || chr(2) || '\2' || chr(3), 'g'), chr(1)) AS ps FROM c),
 u AS (SELECT doc_id, len(ps) AS n, unnest(ps) AS x, unnest(range(len(ps))) AS i FROM p),
 s AS (SELECT doc_id, i, n,
   CASE WHEN contains(x, chr(3)) THEN {sql_strip("split_part(split_part(x, chr(3), 1), chr(2), 2)")} ELSE '' END AS title,
   CASE WHEN contains(x, chr(3)) THEN {sql_strip("split_part(x, chr(3), 2)")} WHEN n = 1 THEN x ELSE {sql_strip('x')} END AS body,
   CASE WHEN contains(x, chr(3)) THEN length(split_part(x, chr(2), 1)) ELSE 0 END AS level FROM u)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, title, md5(body) AS body_md5, level::BIGINT AS level
FROM s WHERE title <> '' OR body <> '' OR n = 1""",
)
def split_sections(spark: SparkSession, sf: str) -> DataFrame:
    d = marked_documents(spark, sf).select("doc_id", T.clean_text(F.col("text")).alias("t"))
    return d.select("doc_id", F.posexplode(T.sections(F.col("t"))).alias("pos", "s")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "s.title", md5("s.body").alias("body_md5"),
        F.col("s.level").cast("bigint").alias("level"),
    )


@query(
    "split_paragraphs",
    rf"""WITH {SQL_MARKED}, p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\n+'), lambda x: {sql_strip('x')}), lambda x: x <> '') AS ps FROM marked)
SELECT doc_id, unnest(range(len(ps))) AS pos, md5(unnest(ps)) AS text_md5 FROM p""",
)
def split_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    d = marked_documents(spark, sf)
    return d.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "p")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), md5("p").alias("text_md5")
    )


@query(
    "split_sentences",
    f"""WITH s AS (SELECT doc_id, {sql_sentences('text')} AS ss FROM documents)
SELECT doc_id, unnest(range(len(ss))) AS pos, md5(unnest(ss)) AS text_md5 FROM s""",
)
def split_sentences(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "p")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), md5("p").alias("text_md5")
    )


def _flat(chunks: DataFrame, *more: str) -> DataFrame:
    return chunks.select(
        "doc_id",
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("chunk_start").cast("bigint").alias("chunk_start"),
        F.col("chunk_end").cast("bigint").alias("chunk_end"),
        md5("text").alias("text_md5"),
        *more,
    )


def _fixed_sql(size: int, overlap: int, minimum: int) -> str:
    step = max(1, size - overlap)
    return rf"""c AS (SELECT doc_id, {sql_clean('text')} AS t FROM documents),
 w AS (SELECT doc_id, t, unnest(range(0, greatest(0, ceil((length(t) - {size}) / {step}.0))::BIGINT + 1)) * {step} AS a FROM c WHERE t <> ''),
 x AS (SELECT doc_id, a, least(length(t), a + {size}) AS b, {sql_strip(f'substr(t, a + 1, {size})')} AS s FROM w),
 fixed AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS chunk_index, a AS chunk_start, b AS chunk_end, s AS text
   FROM x WHERE length(s) >= {minimum} AND s <> '')"""


_FIXED = _fixed_sql(512, 64, 100)


@query("chunk_fixed", f"WITH {_FIXED} SELECT doc_id, chunk_index, chunk_start, chunk_end, md5(text) AS text_md5 FROM fixed")
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(chunk(table(spark, sf, "documents").select("doc_id", "text"), "fixed"))


@query("chunk_markdown", markdown_sql())
def chunk_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(chunk(marked_documents(spark, sf), "markdown"), "section")


@query("chunk_recursive", recursive_sql())
def chunk_recursive(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(chunk(marked_documents(spark, sf), "recursive"))


def hashed_text_encoder():
    """Encoder factory for sentences: hashed vectors of the index tokens."""
    import re

    split = re.compile(r"[^\s\-_.,;:!?()\[\]{}\"'/]+")
    return lambda texts: hashed_sentence_encoder([split.findall(t.lower()) for t in texts])


@query("chunk_semantic", semantic_sql())
def chunk_semantic(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text")
    return _flat(chunk(d, "semantic", encoder=hashed_text_encoder))


@query(
    "chunk",
    f"WITH {_fixed_sql(1000, 200, 100)} SELECT doc_id, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM fixed GROUP BY doc_id",
)
def chunk_q(spark: SparkSession, sf: str) -> DataFrame:
    """The strategy switch with a size and overlap of the call's own."""
    c = chunk(table(spark, sf, "documents").select("doc_id", "text"), "fixed", ChunkConfig(size=1000, overlap=200))
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


def _sql_truncated(tokens: int) -> str:
    half = 2 * tokens
    return f"""CASE WHEN length(text) > {4 * tokens} THEN substr(text, 1, {half}) || {sql_str(L.OMITTED_MIDDLE)} || substr(text, length(text) - {half - 1}) ELSE text END"""


@query("truncate_document", f"SELECT doc_id, md5({_sql_truncated(200)}) AS text_md5 FROM documents")
def truncate_document_q(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", md5(truncate_document(F.col("text"), 200)).alias("text_md5"))


def _fixed(spark: SparkSession, sf: str) -> DataFrame:
    return chunk(table(spark, sf, "documents").select("doc_id", "text"), "fixed")


@query(
    "build_context_prompts",
    f"""WITH {_FIXED}, d AS (SELECT doc_id, {_sql_truncated(6000)} AS doc FROM documents)
SELECT doc_id, chunk_index, md5({sql_str(L.COMPACT_SYSTEM_PROMPT)}) AS system_md5,
  md5(replace(replace({sql_str(L.CONTEXT_PROMPTS['compact'])}, '{{chunk}}', text), '{{document}}', doc)) AS prompt_md5
FROM fixed JOIN d USING (doc_id)""",
)
def build_context_prompts_q(spark: SparkSession, sf: str) -> DataFrame:
    p = build_context_prompts(table(spark, sf, "documents"), _fixed(spark, sf), "qwen3-8b")
    return p.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), md5("system_prompt").alias("system_md5"), md5("prompt").alias("prompt_md5"))


@query(
    "apply_contexts",
    rf"""WITH {_FIXED}, r AS (SELECT doc_id, chunk_index, text,
  CASE (doc_id + chunk_index) % 4 WHEN 0 THEN '<think>a' || chr(10) || 'b</think> about ' || substr(text, 1, 20)
    WHEN 1 THEN 'context of ' || doc_id::VARCHAR WHEN 2 THEN '<think>x</think>' END AS response FROM fixed),
 told AS (SELECT *, coalesce({sql_strip("regexp_replace(response, '(?s)<think>.*?</think>', '', 'g')")}, '') AS ctx FROM r)
SELECT doc_id, chunk_index, md5(CASE WHEN ctx <> '' THEN ctx || chr(10) || chr(10) || text ELSE text END) AS text_md5,
  md5(text) AS original_md5, ctx AS context, ctx <> '' AS has_context FROM told""",
)
def apply_contexts_q(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _fixed(spark, sf)
    kind = (F.col("doc_id") + F.col("chunk_index")) % 4
    response = (
        F.when(kind == 0, F.concat(F.lit("<think>a\nb</think> about "), F.left("text", F.lit(20))))
        .when(kind == 1, F.concat(F.lit("context of "), F.col("doc_id").cast("string")))
        .when(kind == 2, "<think>x</think>")
    )
    done = apply_contexts(chunks, chunks.select("doc_id", "chunk_index", response.alias("response")).filter("response is not null"))
    return done.select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), md5("text").alias("text_md5"),
        md5("original_text").alias("original_md5"), "context", "has_context",
    )


@query(
    "to_index_rows",
    f"""WITH {_FIXED} SELECT doc_id, chunk_index, md5(array_to_string({sql_tokens('f.text')}, ' ')) AS text_md5,
  md5(f.text) AS original_md5, source, '' AS path, substr(lang || ' ' || repeat(source, 200), 1, 500) AS title, '20' || source AS year,
  substr('["' || lang || '", "k ' || source || '"]', 1, 1000) AS keywords, '' AS indexed_at
FROM fixed f JOIN documents d USING (doc_id)""",
)
def to_index_rows_q(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(
        "doc_id", "text", "source",
        F.lit(None).cast("string").alias("path"),
        F.concat("lang", F.lit(" "), F.repeat("source", 200)).alias("title"),
        F.concat(F.lit("20"), "source").alias("year"),
        F.lit(None).cast("string").alias("doi"),
        F.array("lang", F.concat(F.lit("k "), "source")).alias("keywords"),
        F.lit(None).cast("string").alias("indexed_at"),
    )
    rows = to_index_rows(chunk(d, "fixed"))
    return rows.select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), md5("text").alias("text_md5"),
        md5("original_text").alias("original_md5"), "source", "path", "title", "year", "keywords", "indexed_at",
    )


@query(
    "tokenize",
    f"""WITH t AS (SELECT doc_id, {sql_tokens('text')} AS ts FROM documents)
SELECT doc_id, len(ts)::BIGINT AS n, md5(array_to_string(ts, ' ')) AS tokens_md5 FROM t""",
)
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    toks = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("ts"))
    return toks.select("doc_id", F.size("ts").cast("bigint").alias("n"), md5(F.array_join("ts", " ")).alias("tokens_md5"))


def sql_hashed(source: str, key: str, text: str, dim: int = 256) -> str:
    """CTE body: (key, bucket, weight) of the hashed unit vectors."""
    return f"""SELECT {key}, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY {key})))::FLOAT AS weight FROM (
  SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS bucket, count(*)::DOUBLE AS n
  FROM (SELECT {key}, unnest({sql_tokens(text)}) AS t FROM {source}) GROUP BY ALL)"""


@query("embed", f"SELECT doc_id, bucket, round(weight::DOUBLE, 4) AS weight FROM ({sql_hashed('documents', 'doc_id', 'text')})")
def embed_q(spark: SparkSession, sf: str) -> DataFrame:
    e = E.embed(table(spark, sf, "documents").select("doc_id", "text"))
    return e.select("doc_id", F.posexplode("embedding").alias("bucket", "w")).filter("w > 0").select(
        "doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round(F.col("w").cast("double"), 4).alias("weight")
    )


NOW = dt.datetime(2024, 3, 1)
_NOW = "TIMESTAMP '2024-03-01 00:00:00'"


def cache_log(spark: SparkSession, sf: str) -> DataFrame:
    """An embedding cache derived from documents and events: two models, various ages."""
    d, e = table(spark, sf, "documents"), table(spark, sf, "events")
    hashed = d.select(F.col("doc_id").alias("event_id"), F.sha2("text", 256).alias("text_sha256"), F.length("text").alias("text_len"))
    rows = hashed.join(e.select("event_id", "ts", "user_id"), "event_id")
    return rows.select(
        F.when(F.col("user_id") % 3 == 0, "old-model").otherwise("new-model").alias("model_id"),
        "text_sha256", "text_len", F.col("ts").alias("created_at"),
        F.array(F.lit(1.0), F.col("text_len").cast("double")).cast("array<float>").alias("embedding"),
    )


_CACHE = """cache AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'old-model' ELSE 'new-model' END AS model_id,
  sha256(text) AS text_sha256, length(text)::BIGINT AS text_len, ts AS created_at FROM documents JOIN events ON doc_id = event_id)"""


@query(
    "embed_with_cache",
    f"""WITH {_CACHE}, live AS (SELECT DISTINCT text_sha256 FROM cache WHERE model_id = 'new-model'
   AND epoch({_NOW}) - epoch(created_at) <= 5184000)
SELECT doc_id, sha256(text) AS text_sha256, sha256(text) IN (SELECT text_sha256 FROM live) AS cache_hit FROM documents""",
)
def embed_with_cache_q(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text")
    rows, _ = E.embed_with_cache(d, cache_log(spark, sf), "new-model", F.lit(NOW), 60 * 86400)
    return rows.select("doc_id", "text_sha256", "cache_hit")


@query("cache_invalidate", f"WITH {_CACHE} SELECT model_id, text_sha256, text_len FROM cache WHERE model_id = 'new-model'")
def cache_invalidate_q(spark: SparkSession, sf: str) -> DataFrame:
    kept = E.cache_invalidate(cache_log(spark, sf), "new-model")
    return kept.select("model_id", "text_sha256", F.col("text_len").cast("bigint").alias("text_len"))


@query("cache_expire", f"WITH {_CACHE} SELECT count(*) FILTER (epoch({_NOW}) - epoch(created_at) > 5097600) AS expired FROM cache")
def cache_expire_q(spark: SparkSession, sf: str) -> DataFrame:
    return E.cache_expire(cache_log(spark, sf), F.lit(NOW), 59 * 86400)[1]


@query(
    "cache_stats",
    f"""WITH {_CACHE} SELECT model_id, count(*) AS total, sum(text_len)::BIGINT AS total_chars, min(created_at) AS oldest,
  max(created_at) AS newest, 86400.0::DOUBLE AS ttl_seconds FROM cache GROUP BY model_id""",
)
def cache_stats_q(spark: SparkSession, sf: str) -> DataFrame:
    return E.cache_stats(cache_log(spark, sf), 86400)


@query(
    "index_job",
    f"""WITH {_FIXED}, n AS (SELECT doc_id, count(*) AS c FROM fixed GROUP BY 1),
 o AS (SELECT d.doc_id, coalesce(c, 0) AS c, d.doc_id % 10 <> 9 AS present FROM documents d LEFT JOIN n USING (doc_id))
SELECT doc_id, CASE WHEN present AND c > 0 THEN 'indexed' ELSE 'failed' END AS status, CASE WHEN present THEN c ELSE 0 END AS chunk_count,
  CASE WHEN NOT present THEN '文件不存在' WHEN c = 0 THEN '解析失败，无文本块' END AS error_message FROM o""",
)
def index_job(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is pending; a tenth of the files is missing."""
    d = table(spark, sf, "documents").withColumn("path", F.col("source")).withColumn("indexed_at", F.lit("2024-03-01"))
    present = d.filter("doc_id % 10 <> 9").select("doc_id", "text", "source", "path", "indexed_at")
    return index_documents(d.select("doc_id"), present, scratch_path(spark, "index-job"), "fixed")


@query(
    "index_job_summary",
    f"""WITH {_FIXED}, n AS (SELECT doc_id, count(*) AS c FROM fixed GROUP BY 1)
SELECT CASE WHEN c > 0 THEN 'indexed' ELSE 'failed' END AS status, count(*) AS files, sum(coalesce(c, 0))::BIGINT AS chunks
FROM documents LEFT JOIN n USING (doc_id) GROUP BY 1""",
)
def index_job_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("path", F.col("source")).withColumn("indexed_at", F.lit("2024-03-01"))
    docs = d.select("doc_id", "text", "source", "path", "indexed_at")
    return outcome_summary(index_documents(d.select("doc_id"), docs, scratch_path(spark, "index-job"), "fixed"))
