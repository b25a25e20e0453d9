"""Sparse, dense and hybrid search; rerank; score handling; result rows."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog.base import query, sql_str, sql_tokens, table
from corpusloom.catalog.ingest import sql_hashed
from corpusloom.functions import lexicon as L
from corpusloom.operators import hits as H
from corpusloom.operators.block_postings import BlockIndex, block_search, build_block_index
from corpusloom.operators.dense import dense_search, dense_search_approx
from corpusloom.operators.embedding import embed
from corpusloom.operators.lsh import dense_search_lsh, recall
from corpusloom.operators.sparse import Bm25Index, bm25_search, build_bm25_index
from corpusloom.plans.search import hybrid_search
from corpusloom.sources.readers import recent_articles
from corpusloom.session import materialize

K = 10


def corpus_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is one chunk, its whole text included."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_INDEXES: dict[tuple[str, str], Bm25Index] = {}


def document_index(spark: SparkSession, sf: str, fresh: bool = False) -> Bm25Index:
    """The stored index of a table directory: written once per application, then only read."""
    key = (spark.sparkContext.applicationId, sf)
    if fresh or key not in _INDEXES:
        _INDEXES[key] = build_bm25_index(corpus_chunks(spark, sf))
    return _INDEXES[key]


# ---- the same definitions as SQL ---------------------------------------
SQL_BM25 = f"""toks AS (SELECT doc_id AS chunk_id, unnest({sql_tokens('text')}) AS term FROM documents),
 postings AS (SELECT chunk_id, term, count(*)::DOUBLE AS tf FROM toks GROUP BY ALL),
 lens AS (SELECT doc_id AS chunk_id, len({sql_tokens('text')})::DOUBLE AS len FROM documents),
 corpus AS (SELECT count(*)::DOUBLE AS n, avg(len) AS avg_len FROM lens),
 dfs AS (SELECT term, count(*)::DOUBLE AS df FROM postings GROUP BY term),
 qterms AS (SELECT query_id, term, count(*)::DOUBLE AS qtf FROM (SELECT query_id, unnest({sql_tokens('query')}) AS term FROM q) GROUP BY ALL),
 bm AS (SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
     / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS score
   FROM qterms JOIN postings USING (term) JOIN dfs USING (term) JOIN lens USING (chunk_id), corpus GROUP BY ALL),
 sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm)"""
SQL_BENCH = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
SQL_DENSE = f"""dv AS ({sql_hashed('documents', 'doc_id', 'text')}),
 qv AS ({sql_hashed('q', 'query_id', 'query')}),
 dn AS (SELECT doc_id, sqrt(sum(weight::DOUBLE * weight::DOUBLE)) AS norm FROM dv GROUP BY 1),
 qn AS (SELECT query_id, sqrt(sum(weight::DOUBLE * weight::DOUBLE)) AS norm FROM qv GROUP BY 1),
 raw AS (SELECT query_id, doc_id AS chunk_id, sum(qv.weight::DOUBLE * dv.weight::DOUBLE) AS dot FROM qv JOIN dv USING (bucket) GROUP BY ALL),
 cos AS (SELECT q.query_id, d.doc_id AS chunk_id, round(coalesce(dot / (qn.norm * dn.norm), 0), 6) AS score
   FROM q CROSS JOIN documents d LEFT JOIN raw r ON r.query_id = q.query_id AND r.chunk_id = d.doc_id
   LEFT JOIN qn ON qn.query_id = q.query_id LEFT JOIN dn ON dn.doc_id = d.doc_id),
 dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cos)"""


def sql_fused(alpha: float, keep: int) -> str:
    return f"""fused_all AS (SELECT query_id, chunk_id,
     round({alpha}::DOUBLE * coalesce((1 + d.score) / 2, 0) + (1 - {alpha}::DOUBLE) * coalesce({2 / math.pi!r}::DOUBLE * atan(s.score), 0), 9) AS score
   FROM (SELECT * FROM dense WHERE rank <= {2 * keep}) d FULL JOIN (SELECT * FROM sparse WHERE rank <= {2 * keep}) s USING (query_id, chunk_id)),
 fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused_all) WHERE rank <= {keep})"""


_CORPORA: dict[tuple[str, str], DataFrame] = {}


def embedded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Query vectors, and the stored vectors of a table directory: written once per application, then only read."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CORPORA:
        _CORPORA[key] = materialize(embed(corpus_chunks(spark, sf).select("chunk_id", "text")).select("chunk_id", "embedding"), "corpus")
    return materialize(embed(benchmark_queries(spark, sf), "query"), "queries"), _CORPORA[key]


@query(
    "build_bm25_index",
    f"""WITH {SQL_BENCH}, {SQL_BM25} SELECT term, df::BIGINT AS df,
  round(max(tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS max_impact, sum(tf)::BIGINT AS tf
FROM postings JOIN dfs USING (term) JOIN lens USING (chunk_id), corpus GROUP BY ALL""",
)
def build_bm25_index_q(spark: SparkSession, sf: str) -> DataFrame:
    index = document_index(spark, sf, fresh=True)
    totals = index.postings.groupBy("term").agg(F.sum("tf").alias("tf"))
    return index.terms.join(totals, "term").select("term", "df", F.round("max_impact", 6).alias("max_impact"), "tf")


@query("bm25_search", f"WITH {SQL_BENCH}, {SQL_BM25} SELECT query_id, chunk_id, score, rank FROM sparse WHERE rank <= 20")
def bm25_search_q(spark: SparkSession, sf: str) -> DataFrame:
    hits = bm25_search(document_index(spark, sf), benchmark_queries(spark, sf), 2 * K, "query")
    return hits.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("bm25_search_pruned", f"WITH {SQL_BENCH}, {SQL_BM25} SELECT query_id, chunk_id, score, rank FROM sparse WHERE rank <= 20")
def bm25_search_pruned_q(spark: SparkSession, sf: str) -> DataFrame:
    """The form for query tables whose hot terms would pair with most chunks."""
    hits = bm25_search(document_index(spark, sf), benchmark_queries(spark, sf), 2 * K, "query", prune=True)
    return hits.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


_BLOCKS: dict[tuple[str, str], BlockIndex] = {}


@query("bm25_block_search", f"WITH {SQL_BENCH}, {SQL_BM25} SELECT query_id, chunk_id, score, rank FROM sparse WHERE rank <= 20")
def bm25_block_search_q(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as queries, through blocks of postings."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BLOCKS:
        _BLOCKS[key] = build_block_index(corpus_chunks(spark, sf))
    hits = block_search(_BLOCKS[key], benchmark_queries(spark, sf), 2 * K, "query")
    return hits.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


# every stored vector is a query against all of them
SQL_VECTORS = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
 n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
 sims AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, a.label AS q_label, b.label AS c_label,
   round(list_inner_product(a.e, b.e), 6) AS score FROM n a CROSS JOIN n b),
 knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims) WHERE rank <= 20)"""


def vector_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf, "embeddings")
    return v.select(F.col("vec_id").alias("query_id"), "embedding"), v.select(F.col("vec_id").alias("chunk_id"), "embedding")


def vector_hits(spark: SparkSession, sf: str, **args) -> DataFrame:
    queries, corpus = vector_tables(spark, sf)
    hits = dense_search(queries, corpus, 2 * K, **args)
    return hits.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("dense_search", f"WITH {SQL_VECTORS} SELECT query_id, chunk_id, score, rank FROM knn")
def dense_search_q(spark: SparkSession, sf: str) -> DataFrame:
    return vector_hits(spark, sf)


@query("dense_search_cells", f"WITH {SQL_VECTORS} SELECT query_id, chunk_id, score, rank FROM knn")
def dense_search_cells_q(spark: SparkSession, sf: str) -> DataFrame:
    """The form for query tables too large to broadcast."""
    return vector_hits(spark, sf, block_bytes=0)


@query("dense_search_approx")
def dense_search_approx_q(spark: SparkSession, sf: str) -> DataFrame:
    queries, corpus = vector_tables(spark, sf)
    return dense_search_approx(queries, corpus, K).select("query_id", "chunk_id", "score", "rank")


@query("dense_search_lsh", "SELECT count(*) AS queries, 10 * count(*) AS expected, true AS recall_reached, 0::BIGINT AS wrong FROM benchmark")
def dense_search_lsh_q(spark: SparkSession, sf: str) -> DataFrame:
    """Whether at least nine in ten of the exact hits are found, and every score is right."""
    queries, corpus = embedded(spark, sf)
    found = recall(dense_search_lsh(queries, corpus, K), dense_search(queries, corpus, K))
    return found.select("queries", "expected", (F.col("found") >= 0.9 * F.col("expected")).alias("recall_reached"), "wrong")


@query(
    "fuse_weighted",
    f"WITH {SQL_BENCH}, {SQL_BM25}, {SQL_DENSE}, {sql_fused(0.7, K)} SELECT query_id, chunk_id, score, rank FROM fused",
)
def fuse_weighted_q(spark: SparkSession, sf: str) -> DataFrame:
    queries, corpus = embedded(spark, sf)
    dense = dense_search(queries, corpus, 2 * K)
    sparse = bm25_search(document_index(spark, sf), queries, 2 * K, "query")
    return H.fuse_weighted(dense, sparse, K).select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


# each query's alpha by its number: terms only, vectors only, mixed
@query(
    "hybrid_search",
    f"""WITH {SQL_BENCH}, {SQL_BM25}, {SQL_DENSE}, {sql_fused(0.5, K)},
 alls AS (SELECT query_id, chunk_id, score, rank FROM fused WHERE query_id % 3 = 2
   UNION ALL SELECT query_id, chunk_id, score, rank FROM sparse WHERE query_id % 3 = 0 AND rank <= {K}
   UNION ALL SELECT query_id, chunk_id, score, rank FROM dense WHERE query_id % 3 = 1 AND rank <= {K})
SELECT * FROM alls""",
)
def hybrid_search_q(spark: SparkSession, sf: str) -> DataFrame:
    queries, corpus = embedded(spark, sf)
    alpha = F.when(F.col("query_id") % 3 == 0, 0.0).when(F.col("query_id") % 3 == 1, 1.0).otherwise(0.5)
    found = hybrid_search(queries.withColumn("alpha", alpha), document_index(spark, sf), corpus, K, "alpha")
    return found.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


SQL_RERANK = f"""cand AS (SELECT f.query_id, f.chunk_id, f.rank AS candidate_rank, list_distinct({sql_tokens('q.query')}) AS a,
   list_distinct({sql_tokens('d.text')}) AS b, q.query, d.text, d.source
   FROM fused f JOIN q USING (query_id) JOIN documents d ON d.doc_id = f.chunk_id),
 scored AS (SELECT *, len(list_intersect(a, b)) AS s FROM cand),
 marks AS (SELECT *, round(CASE WHEN s = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * s / (len(a) + len(b)) END, 6) AS rerank_score FROM scored),
 reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, candidate_rank) AS rank FROM marks) WHERE rank <= {K})"""


def reranked_hits(spark: SparkSession, sf: str) -> DataFrame:
    queries, corpus = embedded(spark, sf)
    return hybrid_search(
        queries, document_index(spark, sf), corpus, K, 0.7, use_rerank=True, texts=corpus_chunks(spark, sf), candidates=50
    )


@query(
    "rerank",
    f"""WITH {SQL_BENCH}, {SQL_BM25}, {SQL_DENSE}, {sql_fused(0.7, 50)}, {SQL_RERANK}
SELECT query_id, chunk_id, candidate_rank, rerank_score, rank FROM reranked""",
)
def rerank_q(spark: SparkSession, sf: str) -> DataFrame:
    return reranked_hits(spark, sf).select(
        "query_id", "chunk_id", F.col("candidate_rank").cast("bigint").alias("candidate_rank"), "rerank_score",
        F.col("rank").cast("bigint").alias("rank"),
    )


# score columns with gaps, derived from the whole vectors
def scored_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    x, y = (F.abs(f("embedding").cast("double")) for f in (F.array_max, F.array_min))
    i = F.col("vec_id")
    return v.select(
        (i % 50).alias("query_id"), i.alias("chunk_id"),
        F.when(i % 4 == 0, F.when(i % 8 == 0, 0.0).otherwise(x)).alias("rerank_score"),
        F.when(i % 3 == 0, y).alias("score"),
        F.when(i % 5 != 0, x + y).alias("distance"),
    )


SQL_SCORED = """sv AS (SELECT vec_id % 50 AS query_id, vec_id AS chunk_id,
   CASE WHEN vec_id % 4 = 0 THEN CASE WHEN vec_id % 8 = 0 THEN 0.0::DOUBLE ELSE abs(list_max(embedding)::DOUBLE) END END AS rerank_score,
   CASE WHEN vec_id % 3 = 0 THEN abs(list_min(embedding)::DOUBLE) END AS score,
   CASE WHEN vec_id % 5 <> 0 THEN abs(list_max(embedding)::DOUBLE) + abs(list_min(embedding)::DOUBLE) END AS distance FROM embeddings)"""


@query(
    "unify_score",
    f"""WITH {SQL_SCORED} SELECT chunk_id, coalesce(rerank_score, score, -distance, 0) AS generator,
  coalesce(rerank_score, score, CASE WHEN distance IS NOT NULL THEN greatest(0::DOUBLE, 1 - distance) END, 0.5::DOUBLE) AS evaluator,
  coalesce(rerank_score, score, 0) AS api,
  coalesce(nullif(rerank_score, 0), score, -distance, 0) AS falsy FROM sv""",
)
def unify_score_q(spark: SparkSession, sf: str) -> DataFrame:
    modes = ["generator", "evaluator", "api", "falsy"]
    return scored_vectors(spark, sf).select("chunk_id", *[H.unify_score(m).alias(m) for m in modes])


@query("filter_relevant", f"WITH {SQL_VECTORS} SELECT query_id, chunk_id, score FROM knn WHERE score >= 0.5::DOUBLE")
def filter_relevant_q(spark: SparkSession, sf: str) -> DataFrame:
    return H.filter_relevant(vector_hits(spark, sf)).select("query_id", "chunk_id", "score")


@query(
    "filter_with_relaxation",
    f"""WITH {SQL_VECTORS}, c AS (SELECT *, count(*) FILTER (score >= 0.5::DOUBLE) OVER (PARTITION BY query_id) AS kept FROM knn)
SELECT query_id, chunk_id, score FROM c WHERE score >= CASE WHEN kept < 3 THEN 0.5::DOUBLE - 0.2::DOUBLE ELSE 0.5::DOUBLE END""",
)
def filter_with_relaxation_q(spark: SparkSession, sf: str) -> DataFrame:
    return H.filter_with_relaxation(vector_hits(spark, sf)).select("query_id", "chunk_id", "score")


# four documents in a row stand for the articles of one query
def query_articles(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        F.floor(F.col("doc_id") / 4).alias("query_id"),
        F.col("doc_id").alias("article_rank"),
        F.col("doc_id").alias("pmid"),
        F.concat(F.lit("Article "), F.col("source")).alias("title"),
        F.when(F.col("doc_id") % 3 != 0, F.col("text")).otherwise("").alias("abstract"),
        F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 5 + 1).cast("int")), lambda i: F.concat(F.lit("A"), i.cast("string"))).alias("authors"),
    )


@query(
    "add_external_hits",
    f"""WITH {SQL_VECTORS}, own AS (SELECT query_id, 'vec ' || chunk_id AS source, '' AS text, score, rank FROM knn),
 art AS (SELECT * FROM (SELECT doc_id // 4 AS query_id, doc_id, text, source, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) AS place FROM documents) WHERE place <= 5),
 ext AS (SELECT query_id, 'PubMed: ' || doc_id AS source, 'Article ' || source || chr(10) || chr(10) || text AS text, 0.8::DOUBLE AS score,
   row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank,
   CASE WHEN doc_id % 5 + 1 > 3 THEN 'A1, A2, A3...' ELSE array_to_string(list_transform(range(1, doc_id % 5 + 2), lambda i: 'A' || i), ', ') END AS authors
   FROM art WHERE doc_id % 3 <> 0 AND length(text) > 0)
SELECT query_id, source, md5(text) AS text_md5, score, rank, NULL AS authors FROM own
UNION ALL SELECT e.query_id, e.source, md5(e.text), e.score, e.rank + coalesce(o.m, 0), e.authors
FROM ext e LEFT JOIN (SELECT query_id, max(rank) AS m FROM own GROUP BY 1) o USING (query_id)""",
)
def add_external_hits_q(spark: SparkSession, sf: str) -> DataFrame:
    own = vector_hits(spark, sf).select(
        "query_id", F.concat(F.lit("vec "), F.col("chunk_id").cast("string")).alias("source"), F.lit("").alias("text"), "score", "rank"
    )
    external = H.article_hits(query_articles(spark, sf), 10).withColumn("rank", F.col("rank").cast("bigint")).drop("pmid")
    both = H.add_external_hits(own, external)
    return both.select("query_id", "source", F.md5("text").alias("text_md5"), "score", "rank", "authors")


@query(
    "search_results",
    f"""WITH {SQL_BENCH}, {SQL_BM25}, h AS (SELECT s.*, d.text, d.source, d.lang FROM sparse s JOIN documents d ON d.doc_id = s.chunk_id WHERE rank <= {K})
SELECT query_id, rank, md5(text) AS text_md5, CASE WHEN chunk_id % 7 = 0 THEN '' ELSE source END AS source, score, 'T ' || lang AS title,
  CASE WHEN chunk_id % 2 = 0 THEN lang || '|b' END AS keywords, 0 AS chunk_index, count(*) OVER (PARTITION BY query_id) AS total,
  CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM h""",
)
def search_results_q(spark: SparkSession, sf: str) -> DataFrame:
    hits = bm25_search(document_index(spark, sf), benchmark_queries(spark, sf), K, "query")
    even = F.col("chunk_id") % 2 == 0
    rows = hits.join(table(spark, sf, "documents").withColumnRenamed("doc_id", "chunk_id"), "chunk_id").select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "text", F.lit(None).cast("string").alias("original_text"),
        F.when(F.col("chunk_id") % 7 != 0, F.col("source")).alias("source"), "score", F.lit(None).cast("double").alias("rerank_score"),
        F.concat(F.lit("T "), "lang").alias("title"), F.lit("").alias("year"), F.lit("").alias("doi"),
        F.when(even, F.concat(F.lit('["'), "lang", F.lit('", "b"]'))).otherwise("[broken").alias("keywords"), F.lit(0).alias("chunk_index"),
    )
    out = H.search_results(rows)
    return out.select(
        "query_id", "rank", F.md5("text").alias("text_md5"), "source", "score", "title",
        F.array_join("keywords", "|").alias("keywords"), "chunk_index", "total", H.preview(F.col("text")).alias("preview"),
    )


@query(
    "recent_articles",
    """SELECT o_orderkey AS pmid, o_orderdate::DATE AS pub_date FROM orders
WHERE o_orderdate::DATE BETWEEN DATE '1998-06-01' - 30 AND DATE '1998-06-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""",
)
def recent_articles_q(spark: SparkSession, sf: str) -> DataFrame:
    """Orders stand for dated articles; the top-k of a report by date."""
    articles = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pmid"), F.col("o_orderdate").cast("date").alias("pub_date"))
    return recent_articles(articles, F.lit(dt.date(1998, 6, 1)), 30, 100)
