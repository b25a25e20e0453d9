"""Hybrid retrieval for a table of queries: candidates, fusion, rerank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import content_words
from corpusloom.operators.dense import dense_search
from corpusloom.operators.hits import fuse_weighted, overlap_f1, rerank
from corpusloom.operators.sparse import Bm25Index, bm25_search
from corpusloom.session import materialize

CANDIDATES = 50


def hybrid_search(
    queries: DataFrame,
    index: Bm25Index,
    corpus: DataFrame,
    top_k: int = 10,
    alpha: float | str = 0.7,
    use_rerank: bool = False,
    texts: DataFrame | None = None,
    scorer: Column | None = None,
    candidates: int = CANDIDATES,
) -> DataFrame:
    """query_id, chunk_id, scores, rank.

    ``queries(query_id, query, embedding[, alpha])``; ``alpha`` is a number or
    the name of a column, so that every query can follow its own route. 1 uses
    vectors only and 0 terms only; those queries skip the other branch. With
    ``use_rerank`` the ``candidates`` best are joined to ``texts(chunk_id, text)``
    and re-scored; ``scorer`` is a column over ``query`` and ``text``.
    """
    keep = candidates if use_rerank else top_k
    named = queries.withColumn("_a", F.col(alpha) if isinstance(alpha, str) else F.lit(float(alpha)))
    dense = dense_search(named.filter("_a > 0"), corpus, 2 * keep)
    sparse = bm25_search(index, named.filter("_a < 1"), 2 * keep, "query")
    weights = named.select("query_id", F.col("_a").alias("alpha"))
    fused = fuse_weighted(dense, sparse, keep, weights if isinstance(alpha, str) else alpha)
    if not use_rerank:
        return fused
    fused = materialize(fused, "fused")  # read for the candidates' texts and for the pairs
    wanted = texts.select("chunk_id", "text").join(fused.select("chunk_id").distinct(), "chunk_id", "left_semi")
    if scorer is None:
        # a text is tokenised once, however many queries have it as a candidate
        wanted = wanted.select("chunk_id", content_words(F.col("text")).alias("_words"))
        asked = queries.select("query_id", content_words(F.col("query")).alias("_asked"))
        scorer = overlap_f1(F.col("_asked"), F.col("_words"))
    else:
        asked = queries.select("query_id", "query")
    pairs = fused.join(wanted, "chunk_id").join(asked, "query_id").withColumn("_score", scorer)
    return rerank(pairs.select(*fused.columns, "_score"), top_k, F.col("_score")).drop("_score")
