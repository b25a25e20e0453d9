"""Rewrite, route, retrieve, assess, and retry what was not good enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.assessment import assess
from corpusloom.operators.embedding import embed
from corpusloom.operators.sparse import Bm25Index
from corpusloom.operators.understanding import rewrite, route
from corpusloom.plans.search import hybrid_search
from corpusloom.session import materialize

# the retrieval branch that each route stands for
BRANCH_ALPHA = {"vector": 1.0, "bm25": 0.0}


def understand(queries: DataFrame) -> DataFrame:
    """query_id, original, query (rewritten), query_type, confidence, alpha."""
    staged = queries.withColumn("_w", rewrite(F.col("query"), F.col("previous_query")))
    staged = staged.select("query_id", F.col("_w.original").alias("original"), F.col("_w.rewritten").alias("query"))
    return staged.withColumn("_r", route(F.col("query"))).select(
        "query_id", "original", "query", "_r.query_type", "_r.confidence", F.col("_r.alpha").alias("alpha")
    )


def agentic_retrieve(
    queries: DataFrame,
    index: Bm25Index,
    corpus: DataFrame,
    texts: DataFrame,
    top_k: int = 10,
    max_attempts: int = 2,
    hybrid_alpha: float = 0.7,
) -> tuple[DataFrame, DataFrame]:
    """(hits, verdicts) for ``queries(query_id, query, previous_query)``.

    Directly answerable queries retrieve nothing. The first pass follows each
    query's route, later passes are hybrid and run only for the queries whose
    result was not sufficient; the pass count is bounded by ``max_attempts``.
    A query that went hybrid before would find the same again: its rows stand
    for the later pass.
    """
    told = materialize(embed(understand(queries), "query"), "agentic-queries")
    active = told.filter("query_type <> 'direct'").withColumn(
        "alpha",
        F.when(F.col("query_type") == "vector", BRANCH_ALPHA["vector"])
        .when(F.col("query_type") == "bm25", BRANCH_ALPHA["bm25"])
        .otherwise(F.lit(hybrid_alpha)),
    )
    kept: list[tuple[DataFrame, DataFrame]] = []
    changed, known = active, None
    for attempt in range(1, max_attempts + 1):
        found = hybrid_search(changed.select("query_id", "query", "embedding", "alpha"), index, corpus, top_k, "alpha")
        rows = found.join(texts, "chunk_id").select("query_id", "chunk_id", "score", "rank", "text", "source")
        rows = rows if known is None else rows.unionByName(known)
        rows = materialize(rows.withColumn("attempt", F.lit(attempt)), "agentic-hits")
        verdict = materialize(assess(active, rows).withColumn("attempt", F.lit(attempt)), "agentic-verdicts")
        if attempt == max_attempts:
            kept.append((rows, verdict))
            break
        good = verdict.filter("decision = 'sufficient'")
        kept.append((rows.join(good.select("query_id"), "query_id", "left_semi"), good))
        again = verdict.filter("decision <> 'sufficient'").select("query_id")
        retried = materialize(active.join(again, "query_id", "left_semi"), "agentic-again")
        same = retried.filter(F.col("alpha") == hybrid_alpha).select("query_id")
        known = rows.join(same, "query_id", "left_semi").drop("attempt")
        active = retried.withColumn("alpha", F.lit(hybrid_alpha))
        changed = active.join(same, "query_id", "left_anti")
    hits, verdicts = kept[0]
    for more_hits, more_verdicts in kept[1:]:
        hits, verdicts = hits.unionByName(more_hits), verdicts.unionByName(more_verdicts)
    route_info = told.select("query_id", "original", "query", "query_type", "confidence")
    return hits, route_info.join(verdicts, "query_id", "left")
