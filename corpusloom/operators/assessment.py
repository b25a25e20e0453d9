"""Judge result lists: relevance, sufficiency, best documents, decision.

One ``groupBy(query_id)`` over top-k hit rows gives all of it; queries without
hits come back through an outer join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import lexicon as L
from corpusloom.functions import text as T

RELEVANT = 0.5
HIGH, LOW, ENOUGH = 0.7, 0.4, 0.5
MIN_RELEVANT = 2


def _coverage(query: Column, text: Column) -> Column:
    """Share of the query's distinct blank-separated words found in the text."""
    words = F.array_distinct(F.filter(F.split(F.lower(query), r"(?U)\s+"), lambda w: w != ""))
    # both are bound once; a lambda would lower the text again for every word
    count = lambda ws, low: F.size(F.filter(ws, lambda w: F.contains(low, w))) / F.greatest(F.size(ws), F.lit(1))
    return T.let(words, lambda ws: T.let(F.lower(text), lambda low: count(ws, low)))


def assess(queries: DataFrame, hits: DataFrame, threshold: float = RELEVANT) -> DataFrame:
    """query_id, relevance, sufficiency, n_hits, best_docs, decision, reason, suggestions.

    ``hits(query_id, rank, score, text, source)`` with ranks from 1;
    ``best_docs`` are 0-based positions as in a result list.
    """
    s, rank = F.col("score"), F.col("rank")
    joined = hits.join(queries.select("query_id", "query"), "query_id")
    top5 = rank <= 5
    facts = joined.groupBy("query_id").agg(
        F.count("*").alias("n_hits"),
        (F.sum(s / rank) / F.sum(1 / rank)).alias("weighted"),
        F.avg(F.when(s > threshold, 1.0).otherwise(0.0)).alias("high_share"),
        F.coalesce(F.max(F.when(rank <= 3, _coverage(F.col("query"), F.col("text")))), F.lit(0.0)).alias("coverage"),
        F.count_if(s > threshold).alias("n_relevant"),
        F.sum(F.when(top5, F.length("text"))).alias("chars"),
        F.count_distinct(F.when(top5 & (F.col("source") != ""), F.col("source"))).alias("sources"),
        F.array_sort(F.collect_list(F.when(s >= threshold, (rank - 1).cast("int")))).alias("_good"),
    )
    relevance = F.least(
        F.lit(0.5) * F.col("weighted") + F.lit(0.3) * F.col("high_share") + F.lit(0.2) * F.col("coverage"), F.lit(1.0)
    )
    sufficiency = (
        F.lit(0.4) * F.least(F.col("n_relevant") / MIN_RELEVANT, F.lit(1.0))
        + F.lit(0.4) * F.least(F.coalesce("chars", F.lit(0)) / 1000, F.lit(1.0))
        + F.lit(0.2) * F.least(F.col("sources") / 3, F.lit(1.0))
    )
    scored = queries.select("query_id").join(facts, "query_id", "left").select(
        "query_id",
        F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
        F.when(F.col("n_hits") > 0, relevance).otherwise(0.0).alias("relevance"),
        F.when(F.col("n_hits") > 0, sufficiency).otherwise(0.0).alias("sufficiency"),
        _best(F.col("_good"), F.col("n_hits")).alias("best_docs"),
    )
    return decide(scored)


def _best(good: Column, n: Column) -> Column:
    """Relevant positions; fewer than three are filled from the first three; five at most."""
    first = F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), 1, F.least(n, F.lit(3)).cast("int"))
    filled = F.when(F.size(good) < 3, F.array_sort(F.array_union(good, first))).otherwise(good)
    return F.coalesce(F.slice(filled, 1, 5), F.array().cast("array<int>"))


def decide(scored: DataFrame) -> DataFrame:
    """Adds decision, reason and suggestions to relevance/sufficiency/n_hits rows."""
    rel, suf, n = F.col("relevance"), F.col("sufficiency"), F.col("n_hits")
    decision = (
        F.when(n == 0, "insufficient")
        .when((rel >= HIGH) & (suf >= ENOUGH), "sufficient")
        .when(rel >= LOW, "partial")
        .otherwise("insufficient")
    )

    def two(c: Column) -> Column:
        return F.format_string("%.2f", c)

    def words(items: list[str]) -> Column:
        return F.array(*[F.lit(i) for i in items])

    reason = (
        F.when(n == 0, L.REASON_EMPTY)
        .when(
            F.col("decision") == "sufficient",
            F.concat(F.lit("检索结果相关性高("), two(rel), F.lit(")且信息充分("), two(suf), F.lit(")")),
        )
        .when(F.col("decision") == "partial", F.concat(F.lit("检索结果部分相关("), two(rel), F.lit(")，建议优化查询")))
        .otherwise(F.concat(F.lit("检索结果相关性低("), two(rel), F.lit(")，建议更换检索策略")))
    )
    suggestions = (
        F.when(n == 0, words(L.SUGGEST_EMPTY))
        .when(F.col("decision") == "sufficient", F.array().cast("array<string>"))
        .when(
            F.col("decision") == "partial",
            F.when(suf < ENOUGH, words([*L.SUGGEST_PARTIAL, L.SUGGEST_MORE])).otherwise(words(L.SUGGEST_PARTIAL)),
        )
        .otherwise(words(L.SUGGEST_INSUFFICIENT))
    )
    return scored.withColumn("decision", decision).withColumn("reason", reason).withColumn("suggestions", suggestions)
