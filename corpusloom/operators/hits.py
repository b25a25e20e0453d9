"""Result lists: fusion, reranking, score conventions, filters, projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import lexicon as L
from corpusloom.functions import text as T
from corpusloom.functions.ranking import top_per_group

DIGITS = 6


def fuse_weighted(
    dense: DataFrame, sparse: DataFrame, k: int, alpha: DataFrame | float = 0.7, norm: str = "bounded"
) -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse over the union of both lists.

    ``alpha`` is a number or a table ``(query_id, alpha)``; a query whose alpha
    is 1 or 0 keeps the plain score of its only side. ``norm='bounded'`` maps
    cosine to [0,1] by (1+x)/2 and BM25 by 2/pi*atan(x); ``norm='none'`` takes
    the scores as they are.
    """
    d = dense.select("query_id", "chunk_id", F.col("score").alias("dense_score"))
    s = sparse.select("query_id", "chunk_id", F.col("score").alias("sparse_score"))
    both = d.join(s, ["query_id", "chunk_id"], "full_outer")
    if isinstance(alpha, DataFrame):
        both = both.join(alpha.select("query_id", "alpha"), "query_id")
    else:
        both = both.withColumn("alpha", F.lit(float(alpha)))
    if norm == "bounded":
        dn = (1 + F.col("dense_score")) / 2
        sn = F.lit(2 / math.pi) * F.atan("sparse_score")
    else:
        dn, sn = F.col("dense_score"), F.col("sparse_score")
    a = F.col("alpha")
    mixed = a * F.coalesce(dn, F.lit(0.0)) + (1 - a) * F.coalesce(sn, F.lit(0.0))
    score = F.when(a == 1, F.col("dense_score")).when(a == 0, F.col("sparse_score")).otherwise(mixed)
    # both inputs have 6 digits; halving and weighting them must not meet the rounding edge
    scored = both.withColumn("score", F.round(score, 9)).filter("score is not null").drop("alpha")
    return top_per_group(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def overlap_f1(a: Column, b: Column) -> Column:
    """F1 of two distinct-token arrays; 0 when either is empty or nothing is shared."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (shared == 0), F.lit(0.0)).otherwise(
        2.0 * shared / (F.size(a) + F.size(b))
    )


def word_overlap(query: Column, text: Column) -> Column:
    """Word-set F1 of two texts, each tokenised once."""
    return T.let(
        T.content_words(query), lambda a: T.let(T.content_words(text), lambda b: overlap_f1(a, b))
    )


def rerank(
    hits: DataFrame,
    k: int,
    scorer: Column | None = None,
    query_col: str = "query",
    text_col: str = "text",
) -> DataFrame:
    """Re-score candidates, stable on ties, keep ``k``.

    ``scorer`` is any column over the hit rows - a model wrapped in a pandas
    UDF or a stored score; the default is the word overlap of query and text.
    A query with one candidate keeps it unscored.
    """
    if scorer is None:
        body = F.coalesce("original_text", text_col) if "original_text" in hits.columns else F.col(text_col)
        scorer = word_overlap(F.col(query_col), body)
    n = F.count("*").over(Window.partitionBy("query_id"))
    scored = (
        hits.withColumn("rerank_score", F.round(scorer, DIGITS))
        .withColumn("_n", n)
        .withColumn("rerank_score", F.when(F.col("_n") > 1, F.col("rerank_score")))
        .withColumnRenamed("rank", "candidate_rank")
    )
    order = [F.desc_nulls_last("rerank_score"), F.asc("candidate_rank")]
    return top_per_group(scored.drop("_n"), ["query_id"], order, k)


def unify_score(mode: str = "evaluator", rerank_col: str = "rerank_score", score_col: str = "score", distance_col: str = "distance") -> Column:
    """One score per hit out of rerank score, score and distance.

    generator: -distance, missing 0 | evaluator: max(0, 1-distance), missing .5
    api: distance ignored, missing 0 | falsy: like generator, a 0 rerank score
    falls through to the score.
    """
    r, s, d = F.col(rerank_col), F.col(score_col), F.col(distance_col)
    if mode == "generator":
        return F.coalesce(r, s, -d, F.lit(0.0))
    if mode == "evaluator":
        return F.coalesce(r, s, F.when(d.isNotNull(), F.greatest(F.lit(0.0), 1 - d)), F.lit(0.5))
    if mode == "api":
        return F.coalesce(r, s, F.lit(0.0))
    if mode == "falsy":
        return F.coalesce(F.when(r != 0, r), s, -d, F.lit(0.0))
    raise ValueError(f"unknown score mode: {mode}")


def filter_relevant(hits: DataFrame, min_score: float = 0.5, score: Column | None = None) -> DataFrame:
    return hits.filter((score if score is not None else F.col("score")) >= min_score)


def filter_with_relaxation(hits: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Queries left with fewer than three hits use a threshold lower by 0.2."""
    if min_score <= 0.3:
        return hits.filter(F.col("score") >= min_score)
    kept = F.count_if(F.col("score") >= min_score).over(Window.partitionBy("query_id"))
    limit = F.when(F.col("_kept") < 3, F.lit(min_score - 0.2)).otherwise(F.lit(min_score))
    return hits.withColumn("_kept", kept).filter(F.col("score") >= limit).drop("_kept")


def article_hits(articles: DataFrame, k: int, score: float = 0.8) -> DataFrame:
    """The first min(5, k) articles a query as hits of a fixed score.

    ``articles`` carries query_id, article_rank, pmid, title, abstract, authors;
    one without an abstract uses up its place but gives no hit.
    """
    first = top_per_group(
        articles, ["query_id"], [F.asc("article_rank"), F.asc("pmid")], min(5, k), "_place"
    )
    kept = first.filter(F.coalesce(F.length("abstract"), F.lit(0)) > 0)
    place = Window.partitionBy("query_id").orderBy("_place")
    names = F.array_join(F.slice("authors", 1, 3), ", ")
    return kept.select(
        "query_id",
        F.row_number().over(place).alias("rank"),
        F.col("pmid").cast("string").alias("pmid"),
        F.concat_ws("\n\n", "title", "abstract").alias("text"),
        F.concat(F.lit("PubMed: "), F.col("pmid").cast("string")).alias("source"),
        F.when(F.size("authors") > 3, F.concat(names, F.lit("..."))).otherwise(names).alias("authors"),
        F.lit(score).alias("score"),
    )


def add_external_hits(hits: DataFrame, external: DataFrame) -> DataFrame:
    """Own hits first, external ones after them; ranks run on."""
    own = hits.groupBy("query_id").agg(F.max("rank").alias("_own"))
    moved = (
        external.join(own, "query_id", "left")
        .withColumn("rank", F.col("rank") + F.coalesce(F.col("_own"), F.lit(0)))
        .drop("_own")
    )
    return hits.unionByName(moved, allowMissingColumns=True)


def search_results(hits: DataFrame) -> DataFrame:
    """Flat result rows: defaults filled, keywords parsed, hit total per query."""
    total = F.count("*").over(Window.partitionBy("query_id"))
    return hits.select(
        "query_id",
        "rank",
        F.coalesce("original_text", "text").alias("text"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("rerank_score", "score", F.lit(0.0)).alias("score"),
        "title",
        "year",
        "doi",
        F.from_json("keywords", "array<string>").alias("keywords"),
        "chunk_index",
        total.alias("total"),
    )


def preview(c: Column, limit: int = 200) -> Column:
    """Leading characters, with three dots when cut."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("..."))).otherwise(c)


def format_results_text(hits: DataFrame) -> DataFrame:
    """One numbered text block per query in rank order."""
    title = F.coalesce(F.col("title"), F.lit(""))
    head = F.concat(
        F.lit("[文献"), F.col("rank").cast("string"), F.lit("]"),
        F.when(title != "", F.concat(F.lit(" "), title)).otherwise(""),
        F.lit(" (来源: "), F.coalesce("source", F.lit(L.UNKNOWN_SOURCE)),
        F.lit(", 相关度: "), F.format_string("%.4f", F.round("score", 4)), F.lit(")\n"),
        F.coalesce("original_text", "text"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", head.alias("part"))))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["part"]), L.PART_SEPARATOR).alias("formatted")
    )
