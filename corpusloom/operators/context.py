"""Answer contexts and message lists, one row per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import lexicon as L
from corpusloom.functions import text as T
from corpusloom.operators.enrichment import fill

MAX_CHARS = 12000
MAX_CHARS_PER_DOC = 2000


def format_context(
    hits: DataFrame, max_chars: int | None = MAX_CHARS, per_doc: int | None = MAX_CHARS_PER_DOC
) -> DataFrame:
    """query_id, context, n_docs: numbered sources within a character budget.

    ``hits(query_id, rank, text, source, score)`` is a top-k list. A running
    sum gives the room left before each document: documents that fit stay
    whole, the first one that does not is cut to the room and ends the list.
    """
    body = T.truncate_ellipsis(F.col("text"), per_doc)
    head = F.concat(
        F.lit("[文献"), F.col("rank").cast("string"), F.lit("] 来源: "),
        F.coalesce("source", F.lit(L.UNKNOWN_SOURCE)),
        F.lit(" (相关度: "), F.format_string("%.4f", F.round("score", 4)), F.lit(")\n"),
    )
    parts = hits.select("query_id", "rank", head.alias("head"), body.alias("body"))
    if max_chars:
        sep = len(L.PART_SEPARATOR)
        so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        whole = F.length("head") + F.length("body")
        used = F.coalesce(F.sum(whole + sep).over(so_far), F.lit(0))
        room = F.col("room") - F.length("head")
        parts = (
            parts.withColumn("room", F.lit(max_chars) - used)
            .filter((F.col("room") > 0) & ((whole <= F.col("room")) | (room > 0)))
            .withColumn("body", F.when(whole <= F.col("room"), F.col("body")).otherwise(T.truncate_ellipsis(F.col("body"), room)))
        )
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.concat("head", "body").alias("part"))))
    return parts.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["part"]), L.PART_SEPARATOR).alias("context"),
        F.count("*").alias("n_docs"),
    )


def build_messages(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """query_id, messages, answer: a query without documents gets the fixed answer."""
    joined = queries.select("query_id", "query").join(contexts.select("query_id", "context"), "query_id", "left")

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    user = fill(L.USER_PROMPT, context=F.col("context"), query=F.col("query"))
    found = F.col("context").isNotNull()
    return joined.select(
        "query_id",
        F.when(found, F.array(message("system", F.lit(L.SYSTEM_PROMPT)), message("user", user))).alias("messages"),
        F.when(~found, F.lit(L.NO_ANSWER)).alias("answer"),
    )


def format_results(queries: DataFrame, formatted: DataFrame) -> DataFrame:
    """Result text per query; queries without a result get the fixed text."""
    return queries.select("query_id").join(formatted, "query_id", "left").select(
        "query_id", F.coalesce("formatted", F.lit(L.NO_RESULTS)).alias("formatted")
    )
