"""MRR, Recall, NDCG and answer-accuracy over whole runs.

``hits(query_id, item, rank)`` is a ranked run. What is relevant comes either
as ``qrels(query_id, item)`` or as labels: an item is relevant to a query of
the same label. Labels are compared on the hits only, so a label that holds a
third of all items never pairs them up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.ranking import hash_order

METRICS = ["mrr", "recall", "ndcg"]
DIGITS = 6


def judge_by_qrels(hits: DataFrame, queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relevant hits, queries with their number ``n_rel`` of relevant items)."""
    rel = qrels.select("query_id", "item").distinct()
    counts = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    good = hits.join(rel, ["query_id", "item"], "left_semi").select("query_id", "item", "rank")
    return good, queries.select("query_id").join(counts, "query_id", "left")


def judge_by_labels(hits: DataFrame, queries: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from ``queries(query_id, label)`` and ``items(item, label)``."""
    counts = items.groupBy("label").agg(F.count("*").alias("n_rel"))
    q = queries.select("query_id", F.col("label").alias("_wanted"))
    good = hits.join(q, "query_id").join(items.select("item", "label"), "item").filter("label = _wanted")
    return good.select("query_id", "item", "rank"), queries.select("query_id", "label").join(counts, "label", "left")


def per_query_metrics(judged: tuple[DataFrame, DataFrame], ks: list[int] = [1, 5, 10], dedupe: bool = False) -> DataFrame:
    """query_id plus mrr@k, recall@k, ndcg@k columns; unanswered queries count as 0.

    Items may repeat in a run (several chunks of a source); NDCG then counts
    each place unless ``dedupe`` keeps the best place only.
    """
    good, queries = judged
    if dedupe:
        good = good.groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    rank = F.col("rank")
    facts = []
    for k in ks:
        within = rank <= k
        facts += [
            F.min(F.when(within, rank)).alias(f"_first{k}"),
            F.size(F.collect_set(F.when(within, F.col("item")))).alias(f"_found{k}"),
            F.sum(F.when(within, 1 / F.log2(rank + 1)).otherwise(0.0)).alias(f"_dcg{k}"),
        ]
    stats = good.filter(rank <= max(ks)).groupBy("query_id").agg(*facts)
    rows = queries.select("query_id", "n_rel").join(stats, "query_id", "left")
    n = F.coalesce("n_rel", F.lit(0))
    out: list[Column] = []
    for k in ks:
        ideal = F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1)).cast("int")),
            F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1),
        )
        some = n > 0
        out += [
            F.coalesce(1 / F.col(f"_first{k}"), F.lit(0.0)).alias(f"mrr@{k}"),
            F.when(some, F.coalesce(f"_found{k}", F.lit(0)) / n).otherwise(0.0).alias(f"recall@{k}"),
            F.when(some, F.coalesce(f"_dcg{k}", F.lit(0.0)) / ideal).otherwise(0.0).alias(f"ndcg@{k}"),
        ]
    return rows.select("query_id", *out)


def _mean_of(judged: tuple[DataFrame, DataFrame], metric: str, k: int, **kw) -> DataFrame:
    per = per_query_metrics(judged, [k], **kw)
    return per.agg(F.round(F.avg(f"`{metric}@{k}`"), DIGITS).alias(metric), F.count("*").alias("n_queries"))


def mrr_at_k(judged: tuple[DataFrame, DataFrame], k: int = 10) -> DataFrame:
    return _mean_of(judged, "mrr", k)


def recall_at_k(judged: tuple[DataFrame, DataFrame], k: int = 10) -> DataFrame:
    return _mean_of(judged, "recall", k)


def ndcg_at_k(judged: tuple[DataFrame, DataFrame], k: int = 10, dedupe: bool = False) -> DataFrame:
    return _mean_of(judged, "ndcg", k, dedupe=dedupe)


def evaluate_run(judged: tuple[DataFrame, DataFrame], ks: list[int] = [1, 5, 10], dedupe: bool = False) -> DataFrame:
    """metric, k, value: every metric at every cut-off, averaged over queries."""
    per = per_query_metrics(judged, ks, dedupe)
    means = per.agg(*[F.avg(f"`{m}@{k}`").alias(f"{m}@{k}") for m in METRICS for k in ks])
    rows = [
        F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.round(F.col(f"`{m}@{k}`"), DIGITS).alias("value"))
        for m in METRICS
        for k in ks
    ]
    return means.select(F.inline(F.array(*rows)))


def compare_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Second minus first per metric and cut-off."""
    a = first.withColumnRenamed("value", "first")
    b = second.withColumnRenamed("value", "second")
    return a.join(b, ["metric", "k"]).withColumn("difference", F.round(F.col("second") - F.col("first"), DIGITS))


def corpus_from_items(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, corpus, qrels) of training items ``(query_id, query, pos[], neg[])``.

    The corpus holds every positive and negative passage; an item's own
    positives are relevant to it.
    """
    queries = items.select("query_id", "query")
    tagged = items.select(
        "query_id",
        F.explode(
            F.concat(
                F.transform("pos", lambda p, i: F.struct(F.lit("p").alias("kind"), i.alias("i"), p.alias("text"))),
                F.transform("neg", lambda p, i: F.struct(F.lit("n").alias("kind"), i.alias("i"), p.alias("text"))),
            )
        ).alias("_p"),
    )
    corpus = tagged.select(
        F.concat_ws("-", F.col("query_id").cast("string"), "_p.kind", F.col("_p.i").cast("string")).alias("chunk_id"),
        F.col("_p.text").alias("text"),
    )
    qrels = tagged.filter("_p.kind = 'p'").select(
        "query_id",
        F.concat_ws("-", F.col("query_id").cast("string"), F.lit("p"), F.col("_p.i").cast("string")).alias("item"),
    )
    return queries, corpus, qrels


def predicted_option(options: Column, answer: Column, strict: bool = False) -> Column:
    """First option key that occurs in the upper-cased answer, '' when none does.

    ``options`` is an ARRAY of (key, value) structs, so that its order is kept.
    ``strict`` asks for the key as a word of its own.
    """
    up = F.upper(answer)
    if strict:
        hit = F.filter(options, lambda o: F.regexp_like(up, F.concat(F.lit(r"\b"), o["key"], F.lit(r"\b"))))
    else:
        hit = F.filter(options, lambda o: F.contains(up, o["key"]))
    return F.coalesce(F.get(hit, F.lit(0))["key"], F.lit(""))


def mirage_accuracy(items: DataFrame, strict: bool = False) -> DataFrame:
    """dataset, correct, total, accuracy, and one row for all of them.

    ``items(dataset, options, answer, response)``; no response counts as wrong.
    """
    right = F.coalesce(
        predicted_option(F.col("options"), F.coalesce("response", F.lit("")), strict) == F.col("answer"), F.lit(False)
    )
    return (
        items.select(F.coalesce("dataset", F.lit("unknown")).alias("dataset"), right.alias("right"))
        .rollup("dataset")
        .agg(
            F.count_if("right").alias("correct"),
            F.count("*").alias("total"),
            F.round(F.avg(F.col("right").cast("double")), DIGITS).alias("accuracy"),
            F.grouping("dataset").alias("_all"),
        )
        .select(F.when(F.col("_all") == 1, "overall").otherwise(F.col("dataset")).alias("dataset"), "correct", "total", "accuracy")
    )


def context_hit_rate(items: DataFrame, hits: DataFrame) -> DataFrame:
    """hit rate and mean number of retrieved texts over all items.

    ``items(query_id, option_text)`` with the correct option's text. A query is
    hit when one of the option's first three words, longer than 3 characters,
    occurs in a retrieved text; options of at most 5 characters never count.
    """
    words = F.filter(F.slice(F.split(T.strip(F.col("option_text")), r"(?U)\s+"), 1, 3), lambda w: F.length(w) > 3)
    keyed = items.select(
        "query_id",
        F.when(F.length("option_text") > 5, words).otherwise(F.array().cast("array<string>")).alias("_w"),
    )
    low = F.lower(F.col("text"))
    seen = hits.join(keyed, "query_id").groupBy("query_id").agg(
        F.max(F.exists("_w", lambda w: F.contains(low, F.lower(w)))).alias("hit"), F.count("*").alias("n")
    )
    rows = items.select("query_id").join(seen, "query_id", "left")
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if("hit").alias("hits"),
        F.round(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)), DIGITS).alias("context_hit_rate"),
        F.round(F.avg(F.coalesce("n", F.lit(0))), DIGITS).alias("avg_retrieved"),
    )


def sample_questions(items: DataFrame, limit: int | None, seed: int = 42, id_col: str = "query_id") -> DataFrame:
    """A repeatable random sample without replacement; no limit keeps everything."""
    if not limit:
        return items
    return items.orderBy(hash_order(id_col, seed=seed), id_col).limit(limit)


def metric_summary(cases: DataFrame, threshold: float = 0.5) -> DataFrame:
    """metric, mean score, pass rate, cases, failures; ``cases(metric, score, error)``.

    A failed case scores 0.
    """
    score = F.when(F.col("error").isNotNull(), 0.0).otherwise(F.coalesce("score", F.lit(0.0)))
    return cases.groupBy("metric").agg(
        F.round(F.avg(score), DIGITS).alias("mean_score"),
        F.round(F.avg(F.when(score >= threshold, 1.0).otherwise(0.0)), DIGITS).alias("pass_rate"),
        F.count("*").alias("cases"),
        F.count("error").alias("failures"),
    )


def build_eval_cases(items: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, question, expected, answer, contexts (non-empty, in rank order)."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("rank", "text"))))
    contexts = hits.groupBy("query_id").agg(F.transform(ordered, lambda x: x["text"]).alias("contexts"))
    return (
        items.join(answers.select("query_id", "answer"), "query_id", "left")
        .join(contexts, "query_id", "left")
        .select(
            "query_id",
            "question",
            F.coalesce("expected", F.lit("")).alias("expected"),
            F.coalesce("answer", F.lit("")).alias("answer"),
            F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"),
        )
    )


def run_report(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean over the rows without an error, numbers of samples and errors, success rate."""
    fine = F.col("error").isNull()
    return results.groupBy(*(keys or [])).agg(
        F.round(F.coalesce(F.avg(F.when(fine, F.col("score"))), F.lit(0.0)), DIGITS).alias("mean_score"),
        F.count("*").alias("samples"),
        F.count_if(~fine).alias("errors"),
        F.round(F.avg(fine.cast("double")), DIGITS).alias("success_rate"),
    )
