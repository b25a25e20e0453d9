"""Answer quality, one projection per metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import lexicon as L
from corpusloom.functions import text as T
from corpusloom.functions.vectors import cosine
from corpusloom.operators.extraction import medical_keywords
from corpusloom.operators.hits import overlap_f1

NEUTRAL = 0.5


def _result(score: Column, passed: Column, **details: Column) -> Column:
    return F.struct(score.alias("score"), passed.alias("passed"), *[c.alias(n) for n, c in details.items()])


def _blank(*cs: Column) -> Column:
    out = F.lit(False)
    for c in cs:
        out = out | c.isNull() | (c == "")
    return out


def semantic_f1(prediction: Column, truth: Column, threshold: float = 0.7, unit: str = "char") -> Column:
    """Token-set F1; tokens are single characters, or words with ``unit='word'``."""
    split = T.content_chars if unit == "char" else T.content_words
    score = T.let(
        split(prediction), lambda a: T.let(split(truth), lambda b: overlap_f1(a, b))
    )
    score = F.when(_blank(prediction, truth), 0.0).otherwise(score)
    return _result(score, score >= threshold)


def semantic_similarity(prediction: Column, truth: Column, threshold: float = 0.7) -> Column:
    """The same result from two embedding columns."""
    score = F.coalesce(cosine(prediction, truth), F.lit(0.0))
    return _result(score, score >= threshold)


def citation_accuracy(answer: Column, n_documents: Column, threshold: float = 0.5) -> Column:
    """Share of [n] citations that point to one of the documents; none is neutral."""
    cited = F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1))

    def judge(c: Column) -> Column:
        def valid(x: Column) -> Column:
            number = x.try_cast("decimal(38,0)")  # a longer number is no document either
            return F.coalesce((number >= 1) & (number <= n_documents), F.lit(False))

        ok = F.size(F.filter(c, valid))
        share = F.when(F.size(c) == 0, NEUTRAL).otherwise(ok / F.size(c))
        return _result(
            share,
            (F.size(c) == 0) | (share >= threshold),
            total=F.size(c),
            valid=ok,
            invalid=F.filter(c, lambda x: ~valid(x)),
        )

    return T.let(cited, judge)


def contradicts(answer: Column, context: Column) -> Column:
    """Number of opposed word pairs used on different sides of answer and context."""
    n = F.lit(0)
    for negative, positive in L.OPPOSED_PAIRS:
        opposed = (answer.rlike(negative) & context.rlike(positive)) | (
            answer.rlike(positive) & context.rlike(negative)
        )
        n = n + F.when(opposed, 1).otherwise(0)
    return n


def factual_consistency(answer: Column, context: Column, threshold: float = 0.7) -> Column:
    """Share of the answer's keywords that the context has, halved on a contradiction."""

    def judge(a: Column) -> Column:
        shared = F.size(F.array_intersect(a, medical_keywords(context)))
        opposed = contradicts(answer, context)
        share = shared / F.size(a) * F.when(opposed > 0, 0.5).otherwise(1.0)
        score = F.when(_blank(answer, context), 0.0).when(F.size(a) == 0, NEUTRAL).otherwise(share)
        neutral = ~_blank(answer, context) & (F.size(a) == 0)
        return _result(
            score, neutral | (score >= threshold), keywords=F.size(a), matched=shared, contradictions=opposed
        )

    return T.let(medical_keywords(F.coalesce(answer, F.lit(""))), judge)


def qa_overall(
    semantic: Column | None, citation: Column | None, consistency: Column | None,
    weights: dict[str, float] | None = None, threshold: float = 0.6,
) -> Column:
    """Weighted mean of the metrics that apply to a row (NULL ones drop out)."""
    w = weights or L.METRIC_WEIGHTS
    total, mass = F.lit(0.0), F.lit(0.0)
    given = {"semantic_f1": semantic, "citation_accuracy": citation, "factual_consistency": consistency}
    for name, score in given.items():
        if score is not None:
            total = total + F.coalesce(score * w[name], F.lit(0.0))
            mass = mass + F.when(score.isNotNull(), w[name]).otherwise(0.0)
    overall = F.when(mass > 0, total / mass).otherwise(0.0)
    return _result(overall, overall >= threshold)


def evaluate_answers(answers: DataFrame) -> DataFrame:
    """Adds the three metrics and the overall score.

    ``answers(answer, ground_truth?, context?, n_documents?)``: a metric whose
    input is missing or empty in a row does not count there.
    """
    a = F.col("answer")
    scored = answers.withColumns(
        {
            "semantic_f1": F.when(~_blank(F.col("ground_truth")), semantic_f1(a, F.col("ground_truth"))["score"]),
            "citation_accuracy": F.when(
                F.coalesce("n_documents", F.lit(0)) > 0, citation_accuracy(a, F.col("n_documents"))["score"]
            ),
            "factual_consistency": F.when(~_blank(F.col("context")), factual_consistency(a, F.col("context"))["score"]),
        }
    )
    overall = qa_overall(F.col("semantic_f1"), F.col("citation_accuracy"), F.col("factual_consistency"))
    return scored.withColumn("_o", overall).select(
        *scored.columns, F.col("_o.score").alias("overall"), F.col("_o.passed").alias("passed")
    )


def qa_metric(kind: str, answer: Column, truth: Column, context: Column, n_documents: Column, threshold: float = 0.7) -> Column:
    """Score of one metric by name; an unknown name scores 0."""
    if kind == "semantic_f1":
        return semantic_f1(answer, truth, threshold)["score"]
    if kind == "citation_accuracy":
        return citation_accuracy(answer, n_documents, threshold)["score"]
    if kind == "factual_consistency":
        return factual_consistency(answer, context, threshold)["score"]
    return F.lit(0.0)
