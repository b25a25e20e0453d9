"""Read fields out of generated responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import lexicon as L
from corpusloom.functions import text as T

ENTITY_LISTS = ["diseases", "symptoms", "medications", "treatments", "examinations", "contraindications"]
ENTITY_OF_LIST = {
    "diseases": "disease", "symptoms": "symptom", "medications": "medication",
    "treatments": "treatment", "examinations": "examination", "contraindications": "contraindication",
}


def _lines(response: Column, label: str, unless: list[str] | None = None) -> Column:
    """Lines with ``label``; those that carry an earlier label are taken already."""

    def wanted(x: Column) -> Column:
        ok = F.contains(x, F.lit(label))
        for other in unless or []:
            ok = ok & ~F.contains(x, F.lit(other))
        return ok

    return F.filter(F.split(T.strip(response), "\n"), wanted)


def _line(
    response: Column, label: str, unless: list[str] | None = None, known: list[str] | None = None
) -> Column:
    """The last such line; with ``known``, the last one naming any of those words."""
    lines = _lines(response, label, unless)
    if known:
        lines = F.filter(lines, lambda x: F.upper(x).rlike("|".join(known)))
    return F.when(F.size(lines) > 0, F.element_at(lines, -1))


def _after_first(line: Column) -> Column:
    return T.strip(F.regexp_replace(line, "(?s)^[^：]*：", ""))


def _after_last(line: Column) -> Column:
    return T.strip(F.substring_index(line, "：", -1))


def _number(response: Column, label: str, unless: list[str], default: float) -> Column:
    """Last parsable value among the lines of a label."""
    values = F.filter(
        F.transform(_lines(response, label, unless), lambda x: _after_last(x).try_cast("double")),
        lambda v: v.isNotNull(),
    )
    return F.when(F.size(values) > 0, F.element_at(values, -1)).otherwise(default)


def route_fields(response: Column) -> Column:
    """STRUCT<query_type, confidence, reason, alpha>; an unknown strategy is hybrid."""
    kinds = ["VECTOR", "BM25", "HYBRID", "DIRECT", "WEB"]
    line = F.upper(_line(response, "策略", known=kinds))
    found = F.lit(None).cast("string")
    for name in reversed(kinds):
        found = F.when(F.contains(line, F.lit(name)), name.lower()).otherwise(found)
    kind = F.coalesce(found, F.lit("hybrid"))
    alpha = F.lit(L.ROUTE_ALPHA["hybrid"])
    for name, value in L.ROUTE_ALPHA.items():
        alpha = F.when(kind == name, value).otherwise(alpha)
    return F.struct(
        kind.alias("query_type"),
        F.lit(0.85).alias("confidence"),
        F.coalesce(_after_first(_line(response, "原因", ["策略"])), F.lit("LLM 决策")).alias("reason"),
        alpha.alias("alpha"),
    )


def rewrite_fields(query: Column, response: Column) -> Column:
    """STRUCT<rewritten, is_modified, reason>."""
    rewritten = F.coalesce(_after_first(_line(response, "优化查询")), query)
    return F.struct(
        rewritten.alias("rewritten"),
        (rewritten != query).alias("is_modified"),
        F.coalesce(_after_first(_line(response, "原因", ["优化查询"])), F.lit("LLM 改写")).alias("reason"),
    )


def evaluation_fields(response: Column) -> Column:
    """STRUCT<relevance, sufficiency, decision, reason> with neutral defaults.

    Decisions are tested in the order sufficient, partial, insufficient by
    containment, so INSUFFICIENT reads as sufficient - kept as is.
    """
    line = F.upper(_after_last(_line(response, "决策", ["相关性", "充分性"], ["SUFFICIENT", "PARTIAL"])))
    decision = (
        F.when(F.contains(line, F.lit("SUFFICIENT")), "sufficient")
        .when(F.contains(line, F.lit("PARTIAL")), "partial")
        .otherwise("partial")
    )
    reason = _after_first(_line(response, "原因", ["相关性", "充分性", "决策"]))
    return F.struct(
        _number(response, "相关性", [], 0.5).alias("relevance"),
        _number(response, "充分性", ["相关性"], 0.5).alias("sufficiency"),
        decision.alias("decision"),
        F.coalesce(reason, F.lit("LLM 评估")).alias("reason"),
    )


def entity_lists(response: Column) -> Column:
    """STRUCT of six string lists from the outermost braces; NULL if unreadable."""
    block = F.get(F.regexp_extract_all(response, F.lit(r"(?s)\{.*\}"), F.lit(0)), F.lit(0))
    schema = "struct<" + ",".join(f"{n}:array<string>" for n in ENTITY_LISTS) + ",_bad:string>"
    return F.from_json(
        block, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )


def parse_entity_json(responses: DataFrame, fallback: DataFrame) -> DataFrame:
    """doc_id, entity_type, text, normalized: parsed lists, else rule-based rows.

    ``fallback`` are rule-extracted entities; only those of documents whose
    response held no readable JSON are used.
    """
    parsed = responses.withColumn("_j", entity_lists(F.col("response")))
    good = F.col("_j").isNotNull() & F.col("_j._bad").isNull()

    def tagged(name: str) -> Column:
        kind = ENTITY_OF_LIST[name]
        values = F.coalesce(F.col(f"_j.{name}"), F.array().cast("array<string>"))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("entity_type"), v.alias("text")))

    lists = F.flatten(F.array(*[tagged(n) for n in ENTITY_LISTS]))
    read = parsed.filter(good).select("doc_id", F.inline(lists)).withColumn("normalized", F.col("text"))
    unread = parsed.filter(~good).select("doc_id")
    ruled = fallback.join(unread, "doc_id", "left_semi").select("doc_id", "entity_type", "text", "normalized")
    return read.unionByName(ruled)


def score_fields(accuracy: Column, completeness: Column, clarity: Column) -> Column:
    """STRUCT of three integer marks (unreadable 3) and their mean."""
    marks = [F.coalesce(T.strip(c).try_cast("int"), F.lit(3)) for c in (accuracy, completeness, clarity)]
    return F.struct(
        marks[0].alias("accuracy"),
        marks[1].alias("completeness"),
        marks[2].alias("clarity"),
        ((marks[0] + marks[1] + marks[2]) / 3).alias("overall"),
    )
