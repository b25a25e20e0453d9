import pytest
from pyspark.sql import functions as F

from corpusloom.operators import answer_metrics as A
from corpusloom.operators import extraction as X
from corpusloom.operators import responses as R
from corpusloom.operators.context import format_context
from corpusloom.operators.enrichment import apply_contexts, fill, template_for, truncate_document
from corpusloom.operators.metadata import header_metadata, keywords_json
from corpusloom.operators.hits import article_hits


def one(spark, column, *values):
    schema = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], schema).select(column.alias("v")).first()["v"]


def entities(spark, text, kind):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return [r for r in X.extract_entities(df).collect() if r.entity_type == kind]


def test_entities(spark):
    text = "患者诊断为2型糖尿病，合并高血压"
    found = entities(spark, text, "disease")
    assert {e.normalized for e in found} == {"糖尿病", "高血压"}
    assert all(text[e.start_pos : e.end_pos] == e.text and e.confidence == 0.9 for e in found)
    found = entities(spark, "处方：二甲双胍、阿司匹林和奥美拉唑，维b", "medication")
    assert {e.normalized for e in found} == {"二甲双胍", "阿司匹林", "奥美拉唑", "维生素"}


def test_entity_offsets_follow_the_original_case(spark):
    text = "İ copd and COPD"  # the first letter grows when lowered
    assert [(e.start_pos, e.text) for e in entities(spark, text, "disease")] == [(2, "copd"), (11, "COPD")]


def test_same_name_and_start_count_once(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id int, text string")
    rows = X.extract_entities(df, patterns={"disease": [("ab", "n"), ("abc", "n"), ("bc", "n")]}).collect()
    assert [(r.start_pos, r.text) for r in rows] == [(0, "ab"), (1, "bc")]


def test_dosages_and_keywords(spark):
    df = spark.createDataFrame([(1, "二甲双胍 500 MG 2次/日，0.5g")], "doc_id int, text string")
    assert [(r.amount, r.unit) for r in X.extract_dosages(df).orderBy("pos").collect()] == [(500, "MG"), (2, "次/日"), (0.5, "g")]
    assert set(one(spark, X.medical_keywords(F.col("c0")), "治疗肺炎 500mg 5mg")) == {"治疗肺炎", "mg", "治疗"}


@pytest.mark.parametrize("answer, n, score, passed", [("见[1]和[2]", 3, 1.0, True), ("见[5]", 2, 0.0, False), ("无引用", 2, 0.5, True), ("[1][9]", 1, 0.5, True), (f"[1][{'9' * 50}]", 1, 0.5, True)])
def test_citations(spark, answer, n, score, passed):
    got = one(spark, A.citation_accuracy(F.col("c0"), F.lit(n)), answer)
    assert (got["score"], got["passed"]) == (score, passed)


def test_semantic_f1(spark):
    assert one(spark, A.semantic_f1(F.col("c0"), F.col("c1")), "糖尿病", "糖尿病")["score"] == 1.0
    assert one(spark, A.semantic_f1(F.col("c0"), F.col("c1")), "", "糖尿病")["score"] == 0.0
    assert one(spark, A.semantic_f1(F.col("c0"), F.col("c1")), "ab", "bc")["score"] == 0.5


def test_consistency(spark):
    f = A.factual_consistency(F.col("c0"), F.col("c1"))
    assert one(spark, f, "需要治疗", "治疗和诊断")["score"] == 1.0
    assert one(spark, f, "不能治疗", "能够治疗")["score"] == 0.5
    assert one(spark, f, "好", "治疗")["score"] == 0.5 and one(spark, f, "好", "治疗")["passed"]


def test_overall_uses_what_there_is(spark):
    df = spark.createDataFrame(
        [("治疗[1]", "治疗[1]", None, 1), ("x", None, None, 0)],
        "answer string, ground_truth string, context string, n_documents int",
    )
    rows = A.evaluate_answers(df).collect()
    assert rows[0].overall == pytest.approx(1.0) and rows[0].passed
    assert rows[1].overall == 0.0 and not rows[1].passed


def test_response_fields(spark):
    r = one(spark, R.route_fields(F.col("c0")), "策略：BM25\n原因：需要：精确")
    assert (r["query_type"], r["alpha"], r["reason"]) == ("bm25", 0.3, "需要：精确")
    assert one(spark, R.route_fields(F.col("c0")), "nothing")["query_type"] == "hybrid"
    assert one(spark, R.route_fields(F.col("c0")), "策略：vector\n策略：?")["query_type"] == "vector"
    e = one(spark, R.evaluation_fields(F.col("c0")), "相关性：0.8\n充分性：bad\n决策：PARTIAL\n原因：ok")
    assert tuple(e) == (0.8, 0.5, "partial", "ok")
    s = one(spark, R.score_fields(F.col("c0"), F.col("c1"), F.col("c2")), "5", "4.5", "1")
    assert tuple(s) == (5, 3, 1, 3.0)


def test_contexts(spark):
    chunks = spark.createDataFrame([(1, 0, "c0"), (1, 1, "c1")], "doc_id int, chunk_index int, text string")
    told = spark.createDataFrame([(1, 0, "<think>a\nb</think> ctx ")], "doc_id int, chunk_index int, response string")
    rows = {r.chunk_index: r for r in apply_contexts(chunks, told).collect()}
    assert rows[0].text == "ctx\n\nc0" and rows[0].original_text == "c0" and rows[0].has_context
    assert rows[1].text == "c1" and rows[1].context == "" and not rows[1].has_context
    assert [r.has_context for r in apply_contexts(chunks, None).collect()] == [False, False]
    assert template_for("Qwen3-8B")[1] and template_for("other")[1] is None
    assert one(spark, fill("<{a}|{b}>", a=F.col("c0"), b=F.col("c1")), "{b}", "y") == "<{b}|y>"
    cut = one(spark, truncate_document(F.col("c0"), 10), "A" * 100)
    assert cut.startswith("A" * 20 + "\n\n[") and cut.endswith("]\n\n" + "A" * 20)


def test_context_budget(spark):
    hits = spark.createDataFrame(
        [("q", i, "x" * 100, "s", 0.5) for i in (1, 2, 3)], "query_id string, rank int, text string, source string, score double"
    )
    head = len("[文献1] 来源: s (相关度: 0.5000)\n")
    full = format_context(hits, None, None).first()
    assert full.n_docs == 3 and full.context.count("---") == 2
    limit = 2 * (head + 100) + 7 - 10
    cut = format_context(hits, limit, None).first()
    assert cut.n_docs == 2 and len(cut.context) == limit and cut.context.endswith("…")
    assert format_context(hits, head + 100 + 7 + head, None).first().n_docs == 1


def test_metadata(spark):
    text = "A study of something\nDOI: 10.1000/xyz.1, 120199\nKeywords: a; b\n\n"
    m = one(spark, header_metadata(F.col("c0"), F.col("c1")), text, "f.pdf")
    assert (m["doi"], m["year"], m["keywords"], m["title"]) == ("10.1000/xyz.1", "2019", ["a", "b"], "A study of something")
    m = one(spark, header_metadata(F.col("c0"), F.col("c1")), "short", "0123abcd_Paper.PDF")
    assert (m["title"], m["doi"], m["year"], m["keywords"]) == ("Paper", None, None, None)
    assert one(spark, keywords_json(F.array("c0", "c1")), '糖"', "b") == '["糖\\"", "b"]'


def test_article_without_abstract_uses_up_its_place(spark):
    rows = [("q", i, i, f"t{i}", "" if i == 1 else "abs", ["A", "B", "C", "D"]) for i in range(1, 8)]
    got = article_hits(
        spark.createDataFrame(rows, "query_id string, article_rank int, pmid int, title string, abstract string, authors array<string>"), 10
    ).orderBy("rank").collect()
    assert [r.pmid for r in got] == ["2", "3", "4", "5"] and got[0].authors == "A, B, C..." and got[0].score == 0.8
