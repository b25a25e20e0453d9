import pytest
from pyspark.sql import functions as F

from corpusloom.operators import conversation as C
from corpusloom.operators import understanding as U
from corpusloom.operators.assessment import assess


def value(spark, column, **fields):
    schema = ", ".join(f"{k} string" for k in fields)
    return spark.createDataFrame([tuple(fields.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "query, kind",
    [
        ("糖尿病的治疗方法有哪些？", "hybrid"),
        ("阿司匹林的剂量是多少mg？", "bm25"),
        ("糖尿病为什么会导致视力下降？机制是什么？", "vector"),
        ("什么是BMI？", "direct"),
        ("2024年糖尿病指南有什么更新？", "web"),
        ("T2DM患者的HbA1c控制目标", "bm25"),
    ],
)
def test_route(spark, query, kind):
    decision = value(spark, U.route(F.col("q")), q=query)
    assert decision["query_type"] == kind
    if kind == "bm25":
        assert decision["alpha"] < 0.5
    if kind == "vector":
        assert decision["alpha"] > 0.7


def test_follow_up_gets_the_topic(spark):
    w = value(spark, U.rewrite(F.col("q"), F.col("p")), q="怎么预防？", p="糖尿病的症状有哪些")
    assert w["rewritten"] == "糖尿病的预防方法" and w["is_modified"]
    assert "追问补全" in w["reason"]


def test_standardize_is_by_substring_unless_bounded(spark):
    s = value(spark, U.standardize_terms(F.col("q")), q="smile MI")
    assert s["text"] == "s心梗le 心梗"
    s = value(spark, U.standardize_terms(F.col("q"), word_boundary=True), q="smile MI")
    assert s["text"] == "smile 心梗"


def test_standard_term_present_blocks_its_synonyms(spark):
    s = value(spark, U.standardize_terms(F.col("q")), q="高血压 htn")
    assert s["text"] == "高血压 htn" and s["applied"] == []


def test_expand_and_ambiguity(spark):
    assert value(spark, U.expand_synonyms(F.col("q")), q="糖尿病 DM") == ["diabetes"]
    assert value(spark, U.check_ambiguity(F.col("q")), q="糖尿病").startswith("'糖尿病'可能指: 1型糖尿病 (T1DM)")
    assert value(spark, U.check_ambiguity(F.col("q")), q="2型糖尿病") is None


def test_plain_query_is_left_alone(spark):
    w = value(spark, U.rewrite(F.col("q"), F.col("p")), q=" hello ", p=None)
    assert (w["rewritten"], w["is_modified"], w["reason"]) == ("hello", False, "无需改写")


GOOD = [("q", 1, 0.95, "糖尿病 治疗" * 120, "a"), ("q", 2, 0.88, "糖尿病" * 100, "b"), ("q", 3, 0.82, "治疗" * 100, "c")]
HITS = "query_id string, rank int, score double, text string, source string"


def test_assess(spark):
    queries = spark.createDataFrame([("q", "糖尿病 治疗"), ("none", "x"), ("poor", "y z")], "query_id string, query string")
    hits = spark.createDataFrame(GOOD + [("poor", 1, 0.3, "short", "")], HITS)
    got = {r.query_id: r for r in assess(queries, hits).collect()}
    assert got["q"].decision == "sufficient" and got["q"].relevance > 0.6 and got["q"].best_docs == [0, 1, 2]
    assert got["none"].decision == "insufficient" and got["none"].relevance == 0 and got["none"].best_docs == []
    assert got["poor"].decision == "insufficient" and got["poor"].best_docs == [0]
    assert len(got["none"].suggestions) == 2 and len(got["poor"].suggestions) == 3


def messages(spark, n, content=lambda i: f"m{i}"):
    rows = [("s", i, "user" if i % 2 == 0 else "assistant", content(i)) for i in range(n)]
    return spark.createDataFrame(rows, "session_id string, turn bigint, role string, content string")


def replay(n, threshold, keep):
    held, summaries, seen = [], 0, None
    for i in range(n):
        held.append(i)
        if len(held) > threshold:
            summaries, seen, held = summaries + 1, len(held), held[-keep:]
    return summaries, seen, len(held), held[0]


@pytest.mark.parametrize("n, threshold, history", [(15, 15, 20), (16, 15, 20), (40, 15, 20), (9, 5, 20), (30, 5, 20), (8, 3, 4), (7, 3, 2)])
def test_summaries_equal_a_replay(spark, n, threshold, history):
    r = C.summarize_sessions(messages(spark, n), threshold, history).first()
    summaries, seen, held, first = replay(n, threshold, history // 2)
    assert (r.n_summaries, r.kept, r.kept_from_turn) == (summaries, held, first)
    assert r.summary == (f"对话包含 {seen} 条消息" if summaries else None)


def test_summary_topics(spark):
    m = messages(spark, 16, lambda i: "糖尿病怎么治疗" if i == 2 else ("高血压" if i == 3 else "好"))
    assert C.summarize_sessions(m).first().summary == "讨论主题: 糖尿病, 治疗"


def test_previous_query_across_spans(spark):
    m = messages(spark, 20)
    from corpusloom.functions.ranking import previous_in_group

    users = m.filter("role = 'user'")
    got = {r.turn: r.p for r in previous_in_group(users, "session_id", "turn", "content", "p", span=3).collect()}
    assert got == {i: (f"m{i - 2}" if i else None) for i in range(0, 20, 2)}


def test_history(spark):
    assert C.history_text(messages(spark, 3), 2).first().history == "助手: m1\n用户: m2"
    r = C.last_user_queries(messages(spark, 4)).first()
    assert (r.last_query, r.previous_query) == ("m2", "m0")


def test_term_table_by_automaton(spark, monkeypatch):
    terms = [("ab", 1, "X"), ("ab", 2, "Y"), ("ab", 3, "Z"), ("b", 1, "bee"), ("", 1, "always"), (None, 1, "n"), ("abc", 1, None), ("糖尿病", 1, "DM"), ("aba", 1, "x1"), ("a" * 50, 1, "long")]
    texts = [(1, "xabab"), (2, "AB"), (3, None), (4, ""), (5, "糖尿病 dm"), (6, "2型糖尿病"), (7, "ab has X and BEE"), (7, "b"), (8, "a" * 100_000)]

    def brute():
        out = set()
        for i, text in texts:
            for term, order, synonym in terms:
                if None not in (text, term, synonym) and order <= 2 and term in text and synonym.lower() not in text.lower():
                    out.add((i, synonym))
        return out

    q, t = spark.createDataFrame(texts, "query_id long, query string"), spark.createDataFrame(terms, "term string, syn_ord int, synonym string")
    for chars in (U.AUTOMATON_CHARS, 20):
        monkeypatch.setattr(U, "AUTOMATON_CHARS", chars)
        assert {tuple(r) for r in U.expand_synonyms_table(q, t).collect()} == brute()
    assert U.expand_synonyms_table(q, t.limit(0)).collect() == [] == U.expand_synonyms_table(q.limit(0), t).collect()
