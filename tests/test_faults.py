"""Cases in which operators once gave wrong results."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.assessment import decide
from corpusloom.operators.contrastive import PairConfig, build_all, pairs_from_sections
from corpusloom.operators.embedding import embed, embed_with_cache
from corpusloom.operators.enrichment import generate
from corpusloom.plans import index_job as J
from corpusloom.plans.index_job import index_documents, live_rows, remove_superseded
from corpusloom.session import scratch_path, scratch_root
from corpusloom.sources import registry as G

CACHE = "model_id string, text_sha256 string, embedding array<float>, text_len int, created_at timestamp"


def column(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr(F.col("text")).alias("x")).first()["x"]


def test_control_characters_are_text(spark):
    text = "one\x01two three. four\x01\x03\x02 \x01\x02five"
    assert column(spark, text, T.sentences) == ["one\x01two three.", "four\x01\x03\x02 \x01\x02five"]
    assert [tuple(s) for s in column(spark, text, T.sections)] == [("", text, 0)]
    headed = "intro\x03\n# A\x01B\nbody\x02\x01\n"
    assert [tuple(s) for s in column(spark, headed, T.sections)] == [("", "intro\x03", 0), ("A\x01B", "body\x02\x01", 1)]
    body = "\x01 body " * 20
    pairs = pairs_from_sections(spark.createDataFrame([(1, f"x\n# A heading\x03 here\n{body}")], "doc_id long, text string"))
    assert [(r["query"], r["positive"]) for r in pairs.collect()] == [("A heading\x03 here", body.strip())]


def test_decisions_are_made_on_exact_values(spark):
    rows = [(1, 0.6999998, 0.9, 3), (2, 0.7, 0.4999999, 3), (3, 0.3999999, 0.9, 3), (4, 0.7, 0.5, 3)]
    got = decide(spark.createDataFrame(rows, "query_id int, relevance double, sufficiency double, n_hits int"))
    assert {r["query_id"]: r["decision"] for r in got.collect()} == {1: "partial", 2: "partial", 3: "insufficient", 4: "sufficient"}


def test_null_texts_have_empty_vectors(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id int, text string")
    assert {r["doc_id"]: len(r["embedding"]) for r in embed(docs, dim=8).collect()} == {1: 8, 2: 0, 3: 8}

    def model():
        import numpy as np

        return lambda texts: np.ones((len(texts), 4))

    assert {r["doc_id"]: len(r["embedding"]) for r in embed(docs, model=model).collect()} == {1: 4, 2: 0, 3: 4}
    rows, entries = embed_with_cache(docs, spark.createDataFrame([], CACHE), "m", F.current_timestamp(), dim=8)
    assert {r["doc_id"]: (len(r["embedding"]), r["cache_hit"]) for r in rows.collect()} == {1: (8, False), 2: (0, False), 3: (8, False)}
    assert entries.count() == 2


def test_a_second_run_replaces_the_rows_of_its_files(spark):
    path = scratch_path(spark, "rerun")
    text = "A sentence about the heart. " * 60
    docs = spark.createDataFrame([(i, text, "s", "p", "2024") for i in (1, 2, 3)], "doc_id long, text string, source string, path string, indexed_at string")
    first = {r["doc_id"]: r["chunk_count"] for r in index_documents(docs.select("doc_id"), docs, path, "fixed", recreate=True).collect()}
    again = docs.filter("doc_id < 3")
    second = {r["doc_id"]: r["chunk_count"] for r in index_documents(again.select("doc_id"), again, path, "fixed").collect()}
    assert second == {i: first[i] for i in (1, 2)} and first[1] > 1
    stored = {r["doc_id"]: r["count"] for r in live_rows(spark, path).groupBy("doc_id").count().collect()}
    assert stored == first
    gone = docs.filter("doc_id = 3").withColumn("text", F.lit(""))
    index_documents(gone.select("doc_id"), gone, path, "fixed").collect()
    assert len(remove_superseded(spark, path)) == 1 and spark.read.parquet(path).select("run").distinct().count() == 1
    assert {r["doc_id"]: r["count"] for r in live_rows(spark, path).groupBy("doc_id").count().collect()} == {i: first[i] for i in (1, 2)}


def poisoned_model():
    import numpy as np

    def encode(texts):
        if any("poison" in t for t in texts):
            raise RuntimeError("cannot encode")
        return np.array([[len(t), 1.0] for t in texts])

    return encode


def test_poison_texts_fail_alone(spark):
    path = scratch_path(spark, "poison")
    bad = {3, 17, 40}
    docs = spark.createDataFrame([(i, ("poison " if i in bad else "plain ") * 200) for i in range(60)], "doc_id long, text string").coalesce(2)
    docs = docs.selectExpr("*", "'s' AS source", "'p' AS path", "'2024' AS indexed_at")
    got = {r["doc_id"]: r for r in index_documents(docs.select("doc_id"), docs, path, "fixed", model=poisoned_model).collect()}
    assert {i for i, r in got.items() if r["status"] == "failed"} == bad and len(got) == 60
    assert all(got[i]["error_message"] == "RuntimeError: cannot encode" and got[i]["chunk_count"] == 0 for i in bad)
    assert {r["doc_id"] for r in live_rows(spark, path).select("doc_id").distinct().collect()} == set(range(60)) - bad


def test_a_killed_run_leaves_every_old_row(spark, monkeypatch):
    path = scratch_path(spark, "killed")
    docs = spark.createDataFrame([(i, "old words " * 200) for i in range(4)], "doc_id long, text string")
    docs = docs.selectExpr("*", "'s' AS source", "'p' AS path", "'2024' AS indexed_at")
    index_documents(docs.select("doc_id"), docs, path, "fixed")
    before = sorted(map(str, live_rows(spark, path).collect()))

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(J, "index_outcome", killed)
    changed = docs.withColumn("text", F.lit("new words " * 200))
    with pytest.raises(KeyboardInterrupt):
        index_documents(changed.select("doc_id"), changed, path, "fixed")
    monkeypatch.undo()
    assert spark.read.parquet(path).count() > len(before)  # the rows were written
    assert sorted(map(str, live_rows(spark, path).collect())) == before
    assert remove_superseded(spark, path) == []
    index_documents(changed.select("doc_id"), changed, path, "fixed")
    assert live_rows(spark, path).filter("original_text LIKE 'old%'").count() == 0 and live_rows(spark, path).count() == len(before)


def test_a_generator_that_fails_leaves_its_chunks_as_they_are(spark):
    def factory():
        def run(prompts):
            if "b" in prompts:
                raise ValueError
            return [p.upper() for p in prompts]

        return run

    rows = generate(spark.createDataFrame([("a",), ("b",), ("c",)], "prompt string").coalesce(1), factory).collect()
    assert [r["response"] for r in rows] == ["A", "", "C"]


def test_a_null_text_fails_alone(spark):
    docs = spark.createDataFrame([(1, "words " * 300), (2, None)], "doc_id long, text string")
    docs = docs.selectExpr("*", "'s' AS source", "'p' AS path", "'2024' AS indexed_at")
    got = {r["doc_id"]: r["status"] for r in index_documents(docs.select("doc_id"), docs, f"{scratch_root(spark)}/null-text", "fixed", recreate=True).collect()}
    assert got == {1: "indexed", 2: "failed"}


def test_the_second_writer_of_a_registry_version_is_told(spark):
    path = f"{scratch_root(spark)}/race"
    row = lambda i: spark.createDataFrame([(str(i), "pending")], "id string, status string")
    base = G.commit_registry(row(1), path)
    assert G.commit_registry(row(1).union(row(2)), path, base) == base + 1
    with pytest.raises(G.RegistryConflict):
        G.commit_registry(row(1).union(row(3)), path, base)
    now = G.read_file_registry(spark, path)
    assert G.commit_registry(now.union(row(3)), path, G.latest_version(spark, path)) == base + 2
    assert sorted(r["id"] for r in G.read_file_registry(spark, path).collect()) == ["1", "2", "3"]


def test_no_cap_unless_asked(spark):
    pairs = spark.createDataFrame([(i, "a question here", f"text {i} " * 20) for i in range(30)], "pair_id int, query string, positive string")
    assert build_all({"x": pairs}).count() == 30
    assert build_all({"x": pairs}, PairConfig(per_source=7)).count() == 7
