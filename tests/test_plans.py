"""User models, cache behaviour, plan shapes and streams."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.catalog import QUERIES
from corpusloom.catalog.retrieval import benchmark_queries, corpus_chunks
from corpusloom.operators import embedding as E
from corpusloom.operators.chunking import chunk
from corpusloom.operators.conversation import last_n_messages
from corpusloom.operators.enrichment import generate
from corpusloom.operators.extraction import extract_entities
from corpusloom.operators.sparse import bm25_search, build_bm25_index
from corpusloom.plans.search import hybrid_search
from corpusloom.session import input_bytes, materialize


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def length_model():
    return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=float)


def test_user_model_vectors_are_unit_length(spark):
    df = spark.createDataFrame([("abc",), ("",)], "text string")
    rows = E.embed(df, model=length_model).collect()
    assert rows[0].embedding == pytest.approx([3 / 10**0.5, 1 / 10**0.5], rel=1e-6)
    q = E.embed(df, model=length_model, instruction="find").first().embedding
    n = len("Instruct: find\nQuery: abc")
    assert q == pytest.approx([n / (n * n + 1) ** 0.5, 1 / (n * n + 1) ** 0.5], rel=1e-6)


def test_user_generator(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string")
    rows = generate(df, lambda: lambda prompts: [p.upper() for p in prompts]).collect()
    assert sorted(r.response for r in rows) == ["A", "B"]


def cache_rows(spark, rows):
    return spark.createDataFrame(rows, "model_id string, text_sha256 string, embedding array<float>, text_len int, created_at timestamp")


def test_cache_hits_models_and_expiry(spark):
    now = dt.datetime(2024, 1, 2)
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "id int, text string")
    sha = {t: r for t, r in texts.select("text", F.sha2("text", 256)).distinct().collect()}
    cache = cache_rows(
        spark,
        [
            ("m", sha["a"], [9.0], 1, dt.datetime(2024, 1, 1, 23)),
            ("m", sha["b"], [9.0], 1, dt.datetime(2023, 12, 1)),  # expired
            ("other", sha["c"], [9.0], 1, dt.datetime(2024, 1, 1, 23)),  # another model
        ],
    )
    rows, entries = E.embed_with_cache(texts, cache, "m", F.lit(now), 86400, model=length_model)
    assert {r.id: r.cache_hit for r in rows.collect()} == {1: True, 2: True, 3: False, 4: False}
    assert {(r.model_id, r.text_sha256, r.text_len) for r in entries.collect()} == {("m", sha["b"], 1), ("m", sha["c"], 1)}
    again, none = E.embed_with_cache(texts, cache.unionByName(entries), "m", F.lit(now), 86400, model=length_model)
    assert again.filter("not cache_hit").count() == 0 and none.count() == 0
    assert E.cache_invalidate(cache, "m").count() == 2
    kept, expired = E.cache_expire(cache, F.lit(now), 86400)
    assert kept.count() == 2 and expired.first().expired == 1


def test_text_operators_do_not_shuffle(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for df in (chunk(docs, "markdown"), chunk(docs, "recursive"), extract_entities(docs), E.embed(docs)):
        assert "Exchange" not in plan_of(df)


def test_embedding_runs_once_below_an_explode(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    df = E.embed(docs).select("doc_id", F.posexplode("embedding").alias("i", "w")).filter("w > 0")
    assert plan_of(df).count("ArrowEvalPython") == 1


def test_bm25_sums_without_shuffling_pairs(spark, sf):
    index = build_bm25_index(corpus_chunks(spark, sf))
    plan = plan_of(bm25_search(index, benchmark_queries(spark, sf), 5, "query"))
    # the only shuffles are those by query, salted first, after each task kept its k best
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")
    assert plan.rindex("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")
    index.drop()


def test_bm25_names_few_terms_to_the_scan(spark, sf):
    index = build_bm25_index(corpus_chunks(spark, sf))
    one = spark.createDataFrame([(1, "the")], "query_id int, query string")
    plan = plan_of(bm25_search(index, one, 5, "query"))
    assert "EqualTo(term,the)" in plan
    index.drop()


def test_group_limit_is_pruned_before_the_shuffle(spark, sf):
    m = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr("conv_id AS session_id", "turn", "role", "text AS content")
    assert plan_of(last_n_messages(m, 3)).count("WindowGroupLimit") == 2


def test_scan_reads_only_what_is_asked(spark, sf):
    df = QUERIES["tokenize"](spark, sf)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan_of(df)


def test_input_bytes_ignores_unknown_leaves(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = input_bytes(docs)
    assert known > 0
    made = spark.createDataFrame([(0,)], "doc_id bigint")
    assert known <= input_bytes(docs.join(made, "doc_id")) <= known + 1024


def test_hybrid_alpha_ends(spark, sf):
    index = build_bm25_index(corpus_chunks(spark, sf))
    corpus = materialize(E.embed(corpus_chunks(spark, sf)).select("chunk_id", "embedding"), "corpus")
    queries = materialize(E.embed(benchmark_queries(spark, sf), "query"), "queries")
    sparse = {(r.query_id, r.chunk_id, r.score) for r in bm25_search(index, queries, 10, "query").collect()}
    only = {(r.query_id, r.chunk_id, r.score) for r in hybrid_search(queries, index, corpus, 10, 0.0).collect()}
    assert only == sparse
    dense = hybrid_search(queries, index, corpus, 10, 1.0).collect()
    assert all(r.sparse_score is None and r.score == r.dense_score for r in dense)
