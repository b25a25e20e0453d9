import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.ranking import global_position, hash_edge, hash_order, top_per_group, value_at
from corpusloom.operators import contrastive as N
from corpusloom.operators import hits as H
from corpusloom.operators import ranking_metrics as M
from corpusloom.operators.dense import dense_search, dense_search_approx
from corpusloom.operators.sparse import bm25_search, build_bm25_index


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(5, 16))
    # one centre holds a third of everything
    where = rng.choice(5, size=600, p=[0.36, 0.16, 0.16, 0.16, 0.16])
    m = centres[where] + 0.4 * rng.normal(size=(600, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    corpus = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>").cache()
    queries = spark.createDataFrame(rows[::6], "query_id bigint, embedding array<float>").cache()
    return m, queries, corpus


def brute(m, k, cosine=True):
    m = m.astype(np.float32).astype(float)
    if cosine:
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = set()
    for q in range(0, 600, 6):
        s = np.round(m @ m[q], 6)
        order = sorted(range(600), key=lambda i: (-s[i], i))[:k]
        out |= {(q, i, r) for r, i in enumerate(order, 1)}
    return out


def triples(df):
    return {(r.query_id, r.chunk_id, r.rank) for r in df.collect()}


@pytest.mark.parametrize("args", [{}, {"block_bytes": 0}, {"metric": "ip"}, {"metric": "ip", "block_bytes": 4096}])
def test_dense_forms_are_exact(vectors, args, monkeypatch):
    import corpusloom.operators.dense as D

    monkeypatch.setattr(D, "CELL_ROWS", 40)  # several blocks per cell
    monkeypatch.setattr(D, "QUERY_ROWS", 10)
    monkeypatch.setattr(D, "SCORES", 200)
    m, queries, corpus = vectors
    assert triples(dense_search(queries, corpus, 7, **args)) == brute(m, 7, "metric" not in args)


def test_dense_approx_recall(vectors):
    m, queries, corpus = vectors
    found = triples(dense_search_approx(queries, corpus, 7, n_probe=6))
    want = {(q, i) for q, i, _ in brute(m, 7)}
    assert len({(q, i) for q, i, _ in found} & want) / len(want) > 0.8
    assert len(triples(dense_search_approx(queries, corpus, 7, n_probe=100)) & brute(m, 7)) == len(brute(m, 7))


def test_bm25_pruning_keeps_the_result(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    queries = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    index = build_bm25_index(docs)
    plain = bm25_search(index, queries, 5).collect()
    pruned = bm25_search(index, queries, 5, prune=True).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, pruned)) and len(plain) == 5 * queries.count()
    index.drop()


def test_bm25_counts_repeated_query_words_and_empty_chunks(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, "...")], "chunk_id int, text string")
    q = spark.createDataFrame([(1, "c"), (2, "c c"), (3, "zzz")], "query_id int, text string")
    index = build_bm25_index(docs)
    assert index.n_chunks == 3 and index.avg_len == pytest.approx(5 / 3)
    got = {(r.query_id, r.chunk_id): r.score for r in bm25_search(index, q, 3).collect()}
    idf = np.log(1 + (3 - 1 + 0.5) / 1.5)
    want = idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / (5 / 3)))
    assert got == {(1, 2): pytest.approx(want, abs=1e-6), (2, 2): pytest.approx(2 * want, abs=2e-6)}


def test_fusion_sides(spark):
    d = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.2)], "query_id int, chunk_id int, score double")
    s = spark.createDataFrame([(1, 11, 3.0), (1, 12, 1.0)], "query_id int, chunk_id int, score double")
    got = {r.chunk_id: r.score for r in H.fuse_weighted(d, s, 5, 0.7, norm="none").collect()}
    assert got == {10: pytest.approx(0.35), 11: pytest.approx(0.14 + 0.9), 12: pytest.approx(0.3)}
    only = H.fuse_weighted(d, s, 5, 1.0).collect()
    assert [(r.chunk_id, r.score) for r in only] == [(10, 0.5), (11, 0.2)]


def test_rerank_is_stable_and_skips_single_candidates(spark):
    rows = [(1, 1, "q", "x y", 0.1), (1, 2, "q", "x y", 0.9), (1, 3, "q", "z", 0.9), (2, 1, "q", "x", 0.3)]
    hits = spark.createDataFrame(rows, "query_id int, rank int, query string, text string, s double")
    got = H.rerank(hits, 2, F.col("s")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.candidate_rank, r.rerank_score) for r in got] == [(1, 2, 0.9), (1, 3, 0.9), (2, 1, None)]


def test_relaxed_filter(spark):
    rows = [(1, s) for s in (0.9, 0.35, 0.2)] + [(2, s) for s in (0.9, 0.8, 0.7, 0.35)]
    hits = spark.createDataFrame(rows, "query_id int, score double")
    kept = H.filter_with_relaxation(hits).groupBy("query_id").count()
    assert {tuple(r) for r in kept.collect()} == {(1, 2), (2, 3)}


def test_metrics_by_hand(spark):
    hits = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3), (2, "z", 1)], "query_id int, item string, rank int")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    qrels = spark.createDataFrame([(1, "a"), (1, "c"), (3, "a")], "query_id int, item string")
    got = {r.query_id: r for r in M.per_query_metrics(M.judge_by_qrels(hits, queries, qrels), [2, 3]).collect()}
    assert got[1]["mrr@2"] == 0.5 and got[1]["recall@3"] == 0.5
    ideal = 1 + 1 / np.log2(3)
    assert got[1]["ndcg@3"] == pytest.approx((1 / np.log2(3) + 0.5) / ideal)
    assert got[2]["recall@3"] == got[3]["mrr@2"] == 0
    once = M.per_query_metrics(M.judge_by_qrels(hits, queries, qrels), [3], dedupe=True).filter("query_id = 1").first()
    assert once["ndcg@3"] == pytest.approx(1 / np.log2(3) / ideal)


def test_salted_top_and_positions(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").otherwise("cold").alias("g"))
    plain = top_per_group(df, ["g"], [F.desc("id")], 50)
    salted = top_per_group(df, ["g"], [F.desc("id")], 50, salt_on=["id"], salts=8)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect()))
    placed = global_position(df, hash_order("id", seed=1), ["id"]).select("pos", "total").collect()
    assert sorted(r.pos for r in placed) == list(range(1000)) and {r.total for r in placed} == {1000}
    assert value_at(df, "id", 123) == 123 and value_at(df, "id", 1000) is None
    order = sorted(range(1000), key=lambda i: hashlib.md5(f"{i}|1".encode()).hexdigest())
    key = hash_order("id", seed=1)
    assert hash_edge(df, key, "id", 700, digits=2)[1] == order[700] and hash_edge(df, key, "id", 1000) is None
    split = N.shuffle_split(df, 0.25, seed=1, id_col="id").filter("split = 'train'").collect()
    assert {r.id for r in split} == set(order[:250])
    assert N.shuffle_split(df, 1.0, id_col="id").filter("split = 'val'").count() == 0


def test_negatives_with_a_hot_text(spark):
    rows = [(i, "q" * 12, "same" * 20 if i % 3 == 0 else f"text {i} " * 10) for i in range(90)]
    pairs = spark.createDataFrame(rows, "pair_id int, query string, positive string")
    got = N.add_random_negatives(pairs).collect()
    assert len(got) == 90
    assert all(len(set(r.negatives)) == 3 and r.positive not in r.negatives for r in got)
    two = N.add_random_negatives(pairs.filter("pair_id in (0, 1, 3)")).collect()
    assert sorted(len(r.negatives) for r in two) == [1, 1, 1]
    assert [r.negatives for r in N.add_random_negatives(pairs.filter("pair_id = 0")).collect()] == [[]]
