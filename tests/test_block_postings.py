import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import block_postings as P
from corpusloom.operators.sparse import bm25_search, build_bm25_index, weighted_terms


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, "common " * rng.randint(1, 3) + " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(300)], k=rng.randint(5, 40)))) for i in range(3000)]
    rows += [(3000, "rare common"), (3001, "rare thing common common"), (3002, None), (3003, ""), (3004, "same same"), (3005, "same same")]
    return spark.createDataFrame(rows, "chunk_id long, text string").repartition(4).cache()


def queries(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


@pytest.mark.parametrize("k, tile", [(3, 16), (20, 128), (5000, 64)])
def test_same_hits_as_the_full_search(spark, chunks, k, tile):
    q = queries(spark, ["common", "w1 w2 w250 w250", "rare common", "same", "nowhere", "", None, "w3 common w17 w199 w298"])
    index = P.build_block_index(chunks, tile_rows=tile)
    plain = build_bm25_index(chunks)
    assert (index.n_chunks, index.avg_len) == (plain.n_chunks, plain.avg_len)
    got = sorted(map(tuple, P.block_search(index, q, k, seed_tiles=2).select("query_id", "rank", "chunk_id", "score").collect()))
    assert got == sorted(map(tuple, bm25_search(plain, q, k).select("query_id", "rank", "chunk_id", "score").collect()))
    index.drop()


def test_a_hot_term_is_read_in_part(spark, chunks):
    index = P.build_block_index(chunks, tile_rows=16)
    terms = weighted_terms(index.totals, queries(spark, ["rare common"]))
    bounds = P.tile_bounds(index, terms)
    floor = P.block_search(index, queries(spark, ["rare common"]), 2).agg(F.min("score")).first()[0]
    open_ = bounds.filter(F.col("bound") >= floor - P.SLACK)
    read = P.wanted_blocks(index, open_, terms).filter("term = 'common'").count()
    assert read * 10 < index.blocks.filter("term = 'common'").count()


def test_blocks_stay_in_their_buckets(spark, chunks):
    index = P.build_block_index(chunks, tile_rows=16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a query table of any size
    try:
        terms = weighted_terms(index.totals, queries(spark, ["common w1"]))
        plan = P.wanted_blocks(index, P.tile_bounds(index, terms), terms)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "postings" in line and "Scan parquet" in line)
    above = []
    depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-*()0123456789"))
    for line in reversed(lines[:scan]):
        at = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if at < depth:
            above.append(line)
            depth = at
    assert not any("Exchange" in line for line in above[: next(i for i, x in enumerate(above) if "Join" in x)])


def test_empty_tables(spark, chunks):
    index = P.build_block_index(chunks.limit(0))
    assert P.block_search(index, queries(spark, ["common"])).collect() == []
