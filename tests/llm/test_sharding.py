import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import sharding as S


def brute(sizes, n):
    """Smallest capacity by trying every sum of neighbours, and the greedy shards there."""
    def shards(c):
        out, fill, k = [], 0, 0
        for s in sizes:
            if fill + s > c:
                k, fill = k + 1, 0
            fill += s
            out.append(k)
        return out

    sums = sorted({sum(sizes[a:b]) for a in range(len(sizes)) for b in range(a + 1, len(sizes) + 1)})
    for c in sums:
        if c >= max(sizes) and shards(c)[-1] < n:
            return c, shards(c)


@pytest.mark.parametrize("seed", range(6))
def test_minimax_cuts(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "FIRST_DIGITS", 1)
    monkeypatch.setattr(S, "MORE_DIGITS", 1)
    rng = np.random.default_rng(seed)
    keys = sorted({hashlib.md5(str(i).encode()).hexdigest() for i in range(int(rng.integers(3, 60)))})
    sizes = [int(x) for x in rng.integers(1, 50, len(keys))]
    if seed % 2:
        sizes[len(sizes) // 2] = 900
    rows = spark.createDataFrame(list(zip(keys, sizes, strict=True)), "k string, s long")
    capacity, cuts = S.minimax_cuts(rows.unionAll(rows.withColumn("s", F.lit(0).cast("long"))), "k", "s", 4)
    want, shards = brute(sizes, 4)
    assert capacity == want
    assert [sum(k >= c for c in cuts) for k in keys] == shards


def test_whole_table(given):
    docs = given("documents").select("doc_id", "text").collect()
    rows = S.shard_documents(given("documents")).collect()
    text = {r["doc_id"]: r["text"] for r in docs}
    assert len(rows) == len(docs) and {r["law"] for r in rows} == {"bytes"}
    of_text, fill, slots = {}, {}, {}
    for r in rows:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), None)
        assert of_text.setdefault(raw, r["shard"]) == r["shard"]
        fill[r["shard"]] = fill.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    groups = {}
    for t in text.values():
        groups[hashlib.md5(t.encode()).hexdigest()] = groups.get(hashlib.md5(t.encode()).hexdigest(), 0) + len(t.encode()) + 1
    assert max(fill.values()) == brute([groups[k] for k in sorted(groups)], 8)[0]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_edge_cases(documents):
    rows = [(1, None), (2, None), (3, ""), (None, "a"), (4, "a"), (4, "a"), (5, "é" * 1000000)]
    got = S.shard_documents(documents(rows)).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["size"]): r for r in got}
    assert by[(1, 1)]["shard"] == by[(2, 1)]["shard"] and by[(1, 1)]["text_crc32"] == 0
    assert by[(5, 2000001)]["size"] == 2000001
    assert len({r["shard"] for r in got if r["size"] == 2}) == 1
    assert len({(r["shard"], r["slot"]) for r in got}) == len(rows)
    assert S.shard_documents(documents([])).count() == 0
