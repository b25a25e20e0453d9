import math
import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import lexical_search as L


def brute(docs, items, k=50):
    """Every document scored against every item."""
    words = [L.terms_of(t.encode()) if t is not None else [] for _, t in docs]
    counts = [Counter(w) for w in words]
    n_docs, n_words = sum(bool(w) for w in words), sum(map(len, words))
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        scored = []
        for (doc, _), w, c in zip(docs, words, counts):
            m = 50 + (50 * len(w) * n_docs) // max(1, n_words)
            score = 0
            for t in set(L.terms_of(text.encode()) if text is not None else []):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=50):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS n", "'x' AS terms", "'x' AS rank", "'x' AS item_id")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS doc_id", "'x' AS score")
    return sorted((tuple(r) for r in L.ranked_search(d, i, k).collect()), key=repr)


def words(rng, n, size):
    return " ".join(f"w{min(int(rng.expovariate(0.15)), size)}" for _ in range(n))


def test_against_brute_force_with_ties_repeats_and_nulls(spark):
    rng = random.Random(5)
    docs = [(i, words(rng, rng.randint(0, 60), 40)) for i in range(400)]
    docs += [(1000 + i, "W1 w2, w3; w3") for i in range(150)] + [(7, "w1 Ä w9 été"), (7, "other w4"), (None, "w2 w2 w2"), (None, "w2 w2 w2"), (8, None), (9, ""), (10, "w5 " * 50_000)]
    items = [(i, words(rng, 12, 45)) for i in range(12)] + [(0, "w3 w3 w2"), (3, None), (4, ""), (5, "..."), (None, "été w9 Ä"), (None, "été w9 Ä"), (6, "nowhere")]
    for k in (5, 50):
        assert found(spark, docs, items, k) == brute(docs, items, k)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_TERMS", 16)
    rng = random.Random(6)
    docs, items = [(i, words(rng, 30, 60)) for i in range(60)], [(i, words(rng, 8, 60)) for i in range(20)]
    assert found(spark, docs, items, 7) == brute(docs, items, 7)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []


@pytest.mark.parametrize("page", [1, 4, 32])
def test_a_tree_skips_only_what_cannot_enter(monkeypatch, page):
    monkeypatch.setattr(L, "PAGE", page)
    rng = np.random.default_rng(page)
    docs, terms = np.nonzero(rng.random((300, 30)) < np.linspace(0.9, 0.02, 30))
    tfs, norms = rng.integers(1, 9, len(docs)), rng.integers(50, 400, 300)
    tree = L.Tree(docs, terms, tfs, norms, 30)
    every = np.zeros((300, 30), np.int64)
    every[docs, terms] = 10**9 * tfs // (1000 * tfs + 20 * norms[docs])
    seen = 0
    for _ in range(40):
        weights = np.where(rng.random(30) < 0.2, rng.integers(1, 9000, 30), 0)
        best, ids = L.Best(10), list(range(300))
        offered = []
        best.offer, plain = (lambda rows, plain=best.offer: (offered.extend(rows := list(rows)), plain(rows))), None
        tree.search((tree.bounds @ weights.astype(float)).tolist(), weights, ids, best)
        scores = every @ weights
        want = sorted([(int(s), i) for i, s in enumerate(scores) if s > 0], key=lambda r: (-r[0], r[1]))[:10]
        assert sorted(best.rows, key=lambda r: (-r[0], r[1]))[:10] == want
        seen += len(offered)
    assert seen < 40 * 300 * 0.8  # subtrees are skipped


def test_bounds_hold_below_every_node():
    rng = np.random.default_rng(1)
    docs, terms = np.nonzero(rng.random((200, 20)) < 0.4)
    tfs, norms = rng.integers(1, 5, len(docs)), rng.integers(50, 300, 200)
    tree = L.Tree(docs, terms, tfs, norms, 20)
    shares = np.zeros((len(tree.docs), 20))
    shares[np.repeat(np.arange(len(tree.docs)), np.diff(tree.starts)), tree.terms] = tree.shares
    for (lo, hi), bound in zip(tree.ranges, tree.bounds):
        assert (shares[lo:hi].max(0) <= bound).all()


def test_terms():
    assert L.terms_of("Ab-9 é_É\x85x\tZ".encode()) == ["ab".encode(), b"9", "é".encode(), "É\x85x".encode(), b"z"]
