import re
from itertools import combinations

import numpy as np
import pytest

from corpusloom.llm import near_duplicates as N
from corpusloom.llm.components import connected_components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    n = min(k, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("words", [2, 5])
def test_same_as_brute_force(given, words):
    docs = given("documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert result(N.near_duplicate_components(docs, N.JoinSettings(words=words))) == brute(rows, words)


@pytest.mark.parametrize("block", [512, 16])
def test_large_group_of_near_copies(documents, monkeypatch, block):
    """One node stays large in every tree; chains of links cross it."""
    monkeypatch.setattr(N, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.choice(120, size=rng.integers(0, 7), replace=False):
            words[at] = f"x{i}_{at}"
        rows.append((i + 1, " ".join(words)))
    rows += [(1000 + i, " ".join(f"y{i}_{j}" for j in range(60))) for i in range(60)]
    how = N.JoinSettings(words=2, leaf=8, levels=3, pivots=2)
    assert result(N.near_duplicate_components(documents(rows), how)) == brute(rows, 2)


def test_edge_cases(documents):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One"), (9, "one"), (10, "a b"), (11, "A\tB"), (11, "A\tB"), (12, "long " * 300000), (3, "long " * 200000)]
    got = result(N.near_duplicate_components(documents([*rows, (None, "a b")]), N.JoinSettings(words=5)))
    assert got == {5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (1, 8), 9: (1, 8), 10: (1, 10), 11: (1, 10), 12: (1, 3), 3: (1, 3), None: (1, None)}
    kept = N.keep_one_per_group(documents([*rows, (None, "a b"), (6, "")]))
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 3, 5, 6, 7, 8, 10]
    assert N.near_duplicate_components(documents([])).count() == 0


def test_pieces_of_long_texts_join(monkeypatch):
    text = "alpha Beta gamma\tdelta  epsilon\nzeta " * 20
    whole = N.word_hashes(text)
    monkeypatch.setattr(N, "PIECE", 7)
    assert np.array_equal(whole, N.word_hashes(text)) and len(whole) == len(text.split())
    assert len(np.unique(whole)) == 6


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{100 + i: 100 for i in range(40)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_polynomials_confuse_differ(spark, n):
    """Thue-Morse words and their exchange agree in every polynomial modulo 2^64."""
    pair = [thue_morse(n), thue_morse(n, "ba")]
    assert len(set(N.word_hashes(" ".join(pair)).tolist())) == 2
    plain, tailed = ([set(N.shingle_set(word + tail, 2).tolist()) for word in pair] for tail in ("", " tail word"))
    assert not plain[0] & plain[1] and len(tailed[0] & tailed[1]) == 1  # the shingle of the tail alone
