import numpy as np

from corpusloom.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, v, a) in enumerate(rows):
        for j, u, b in rows[:k]:
            if a is not None and a == b and ok(v) and ok(u) and len(u) == len(v):
                x, y = np.array(v, float), np.array(u, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links[i] += 1
                    links[j] += 1
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in links}


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}


def clustered(n, dim, noise, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        c = centres[rng.integers(0, 6)]
        v = c + noise * rng.normal(size=dim) * np.linalg.norm(c) / np.sqrt(dim)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 2))))
    return rows


def test_recall_and_precision(spark):
    """Groups that straddle the threshold: no link below it, and nearly all above it."""
    found = total = 0
    for noise, dim in ((0.02, 64), (0.12, 64), (0.16, 64), (0.12, 16)):
        rows = clustered(300, dim, noise, 3)
        got, want = result(E.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA))), brute(rows)
        assert all(got[i][0] <= want[i][0] for i in want)
        found += sum(n for n, _ in got.values())
        total += sum(n for n, _ in want.values())
    assert total > 10000 and found >= 0.99 * total


def test_table(given):
    t = given("embeddings")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in t.collect()]
    assert result(E.near_duplicate_vectors(t)) == brute(rows)


def test_edge_cases(spark):
    a, b = [1.0] * 8, [2.0] * 7 + [2.1]
    rows = [(5, a, 1), (3, b, 1), (4, a, 2), (6, a, None), (7, None, 1), (8, [], 1), (9, [0.0] * 8, 1), (10, [float("nan")] * 8, 1), (11, [float("inf")] + a[1:], 1), (12, [None] + a[1:], 1), (13, [1.0] * 4, 1), (14, [1e-30] * 8, 1)]
    want = {i: (0, i) for i, _, _ in rows} | {3: (2, 3), 5: (2, 3), 14: (2, 3)}
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS class", "'y' AS code", "'z' AS rid")
    assert result(E.near_duplicate_vectors(df)) == want
    twice = E.near_duplicate_vectors(spark.createDataFrame([(1, a, 1), (1, a, 1), (None, a, 3)], SCHEMA)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["kept"]) for r in twice) == [(0, 0, True), (1, 1, True), (1, 1, True)]
    assert E.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_codes_are_balanced():
    x = np.random.default_rng(0).normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    bits = x @ E.learn_rotation(x) > 0
    assert (abs(bits.mean(axis=0) - 0.5) < 0.05).all()
