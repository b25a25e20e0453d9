"""Faults of the fourth round's findings."""

import time

import numpy as np
from pyspark.sql import functions as F

from corpusloom.catalog import evaluation
from corpusloom.llm import embedding_dedup as E
from corpusloom.operators import assessment
from corpusloom.operators import dense as D
from corpusloom.operators import lsh as H
from corpusloom.sources import readers as R


def labelled(spark, vectors, copies=1):
    rows = [(c * len(vectors) + i, [float(x) for x in v], 1) for c in range(copies) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_unit_vectors_take_time_linear_in_their_width(spark):
    wide = labelled(spark, np.random.default_rng(1).normal(size=(200, 256)))
    began = time.perf_counter()
    _, usable = E._usable(wide, "vec_id", "embedding", "label")
    units = np.array([r["unit"] for r in usable.filter(F.xxhash64("unit", "rid") % 2 == 0).select("unit").collect()])
    assert time.perf_counter() - began < 20
    assert np.allclose(np.linalg.norm(units, axis=1), 1)


def test_copies_of_vectors_make_no_classes(spark, monkeypatch):
    met, pairs = [], E.class_pairs
    monkeypatch.setattr(E, "learn_rotation", lambda sample: np.zeros((sample.shape[1], 64)))  # one code for all
    monkeypatch.setattr(E, "class_pairs", lambda classes: met.append(classes.count()) or pairs(classes))
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 32))
    vectors = np.vstack([base + 0.12 * rng.normal(size=base.shape) for _ in range(5)])
    units = vectors.astype(np.float32).astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    found = {r["vec_id"]: r for r in E.near_duplicate_vectors(labelled(spark, vectors, copies=4)).collect()}
    near = units @ units.T >= 0.98
    assert 6 < near.sum() - len(units) and met[0] <= len(units)
    assert [found[i]["n_links"] for i in range(4 * len(units))] == [4 * n - 1 for n in near.sum(axis=1)] * 4
    assert {i: r["component_id"] for i, r in found.items() if i >= 30} == {i: found[i % 30]["component_id"] for i in range(30, 120)}


def test_exact_search_by_cells_shuffles_no_vectors_to_cells(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(600, 24)).astype(np.float32)
    m[550:] = m[:50]  # ties
    monkeypatch.setattr(D, "BLOCK_BYTES", 24 * 8 * 150)  # four blocks of queries
    visits, visit = [], D._visit
    monkeypatch.setattr(D, "_visit", lambda cells, routed, k: visits.append(routed.select(F.sum(F.size("cells"))).first()[0]) or visit(cells, routed, k))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "query_id long, embedding array<float>")
    found = D.dense_search(queries, queries.withColumnRenamed("query_id", "chunk_id"), 5).collect()
    assert sum(visits) <= 2 * len(m)  # the nearest cells, for a floor
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    best = {(i, int(c), r + 1, scores[i, c]) for i in range(600) for r, c in enumerate(np.lexsort((np.arange(600), -scores[i]))[:5])}
    assert {(r["query_id"], r["chunk_id"], r["rank"], r["score"]) for r in found} == best


def test_compare_runs_searches_once(spark, sf, monkeypatch):
    calls, search = [], evaluation.dense_search
    monkeypatch.setattr(evaluation, "dense_search", lambda *args: calls.append(1) or search(*args))
    assert evaluation.compare_runs_q(spark, sf).count() == 9 and len(calls) == 1


def test_lsh_shuffles_no_vectors(spark, monkeypatch):
    plans, store = [], H.materialize
    monkeypatch.setattr(H, "materialize", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df, label))
    m = np.random.default_rng(4).normal(size=(300, 16))
    rows = labelled(spark, m).selectExpr("vec_id AS chunk_id", "embedding")
    queries = rows.withColumnRenamed("chunk_id", "query_id")
    monkeypatch.setattr(H, "BLOCK_BYTES", (16 + 16) * 8 * 100)  # three blocks of queries
    found = H.dense_search_lsh(queries, rows, 5).collect()
    assert not any("Exchange" in plan for plan in plans) and len(plans) == 5
    assert [r["chunk_id"] for r in found if r["rank"] == 1] == [r["query_id"] for r in found if r["rank"] == 1]
    assert len({r["query_id"] for r in found}) == 300


def test_units_of_lsh_take_time_linear_in_their_width(spark):
    wide = labelled(spark, np.random.default_rng(5).normal(size=(400, 1024))).coalesce(1)
    H.unit_vectors(wide.limit(8), "vec_id").count()
    began = time.perf_counter()
    H.unit_vectors(wide, "vec_id").write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - began < 5


def test_text_files_are_listed_by_tasks(spark, tmp_path):
    names = ["a.md", "b ü#%.md", "c.txt", "_no.md", ".no.md", "deep/er/d.md", "_hidden/e.md", "x=1/f.md", "deep/empty.md", "deep/bad.md"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else b"\xff\xfe" if "bad" in name else f"text of\n{name}\r\n".encode())
    for at, glob in ((tmp_path, "*.md"), (f"file://{tmp_path}/*", "*.{md,txt}"), (tmp_path / "a.md", "[!b].md")):
        files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(str(at), wholetext=True)
        spark_reads = files.selectExpr("hex(value)", "_metadata.file_name", "_metadata.file_path", "_metadata.file_size")
        found = R.read_markdown_dir(spark, str(at), glob)
        # no file is named in the plan's own index, which lies on the driver
        assert not any(name.endswith((".md", ".txt")) for name in found.inputFiles())
        assert sorted(map(tuple, found.selectExpr("hex(text)", "source", "path", "file_size").collect())) == sorted(map(tuple, spark_reads.collect()))


def test_a_text_is_lowered_once_for_all_words(spark):
    rows = spark.range(2).selectExpr("concat('Alpha beta ', id) AS q", "'ALPHA 1' AS t")
    covered = rows.select(assessment._coverage(F.col("q"), F.col("t")).alias("share"))
    assert "contains(lower(" not in covered._jdf.queryExecution().analyzed().toString().lower()
    assert [round(r["share"], 6) for r in covered.collect()] == [0.333333, 0.666667]
