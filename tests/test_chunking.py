import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunk_streams
from corpusloom.operators.chunking import ChunkConfig, chunk, legacy_windows

MD = "# Title\n\nIntro para one.\n\n## Sec A\n\nText a1.\n\nText a2 is here.\n\n###   Sec B\nbody b\n#no heading\n####### seven\n"


def run(spark, text, strategy, cfg=None, encoder=None):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = chunk(df, strategy, cfg, encoder=encoder).orderBy("chunk_index").collect()
    return [(r.text, r.chunk_index, r.chunk_start, r.chunk_end) for r in rows], [r.section for r in rows]


def value(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("v")).first()["v"]


def test_clean_text(spark):
    assert value(spark, "　 a  b\n\n\n\nc \n", T.clean_text) == "a b\n\nc"


def test_sections(spark):
    found = [tuple(s) for s in value(spark, "pre\n" + MD.strip(), T.sections)]
    assert found == [
        ("", "pre", 0),
        ("Title", "Intro para one.", 1),
        ("Sec A", "Text a1.\n\nText a2 is here.", 2),
        ("Sec B", "body b\n#no heading\n####### seven", 3),
    ]
    assert [tuple(s) for s in value(spark, "no heading", T.sections)] == [("", "no heading", 0)]


def test_sentences(spark):
    assert value(spark, '他说"好。" 然后？！走了. End', T.sentences) == ['他说"好。"', "然后？！", "走了.", "End"]


def test_tokens(spark):
    assert value(spark, "HbA1c控制 目标/T2DM-患", T.tokens) == ["hba1c", "控制", "目标", "t2dm", "患"]
    assert value(spark, "糖尿病", T.tokens) == ["糖尿", "尿病"]
    assert value(spark, " .,; ", T.tokens) == []


@pytest.mark.parametrize("strategy", ["fixed", "markdown", "recursive"])
def test_empty_text_has_no_chunks(spark, strategy):
    assert run(spark, "  \n ", strategy)[0] == []


def test_fixed_windows(spark):
    got, _ = run(spark, "A" * 200, "fixed", ChunkConfig(size=100, overlap=20, min_size=50))
    assert got == [("A" * 100, 0, 0, 100), ("A" * 100, 1, 80, 180)]
    got, _ = run(spark, "A" * 200, "fixed", ChunkConfig(size=100, overlap=20, min_size=10))
    assert [g[1:] for g in got] == [(0, 0, 100), (1, 80, 180), (2, 160, 200)]


def test_fixed_overlap_larger_than_step(spark):
    text = "".join(chr(97 + i % 26) for i in range(50))
    got, _ = run(spark, text, "fixed", ChunkConfig(size=20, overlap=15, min_size=1))
    assert [g[2] for g in got] == list(range(0, 31, 5))
    assert all(g[0] == text[g[2] : g[3]] for g in got)


def test_legacy_windows(spark):
    df = spark.createDataFrame([(1, " abcdefghij ")], "id int, text string")
    rows = legacy_windows(df, 4, 1).collect()
    assert [(r.text, r.chunk_start, r.chunk_end) for r in rows] == [("abcd", 0, 4), ("defg", 3, 7), ("ghij", 6, 10)]
    assert [r.text for r in legacy_windows(df, 0, 0).collect()] == ["abcdefghij"]


def test_markdown_sections_and_prefix(spark):
    cfg = ChunkConfig(size=40, overlap=12, min_size=5, max_size=60)
    got, sections = run(spark, MD, "markdown", cfg)
    assert sections == ["Title", "Sec A", "Sec B"]
    assert got[1] == ("## Sec A\n\nText a1.\n\nText a2 is here.", 1, 36, 72)


def test_markdown_overlap_and_small_tail(spark):
    cfg = ChunkConfig(size=20, overlap=6, min_size=8, max_size=100)
    got, _ = run(spark, "aaaaaaaaaa\n\nbbbbb\n\ncccccccccc\n\nddd", "markdown", cfg)
    # bbbbb (5 <= 6) is carried over; c + ddd fit together; nothing else fits
    assert [g[0] for g in got] == ["aaaaaaaaaa\n\nbbbbb", "bbbbb\n\ncccccccccc\n\nddd"]
    got, _ = run(spark, "aaaaaaaaaaaaaaaa\n\ndddddd", "markdown", ChunkConfig(size=20, overlap=0, min_size=8, max_size=100))
    assert [g[0] for g in got] == ["aaaaaaaaaaaaaaaa"]  # the final 6 characters are below the minimum


def test_markdown_long_paragraph(spark):
    cfg = ChunkConfig(size=12, overlap=0, min_size=1, max_size=20)
    got, _ = run(spark, "aaaa.\n\n" + "bbbb. cccc. dddd. eeee. ffff.", "markdown", cfg)
    assert [g[0] for g in got] == ["aaaa.", "bbbb. cccc.", "cccc. dddd.", "dddd. eeee.", "eeee. ffff."]


def test_recursive_levels(spark):
    cfg = ChunkConfig(size=20, overlap=5, min_size=1, max_size=60)
    # paragraphs of at most 20 are merged without their separator
    assert [g[0] for g in run(spark, "aaaaaaaa\n\nbbbbbbbb\n\ncccccccc", "recursive", cfg)[0]] == ["aaaaaaaabbbbbbbb", "cccccccc"]
    # one word without any separator is cut by force with the overlap
    forced = run(spark, "x" * 40, "recursive", cfg)[0]
    assert [(len(g[0]), g[1]) for g in forced] == [(20, 0), (20, 1), (10, 2)]
    # pieces below the minimum leave a gap in the index
    cfg = ChunkConfig(size=20, overlap=5, min_size=10, max_size=60)
    got = run(spark, "aaaaaaaaaaaaaaaaaaa\n\nbbb\n\nccccccccccccccccccc", "recursive", cfg)[0]
    assert [(g[0][:1], g[1], g[2]) for g in got] == [("a", 0, 0), ("c", 2, 26)]


def test_recursive_bounds(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    cfg = ChunkConfig()
    c = chunk(docs, "recursive", cfg)
    assert c.filter(F.length("text") > cfg.size).count() == 0
    assert c.filter(F.length("text") < cfg.min_size).count() == 0


def one_hot_encoder():
    import numpy as np

    # sentences that begin with the same letter are alike
    return lambda texts: np.array([[float(t[0] == c) for c in "abcdefgh"] for t in texts])


def test_semantic_cuts(spark):
    cfg = ChunkConfig(min_size=6, max_size=100)
    text = "a one. a two. b one. b two. b three. c one."
    got, _ = run(spark, text, "semantic", cfg, one_hot_encoder)
    assert [g[0] for g in got] == ["a one. a two.", "b one. b two. b three.", "c one."]
    assert [g[1:3] for g in got] == [(0, 0), (1, 14), (2, 37)]
    assert run(spark, "single sentence", "semantic", cfg, one_hot_encoder)[0] == [("single sentence", 0, 0, 15)]


def test_semantic_size_limit_and_fallback(spark):
    cfg = ChunkConfig(min_size=1, max_size=12)
    got, _ = run(spark, "a one. a two. a six. a ten.", "semantic", cfg, one_hot_encoder)
    # the length restarts at zero after a cut: the sentence that opened the group is not counted
    assert [g[0] for g in got] == ["a one.", "a two. a six.", "a ten."]
    assert run(spark, MD, "semantic", ChunkConfig(min_size=5))[0] == run(spark, MD, "recursive", ChunkConfig(min_size=5))[0]


def test_chunks_lie_in_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("whole"), "text")
    c = chunk(docs, "fixed").withColumn("whole", T.clean_text(F.col("whole")))
    same = T.strip(F.substring("whole", F.col("chunk_start") + 1, F.col("chunk_end") - F.col("chunk_start")))
    assert c.filter(same != F.col("text")).count() == 0


def long_text(chars):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(5000)]
    out, n = [], 0
    while n < chars:
        part = " ".join(rng.choices(words, k=rng.randint(3, 40))) + rng.choice([". ", "! ", "\n", "\n\n", ".\n\n## " + rng.choice(words) + "\n"])
        out.append(part)
        n += len(part)
    return "".join(out)[:chars]


@pytest.mark.parametrize("strategy", ["fixed", "markdown", "recursive", "semantic"])
def test_time_grows_with_the_text(spark, strategy):
    took = []
    for chars in (400_000, 1_600_000):
        df = spark.createDataFrame([(1, long_text(chars))], "doc_id int, text string").cache()
        df.count()
        best = min(timed(chunk(df, strategy, encoder=flat_encoder)) for _ in range(3))
        took.append(best)
    assert took[1] <= 4.5 * took[0]


def flat_encoder():
    import numpy as np

    return lambda texts: np.array([[len(t) % 7, len(t) % 11, 1.0] for t in texts])


def timed(df):
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def test_places_far_away():
    text = long_text(60_000)
    places = chunk_streams.Places(text)
    for at, size in [(0, 40), (50_000, 300), (59_950, 50), (59_990, 10), (30_000, 9)]:
        part = text[at : at + size]
        for begin in (0, 17, at):
            assert places.find(part, begin) == text.find(part, begin)
    assert places.find("no such text anywhere", 5) == -1 == places.find("~~~", 5)
    assert places.find(text[100:200], 101) == text.find(text[100:200], 101)


def raising_encoder():
    def encode(texts):
        if any("poison" in t for t in texts):
            raise RuntimeError("model failed")
        return one_hot_encoder()(texts)

    return encode


def test_texts_that_the_encoder_fails_on_are_cut_recursively(spark):
    cfg = ChunkConfig(size=30, overlap=5, min_size=6, max_size=100)
    good, bad = "a one. a two. b one. b two. b three. c one.", "a poison. b first line. b second line. c third line."
    df = spark.createDataFrame([(i, bad if i in (1, 5) else good) for i in range(9)] + [(9, None), (10, "")], "doc_id int, text string").coalesce(1)
    found = {}
    for r in chunk(df, "semantic", cfg, encoder=raising_encoder).orderBy("doc_id", "chunk_index").collect():
        found.setdefault(r.doc_id, []).append(r.text)
    assert found.pop(10) == [""] and 9 not in found
    alone = [g[0] for g in run(spark, bad, "recursive", cfg)[0]]
    assert all(v == (alone if k in (1, 5) else ["a one. a two.", "b one. b two. b three.", "c one."]) for k, v in found.items())


def test_columns_of_any_type_go_along(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('x', array(1, 2)) AS s, timestamp'2024-01-02 03:04:05' AS t, concat_ws('. ', array_repeat('Some words here', 40)) AS text, map('k', 1) AS m")
    rows = chunk(df, "recursive").collect()
    assert len(rows) > 1 and all(r.s.x == [1, 2] and r.m == {"k": 1} and r.t.year == 2024 for r in rows)
    only = chunk(df.select("text"), "markdown").collect()
    assert [r.chunk_index for r in only] == list(range(len(only)))
