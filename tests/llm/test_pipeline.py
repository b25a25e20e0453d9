"""The stages against plain Python versions, each on what its predecessor kept."""

import hashlib
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from corpusloom.llm import byte_bpe
from tests.llm.test_near_duplicates import brute as components


def without_repeats(rows):
    seen, out = set(), {}
    for i, text in sorted(rows.items()):
        raw = text.encode()
        cut = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                cut[s : s + 100] = b"\x01" * 100
            seen.add(w)
        out[i] = bytes(b for b, c in zip(raw, cut, strict=True) if not c).decode("utf-8", "ignore")
    return out


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def contaminated(text, windows):
    w, hit = words(text), set()
    for p in range(len(w) - 12):
        if tuple(w[p : p + 13]) in windows:
            hit |= set(range(p, p + 13))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages(spark, given, sf):
    docs = given("documents")
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    bench = [words(r["text"]) for r in given("benchmark").collect()]
    assert all(len(b) >= 13 for b in bench)
    windows = {tuple(b[i : i + 13]) for b in bench for i in range(len(b) - 12)}
    want = {i: t for i, t in want.items() if any(c.isalpha() for c in t)}
    expected = [dict(want)]
    parts = components(list(want.items()), 5)
    want = {i: t for i, t in want.items() if parts[i][1] == i}
    expected.append(dict(want))
    want = without_repeats(want)
    expected.append(dict(want))
    want = {i: t for i, t in want.items() if not contaminated(t, windows)}
    expected.append(dict(want))
    assert len(expected[0]) > len(expected[1]) > len(expected[3]) > 0.6 * len(expected[0])
    now = docs
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], expected, strict=True):
        now = corpus_pipeline.materialize(stage(spark, now, sf), "test-stage")
        assert now.columns == docs.columns, name
        assert {r["doc_id"]: r["text"] for r in now.collect()} == rows, name
        assert all(r["n_chars"] == len(r["text"]) for r in now.collect()) or name in ("language_id", "near_duplicates")
    ranks = byte_bpe.read_ranks(None, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    ids = {i: ",".join(map(str, encoder.encode_ordinary(t))) for i, t in expected[-1].items()}
    assert {r["doc_id"]: r["ids_sha256"] for r in last.collect()} == {i: hashlib.sha256(x.encode()).hexdigest() for i, x in ids.items()}


def test_nulls_repeats_and_an_empty_table(spark, given, sf):
    docs = given("documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == given("documents").columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 0
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "some words here", None, None, None), (3, "some words here", None, None, None), (None, "other words there", "en", "s", 17)]
    odd = spark.createDataFrame(rows, given("documents").schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = corpus_pipeline.materialize(stage(spark, odd, sf), "test-odd")
    assert sorted(r["doc_id"] or 0 for r in odd.collect()) == [0, 3]
