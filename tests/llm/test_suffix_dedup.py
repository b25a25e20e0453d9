import hashlib
import random

import pytest

from corpusloom.llm import suffix_dedup as S


def brute(rows):
    seen, out = {}, {}
    texts = {}
    for i, t in rows:
        texts.setdefault((-1 if i is None else i, t), None)
    for i, t in texts:
        raw = (t or "").encode()
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            seen[w] = min(seen.get(w, (i, s)), (i, s))
    for i, t in texts:
        raw = (t or "").encode()
        cut = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if seen[raw[s : s + 100]] < (i, s):
                cut[s : s + 100] = b"\x01" * 100
        kept = bytes(b for b, c in zip(raw, cut, strict=True) if not c)
        spans = sum(c and not (k and cut[k - 1]) for k, c in enumerate(cut))
        out[(i, t)] = (len(raw), sum(cut), spans, hashlib.sha256(kept).hexdigest())
    return out


def compare(df, rows):
    want = brute(rows)
    got = df.collect()
    assert len(got) == len(rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in got) == sorted((-1 if i is None else i, *want[(-1 if i is None else i, t)]) for i, t in rows)


def test_same_as_brute_force(given):
    docs = given("documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    compare(S.repeat_digests(docs), rows)


@pytest.mark.parametrize("pieces", [1 << 22, 150])
def test_shared_passages_and_edges(documents, monkeypatch, pieces):
    rng = random.Random(4)
    line = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, short = line(260), line(97)
    rows = [(i, line(rng.randint(0, 300)) + rng.choice(["", passage, short, passage[20:150], passage[:99]]) + line(80)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "z" * 99), (103, "z" * 100), (104, "z" * 5000), (105, "ab" * 400), (106, passage * 3), (107, passage), (107, passage), (None, passage)]
    monkeypatch.setattr(S, "PIECE", pieces)
    compare(S.repeat_digests(documents(rows), ), rows)


def test_small_runs_and_ranges(documents, monkeypatch):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(i, f"{i} " * 40 + passage[i % 7 :] + f" {i}" * 30) for i in range(80)]
    monkeypatch.setattr(S, "RUN_BYTES", 2000)
    monkeypatch.setattr(S, "GROUP_BYTES", 500)
    compare(S.repeat_digests(documents(rows)), rows)


def test_merge_orders_front_coded_runs():
    rng = random.Random(1)
    for count in (1, 2, 3, 7):
        runs = [sorted((b"k" * rng.randint(0, 5) + bytes(rng.choices(b"ab", k=rng.randint(0, 9))), b"L", i, 0, j) for j in range(rng.randint(0, 30))) for i in range(count)]
        merged = list(S.merge_runs([S.front_code(r) for r in runs]))
        words = [m[1] for m in merged]
        assert words == sorted(r[0] for run in runs for r in run)
        assert all(m[0] == S.shared_length(a, m[1]) for a, m in zip([b"", *words], merged, strict=False))


def test_removal_keeps_columns_and_whole_characters(documents):
    passage = "é" * 120
    tail = "".join(random.Random(2).choices("abcdefgh", k=150))
    rows = [(1, "a" + passage), (2, "bb" + passage + "c"), (3, None), (4, "é" + tail), (5, "©" + tail)]
    cut = S.remove_repeats(documents(rows))
    assert cut.columns == documents(rows).columns
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "aé", 2: "bbc", 3: None, 4: "é" + tail, 5: ""}


def test_empty_table(documents):
    assert S.repeat_digests(documents([])).count() == 0


def hot_rows(n):
    rng = random.Random(11)
    line = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = line(230)
    rows = [(i, line(rng.randint(20, 70)) + passage + line(rng.randint(20, 70))) for i in range(n)]
    rows += [(n, passage), (n, passage), (n + 1, passage * 2), (n + 2, "q" * 3000), (n + 3, "r" + "q" * 2500)]
    return rows + [(None, passage + line(9)) for _ in range(3)] + [(n + 4, passage + "x"), (n + 4, passage + "y"), (n + 5, None)]


def test_hot_anchor_is_not_gathered_in_one_task(documents, monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(S, "HOT_RECORDS", 100, raising=False)
    rows = hot_rows(400)
    df = documents(rows)
    keyed = S._keyed(df, "doc_id", "text")
    held = SimpleNamespace(value=S.repeated_anchors(keyed))
    batch = pa.record_batch([pa.array([i for i in range(len(rows))]), pa.array(list(range(len(rows)))), pa.array([t for _, t in rows])], ["doc", "text_hash", "text"])
    groups = {}
    for sent in S._send_runs(held, 4)(iter([batch])):
        for block in sent.column(sent.schema.get_field_index("block")):
            for r in S.read_run(block.as_py()) if block.is_valid else ():
                groups[r[1][:8]] = groups.get(r[1][:8], 0) + 1
    assert max(groups.values(), default=0) <= 100
    compare(S.repeat_digests(df), rows)


@pytest.mark.parametrize("hot", [1, 5])
def test_windows_of_hot_anchors_give_the_same_spans(documents, monkeypatch, hot):
    rows = hot_rows(60)
    monkeypatch.setattr(S, "HOT_RECORDS", hot)
    compare(S.repeat_digests(documents(rows).repartition(7)), rows)
