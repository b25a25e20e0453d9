import hashlib
import random
import re
import zlib

import pytest

from corpusloom.llm import conversation_repair as R

PATTERN = re.compile(r"(s?(ua)+)?\Z")


def brute(rows):
    """(cost, audit, turns) of the best edit sequence, by listing all with few insertions; rows are (role, text, fault)."""
    options = [(0, "", "", [])]
    alive = re.compile(r"s?(ua)*u?\Z")
    insert = lambda o: [o] + [(o[0] + 5, o[1] + "I", o[2] + r[0], o[3] + [(r, "")]) for r in ("user", "assistant")]

    def spread(options):
        once = [x for o in options for x in insert(o)]
        return [x for o in once for x in insert(o)] if options else []

    def pruned(options):
        best = {}
        for o in options:
            if alive.match(o[2]):
                key = (o[2][-1:], o[2] == "s", o[2] == "")
                best[key] = min(best.get(key, o), o, key=lambda x: x[:2])
        return list(best.values())

    for role, text, fault in rows:
        after = []
        for o in spread(options):
            after.append((o[0] + 2, o[1] + "D", o[2], o[3]))
            if fault in ("", "truncated"):
                more = o[0] + 5 * (fault == "truncated")
                after.append((more, o[1] + "K", o[2] + (role[:1] or "?"), o[3] + [(role, text)]))
                after += [(more + 1, o[1] + "R", o[2] + r[0], o[3] + [(r, text)]) for r in ("user", "assistant")]
        options = pruned(after)
    return min((o for o in spread(options) if PATTERN.match(o[2])), key=lambda o: o[:2])


def judged(rows):
    """Rows (turn, role, text) of one conversation in order, with their faults."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest())
    rows, seen, out = sorted(rows, key=key), set(), []
    for turn, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def expected(rows):
    rows = judged(rows)
    turns = {t for t, *_ in rows if t is not None}
    cost, audit, _, said = brute([r[1:] for r in rows])
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    kinds = [sum(r[3] == k for r in rows) for k in ("blank", "duplicate", "truncated")]
    text = "\n".join(f"{r}:{t}" for r, t in said)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *kinds, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def conversation(rng, n):
    texts = ["Yes.", "No!", "cut off", "", " \t", "What?", "Yes.  \n", "long " * 50 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", " "]
    return [(rng.choice([None, *range(n)]) if rng.random() < 0.1 else i, rng.choice(roles[: rng.choice([2, 5, 8])]), rng.choice(texts)) for i in range(n)]


def test_agenda_against_all_edits():
    rng = random.Random(1)
    for n in [1, 2, 3] * 40 + [12] * 60:
        rows = [r[1:] for r in judged(conversation(rng, n))]
        got = R.lightest([r[0][:1] for r in rows], [r[2] for r in rows], {R.NOTHING: "", R.ASSISTANT: ""})[R.NOTHING, ""]
        want = brute(rows)
        assert got == want[:2]
        assert [t[:2] for t in R.apply_audit([r[:2] for r in rows], got[1], R.NOTHING)] == want[3]


SCHEMA = "conv_id long, turn long, role string, text string"


def repaired(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' AS {c}" for c in ("digest", "seen", "first", "part", "seq", "before", "audit")])
    return R.repair_conversations(df)


@pytest.mark.parametrize("block", [512, 3])
def test_whole_tables_and_cut_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK_ROWS", block)
    rng = random.Random(block)
    convs = {c: conversation(rng, rng.choice([1, 2, 5, 9, 40])) for c in [None, *range(60)]}
    convs[100] = conversation(rng, 2000)  # one conversation with most of the rows
    convs[101] = [(1, "user", "Same.")] * 50 + [(2, "assistant", "x")]
    result = repaired(spark, [(c, *r) for c, rows in convs.items() for r in rows])
    got = {r["conv_id"]: tuple(r)[1:] for r in result.summary.collect()}
    assert len(got) == len(convs)
    for c, rows in convs.items():
        assert got[c] == expected(rows), c
    said = {}
    for m in sorted(result.messages.collect(), key=lambda m: (m["block"], m["place"])):
        said.setdefault(m["conv_id"], []).append(f"{m['role']}:{m['text']}")
    for c in convs:
        assert hashlib.sha256("\n".join(said.get(c, [])).encode()).hexdigest() == got[c][-1]


def test_damage_and_lost_conversations(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {c} {t}. Ok!") for c in range(40) for t in range(3)] + [(None, None, None, None), (5, None, "user", "a.b")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, R.damage(df).collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    assert got == sorted(want, key=repr)
    nothing = spark.createDataFrame([(9, 1, "user", "x")], SCHEMA)
    lost = R.with_lost(nothing, repaired(spark, []).summary).collect()
    assert [tuple(r) for r in lost] == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_empty_table_and_nulls(spark):
    assert repaired(spark, []).summary.collect() == [] and repaired(spark, []).messages.collect() == []
    row = repaired(spark, [(1, None, None, None)]).summary.first()
    assert tuple(row)[1:7] == (0, 1, 0, 0, 0, 2) and row["audit"] == "D"
