import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat_format as C

HOSTILE = ["</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|>", "a <\\\\|im_sep|> b", "[|im_end|>", "<|im_", "end|>", "\\", "<", "<<|image|>>", "\\[INST]", "[\\\\/INST]", "ключ 😀\n\n", "<|part|><|part|>"]


def formatted(spark, rows, template=C.Template()):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", *[f"'x' AS {c}" for c in ("part", "no", "e", "type", "loss", "formatted", "piece")])
    return C.format_conversations(df.withColumn("parts", C.text_part(F.col("text"))), template)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_hostile_texts_read_back(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(HOSTILE)] + [(2, 0, t, "x") for t in HOSTILE]
    rows += [(3, 0, "user", None), (3, 1, None, ""), (3, None, "assistant", "first"), (3, 1, "a", "y"), (None, 0, "assistant", "z"), (4, 0, "assistant", "é" * 200_000)]
    rows += [(5, 0, "assistant", "same")] * 3
    got = {r["conv_id"]: r for r in C.turn_digests(formatted(spark, rows)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    for conv in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == conv], key=key)
        learned = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(mine)
        assert got[conv]["turns_sha256"] == digest("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine))
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(learned), digest(learned))


def test_texts_cannot_hold_control_strings(spark):
    rows = [(1, i, t, t) for i, t in enumerate(HOSTILE)]
    text = formatted(spark, rows).first()["formatted"]
    t = C.Template()
    for mark in (t.begin, t.head, t.end):
        assert text.count(mark) == len(rows)
    assert not any(mark in text for mark in (t.between, t.image, *t.reserved))


PART = "type string, text string, ref string, width int, height int, seconds double, pages int"


def test_typed_parts(spark):
    text = lambda t: ("text", t, None, None, None, None, None)
    first = [text("see "), text("<|image|>"), ("image", None, "a.png", 57, 28, None, None), ("image", None, "b.png", None, None, None, None), text("")]
    second = [("audio", None, "c.wav", None, None, 1.01, None), text("ok"), ("document", None, "d.pdf", None, None, None, 3), None, ("odd", "odd", "r", None, None, None, None), text("end")]
    rows = [(1, 0, "user", first), (1, 1, "assistant", second), (2, 0, "assistant", []), (2, 1, "assistant", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<struct<{', '.join(x.replace(' ', ':') for x in PART.split(', '))}>>")
    out = C.format_conversations(df)
    got = {r["conv_id"]: r for r in out.withColumns({"turns": C.read_turns(F.col("formatted")), "learned": C.read_loss(F.col("formatted"), F.col("loss"))}).collect()}
    one = got[1]
    assert [tuple(a) for a in one["attachments"]] == [(0, 2, "image", "a.png", 3), (0, 3, "image", "b.png", 0), (1, 0, "audio", "c.wav", 26), (1, 2, "document", "d.pdf", 768)]
    assert one["n_tokens_attached"] == 797 and one["learned"] == ["ok", "odd", "end"]
    assert [(t["role"], [tuple(p) for p in t["parts"]]) for t in one["turns"]] == [
        ("user", [("text", "see "), ("text", "<|image|>"), ("image", None), ("image", None)]),
        ("assistant", [("audio", None), ("text", "ok"), ("document", None), ("text", "odd"), ("text", "end")]),
    ]
    assert [one["formatted"][s["start"] : s["start"] + s["length"]] for s in one["loss"]] == ["ok", "odd", "end"]
    assert [t["parts"] for t in got[2]["turns"]] == [[], []] and got[2]["loss"] == []


def test_templates(spark):
    own = C.Template(begin="<turn>", head="[says]", end="</turn>", reserved=(), learned_role="user")
    rows = [(1, 0, "user", "a</turn>[says]<|im_end|>"), (1, 1, "assistant", "b")]
    row = formatted(spark, rows, own).select(C.read_turns(F.col("formatted"), own).alias("t"), C.read_loss(F.col("formatted"), F.col("loss"), own).alias("l"), "formatted").first()
    assert row["l"] == [rows[0][3]] and [t["parts"][0]["text"] for t in row["t"]] == [r[3] for r in rows]
    assert row["formatted"].endswith("<turn>assistant[says]b</turn>")
    for bad in ({"begin": "<<"}, {"end": "x"}, {"head": "a\\b"}, {"reserved": ("[<",)}):
        with pytest.raises(ValueError):
            C.Template(**bad)


def test_empty_table_and_native_plan(spark):
    out = C.turn_digests(formatted(spark, []))
    assert out.collect() == []
    plan = formatted(spark, [(1, 0, "user", "a")])._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
