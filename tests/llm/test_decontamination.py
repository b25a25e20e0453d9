import re

from corpusloom.llm import decontamination as D

ITEM = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12 q13 q14 q15"


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        b = words(t)
        k = min(13, len(b))
        for j in range(len(b) - k + 1 if b else 0):
            for p in range(len(w) - k + 1):
                if w[p : p + k] == b[j : j + k]:
                    hit |= set(range(p, p + k))
                    found.add(i)
    return len(w), len(hit), found


def test_windows_short_items_and_repeats(spark, documents):
    items = [(1, ITEM), (2, "Short-item!"), (3, None), (4, ""), (5, "... "), (6, ITEM.upper()), (7, "one"), (7, "zwei drei vier fünf")]
    texts = [
        None, "", "!!!", "x " + ITEM, ITEM.replace("q7", "zz"), " ".join(ITEM.split()[1:14]) + " tail", "short item and more short ITEM",
        "one two three", "a " * 300 + ITEM, "one one", "ZWEI, drei; vier fünf", "filler " * 20000 + ITEM,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, ITEM)]
    got = D.find_contamination(documents(rows), bench(spark, items)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = ITEM if r["doc_id"] is None else texts[r["doc_id"]]
        n, hit, found = brute(text, items)
        assert (r["n_words"], r["n_hit"], set(r["items"])) == (n, hit, found), text
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_removal(spark, documents):
    rows = [(1, "Clean text, stays."), (2, "Head " + ITEM + " tail."), (3, None), (None, ITEM)]
    kept = D.remove_documents(documents(rows), bench(spark, [(1, ITEM)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3] and kept.columns == documents(rows).columns
    cut = {r["doc_id"]: r["text"] for r in D.remove_spans(documents(rows), bench(spark, [(1, ITEM)])).collect()}
    assert cut == {1: "Clean text, stays.", 2: "Head tail.", 3: None, None: ""}


def test_empty_tables(spark, documents):
    assert D.find_contamination(documents([]), bench(spark, [(1, ITEM)])).count() == 0
    got = D.find_contamination(documents([(1, ITEM)]), bench(spark, [])).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in got] == [(15, 0, False)]


def test_blocks_of_windows(spark, documents, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 1)
    got = D.find_contamination(documents([(1, ITEM)]), bench(spark, [(1, ITEM)])).collect()
    assert [(r["n_hit"], r["items"]) for r in got] == [(15, [1])]


def test_no_python_in_the_plan(given):
    found = D.find_contamination(given("documents"), given("benchmark"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
