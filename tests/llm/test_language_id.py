import zlib

from corpusloom.llm import language_id as L

EN = "the cat sat on the mat and the dog was in the house with the other animals number {}"
DE = "der hund und die katze sind in dem haus und das ist nicht der garten nummer {}"


def test_held_out_accuracy_and_scores(given):
    docs = given("documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = L.identify(docs).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edge_cases(documents):
    rows = [(i, EN.format(i), "en") for i in range(40)] + [(100 + i, DE.format(i), "de") for i in range(40)]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "12 34 !?", "en"), (None, EN.format(7), None), (0, EN.format(0), "en"), (1003, EN.format(1) * 30000, None)]
    got = {(r["doc_id"], r["lang_pred"]) for r in L.identify(documents(rows)).collect()}
    assert {(1000, "und"), (1001, "und"), (1002, "und"), (None, "en"), (0, "en"), (1003, "en"), (105, "de")} <= got
    assert L.identify(documents(rows)).count() == len(rows)
    kept = L.keep_identified(documents(rows))
    assert kept.columns == documents(rows).columns and kept.count() == len(rows) - 3


def test_no_labels_and_empty_table(documents):
    assert [r["lang_pred"] for r in L.identify(documents([(1, "abc", None)])).collect()] == ["und"]
    assert L.identify(documents([])).count() == 0


def test_presence_kernel_ignores_repeats():
    import numpy as np

    a, b = (np.unique(L.gram_buckets(x)) for x in ("abab", "ababab"))
    assert set(a) <= set(b) and len(a) == len({*["ab", "ba"], *["aba", "bab"], "abab"})


def test_pieces_join_without_loss():
    import numpy as np

    text = EN * 3
    assert np.array_equal(np.unique(L.gram_buckets(text, piece=17)), np.unique(L.gram_buckets(text)))


def test_copies_do_not_crowd_out_the_texts_of_their_language(documents, monkeypatch):
    rows = [(i, DE.format("eins"), "de") for i in range(3996)] + [(3996 + i, DE.format("abcd"[i] * 5), "de") for i in range(4)]
    rows += [(5000 + i, EN.format(f"{chr(97 + i % 26)}{chr(97 + i // 26)}" * 3), "en") for i in range(200)]
    learnt = []
    monkeypatch.setattr(L, "fit", lambda samples: learnt.extend(samples))
    L.train(documents(rows), sample=8)
    texts = {(name, tuple(ids)) for name, ids in learnt}
    assert len(learnt) == len(texts) == 8
    assert sorted(name for name, _ in texts) == ["de"] * 4 + ["en"] * 4
