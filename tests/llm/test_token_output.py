import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from corpusloom.llm import token_output as K

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return K.WordEncoder(f.read())


def direct(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_code_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype("<u4")
        control, data = K.encode_ranks(ranks)
        assert len(control) == -(-n // 4) and np.array_equal(K.decode_ranks(control, data, n), ranks)


def test_pieces_give_the_ids_of_the_whole_text(encoder):
    random.seed(5)
    parts = ["a", "É", "é", " ", "\n", "'s", "'S", "日", "ß", "1", "!", "ing", "🎉", "\t", "’", "ŉ", "Ÿ", "İ", "²", "x́", "“", "<|endoftext|>", "\x85", "Σ", "'ll", "ª", "\x1c"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == direct(encoder, text), text


def test_files_hold_all_documents(given, encoder):
    docs = given("documents")
    rows = {r["doc_id"]: r for r in K.token_round_trip(docs, PATH).collect()}
    start = 0
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        ids = np.array([*direct(encoder, r["text"]), K.END_ID], dtype="<u4")
        got = rows[r["doc_id"]]
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(rows) == docs.count()


def test_frequent_ids_have_low_ranks_and_ids_come_back(spark, documents, tmp_path, encoder):
    path = str(tmp_path / "tokens")
    texts = ["the the the the cat", "the dog", None, ""]
    K.write_tokens(documents(list(enumerate(texts))), path, encoder.tokenizer.to_str())
    ranks = {r["id"]: r["rank"] for r in spark.read.parquet(f"{path}/ranks").collect()}
    assert ranks[direct(encoder, "the")[0]] == 0 and ranks[K.END_ID] == 1
    back = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in K.read_tokens(spark, path).collect()}
    assert back == {i: [*direct(encoder, t), K.END_ID] for i, t in enumerate(texts)}


def test_edge_cases(documents):
    rows = [(3, None), (1, ""), (2, "word " * 200000), (2, "word " * 200000), (None, "x"), (-5, "日本")]
    got = sorted(K.token_round_trip(documents(rows), PATH).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, -5, 1, 2, 2, 3]
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(6)]
    assert K.token_round_trip(documents([]), PATH).count() == 0


def test_added_tokens_get_the_ids_of_an_unchanged_tokenizer(documents, encoder):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "a<|startoftext|>b", "<|EndOfText|> a", "x <|STARTOFTEXT|>", "<|endoftext|><|endoftext|>", "<| endoftext |>", "<|endoftext|", "日<|endoftext|>", "plain"]
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert 49407 in want[0]
    assert [ids.tolist() for ids in encoder.encode(texts)] == want
    random.seed(6)
    parts = ["<|", "|>", "endoftext", "startoftext", "<|endoftext|>", "<|STARTOFTEXT|>", " ", "a", "É", "'s", "\n", "1"]
    mixed = ["".join(random.choice(parts) for _ in range(random.randint(1, 12))) for _ in range(2000)]
    for text, ids in zip(mixed, encoder.encode(mixed), strict=True):
        assert ids.tolist() == fresh.encode(text, add_special_tokens=False).ids, text
    rows = sorted(K.token_round_trip(documents(list(enumerate(texts))), PATH).collect(), key=lambda r: r["doc_id"])
    assert [r["ids_crc32"] for r in rows] == [zlib.crc32(np.array([*w, K.END_ID], dtype="<u4").tobytes()) for w in want]
