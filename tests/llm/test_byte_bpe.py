import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from corpusloom.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return B.read_ranks(None, PATH)


@pytest.fixture(scope="module")
def codec(ranks):
    return B.Codec(ranks, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(codec, reference):
    random.seed(2)
    parts = ["a", "é", " ", "\n", "'s", "日", "ß", "\x1c", "1", "!", "ing", "🎉", "\t", "  ", "’", "x́", "\xa0", "\u3000", "tion", "the"]
    for _ in range(4000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 40)))
        ids = codec.encode(text).tolist()
        assert ids == reference.encode_ordinary(text), repr(text)
        assert "".join(codec.decode_stream([[i] for i in ids])) == text


def test_random_bytes_through_the_transducer(codec, reference, ranks):
    random.seed(3)
    for _ in range(3000):
        piece = bytes(random.choice([*b"aeinrst th", random.randrange(256)]) for _ in range(random.randint(1, 24)))
        assert codec.transducer.encode(piece) == ([ranks[piece]] if piece in ranks else codec.transducer.merged(piece))


@pytest.mark.parametrize("cache", [0, 4000, 200_000])
def test_states_and_chunks_can_be_dropped(ranks, reference, cache):
    """Also inside a piece; without room for chunks the transducer alone gives all ids."""
    small = B.Codec(ranks, public_tokenizers.PATTERN, cache)
    for text in ["unbelievable transformations everywhere, and somewhere else " * 3, "x" * 3000 + "Donaudampfschifffahrtsgesellschaft" * 20, "日本語のテキスト " * 30]:
        assert small.encode(text).tolist() == reference.encode_ordinary(text)
    assert small.bytes <= small.chunk_bytes and (cache or not small.known)


def test_a_worker_stays_small(ranks):
    """Distinct words of 64 characters without end, with a small budget: memory stays within it."""
    codec, rng = B.Codec(ranks, public_tokenizers.PATTERN, 16 << 20), random.Random(4)
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    stems = ["".join(rng.choices("abcdefghij", k=32)) for _ in range(60)]
    codec.encode(" ".join(stems))
    before = resident()
    for part in range(20):
        codec.encode(" ".join(f"{rng.choice(stems)}{part * 10_000 + i:032d}" for i in range(10_000)))
        assert codec.bytes <= codec.chunk_bytes and codec.transducer.bytes <= codec.transducer.state_bytes + 4096
    assert resident() - before < 80 << 20


def test_pairs_are_judged_as_the_merges_do(ranks):
    t, rng = B.Transducer(ranks), random.Random(8)
    texts = "the quick brown fox jumped over everlasting transformations und Grüße aus München 日本語 éèê".encode()
    pairs = [(ranks[texts[i:j]], ranks[texts[j:k]]) for i in range(len(texts)) for j in range(i + 1, i + 7) for k in range(j + 1, j + 7) if texts[i:j] in ranks and texts[j:k] in ranks]
    pairs += [(rng.choice(list(t.token_bytes)[:3000]), rng.choice(list(t.token_bytes)[:3000])) for _ in range(3000)]
    seen = set()
    for a, b in pairs:
        if t._learn(a):
            want = t._learn(b) and t.merged(t.token_bytes[a] + t.token_bytes[b]) == [a, b]
            assert t._follows(a, b) == want
            seen.add(want)
    assert seen == {True, False}


def test_stream_decoder_waits_for_characters():
    stream = B.Utf8Stream()
    raw = "aé日🎉".encode()
    assert [stream.feed(raw[i : i + 1]) for i in range(len(raw))] == ["a", "", "é", "", "", "日", "", "", "", "🎉"]
    assert stream.feed(b"\xe6\x97") == "" and stream.close() == "\ufffd"


def test_whole_table(given, reference):
    docs = given("documents")
    rows = {r["doc_id"]: r for r in B.encode_digests(docs, PATH, public_tokenizers.PATTERN).collect()}
    for r in docs.select("doc_id", "text").collect():
        ids, got = reference.encode_ordinary(r["text"]), rows[r["doc_id"]]
        assert (got["n_tokens"], got["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_edge_cases(spark, documents):
    rows = [(1, None), (2, ""), (3, "x " * 300000), (3, "x " * 300000), (None, "a")]
    got = B.encode_digests(documents(rows), PATH, public_tokenizers.PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got)[:3] == [(0, 1), (1, 0), (2, 0)]
    assert all(r["ids_sha256"] == r["decoded_sha256"] == empty for r in got if r["doc_id"] in (1, 2))
    assert B.encode_digests(documents([]), PATH, public_tokenizers.PATTERN).count() == 0


def test_columns_of_ids(spark, documents):
    encode, decode = (f(spark, PATH, public_tokenizers.PATTERN) for f in (B.encode_column, B.decode_column))
    rows = documents([(1, "Grüße, 日本! 🎉"), (2, None)]).select("text", encode("text").alias("ids"))
    assert [r["back"] for r in rows.select(decode("ids").alias("back")).collect()] == ["Grüße, 日本! 🎉", ""]
