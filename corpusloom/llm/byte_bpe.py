"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

A token sequence is the BPE encoding of its bytes exactly if every neighbouring
pair of tokens is what the merges make of the pair's bytes. The transducer's
configurations therefore hold the last complete token, the place in the trie of
tokens, and the tokens not yet emitted. A deterministic state is a set of such
configurations; what all of them have in common is emitted at once, so a token
leaves after a bounded lookahead. States and transitions are made when a text
first needs them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.workers import give_back

#: Bytes of objects that one worker keeps at most: five eighths for states and transitions, the rest for encoded chunks.
CACHE_BYTES = 384 << 20
#: Ids that are sent on together where a result holds them.
SENT_IDS = 1 << 18
# sizes of the objects behind one entry, dictionary slots included, as measured
MOVE_SIZE, OUT_SIZE, STATE_SIZE, CONFIGURATION_SIZE, CHUNK_SIZE = 120, 110, 190, 50, 240
# what can end inside a run of other white space; such texts are not cut into chunks
RARE_SPACE = regex.compile(r"[^\S \t\n\r]|[\x1c-\x1f]")
CHUNK = re.compile(r"[ \t\n\r]*+[^ \t\n\r]++|[ \t\n\r]++")


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Rank file on the driver: base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Encoder of single pieces; ``encode`` walks cached transitions and builds missing ones.

    A configuration is a packed number (place in the trie, last token + 1) and
    its waiting tokens; a state is the flat tuple of its configurations, in
    order. A transition is the next state alone where nothing is emitted.
    """

    LAST = 20  # bits of the last token

    def __init__(self, ranks: dict[bytes, int], state_bytes: int = CACHE_BYTES * 5 // 8):
        self.state_bytes = state_bytes
        size = max(ranks.values()) + 1
        if size >= (1 << self.LAST) - 1:
            raise ValueError("a rank does not fit into a configuration")
        self.ranks = ranks
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}  # trie node * 256 + byte -> node
        token_at, inner = [-1], bytearray(1)  # by node: token that ends there, whether it goes on
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node * 256 + byte
                if key not in self.child:
                    self.child[key] = len(token_at)
                    inner[node] = 1
                    token_at.append(-1)
                    inner.append(0)
                node = self.child[key]
            token_at[node] = rank
        self.token_at, self.inner = token_at, inner
        # the two tokens whose merge makes a token: -2 not asked yet, -1 never made, itself for a byte
        self.left, self.right = [-2] * size, [-2] * size
        self._clear()

    def _clear(self) -> None:
        start = (0, ())
        self.states: dict[tuple, int] = {start: 0}
        self.configurations: list[tuple] = [start]
        self.moves: dict[int, int | tuple[int, tuple[int, ...]]] = {}
        self.bytes = 0

    def _state(self, key: tuple) -> int:
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = len(self.configurations)
            self.configurations.append(key)
            self.bytes += STATE_SIZE + CONFIGURATION_SIZE * (len(key) // 2)
        return state

    def merged(self, piece: bytes, least: int = 1) -> list[int]:
        """The merges themselves: lowest rank first, leftmost among equals, down to ``least`` tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _learn(self, token: int) -> bool:
        """Fill in the halves of ``token``; whether the merges make it."""
        if self.left[token] == -2:
            piece = self.token_bytes[token]
            found = self.merged(piece, 2) if len(piece) > 1 else [token, token]
            made = len(found) == 2 and self.merged(piece) == [token]
            self.left[token], self.right[token] = found if made else (-1, -1)
        return self.left[token] >= 0

    def _follows(self, last: int, token: int) -> bool:
        """Whether the merges leave the two tokens as they are next to each other.

        Their merges are taken back, the later one first; a merge across the
        border that ranks before the one taken back would have come first.
        """
        lefts, rights, spelt, get = self.left, self.right, self.token_bytes, self.ranks.get
        if lefts[token] < 0 and not self._learn(token):
            return False
        if last < 0:
            return True
        limit = 1 << 60
        while True:
            if get(spelt[last] + spelt[token], limit) < limit:
                return False
            left, right = lefts[token], rights[last]
            if left == -2 or right == -2:  # halves of made tokens are made themselves
                self._learn(token)
                self._learn(last)
                left, right = lefts[token], rights[last]
            if (last > token and right != last) or left == token:
                if right == last:
                    return True
                limit, last = last, right
            else:
                limit, token = token + 1, left

    def _move(self, state: int, byte: int) -> int | tuple[int, tuple[int, ...]]:
        child, token_at, inner, follows, bits = self.child, self.token_at, self.inner, self._follows, self.LAST
        found, key = [], self.configurations[state]
        for at in range(0, len(key), 2):
            packed, waiting = key[at], key[at + 1]
            node = child.get((packed >> bits) * 256 + byte)
            if node is None:
                continue
            token = token_at[node]
            last = packed & ((1 << bits) - 1)
            if token >= 0 and follows(last - 1, token):
                found.append((token + 1, (*waiting, token)))
            if inner[node]:
                found.append((node << bits | last, waiting))
        out: tuple[int, ...] = ()
        if found and all([w for _, w in found]):
            shared, shortest = 0, min([len(w) for _, w in found])
            while shared < shortest and len({w[shared] for _, w in found}) == 1:
                shared += 1
            if shared:
                out = found[0][1][:shared]
                found = [(packed, w[shared:]) for packed, w in found]
        found.sort()
        target = self._state(tuple([x for pair in found for x in pair]))
        step = (target, out) if out else target
        self.moves[state * 256 + byte] = step
        self.bytes += MOVE_SIZE + (OUT_SIZE + 8 * len(out) if out else 0)
        return step

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one piece; a piece that is a token itself is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out, moves = 0, [], self.moves
        for byte in piece:
            step = moves.get(state * 256 + byte)
            if step is None:
                if self.bytes > self.state_bytes:  # the walk goes on from the same configurations
                    here = self.configurations[state]
                    self._clear()
                    state, moves = self._state(here), self.moves
                step = self._move(state, byte)
            if step.__class__ is int:
                state = step
            else:
                state = step[0]
                out += step[1]
        key = self.configurations[state]
        (final,) = [key[at + 1] for at in range(0, len(key), 2) if not key[at] >> self.LAST]
        return [*out, *final]


class Utf8Stream:
    """Incremental UTF-8: ``feed`` returns the text that is complete, the rest waits for more bytes."""

    def __init__(self):
        self.waiting = b""

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        end = len(data)
        for back in range(1, min(4, end) + 1):
            byte = data[end - back]
            if byte & 0xC0 == 0x80:
                continue
            need = 4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2 if byte >= 0xC0 else 1
            if need > back:
                end -= back
            break
        self.waiting = data[end:]
        return data[:end].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Texts to ids and back. Chunks that no piece can cross are encoded once and kept while there is room.

    The kept chunks are a memo beside the transducer: in two generations, of
    which the older goes when the younger holds half of its room.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_bytes: int = CACHE_BYTES):
        self.transducer = Transducer(ranks, cache_bytes * 5 // 8)
        self.chunk_bytes = cache_bytes * 3 // 8
        self.pieces = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes = 0
        self.table = [self.transducer.token_bytes.get(i, b"") for i in range(max(ranks.values()) + 1)]

    def _ids(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in self.pieces.findall(text):
            ids += self.transducer.encode(piece.encode("utf-8"))
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """All ids of the whole text; none for null."""
        if not text:
            return np.zeros(0, dtype="<u4")
        if RARE_SPACE.search(text):
            return np.frombuffer(self._ids(text), dtype="<u4")
        known, out = self.known, []
        for found in CHUNK.finditer(text):
            part = found.group()
            ids = known.get(part)
            if ids is None:
                ids = self.older.get(part)
                if ids is None:
                    ids = self._ids(part)
                size = CHUNK_SIZE + sys.getsizeof(part) + len(ids)
                if size < self.chunk_bytes // 64:
                    if self.bytes + size > self.chunk_bytes // 2:
                        self.older, self.known, self.bytes = known, {}, 0
                        known = self.known
                    known[part] = ids
                    self.bytes += size
            out.append(ids)
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decode_stream(self, batches: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text pieces of id batches; characters that batches cut in two come out whole."""
        stream = Utf8Stream()
        for ids in batches:
            yield stream.feed(self.decode_bytes(ids))
        yield stream.close()


_CODECS: dict[tuple, Codec] = {}


def _codec(key: tuple, shared) -> Codec:
    """One codec per worker and vocabulary; its cached states serve all later tasks."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(*shared.value)
    return _CODECS[key]


def _forget() -> None:
    _CODECS.clear()
    give_back()


def _shared(spark: SparkSession, path: str, pattern: str, cache_bytes: int):
    ranks = read_ranks(spark, path)
    key = (hashlib.sha256(repr((sorted(ranks.items()), pattern, cache_bytes)).encode()).hexdigest(),)
    return key, spark.sparkContext.broadcast((ranks, pattern, cache_bytes))  # a vocabulary file, fixed size


def encode_column(spark: SparkSession, path: str, pattern: str, cache_bytes: int = CACHE_BYTES):
    """Column function: text -> array<int> of ids (null: empty)."""
    key, shared = _shared(spark, path, pattern, cache_bytes)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(key, shared)
        for texts in batches:
            yield pd.Series([codec.encode(t).astype(np.int32) for t in texts])

    return encode.asNondeterministic()


def decode_column(spark: SparkSession, path: str, pattern: str, step: int = 4096):
    """Column function: array<int> -> text, decoded in steps of so many ids (null: empty)."""
    key, shared = _shared(spark, path, pattern, CACHE_BYTES)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(key, shared)
        for rows in batches:
            yield pd.Series(["".join(codec.decode_stream(_steps(ids, step))) if ids is not None else "" for ids in rows])

    return decode.asNondeterministic()


def _steps(ids: np.ndarray, step: int) -> Iterator[list[int]]:
    for at in range(0, len(ids), step):
        yield ids[at : at + step].tolist()


def _digest_frames(codec: Codec, decimal: list[bytes], texts: Iterable[str | None], keep_ids: bool) -> Iterator[pd.DataFrame]:
    """Rows of the texts in order; with ids, which are as large as the texts, in frames of about SENT_IDS of them."""
    names, rows, held = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 if keep_ids else 3], [], 0
    for text in texts:
        ids = codec.encode(text)
        listed = ids.tolist()
        back = hashlib.sha256()
        for part in codec.decode_stream(_steps(ids, 1 << 16)):
            back.update(part.encode("utf-8"))
        row = (len(listed), hashlib.sha256(b",".join(map(decimal.__getitem__, listed))).hexdigest(), back.hexdigest())
        rows.append((*row, ids.astype(np.int32)) if keep_ids else row)
        held += len(listed)
        if keep_ids and held > SENT_IDS:
            yield pd.DataFrame(rows, columns=names)
            rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=names)


def encode_digests(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = CACHE_BYTES, keep_ids: bool = False, keep_codec: bool = True
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and the ids) of every text, encoded and decoded again.

    Null and empty texts have no tokens; repeated rows are kept. The decoded
    digest is taken over the bytes that the stream decoder gives for the ids.
    ``cache_bytes`` bounds what a worker keeps between texts: less of it costs
    time, never a result. Without ``keep_codec`` a task leaves nothing of it in
    its worker, for what runs there next.
    """
    key, shared = _shared(docs.sparkSession, path, pattern, cache_bytes)
    ids_type = ", ids array<int>" if keep_ids else ""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + ids_type)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(key, shared)
        decimal = [str(i).encode() for i in range(len(codec.table))]
        for texts in batches:
            yield from _digest_frames(codec, decimal, texts, keep_ids)
        if not keep_codec:
            del codec
            _forget()

    return docs.select(F.col(id_col).alias("doc_id"), digest.asNondeterministic()(F.col(text_col)).alias("d")).select("doc_id", "d.*")
