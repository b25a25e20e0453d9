"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

An id is replaced by its rank among all ids of the corpus (most frequent first),
and a rank takes one to four bytes. Four lengths share one control byte; control
and data bytes are two columns of a row per document. The rows lie in ascending
document order in Parquet files below ``path/docs``, the ranks below
``path/ranks``. Decoding looks up the four lengths of a control byte in a table.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.session import scratch_path

END_ID = 1
#: Pieces and chunks that a worker keeps.
MAX_KNOWN = 1_000_000
# fixed value: the pattern of the tokenizer whose texts are encoded piece by piece
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Letters, digits and signs that normalisation leaves alone one by one, with the white space between them;
# every other text goes to the tokenizer as a whole.
_LETTER = "a-zß-öø-ſ"
PLAIN = re.compile("[^ \t\n\r\x21-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-įı-ſ‐-‧‰-⁞]")
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9]+")

_LENGTHS = np.array([[(c >> 2 * j & 3) + 1 for j in range(4)] for c in range(256)], dtype=np.int64)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(code) // 4) * 4, dtype=np.uint8)
    padded[: len(code)] = code
    four = padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)
    control = np.bitwise_or.reduce(four, axis=1) if len(four) else padded
    used = np.arange(4)[None, :] <= code[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks behind control and data bytes."""
    lengths = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    raw = np.frombuffer(data, dtype=np.uint8)
    out = raw[starts].astype(np.uint32)
    for j in (1, 2, 3):
        longer = np.flatnonzero(lengths > j)
        if not len(longer):
            break
        out[longer] |= raw[starts[longer] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


def id_kind(vocabulary: int) -> str:
    """Type in which ids are held before they are ranked."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class WordEncoder:
    """Ids of whole texts by the tokenizer; of plain texts each piece is given to it once and kept.

    Where the tokenizer folds case, splits by ``PIECE`` and drops white space,
    the ids of a plain text are those of its pieces in order. Pieces go to the
    tokenizer many at a time; the ids that end a word tell them apart again.
    The tokenizer finds added tokens (``<|endoftext|>``) before it splits, so a
    text that holds the content of one, in whatever case, is no plain text.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.known: dict[str, bytes] = {}  # pieces, and chunks between white space
        spec = json.loads(definition)
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        suffix = spec["model"].get("end_of_word_suffix")
        self.added = [token["content"].lower() for token in spec.get("added_tokens") or []]
        plain = not any(PLAIN.search(content) or content.split() != [content] for content in self.added)
        self.by_piece = steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex") == SPLIT and bool(suffix) and plain
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1, dtype=bool)
        self.kind = id_kind(len(self.ends_word))
        if suffix:
            self.ends_word[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _chunks(self, text: str | None) -> list[str] | None:
        """Lower-cased parts between white space; None if the text has to be encoded whole."""
        if not text or not self.by_piece or PLAIN.search(text):
            return None
        lower = text.lower()
        return None if any(content in lower for content in self.added) else lower.split()

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 1024):
            part = new[at : at + 1024]
            (ids,) = self._direct([" ".join(part)])
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * ids.itemsize
            if len(ends) == len(part):
                raw = ids.tobytes()
                cut = [raw[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            else:
                cut = [x.tobytes() for x in self._direct(part)]
            self.known.update(zip(part, cut, strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        known = self.known
        if len(known) > MAX_KNOWN:
            known.clear()
        split = [self._chunks(t) for t in texts]
        fresh = set().union(*(parts for parts in split if parts)).difference(known)
        cut = {c: PIECE.findall(c) for c in fresh if not c.isalpha()}
        self._learn(list(fresh.difference(cut).union(*cut.values()).difference(known)))
        get = known.__getitem__
        known.update([(c, b"".join(map(get, parts))) for c, parts in cut.items()])
        rows = []
        for text, parts in zip(texts, split, strict=True):
            if parts is not None:
                rows.append(np.frombuffer(b"".join(map(get, parts)), dtype=self.kind))
            else:
                rows.append(self._direct([text])[0] if text else np.zeros(0, dtype=self.kind))
        return rows


_ENCODERS: dict[int, WordEncoder] = {}


def _encoder(shared) -> WordEncoder:
    """One encoder per worker and definition."""
    key = zlib.crc32(shared.value.encode("utf-8"))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(shared.value)
    return _ENCODERS[key]


def _batches(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch with about ``limit`` characters of its last column."""
    texts = batch.column(batch.num_columns - 1).to_pylist()
    at = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= limit:
            yield batch.slice(at, i + 1 - at), texts[at : i + 1]
            at, held = i + 1, 0
    if at < len(texts):
        yield batch.slice(at), texts[at:]


def count_ids(stored: DataFrame, held: str) -> list[tuple[int, int]]:
    """(id, occurrences) over the column ``ids``; at most one row per vocabulary entry reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            for ids in batch.column(0):
                more = np.bincount(np.frombuffer(ids.as_buffer(), dtype=held).astype(np.int32))
                if len(more) > len(total):
                    total = np.pad(total, (0, len(more) - len(total)))
                total[: len(more)] += more
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["id", "n"])

    counted = stored.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return [(r["id"], r["n"]) for r in counted.collect()]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` and ``ranks`` below ``path``; ``tokenizer`` is the JSON definition.

    Texts are dealt by ranges of the id, encoded once and stored in order in the
    scratch folder; the counts and then the files are made from these ids. Every
    row names its range and its place there. Null texts hold the end id alone.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer)
    held = WordEncoder(tokenizer).kind
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "part", "part_start", "n_tokens"]
    head = f"doc_id {kind}, part int, part_start long, n_tokens long"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at, end = _encoder(shared), TaskContext.get().partitionId(), 0, np.array([END_ID], dtype=held).tobytes()
        for batch in batches:
            for rows, texts in _batches(batch):
                coded = [ids.tobytes() + end for ids in encoder.encode(texts)]
                sizes = np.array([len(c) // len(end) for c in coded])
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                own = [rows.column(0), pa.array([part] * len(sizes), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())]
                yield pa.record_batch([*own, pa.array(coded, pa.binary())], [*names, "ids"])

    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    raw = scratch_path(spark, "token-ids")
    ordered.mapInArrow(encode, f"{head}, ids binary").write.option("compression", "zstd").parquet(raw)
    stored = spark.read.parquet(raw)
    order = [i for i, _ in sorted(count_ids(stored, held), key=lambda x: (-x[1], x[0]))]
    spark.createDataFrame([(i, r) for r, i in enumerate(order)], "id long, rank long").coalesce(1).write.parquet(f"{path}/ranks")
    table = np.zeros(max(order, default=0) + 1, dtype="<u4")
    table[order] = np.arange(len(order), dtype="<u4")
    ranks = spark.sparkContext.broadcast(table)  # one entry per vocabulary id

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [encode_ranks(ranks.value[np.frombuffer(ids.as_buffer(), dtype=held)]) for ids in batch.column(4)]
            two = [pa.array([c[i] for c in coded], pa.binary()) for i in (0, 1)]
            yield pa.record_batch([*batch.columns[:4], *two], [*names, "control", "data"])

    ranked = stored.select(*names, "ids").mapInArrow(rank, f"{head}, control binary, data binary")
    ranked.sortWithinPartitions("part", "part_start").write.option("compression", "zstd").parquet(f"{path}/docs")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of the files below ``path``."""
    return _decoded(spark, path, "ids binary", lambda ids: ids.tobytes(), pa.binary())


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the decoded ids."""
    return _decoded(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids), pa.int64())


def _decoded(spark: SparkSession, path: str, field: str, result, kind: pa.DataType) -> DataFrame:
    ranks = spark.read.parquet(f"{path}/ranks").collect()
    table = np.zeros(len(ranks), dtype="<u4")
    for r in ranks:
        table[r["rank"]] = r["id"]
    shared = spark.sparkContext.broadcast(table)
    stored = spark.read.parquet(f"{path}/docs")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per written partition
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_pylist()
            ids = [
                result(shared.value[decode_ranks(c.as_py(), d.as_py(), n)])
                for n, c, d in zip(sizes, batch.column(4), batch.column(5), strict=True)
            ]
            yield pa.record_batch([*batch.columns[:4], pa.array(ids, kind)], ["doc_id", "part", "part_start", "n_tokens", field.split()[0]])

    doc_type = stored.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "part", "part_start", "n_tokens", "control", "data"]
    rows = stored.select(*columns).mapInArrow(decode, f"doc_id {doc_type}, part int, part_start long, n_tokens long, {field}")
    return rows.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("part_start")).alias("start"), "n_tokens", field.split()[0])


def token_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from files that are written and read back.

    One row per input row; null and empty texts have the end id alone, repeated
    rows are written each, null ids come first, an empty table gives none.
    """
    with open(tokenizer_path, encoding="utf-8") as definition:
        tokenizer = definition.read()
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, id_col, text_col)
    return read_token_digests(docs.sparkSession, path)
