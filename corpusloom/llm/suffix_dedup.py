"""Repeated byte strings across documents: a distributed merge sort of sampled suffixes.

Every window of 100 bytes names one of its places as its anchor: the place of
its smallest 32-gram hash. Equal windows name equal places, so it is enough to
sort the suffixes that start at anchors. Windows in a row with one anchor are one
record: the suffix from the anchor on, and the bytes before it.

1. Anchor hashes are counted. A fixed-size Bloom filter of those that occur more
   than once goes to the tasks; it only saves work, a false hit changes nothing.
2. Each task sorts its remaining records, joins equal ones, cuts the run by key
   range and front-codes it: the length shared with the record before, then the rest.
3. A range's runs are merged by a loser tree that holds, for each head, how much
   it shares with the last output, and so compares no known prefix again.
4. Suffixes of one anchor come out together. Equal windows among them are found
   by their hashes; all but the earliest are removed.

Records of an anchor that occurs very often do not take part in 2 to 4. The
sending task compares their windows in blocks and sends the earliest of each
window hash, dealt by that hash; all but the earliest of these are removed.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.hash_filter import HashFilter, bloom_of, mix
from corpusloom.llm.workers import lean
from corpusloom.session import materialize

LENGTH = 100
GRAM = 32
#: Bits of the filter of repeated anchors, at most.
FILTER_BITS = 1 << 28
#: Bytes of records that a run holds before it is sorted and sent.
RUN_BYTES = 24 << 20
#: Bytes of text that one pass over a long document looks at.
PIECE = 1 << 22
#: Bytes of short texts that are looked at together.
JOINED = 1 << 17
#: Context bytes whose windows are compared at once; a larger group (at most HOT_RECORDS) is held as a whole.
GROUP_BYTES = 1 << 20
#: Anchors that occur more often are dealt by their windows; a window is a row of 32 bytes, so fewer records are cheaper as a group.
HOT_RECORDS = 1 << 14
#: Bytes of records of hot anchors that are compared and sent together.
HOT_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15
_TABLE: list[np.ndarray] = [np.ones(0, dtype=np.uint64)] * 2


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLE[0]) < n:
        size = max(n, 1 << 16) * 5 // 4
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _TABLE[i] = np.multiply.accumulate(steps)
    return _TABLE[0][:n], _TABLE[1][:n]


def _prefix(raw: np.ndarray) -> np.ndarray:
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        terms = raw.astype(np.uint64)
        terms += np.uint64(1)
        terms *= _powers(len(raw))[0]
        np.cumsum(terms, out=total[1:])
    return total


def _hashes(total: np.ndarray, starts: np.ndarray | slice, length: int) -> np.ndarray:
    """Hash of ``length`` bytes from each start, the same wherever the bytes stand."""
    down = _powers(len(total))[1]
    with np.errstate(over="ignore"):
        if isinstance(starts, slice):
            n = len(total) - length
            spans = total[length:] - total[:n]
            spans *= down[:n]
            return mix(spans)
        return mix((total[starts + length] - total[starts]) * down[starts])


def anchors(raw: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor, first, last) of the runs of window starts with one anchor.

    ``raw`` may be several texts in a row with the given ends; windows across an end do not count.
    """
    found: list[tuple] = []
    windows = len(raw) - LENGTH + 1
    span = LENGTH - GRAM + 1
    for at in range(0, max(windows, 0), PIECE):
        part = raw[at : min(at + PIECE, windows) + LENGTH - 1]
        gram = _hashes(_prefix(part), slice(None), GRAM)
        packed = (gram & ~np.uint64((1 << 24) - 1)) | np.arange(len(gram), dtype=np.uint64)
        least, width = packed, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        for end in [] if ends is None else (ends[:-1] - at).tolist():
            place[max(end - LENGTH + 1, 0) : max(end, 0)] = -1
        cut = np.append(0, np.flatnonzero(place[1:] != place[:-1]) + 1)
        last = np.append(cut[1:], len(place)) - 1
        if ends is not None:
            inside = place[cut] >= 0
            cut, last = cut[inside], last[inside]
        found.append((gram[place[cut]], place[cut] + at, cut + at, last + at))
    if not found:
        return (np.zeros(0, dtype=np.uint64),) + (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _raw(text: pa.Scalar) -> np.ndarray:
    value = text.as_buffer()
    return np.frombuffer(value, dtype=np.uint8) if value is not None and value.size else np.zeros(0, dtype=np.uint8)


def joined(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first, bytes, ends) of texts in a row: at most JOINED bytes, or one text."""
    first, held, size = 0, [], 0
    for n, text in enumerate(texts):
        raw = _raw(text)
        if held and size + len(raw) > min(JOINED, PIECE):
            yield first, np.concatenate(held), np.cumsum([len(r) for r in held])
            first, held, size = n, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, np.concatenate(held), np.cumsum([len(r) for r in held])


def repeated_anchors(docs: DataFrame) -> tuple[HashFilter, np.ndarray]:
    """Filter of the (mixed) anchor hashes that occur at least twice in column ``text``; sorted hashes of those over HOT_RECORDS."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, raw, ends in joined(batch.column(0)):
                held.append(mix(anchors(raw, ends)[0]))  # the least of many are small numbers; the filter takes its segments by upper bits
                n += len(held[-1])
                if n > 1 << 20:
                    yield counted(held)
                    held, n = [], 0
        yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        values, times = np.unique(np.concatenate(held) if held else np.zeros(0, dtype=np.uint64), return_counts=True)
        return pa.record_batch([pa.array(values.view(np.int64)), pa.array(times.astype(np.int64))], ["hash", "times"])

    counted_all = docs.select("text").mapInArrow(count, "hash long, times long").groupBy("hash").agg(F.sum("times").alias("times"))
    again = materialize(counted_all.filter("times > 1").select("hash", (F.col("times") > HOT_RECORDS).alias("hot")), "repeated-anchors")
    hot = [r["hash"] for r in again.filter("hot").select("hash").toLocalIterator()]  # at most one per HOT_RECORDS anchors
    return bloom_of(again.select("hash"), FILTER_BITS), np.sort(np.array(hot, dtype=np.int64).view(np.uint64))


# ---- runs -----------------------------------------------------------------
def shared_length(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    n = min(len(a), len(b))
    x, y = a[start:n], b[start:n]
    if x == y:
        return n
    differ = int.from_bytes(x) ^ int.from_bytes(y)
    return start + len(x) - (differ.bit_length() + 7) // 8


def front_code(records: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """Sorted (suffix, left, doc, text hash, start), packed: lengths, places and documents as arrays, then the bytes that are new, then those to the left."""
    n, suffixes = len(records), [r[0] for r in records]
    sizes = np.fromiter(map(len, suffixes), np.int64, n)
    place = np.arange(sizes.max() + 1)
    held = place < sizes[:, None]
    grid = np.zeros(held.shape, dtype=np.uint8)
    grid[held] = np.frombuffer(b"".join(suffixes), dtype=np.uint8)
    differ = (grid[1:] != grid[:-1]) | (place >= np.minimum(sizes[1:], sizes[:-1])[:, None])
    shared = np.append(0, differ.argmax(axis=1))
    fresh = grid[held & (place >= shared[:, None])]
    lefts = np.fromiter((len(r[1]) for r in records), np.int64, n)
    known = {d: i for i, d in enumerate(dict.fromkeys((doc, text) for _, _, doc, text, _ in records))}
    which = np.array([known[doc, text] for _, _, doc, text, _ in records], dtype="<u4")
    starts = np.array([r[4] for r in records], dtype="<u4")
    table = np.array(list(known), dtype="<i8").reshape(len(known), 2)
    head = n.to_bytes(4, "little") + len(known).to_bytes(4, "little")
    columns = [shared.astype("<u2"), (sizes - shared).astype("<u2"), lefts.astype("<u1"), which, starts, table, fresh]
    plain = b"".join([head, *(c.tobytes() for c in columns), *(r[1] for r in records)])
    return len(plain).to_bytes(4, "little") + pa.Codec("zstd").compress(plain, asbytes=True)


def read_run(packed: bytes) -> Iterator[tuple[int, bytes, bytes, int, int, int]]:
    """(shared with the record before, suffix, left, doc, text hash, start) in order."""
    block = pa.Codec("zstd").decompress(packed[4:], decompressed_size=int.from_bytes(packed[:4], "little"), asbytes=True)
    n, known, at = int.from_bytes(block[:4], "little"), int.from_bytes(block[4:8], "little"), 8
    columns = []
    for kind, width in (("<u2", 2), ("<u2", 2), ("<u1", 1), ("<u4", 4), ("<u4", 4)):
        columns.append(np.frombuffer(block, kind, n, at))
        at += width * n
    table = np.frombuffer(block, "<i8", 2 * known, at).reshape(known, 2).tolist()
    at += 16 * known
    suffix, beside = b"", at + int(columns[1].sum())
    for part in range(0, n, 1024):  # numbers of few records at a time: as objects they are larger than the records
        for same, more, left, which, start in zip(*(c[part : part + 1024].tolist() for c in columns), strict=True):
            suffix = suffix[:same] + block[at : at + more]
            at += more
            yield same, suffix, block[beside : beside + left], *table[which], start
            beside += left


def merge_runs(blocks: list[bytes]) -> Iterator[tuple[int, bytes, bytes, int, int, int]]:
    """All records in order, each with the length it shares with the one before.

    Every loser in the tree keeps the length it shares with the last output. Of
    two heads the one that shares more is the smaller; only heads that share
    equally are compared, from that length on.
    """
    runs = [read_run(b) for b in blocks]
    count = len(runs)
    heads = [next(r, None) for r in runs]
    known = [-1 if h is None else 0 for h in heads]

    def beats(i: int, j: int) -> bool:
        """Whether head i goes before head j; the loser then knows what it shares with the winner."""
        if known[i] != known[j]:
            return known[i] > known[j]
        if known[i] < 0:
            return True
        a, b = heads[i][1], heads[j][1]
        same = shared_length(a, b, known[i])
        first = a[same:] <= b[same:]
        known[j if first else i] = same
        return first

    size = 1
    while size < count:
        size *= 2
    heads += [None] * (size - count)
    known += [-1] * (size - count)
    losers = [0] * size

    def fill(node: int) -> int:
        if node >= size:
            return node - size
        i, j = fill(2 * node), fill(2 * node + 1)
        i, j = (i, j) if beats(i, j) else (j, i)
        losers[node] = j
        return i

    best = fill(1) if size > 1 else 0
    while known[best] >= 0:
        head = heads[best]
        yield (known[best], *head[1:])
        following = next(runs[best], None)
        heads[best] = following
        known[best] = -1 if following is None else following[0]
        node = (best + size) // 2
        while node:
            other = losers[node]
            if known[best] < known[other] or (known[best] == known[other] and not beats(best, other)):
                best, losers[node] = other, best
            node //= 2


# ---- windows ----------------------------------------------------------------
def compare_windows(group: list[tuple[bytes, int, int, int]]) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """Spans (doc, text hash, from, to) under windows of the records (context, doc, text hash, start) that also start earlier in them,
    and the other windows as rows (window hash, doc, text hash, start)."""
    group = sorted(group, key=itemgetter(1, 3))
    sizes = np.array([len(c) for c, _, _, _ in group])
    raw = np.frombuffer(b"".join(c for c, _, _, _ in group), dtype=np.uint8)
    numbers = np.stack([np.fromiter(c, np.int64, len(group)) for c in list(zip(*group, strict=True))[1:]], axis=1)
    each = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(group)), each)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    value = _hashes(_prefix(raw), (np.cumsum(sizes) - sizes)[owner] + inner, LENGTH)
    doc, start = numbers[owner, 0], numbers[owner, 2] + inner
    hit = _later(value, doc, start)
    edge = np.flatnonzero(np.diff(np.where(hit, owner, -1), prepend=-1, append=-1))
    spans = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if hit[a]:
            i = owner[a]
            spans.append((int(numbers[i, 0]), int(numbers[i, 1]), int(start[a]), int(start[b - 1]) + LENGTH))
    first = ~hit
    return spans, np.stack([value[first].view(np.int64), doc[first], numbers[owner[first], 1], start[first]], axis=1)


def _by_hash(value: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Order by hash, doc and start: windows that come by doc and start need one sort of numbers, the hash's high bits over the window's place."""
    low = np.uint64((1 << 20) - 1)
    if len(value) <= low and np.all((doc[1:] > doc[:-1]) | ((doc[1:] == doc[:-1]) & (start[1:] >= start[:-1]))):
        packed = np.sort((value.astype(np.uint64) & ~low) | np.arange(len(value), dtype=np.uint64))
        order = (packed & low).astype(np.int64)
        v = value[order]
        if not np.any(((packed[1:] ^ packed[:-1]) <= low) & (v[1:] != v[:-1])):  # else two hashes are alike in the high bits
            return order
    return np.lexsort((start, doc, value))


def _later(value: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows come after the earliest place of their hash."""
    order = _by_hash(value, doc, start)
    v, d, s = value[order], doc[order], start[order]
    opens = np.flatnonzero(np.diff(v, prepend=v[:1] ^ v.dtype.type(1)) != 0)
    lead = np.repeat(opens, np.diff(np.append(opens, len(v))))
    hit = np.zeros(len(v), dtype=bool)
    hit[order[(d != d[lead]) | (s != s[lead])]] = True
    return hit


def repeated_windows(group: list[tuple[bytes, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(doc, text hash, from, to) of the bytes under windows that also start earlier in the records (context, doc, text hash, start)."""
    return compare_windows(group)[0]


def join_spans(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Touching spans of one text as one."""
    out: list[tuple[int, int, int, int]] = []
    for doc, text, a, b in sorted(spans):
        if out and out[-1][:2] == (doc, text) and a <= out[-1][3]:
            out[-1] = (doc, text, out[-1][2], max(b, out[-1][3]))
        else:
            out.append((doc, text, a, b))
    return out


def pack_windows(rows: np.ndarray) -> bytes:
    plain = np.ascontiguousarray(rows.T, dtype="<i8").tobytes()
    return len(plain).to_bytes(8, "little") + pa.Codec("zstd").compress(plain, asbytes=True)


def read_windows(packed: bytes) -> np.ndarray:
    plain = pa.Codec("zstd").decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), asbytes=True)
    return np.frombuffer(plain, "<i8").reshape(4, -1).T


def _hot_windows(records: list[tuple]) -> tuple[list[tuple], np.ndarray]:
    """Spans and remaining windows of records (suffix, left, doc, text hash, start), compared in blocks of GROUP_BYTES."""
    spans, rows, group, size = [], [np.zeros((0, 4), dtype=np.int64)], [], 0
    for n, (suffix, left, doc, text, start) in enumerate(records, 1):
        group.append((left + suffix[8:], doc, text, start))
        size += len(group[-1][0])
        if size > GROUP_BYTES or n == len(records):
            found, first = compare_windows(group)
            spans += found
            rows.append(first)
            group, size = [], 0
    return spans, np.concatenate(rows)


def _span_batch(spans: list[tuple[int, int, int, int]]) -> list[pa.Array]:
    columns = np.array(spans, dtype=np.int64).reshape(len(spans), 4).T
    return [pa.array(c) for c in columns]


def _send_runs(repeat, ranges: int, run_bytes: int | None = None):
    """mapInArrow over (doc, text_hash, text): front-coded runs by key range, windows of hot anchors by hash range, and spans that are settled here."""

    edges = [(-(-(k << 64) // ranges)).to_bytes(8) for k in range(1, ranges)]
    run_bytes = run_bytes or RUN_BYTES

    def settle(records: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        records.sort()
        kept, spans, first = [], [], None
        for r in records:
            if first is not None and r[0] == first[0] and r[1] == first[1]:
                if (r[2], r[4]) != (first[2], first[4]):
                    spans.append((r[2], r[3], r[4], r[4] + len(r[1]) + len(r[0]) - 8))
                    continue
                if r[3] == first[3]:
                    continue
            kept.append(r)
            first = r if first is None or (r[0], r[1]) != (first[0], first[1]) else first
        return kept, spans

    def output(records: list[tuple], often: list[tuple]) -> Iterator[pa.RecordBatch]:
        kept, spans = settle(records)
        cuts = [bisect_left(kept, (edge,)) for edge in edges]  # a range begins at the first suffix that is not below its edge
        blocks = [(k, front_code(kept[i:j])) for k, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(kept)], strict=True)) if i < j]
        kept, more = settle(often)
        found, rows = _hot_windows(kept)
        deal = ((rows[:, 0].view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        rows = rows[np.argsort(deal, kind="stable")]
        ends = np.cumsum(np.bincount(deal, minlength=ranges))
        windows = [(k, pack_windows(rows[i:j])) for k, (i, j) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if i < j]
        spans = join_spans(spans + more + found)
        names = ["range", "block", "windows", "doc", "text_hash", "from", "to"]
        for name, packed in (("block", blocks), ("windows", windows)):
            if packed:
                none, held = pa.nulls(len(packed), pa.binary()), pa.array([b for _, b in packed], pa.binary())
                two = [held, none] if name == "block" else [none, held]
                yield pa.record_batch([pa.array([k for k, _ in packed], pa.int32()), *two, *[pa.nulls(len(packed), pa.int64())] * 4], names)
        if spans:
            deal = pa.array([s[1] % ranges for s in spans], pa.int32())
            yield pa.record_batch([deal, *[pa.nulls(len(spans), pa.binary())] * 2, *_span_batch(spans)], names)

    @lean
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_filter, hot = repeat.value
        records, often, held, held_often = [], [], 0, 0

        def add(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal records, often, held, held_often
            docs, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for number, raw, ends in joined(batch.column(2)):
                value, place, first, last = anchors(raw, ends)
                if not len(value):
                    continue
                value = mix(value)
                again = held_filter.may_hold(value)
                value, begin = value[again], first[again]
                is_hot = hot[np.minimum(np.searchsorted(hot, value), len(hot) - 1)] == value if len(hot) else np.zeros(len(value), dtype=bool)
                owner = np.searchsorted(ends, begin, side="right")
                starts = np.append(0, ends[:-1])[owner]
                data, ids = raw.tobytes(), list(zip(docs[number:][: len(ends)].tolist(), hashes[number:][: len(ends)].tolist(), strict=True))
                columns = (value, is_hot, place[again], begin, last[again], owner, begin - starts)
                for h, many, a, s, e, i, at in zip(*(c.tolist() for c in columns), strict=True):
                    (often if many else records).append((h.to_bytes(8) + data[a : e + LENGTH], data[s:a], *ids[i], at))
                    held, held_often = (held, held_often + e + LENGTH - s) if many else (held + e + LENGTH - s, held_often)
                if held > run_bytes:
                    yield from output(records, [])
                    records, held = [], 0
                if held_often > HOT_BYTES:
                    yield from output([], often)
                    often, held_often = [], 0

        for batch in batches:
            yield from add(batch)
            del batch  # no text is held while the next ones come
        yield from output(records, often)

    return send


@lean
def _merge_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over rows sorted by range: merged runs, compared windows, spans.

    A window hash comes at most once from each block that a task has compared,
    but for rows of one doc that hold it at the same place.
    """
    names = ["doc", "text_hash", "from", "to"]

    def compared(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        ready, size, group, spans = [], 0, [], []
        for shared, suffix, left, doc, text, start in merge_runs(blocks):
            if shared < 8:
                if len(group) > 1:
                    ready += group
                group = []
                if size > GROUP_BYTES:
                    spans += repeated_windows(ready) if ready else []
                    ready, size = [], 0
                    if spans:
                        yield pa.record_batch(_span_batch(spans), names)
                        spans = []
            group.append((left + suffix[8:], doc, text, start))
            size += len(left) + len(suffix)
        if len(group) > 1:
            ready += group
        if ready and (spans := repeated_windows(ready)):
            yield pa.record_batch(_span_batch(spans), names)

    def dealt(windows: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([read_windows(w) for w in windows])
        rows = rows[_later(rows[:, 0], rows[:, 1], rows[:, 3])]
        if len(rows):
            yield pa.record_batch([pa.array(c) for c in (rows[:, 1], rows[:, 2], rows[:, 3], rows[:, 3] + LENGTH)], names)

    def finish(blocks: list[bytes], windows: list[bytes]) -> Iterator[pa.RecordBatch]:
        if blocks:
            yield from compared(blocks)
        if windows:
            yield from dealt(windows)

    now, blocks, windows = None, [], []
    for batch in batches:
        settled = batch.filter(batch.column(3).is_valid())
        if settled.num_rows:
            yield pa.record_batch(settled.columns[3:], names)
        for key, block, window in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if key != now:
                yield from finish(blocks, windows)
                now, blocks, windows = key, [], []
            if block.is_valid:
                blocks.append(block.as_py())
            if window.is_valid:
                windows.append(window.as_py())
    yield from finish(blocks, windows)


def repeated_spans(docs: DataFrame, ranges: int | None = None, run_bytes: int | None = None) -> DataFrame:
    """doc, text_hash, spans: merged (start, end) byte ranges to remove, for documents that have any.

    ``docs`` has doc (bigint), text_hash and text. A byte is removed if a
    100-byte string that covers it also starts earlier: in a smaller doc, or
    earlier in the same one. Rows with one doc do not count as earlier than
    each other at the same place. ``run_bytes`` takes the place of RUN_BYTES.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    repeat = spark.sparkContext.broadcast(repeated_anchors(docs))  # at most FILTER_BITS, and 8 bytes per HOT_RECORDS anchors
    sent = docs.select("doc", "text_hash", "text").mapInArrow(
        _send_runs(repeat, ranges, run_bytes), "range int, block binary, windows binary, doc long, text_hash long, `from` long, `to` long"
    )
    dealt = sent.repartition(ranges, "range").sortWithinPartitions("range")
    spans = dealt.mapInArrow(_merge_ranges, "doc long, text_hash long, `from` long, `to` long")
    by_doc = spans.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set(F.struct(F.col("from").alias("s"), F.col("to").alias("e")))).alias("all"))
    return by_doc.select("doc", "text_hash", _merged(F.col("all")).alias("spans"))


def _merged(spans: Column) -> Column:
    """Union of sorted (s, e) ranges: a range opens where all before it have ended."""
    def step(a: Column, x: Column) -> Column:
        joins = x.s <= a.end
        done = F.when(joins, a.done).otherwise(F.concat(a.done, F.array(F.struct(a.start.alias("s"), a.end.alias("e")))))
        return F.struct(done.alias("done"), F.when(joins, a.start).otherwise(x.s).alias("start"), F.greatest(a.end, x.e).alias("end"))

    head = F.get(spans, F.lit(0))
    zero = F.struct(F.array().cast("array<struct<s:bigint,e:bigint>>").alias("done"), head.s.alias("start"), head.e.alias("end"))
    return F.aggregate(spans, zero, step, lambda a: F.concat(a.done, F.array(F.struct(a.start.alias("s"), a.end.alias("e")))))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, text_hash, text; a null id stands before all others."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("doc"),
        F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"),
    )


def kept_bytes(data: bytes, spans: list[dict] | None) -> bytes:
    parts, at = [], 0
    for span in spans or []:
        parts.append(data[at : span["s"]])
        at = span["e"]
    return b"".join([*parts, data[at:]]) if spans else data


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row per input row.

    Null and empty texts have no bytes; texts under 100 bytes lose none.
    Repeated rows share their id's spans, and neither counts as the earlier
    one; a null id counts as the smallest. An empty table gives an empty result.
    """
    keyed = _keyed(docs, id_col, text_col)
    spans = materialize(repeated_spans(keyed), "spans")
    key = F.xxhash64("doc", "text_hash")
    held = docs.sparkSession.sparkContext.broadcast(bloom_of(spans.select(key.alias("hash")), FILTER_BITS))

    @F.pandas_udf("boolean")
    def may_hold(hashes: pd.Series) -> pd.Series:
        return pd.Series(held.value.may_hold(hashes.to_numpy().view(np.uint64)))

    kind = docs.schema[id_col].dataType.simpleString()
    doc_id = F.when(F.col("doc") != -(1 << 63), F.col("doc")).cast(kind).alias("doc_id")
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def digests(ids: pa.Array, texts: Iterable[pa.Scalar], cuts: Iterable[list[dict] | None]) -> pa.RecordBatch:
        out = []
        for text, cut in zip(texts, cuts, strict=True):
            data = _raw(text).tobytes()
            kept = kept_bytes(data, cut)
            out.append((len(data), len(data) - len(kept), len(cut or []), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        types = [pa.int64()] * 3 + [pa.string()]
        return pa.record_batch([ids, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    @lean
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield digests(batch.column(0), batch.column(1), batch.column(2).to_pylist())

    @lean
    def digest_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure = np.flatnonzero(~held.value.may_hold(batch.column(2).to_numpy().view(np.uint64)))
            texts = batch.column(1)
            yield digests(batch.column(0).take(pa.array(sure)), (texts[i] for i in sure.tolist()), [None] * len(sure))

    # texts that surely lose nothing are not moved to the join; a task has one Python worker at a time in either way
    moved = keyed.filter(may_hold(key)).join(spans, ["doc", "text_hash"], "left").select(doc_id, "text", "spans")
    return moved.mapInArrow(digest, schema).unionByName(keyed.select(doc_id, "text", key.alias("key")).mapInArrow(digest_whole, schema))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_bytes: int | None = None) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the texts, other columns as they were.

    A character that a cut divides goes as a whole. Smaller runs (``run_bytes``) leave more memory to others.
    """
    spans = materialize(repeated_spans(_keyed(docs, id_col, text_col), run_bytes=run_bytes), "spans")
    spans = spans.select(
        F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash"),
        F.transform("spans", lambda x: x.s).alias("_from"), F.transform("spans", lambda x: x.e).alias("_to"),
    )
    own = F.coalesce(docs[id_col].cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    joined = docs.join(spans, (own == F.col("_doc")) & (F.xxhash64(docs[text_col]) == F.col("_hash")), "left")

    @F.pandas_udf("string")
    @lean
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, starts, ends in batches:
            out = []
            for text, s, e in zip(texts, starts, ends, strict=True):
                if text is not None and s is not None:
                    text = kept_bytes(text.encode("utf-8"), [{"s": a, "e": b} for a, b in zip(s, e, strict=True)]).decode("utf-8", "ignore")
                out.append(text)
            yield pd.Series(out, dtype=object)

    return joined.withColumn(text_col, cut(F.col(text_col), F.col("_from"), F.col("_to"))).drop("_doc", "_hash", "_from", "_to")
