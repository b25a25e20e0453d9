"""Minimax contiguous partition of documents into shards (law ``bytes``).

Atomic groups (equal texts) stand in the order of the md5 of their text. The
smallest capacity for which a greedy pass needs at most ``n_shards`` shards is
found by binary search, and the shards are cut there. The driver never sees the
groups: it sees sums of hash-prefix buckets (65,536 at most) and splits only the
few buckets in which a cut can fall, until these hold single groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize

FIRST_DIGITS = 4
MORE_DIGITS = 3
SLOT_BUCKETS = 4096


def _greedy(ends: np.ndarray, capacity: int, n: int) -> list[int]:
    """Cut indices (item counts before each cut) of the greedy pass, at most ``n`` shards long."""
    cuts, start = [], 0
    for _ in range(n):
        base = ends[start - 1] if start else 0
        start = int(np.searchsorted(ends, base + capacity, side="right"))
        cuts.append(start)
        if start >= len(ends):
            break
    return cuts


def _smallest(feasible, low: int, high: int) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


def _relaxed(ends: np.ndarray, starts: np.ndarray, single: np.ndarray, capacity: int, n: int) -> list[int]:
    """Byte positions of greedy cuts if buckets that are no single group could be cut anywhere."""
    at, cuts = 0, []
    for _ in range(n):
        at += capacity
        i = int(np.searchsorted(ends, at, side="right"))
        if i >= len(ends):
            cuts.append(int(ends[-1]))
            break
        if single[i]:
            at = int(starts[i])
        cuts.append(at)
    return cuts


def minimax_cuts(groups: DataFrame, key: str, size: str, n_shards: int) -> tuple[int, list[str]]:
    """Smallest feasible capacity and the key prefixes at which shards 1, 2, ... begin.

    ``groups`` has a hex key and a size per row; rows of one key are one atomic
    group. Keys are compared as strings, so ``key >= prefix`` places a row.
    """

    def buckets(rows: DataFrame, digits: int) -> list[tuple[str, int, bool]]:
        found = rows.groupBy(F.substring(key, 1, digits).alias("p")).agg(
            F.sum(size).alias("s"), (F.min(key) == F.max(key)).alias("one")
        )
        return [(r["p"], int(r["s"]), bool(r["one"])) for r in found.collect()]

    items = sorted(buckets(groups, FIRST_DIGITS))
    if not items:
        return 0, []
    while True:
        sizes = np.array([s for _, s, _ in items], dtype=np.int64)
        single = np.array([one for _, _, one in items])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        total = int(ends[-1])
        whole = lambda c: _greedy(ends, c, n_shards)[-1] >= len(ends)
        split = lambda c: _relaxed(ends, starts, single, c, n_shards)[-1] >= total
        least = max(-(-total // n_shards), int(sizes[single].max(initial=1)))
        high = _smallest(whole, max(least, 1), total)
        low = _smallest(split, max(least, 1), high)
        first = [int(starts[i]) if i < len(items) else total for i in _greedy(ends, low, n_shards)]
        last = _relaxed(ends, starts, single, high, n_shards)
        last += [total] * (len(first) - len(last))
        open_items = {
            i
            for a, b in zip(first, last, strict=False)
            for i in range(int(np.searchsorted(ends, a, side="right")), min(int(np.searchsorted(starts, b, side="right")), len(items)))
            if not single[i]
        }
        if low == high or not open_items:
            cuts = [i for i in _greedy(ends, high, n_shards) if i < len(items)]
            if not any(not single[i] for i in open_items):
                return high, [items[i][0] for i in cuts]
        depth: dict[int, list[int]] = {}
        for i in open_items:
            depth.setdefault(len(items[i][0]), []).append(i)
        kept = [x for i, x in enumerate(items) if i not in open_items]
        for digits, members in depth.items():
            prefixes = [items[i][0] for i in members]
            kept += buckets(groups.filter(F.substring(key, 1, digits).isin(prefixes)), digits + MORE_DIGITS)
        items = sorted(kept)


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per input row.

    Size is the UTF-8 length plus 1 (a null text has no bytes, its crc is 0).
    Null texts form one group, empty texts another. Repeated rows and repeated
    or null ids are kept and get their own slots. Slots count from 0 within a
    shard: counted buckets of the id's hash give the offset, so no task numbers
    a whole shard. An empty table gives an empty result. A group larger than an
    even share fills a shard alone or with neighbours; later shards may then
    stay empty.
    """
    text = F.col(text_col)
    slim = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("bigint").alias("text_crc32"),
            F.coalesce(F.md5(text), F.lit("")).alias("_key"),
        ),
        "shard-sizes",
    )
    _, cuts = minimax_cuts(slim, "_key", "size", n_shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + F.when(F.col("_key") >= cut, 1).otherwise(0)
    placed = slim.select(
        "doc_id", "size", "text_crc32", shard.cast("int").alias("shard"),
        F.pmod(F.xxhash64("doc_id", "_key"), F.lit(SLOT_BUCKETS)).cast("int").alias("_bucket"),
    )
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
        .select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )  # at most n_shards x SLOT_BUCKETS rows
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32")
    return (
        placed.withColumn("_place", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["shard", "_bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("_offset") + F.col("_place") - 1).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
