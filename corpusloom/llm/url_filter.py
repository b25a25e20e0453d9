"""URL rules by a Bloom filter cascade: exact membership of the corpus's keys without a join.

Level 1 is a Bloom filter of the listed keys. Of the universe (every key that
the corpus can ask for) some unlisted keys pass it; level 2 encodes exactly
those, level 3 the listed keys that pass level 2, and so on until no key is
wrong. A key of the universe is then judged exactly by the first level that
rejects it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import materialize

#: Bits of all levels together that are broadcast; beyond it membership is decided by a join.
MAX_BITS = 1 << 30


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Level:
    """One Bloom filter; positions come from two 64-bit hashes of the key and the level's number."""

    def __init__(self, number: int, n: int, rate: float):
        self.number, self.m = number, max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        self.k = max(1, round(self.m / max(n, 1) * math.log(2)))
        self.k = min(self.k, 24)
        self.words = np.zeros((self.m + 63) // 64, dtype=np.uint64)

    def positions(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        salt = np.uint64(0x9E3779B97F4A7C15 * (self.number + 1) % (1 << 64))
        with np.errstate(over="ignore"):
            a, b = _mix(h1.view(np.uint64) ^ salt), _mix(h2.view(np.uint64) + salt) | np.uint64(1)
            return (a[:, None] + b[:, None] * np.arange(self.k, dtype=np.uint64)) % np.uint64(self.m)

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.positions(h1, h2)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


class Cascade:
    """Levels in order; ``contains`` judges arrays of hash pairs."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), len(self.levels) % 2 == 1)
        left = np.arange(len(h1))
        for i, level in enumerate(self.levels):
            ok = level.passes(h1[left], h2[left])
            out[left[~ok]] = i % 2 == 1
            left = left[ok]
        return out

    @property
    def bits(self) -> int:
        return sum(level.m for level in self.levels)


def key_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


def _encode(keys: DataFrame, level: Level) -> None:
    """Fill the level: positions per task, words joined by bit_or before they reach the driver."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(level.positions(batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.left_shift(np.uint64(1), at & np.uint64(63))
            masks = np.bitwise_or.reduceat(bits, first) if len(first) else bits
            yield pa.record_batch([pa.array(word.astype(np.int64)), pa.array(masks.view(np.int64))], ["word", "mask"])

    words = keys.mapInArrow(mark, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    level.words[words["word"].to_numpy()] = words["mask"].to_numpy(dtype=np.int64).view(np.uint64)


def _passes(spark: SparkSession, level: Level):
    shared = spark.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def passes(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(shared.value.passes(h1.to_numpy(), h2.to_numpy()))

    return passes


def build_cascade(spark: SparkSession, listed: DataFrame, universe: DataFrame, first_rate: float = 0.01, rate: float = 0.5) -> Cascade | None:
    """Cascade of the column ``key`` of ``listed`` over that of ``universe``; None beyond MAX_BITS.

    Null keys are not keys. The key tables are stored once as hash pairs; each
    level reads what the level before let through.
    """
    pair = lambda df: df.filter("key IS NOT NULL").select("key").distinct().select(*[h.alias(n) for h, n in zip(key_hashes(F.col("key")), ("h1", "h2"), strict=True)])
    inside = materialize(pair(listed), "listed")
    outside = materialize(pair(universe).join(inside, ["h1", "h2"], "left_anti"), "unlisted")
    levels: list[Level] = []
    encode, against, n = inside, outside, inside.count()
    while n:
        level = Level(len(levels), n, rate if levels else first_rate)
        if sum(x.m for x in levels) + level.m > MAX_BITS:
            return None
        _encode(encode, level)
        levels.append(level)
        wrong = materialize(against.filter(_passes(spark, level)("h1", "h2")), "passed")
        encode, against, n = wrong, encode, wrong.count()
    return Cascade(levels)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every rule that could fit: the host and its parents with the path cut to each rule length, longest first."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    keys = F.flatten(F.transform(parents, lambda h: F.transform(F.filter(cuts, lambda p: p.isNotNull()), lambda p: F.concat(h, p))))
    ranked = F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))
    return F.transform(F.array_sort(ranked), lambda x: x.k)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict; one row per input row.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host
    and all subdomains if the url's path starts with the rule's path; the
    longest fitting rule wins, and ``default`` holds where none fits. Allowed
    and blocked rules are two cascades over all candidate keys of the pages; a
    rule listed in both counts as block. Null urls, urls without ``://`` and
    empty hosts have no candidates but the empty host's and fall to the
    default. Repeated rows are kept; no rules: default for all.
    """
    spark = pages.sparkSession
    listed = rules.select(F.concat("host", "path").alias("key"), F.length("path").alias("n"), F.col("verdict").alias("v")).filter("key IS NOT NULL")
    lengths = sorted(r["n"] for r in listed.select("n").distinct().collect())
    host, path = url_parts(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not lengths:
        return parsed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = parsed.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = materialize(keyed.select(F.explode("keys").alias("key")).distinct(), "universe")
    flagged = keyed
    for verdict in ("block", "allow"):
        mine = listed.filter(F.col("v") == verdict).select("key")
        cascade = build_cascade(spark, mine, universe)
        flagged = _flag(flagged, cascade, mine, universe, verdict)
    first = F.filter(
        F.arrays_zip(F.col("keys").alias("k"), F.col("block").alias("b"), F.col("allow").alias("a")), lambda x: x.b | x.a
    )
    best = F.get(first, F.lit(0))
    return flagged.select(
        "page_id", "host", "path", best.k.alias("rule"),
        F.when(best.b, "block").when(best.a, "allow").otherwise(default).alias("verdict"),
    )


def _flag(pages: DataFrame, cascade: Cascade | None, listed: DataFrame, universe: DataFrame, name: str) -> DataFrame:
    """Adds array<boolean> ``name``: which of the row's keys are listed."""
    if cascade is None:
        hit = universe.join(listed.distinct(), "key", "left_semi")
        row = pages.withColumn("_row", F.monotonically_increasing_id())
        row = materialize(row, "rows")
        found = row.select("_row", F.explode("keys").alias("key")).join(hit, "key").groupBy("_row").agg(F.collect_set("key").alias("_hit"))
        out = row.join(found, "_row", "left")
        return out.withColumn(name, F.transform("keys", lambda k: F.coalesce(F.array_contains("_hit", k), F.lit(False)))).drop("_row", "_hit")
    shared = pages.sparkSession.sparkContext.broadcast(cascade)

    @F.pandas_udf("array<boolean>")
    def contains(h1: pd.Series, h2: pd.Series) -> pd.Series:
        sizes = np.fromiter((len(x) for x in h1), dtype=np.int64, count=len(h1))
        if not sizes.sum():
            return pd.Series([[] for _ in sizes], dtype=object)
        flat = shared.value.contains(np.concatenate(h1.to_list()).astype(np.int64), np.concatenate(h2.to_list()).astype(np.int64))
        return pd.Series(np.split(flat, np.cumsum(sizes)[:-1]))

    first, second = F.transform("keys", lambda k: key_hashes(k)[0]), F.transform("keys", lambda k: key_hashes(k)[1])
    return pages.withColumn(name, contains(first, second))
