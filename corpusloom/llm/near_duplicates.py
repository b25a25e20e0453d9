"""Near-duplicate documents by a chosen-path set similarity join.

A document's set of word shingles is sketched by minwise hashes. In each of
several independent trees a node picks one or two of the sketch's places (1.25
on average, the inverse of the similarity sought) and a document goes to the
child named by its minwise token there; two documents with a similarity of 0.8
so keep about one common child per level. Nodes of few documents are compared
exhaustively and branch no further; the others branch again. Trees are grown
level by level: which child a document takes is computed where its sketch lies,
only the sizes of nodes are aggregated.

Large nodes whose documents agree nearly everywhere leave the trees. Their
documents meet several pivots first; what is then connected needs no further
comparison, and the rest meets the whole node in blocks. All candidates are
confirmed on full sets, nearest first: pairs that confirmed links connect
already change no component and are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.components import connected_components
from corpusloom.llm.hash_filter import bloom_of, mix
from corpusloom.llm.workers import lean
from corpusloom.session import materialize

SKETCH = 64
#: Sketch bits (of 64) in which a pair of the sought similarity may differ: mean 6.4, deviation 2.4.
MAX_DIFFERING = 17
#: Sketch tokens (of 64) that a pair of the sought similarity shares at least: mean 51, deviation 3.2.
MIN_TOKENS = 37
#: Bits of the filter of candidates, at most.
FILTER_BITS = 1 << 28
#: Documents that one task holds of a group, or of each side of a dense node.
BLOCK = 512
PIECE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SALT = np.random.default_rng(20).integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class JoinSettings:
    words: int = 5
    percent: int = 80
    trees: int = 12
    levels: int = 6
    leaf: int = 24
    pivots: int = 4


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of every word (maximal run without ASCII white space, A-Z lower-cased) of the whole text.

    Every byte is mixed with its place in the word before the sum is taken: a
    polynomial modulo 2^64 would be the same for words that any base confuses.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    found, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        part = _LOWER[raw[at:end]]
        at = end
        letter = ~_SPACE[part]
        edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            continue
        lengths = ends - starts
        first = np.cumsum(lengths) - lengths
        place = np.arange(lengths.sum()) - np.repeat(first, lengths)
        with np.errstate(over="ignore"):
            value = np.add.reduceat(mix((place.astype(np.uint64) << np.uint64(8)) + part[letter]), first)
            found.append(mix(value + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text with words is one shingle, no words none."""
    hashes = word_hashes(text) if text else np.zeros(0, dtype=np.uint64)
    if not len(hashes):
        return hashes
    n = min(words, len(hashes))
    with np.errstate(over="ignore"):
        folded = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            folded = mix(folded * np.uint64(0x2545F4914F6CDD1D) + hashes[j : len(hashes) - n + 1 + j])
    return np.unique(folded)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Minwise tokens: the upper halves of the smallest salted hashes."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 512):
            np.minimum(least, (shingles[at : at + 512, None] * _SALT).min(axis=0), out=least)
    return (mix(least) >> np.uint64(32)).astype(np.uint32)


def _sketches(words: int):
    @lean
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "k1", "k2", "bits", "sketch"]
        weights = np.uint64(1) << np.arange(SKETCH, dtype=np.uint64)
        for batch in batches:
            n, k1, k2, bits, tokens = [], [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words)
                n.append(len(s))
                with np.errstate(over="ignore"):
                    k1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    k2.append(int(np.bitwise_xor.reduce(mix(s)).view(np.int64)) if len(s) else 0)
                t = sketch(s)
                bits.append(int((weights[(t & np.uint32(1)).astype(bool)].sum(dtype=np.uint64)).view(np.int64)))
                tokens.append(t.tobytes() if len(s) else None)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bits, pa.int64()), pa.array(tokens, pa.binary())]
            yield pa.record_batch(columns, names)

    return build


def _branch(nodes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of the children that the rows (node, sketch) take: one place, or two for every fourth node."""
    rows, children = [], []
    seed = mix(nodes ^ np.uint64(0xA0761D6478BD642F))
    for j in range(2):
        chosen = np.flatnonzero((seed & np.uint64(3) == 0) | (j == 0))
        place = (mix(seed[chosen] + np.uint64(j + 1)) >> np.uint64(20)) % np.uint64(SKETCH)
        token = tokens[chosen, place.astype(np.int64)].astype(np.uint64)
        with np.errstate(over="ignore"):
            children.append(mix(mix(nodes[chosen] + place * np.uint64(0xE7037ED1A0B428DB)) ^ (token * np.uint64(0x8EBC6AF09C88C6E3))))
        rows.append(chosen)
    return np.concatenate(rows), np.concatenate(children)


def _grow(names: list[str], trees: int = 0):
    """mapInArrow over (rep, bits, sketch[, node]): the children of the node, or of all roots."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, bits, packed = batch.column(0), batch.column(1), batch.column(2)
            tokens = np.frombuffer(b"".join(packed.to_pylist()), dtype=np.uint32).reshape(-1, SKETCH)
            if trees:
                rows = np.repeat(np.arange(len(tokens)), trees)
                nodes = np.tile(mix(np.arange(1, trees + 1, dtype=np.uint64)), len(tokens))
            else:
                rows, nodes = np.arange(len(tokens)), batch.column(3).to_numpy().view(np.uint64)
            taken, child = _branch(nodes, tokens[rows])
            at = pa.array(rows[taken])
            yield pa.record_batch([pa.array(child.view(np.int64)), rep.take(at), bits.take(at)], names)

    return grow


def candidate_pairs(reps: DataFrame, how: JoinSettings) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b, d) with a < b that meet in small nodes, and the members (pivot, rep, bits) of the other ones.

    ``reps`` has rep, bits and sketch, one row per distinct set. Every pair of a
    small node whose sketch bits differ in few places is a candidate; the join
    emits only those. A larger node most of whose documents agree with its
    pivot cannot be told apart by branching and leaves the tree as it is, and so
    do those that are large after the last level. Nodes of one pivot are one.
    """
    kind = reps.schema["rep"].dataType.simpleString()
    names, schema = ["node", "rep", "bits"], f"node long, rep {kind}, bits long"
    frontier = reps.select("rep", "bits", "sketch").mapInArrow(_grow(names, how.trees), schema)
    pairs, dense = None, None
    for level in range(how.levels):
        frontier = materialize(frontier, "nodes")
        nodes = frontier.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        small = frontier.join(nodes.filter(F.col("size") <= how.leaf).select("node"), "node")
        found = materialize(_meet(small, small), "met")
        pairs = found if pairs is None else pairs.unionAll(found)
        large = materialize(frontier.join(nodes.filter(F.col("size") > how.leaf).select("node"), "node"), "large")
        if large.isEmpty():
            break
        last = level + 1 == how.levels
        pivots = large.groupBy("node").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), "rep", "bits")).alias("p"))
        led = large.join(pivots.select("node", F.col("p.rep").alias("pivot"), F.col("p.bits").alias("_p")), "node")
        near = (F.bit_count(F.col("bits").bitwiseXOR(F.col("_p"))) <= MAX_DIFFERING).cast("int")
        tight = led.groupBy("node").agg((F.avg(near) >= (0.0 if last else 0.5)).alias("tight"))
        split = materialize(led.drop("_p").join(tight, "node"), "split")
        done = split.filter("tight").select("pivot", "rep", "bits")
        dense = done if dense is None else dense.unionAll(done)
        if last:
            break
        grown = split.filter("NOT tight").select("node", "rep").join(reps.select("rep", "bits", "sketch"), "rep").select("rep", "bits", "sketch", "node")
        frontier = grown.mapInArrow(_grow(names), schema)
    if dense is not None:
        dense = materialize(dense.distinct(), "dense")
    return pairs, None if dense is None or dense.isEmpty() else dense


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs within a node whose sketch bits agree enough, once per node."""
    x = left.select("node", F.col("rep").alias("a"), F.col("bits").alias("x"))
    y = right.select(F.col("node").alias("_node"), F.col("rep").alias("b"), F.col("bits").alias("y"))
    differing = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    close = (F.col("node") == F.col("_node")) & (F.col("a") < F.col("b")) & (differing <= MAX_DIFFERING)
    return x.join(y, close).select("a", "b", differing.alias("d"))


def _pivot_pairs(dense: DataFrame, pivots: int) -> DataFrame:
    """Every member of a dense node with a few of its members (smallest hashes)."""
    order = Window.partitionBy("pivot").orderBy(F.xxhash64("rep"), "rep")
    node = dense.withColumnRenamed("pivot", "node")
    chosen = dense.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= pivots).drop("_n").withColumnRenamed("pivot", "node")
    return _meet(node, chosen).unionAll(_meet(chosen, node))


class _Merged:
    """Union-find over what a task has met."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x, y) -> None:
        self.up[self.root(x)] = self.root(y)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared)


def _confirm(pairs: DataFrame, texts: DataFrame, how: JoinSettings) -> DataFrame:
    """Pairs (a, b) with similar full sets, without those that such pairs connect already.

    Every document is dealt to its smallest candidate, so that copies of one
    text lie together and each text moves about once; documents around a hot one
    are cut into blocks. Pairs across go to a group of their own two blocks.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    near = pairs.select(F.col("b").alias("x"), F.col("a").alias("g")).unionAll(pairs.select(F.col("a").alias("x"), F.col("a").alias("g")))
    near = near.groupBy("x").agg(F.min("g").alias("g"))
    blocks = near.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    home = materialize(near.join(blocks, "g").select("x", "g", F.pmod(F.xxhash64("x"), F.col("n")).cast("int").alias("k")), "homes")
    at = lambda c: home.select(F.col("x").alias(c), F.col("g").alias(f"g{c}"), F.col("k").alias(f"k{c}"))
    key = ["ga", "gb", "ka", "kb"]
    dealt = materialize(pairs.join(at("a"), "a").join(at("b"), "b").select(*key, "a", "b", "d"), "dealt-pairs")
    asked = dealt.select(*key, F.col("a").alias("rep")).unionAll(dealt.select(*key, F.col("b").alias("rep"))).distinct()
    none = F.lit(None)
    rows = asked.join(texts, "rep").select(*key, F.lit(-1).alias("d"), F.col("rep").alias("a"), none.cast(kind).alias("b"), "text")
    rows = rows.unionAll(dealt.select(*key, F.col("d").cast("int"), "a", "b", none.cast("string").alias("text")))

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sets, merged = None, {}, _Merged()
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6)]
            for *own, a, b, text in zip(*columns, batch.column(7), strict=True):
                if own != group:
                    group, sets, merged = own, {}, _Merged()
                if b is None:
                    sets[a] = shingle_set(text.as_py(), how.words)
                elif merged.root(a) != merged.root(b) and _similar(sets[a], sets[b], how.percent):
                    merged.join(a, b)
                    out.append((a, b))
            yield pa.record_batch([pa.array([x[i] for x in out], batch.schema.field(5).type) for i in (0, 1)], ["a", "b"])

    sorted_rows = rows.repartition(*key).sortWithinPartitions(*key, "d")
    return sorted_rows.mapInArrow(compare, f"a {kind}, b {kind}")


def _dense_links(dense: DataFrame, labels: DataFrame, texts: DataFrame, how: JoinSettings) -> DataFrame | None:
    """Links between components of a dense node: members outside its main one meet all members, in blocks.

    A task holds two blocks. Sketches are compared by matrix, close ones on full
    sets, and only links that connect something new come out.
    """
    kind = dense.schema["rep"].dataType.simpleString()
    known = dense.join(labels, dense["rep"] == labels["node"], "left").select("pivot", "rep", F.coalesce("component", "rep").alias("c"))
    parts = known.groupBy("pivot", "c").agg(F.count("*").alias("n"))
    main = parts.groupBy("pivot").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    main = main.filter("parts > 1").select("pivot", F.col("m.c").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("right"), F.ceil((F.col("n") - F.col("m.n")) / BLOCK).cast("int").alias("left"))
    member = materialize(known.join(main, "pivot"), "dense-members")
    if member.isEmpty():
        return None
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    x = member.filter("c <> main").select("pivot", own("left").alias("i"), every("right").alias("j"), F.lit(0).alias("side"), "rep", "c")
    y = member.select("pivot", every("left").alias("i"), own("right").alias("j"), F.lit(1).alias("side"), "rep", "c")
    key = ["pivot", "i", "j"]
    rows = x.unionAll(y).join(texts, "rep").select(*key, "side", "rep", "c", "text")

    def met(left: list, right: list) -> list[tuple]:
        merged, out = _Merged(), []
        sketches = [np.stack([sketch(s) for _, _, s in side]) for side in (left, right)]
        for (a, ca, sa), tokens in zip(left, sketches[0], strict=True):
            same = (sketches[1] == tokens).sum(axis=1)
            for k in np.flatnonzero(same >= MIN_TOKENS)[np.argsort(-same[same >= MIN_TOKENS], kind="stable")].tolist():
                b, cb, sb = right[k]
                if a != b and merged.root(ca) != merged.root(cb) and _similar(sa, sb, how.percent):
                    merged.join(ca, cb)
                    out.append((min(a, b), max(a, b)))
        return out

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sides, rep_type = None, ([], []), None
        emit = lambda out: pa.record_batch([pa.array([x[i] for x in out], rep_type) for i in (0, 1)], ["a", "b"])
        for batch in batches:
            rep_type = batch.schema.field(4).type
            for *now, side, rep, c, text in zip(*[batch.column(i).to_pylist() for i in range(6)], batch.column(6), strict=True):
                if now != group:
                    if sides[0] and sides[1]:
                        yield emit(met(*sides))
                    group, sides = now, ([], [])
                sides[side].append((rep, c, shingle_set(text.as_py(), how.words)))
        if sides[0] and sides[1]:
            yield emit(met(*sides))

    return rows.repartition(*key).sortWithinPartitions(*key, "side").mapInArrow(compare, f"a {kind}, b {kind}")


def near_duplicate_components(docs: DataFrame, how: JoinSettings = JoinSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per input row.

    Documents with equal sets are one node of the join (their smallest id), so
    copies are never paired. A document without words, and one without an id, is
    linked with nothing and kept. Repeated rows share their id's component. An
    empty table gives an empty result. No set, pair or member is dropped: the
    trees' recall is the only thing left to chance (12 trees miss about one pair
    in ten thousand at the threshold, and fewer above it).
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = plain.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n long, k1 long, k2 long, bits long, sketch binary"
    sketched = materialize(plain.mapInArrow(_sketches(how.words), schema), "sketches")
    real = sketched.filter("n > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "bits", "sketch")).alias("r")
    grouped = materialize(real.groupBy("n", "k1", "k2").agg(first).select("n", "k1", "k2", F.col("r.doc_id").alias("rep"), "r.bits", "r.sketch"), "groups")
    groups, reps = grouped.select("n", "k1", "k2", "rep"), grouped.select("rep", "bits", "sketch")
    labels = _labels(plain, reps, how)
    known = groups.join(labels, groups["rep"] == labels["node"], "left").select("n", "k1", "k2", F.coalesce("component", "rep").alias("component"))
    rows = sketched.select("doc_id", "n", "k1", "k2")
    placed = rows.join(known, ["n", "k1", "k2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component"))
    return placed.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _labels(plain: DataFrame, reps: DataFrame, how: JoinSettings) -> DataFrame:
    pairs, dense = candidate_pairs(reps, how)
    if dense is not None:
        pairs = pairs.unionAll(_pivot_pairs(dense, how.pivots))
    pairs = materialize(pairs.groupBy("a", "b").agg(F.min("d").alias("d")), "pairs")
    ends = pairs.select(F.col("a").alias("rep")).unionAll(pairs.select(F.col("b").alias("rep")))
    if dense is not None:
        ends = ends.unionAll(dense.select("rep"))
    texts = materialize(_texts_of(plain, materialize(ends.distinct(), "ends")), "texts")
    links = materialize(_confirm(pairs, texts, how), "links")
    labels = materialize(connected_components(links), "labels")
    more = None if dense is None else _dense_links(dense, labels, texts, how)
    if more is None:
        return labels
    more = materialize(more, "links")
    return labels if more.isEmpty() else materialize(connected_components(links.unionAll(more)), "labels")


def _texts_of(plain: DataFrame, ends: DataFrame) -> DataFrame:
    """rep, text of the documents in ``ends``; a filter keeps most other texts from being moved to the join."""
    held = plain.sparkSession.sparkContext.broadcast(bloom_of(ends.select(F.xxhash64("rep").alias("hash")), FILTER_BITS))

    @F.pandas_udf("boolean")
    def may_hold(hashes: pd.Series) -> pd.Series:
        return pd.Series(held.value.may_hold(hashes.to_numpy().view(np.uint64)))

    asked = plain.select(F.col("doc_id").alias("rep"), "text").filter(F.col("rep").isNotNull())
    return asked.filter(may_hold(F.xxhash64("rep"))).join(ends, "rep", "left_semi")


def keep_one_per_group(docs: DataFrame, how: JoinSettings = JoinSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose document stands for its group, all columns; of rows with one id and words one stays."""
    found = near_duplicate_components(docs, how, id_col, text_col).filter("kept")
    ids = found.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept")).distinct()
    stay = docs.join(ids, docs[id_col] == F.col("_kept"), "left_semi")
    if not docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").isEmpty():
        stay = stay.dropDuplicates([id_col])
    return stay.unionAll(docs.filter(F.col(id_col).isNull()))
