"""Ranked lexical search: document FP-trees and depth-first branch and bound per item.

Documents are restricted to the terms that the items hold. In each task the
restricted term vectors of a chunk of documents, in order of falling document
frequency, form an FP-tree: vectors with a common beginning share a path. Every
subtree carries the largest tf of each term and the smallest length norm ``m``
of its documents; a term's share rises with tf and falls with ``m``, so both
together bound every score below the node. An item's search walks the tree
depth first, best bound first, and skips subtrees that cannot reach the item's
k-th best score so far, which it carries from chunk to chunk of its task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.functions.ranking import top_per_group
from corpusloom.session import materialize

# fixed values: letters that are folded; digits, a-z and every byte of a non-ASCII character are kept, the rest separates
FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
#: Distinct terms of one block of items (broadcast, one scan of the documents each) and of one group of items (one tree each).
BLOCK_TERMS, GROUP_TERMS = 1 << 18, 1 << 13
#: Documents and term entries of one tree; documents of one leaf page; terms of a path that the tree branches on.
CHUNK_DOCS, CHUNK_ENTRIES, PAGE, DEPTH = 8192, 1 << 21, 32, 48


def terms_of(text: bytes | None) -> list[bytes]:
    """All terms of a UTF-8 text in order, A-Z lower-cased; null has none."""
    return text.translate(FOLD).split() if text else []


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, item_key, terms (distinct): one row per distinct id and text, those without terms left out."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t))) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "item_key", "terms"]
            )

    one = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").distinct()
    keyed = one.select("item_id", F.sha2(F.to_json(F.struct("item_id", "text")), 256).alias("item_key"), "text")
    schema = T.StructType([keyed.schema["item_id"], keyed.schema["item_key"], T.StructField("terms", T.ArrayType(T.BinaryType()))])
    return keyed.mapInArrow(split, schema).filter(F.size("terms") > 0)


def _blocks(items: DataFrame) -> int:
    """Number of hash blocks of items so that none holds more than BLOCK_TERMS terms, but for single larger items."""
    total = items.agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("t")).first()
    blocks = max(1, -(-(total["t"] or 0) // BLOCK_TERMS))
    while blocks > 1:
        part = F.pmod(F.xxhash64("item_key"), F.lit(blocks)).alias("b")
        crowded = items.groupBy(part).agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("t")).filter((F.col("t") > BLOCK_TERMS) & (F.col("n") > 1))
        if not crowded.take(1):
            break
        blocks *= 2
    return blocks


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, terms, tfs: every document's length and its entries of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most BLOCK_TERMS terms

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lengths, terms, tfs = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = terms_of(text)
                counts = Counter(words)
                held = known.keys() & counts.keys()
                lengths.append(len(words))
                terms.append([known[t] for t in held])
                tfs.append([counts[t] for t in held])
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType())),
    ])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(restrict, schema)


class Best:
    """The k best documents of one item so far; ``floor`` is the least score that can still enter."""

    def __init__(self, k: int):
        self.k, self.floor, self.rows = k, 1, []

    def offer(self, rows: Iterable[tuple]) -> None:
        self.rows.extend(rows)
        if len(self.rows) >= self.k:
            self.rows.sort(key=lambda r: (-r[0], r[1] is not None, r[1] if r[1] is not None else 0))
            del self.rows[self.k :]
            self.floor = max(1, self.rows[-1][0])


class Tree:
    """FP-tree of one chunk: nodes as ranges of documents in path order, with subtree maxima of tf and minima of m.

    ``docs``, ``terms``, ``tfs`` hold one entry per (document, term), grouped by
    document; a smaller term number is a more frequent term.
    """

    def __init__(self, docs: np.ndarray, terms: np.ndarray, tfs: np.ndarray, norms: np.ndarray, n_terms: int):
        order = np.lexsort((terms, docs))
        docs, terms, tfs = docs[order], terms[order], tfs[order]
        held, row = np.unique(docs, return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(held)))])
        place = np.arange(len(terms)) - starts[row]
        path = np.zeros((len(held), DEPTH), np.int32)
        top = place < DEPTH
        path[row[top], place[top]] = terms[top] + 1
        by_path = np.lexsort(path.T[::-1])
        # entries in path order
        sizes = np.diff(starts)[by_path]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        entry = np.repeat(starts[by_path] - self.starts[:-1], sizes) + np.arange(len(terms))
        self.terms, tfs = terms[entry], tfs[entry].astype(np.int64)
        self.docs = held[by_path]
        norms = norms[self.docs]
        self.shares = 1_000_000_000 * tfs // (1000 * tfs + 20 * np.repeat(norms, sizes))
        self._branch(path[by_path])
        # maxima and minima: leaf pages first, then every parent from its children
        best = np.zeros((len(self.ranges), n_terms), np.int64)
        least = np.full(len(self.ranges), np.iinfo(np.int64).max)
        for at in range(len(self.ranges) - 1, -1, -1):
            lo, hi = self.ranges[at]
            if self.children[at]:
                best[at] = best[self.children[at]].max(0)
                least[at] = least[self.children[at]].min()
            else:
                part = slice(self.starts[lo], self.starts[hi])
                np.maximum.at(best[at], self.terms[part], tfs[part])
                least[at] = norms[lo:hi].min()
        # whole numbers far below 2^53, so that products of doubles are exact
        self.bounds = (1_000_000_000 * best // (1000 * best + 20 * least[:, None])).astype(np.float64)

    def _branch(self, path: np.ndarray) -> None:
        same = path[1:] == path[:-1]
        shared = np.where(same.all(1), DEPTH, same.argmin(1)) if len(path) > 1 else np.zeros(0, np.int64)
        self.ranges: list[tuple[int, int]] = [(0, len(path))]
        self.children: list[list[int]] = [[]]
        at = 0
        while at < len(self.ranges):  # breadth first, so that children come after their parent
            lo, hi = self.ranges[at]
            inside = shared[lo : hi - 1]
            depth = int(inside.min()) if hi - lo > PAGE else DEPTH
            if depth < DEPTH:
                begin = lo
                cuts = [*(lo + 1 + np.flatnonzero(inside == depth)).tolist(), hi]
                for k, cut in enumerate(cuts):  # small siblings next to each other share a page
                    if k + 1 == len(cuts) or cuts[k + 1] - begin > PAGE:
                        self.children[at].append(len(self.ranges))
                        self.ranges.append((begin, cut))
                        self.children.append([])
                        begin = cut
            at += 1

    def search(self, bounds: list[float], weights: np.ndarray, ids: list, best: Best) -> None:
        """Offer ``best`` every document that can still enter it, depth first from the root."""
        stack = [0]
        while stack:
            at = stack.pop()
            if bounds[at] < best.floor:
                continue
            below = self.children[at]
            if below:
                stack.extend(sorted(below, key=bounds.__getitem__))
                continue
            lo, hi = self.ranges[at]
            part = slice(self.starts[lo], self.starts[hi])
            scores = np.add.reduceat(weights[self.terms[part]] * self.shares[part], self.starts[lo:hi] - self.starts[lo])
            good = np.flatnonzero(scores >= best.floor)
            best.offer(zip(scores[good].tolist(), [ids[d] for d in self.docs[lo + good]], strict=True))


@dataclass
class Group:
    """Items that share one tree: the number of each vocabulary term by falling frequency; index, numbers and weights of every item."""

    numbers: np.ndarray
    n_terms: int
    items: list[tuple[int, np.ndarray, np.ndarray]]


def _groups(items: list[np.ndarray], df: np.ndarray, n_docs: int) -> Iterator[Group]:
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    rank = np.lexsort((np.arange(len(df)), -df)).argsort()
    for chosen in _packed(items):
        held = np.unique(np.concatenate([items[i] for i in chosen]))
        held = held[np.argsort(rank[held])]
        numbers = np.full(len(df), -1, np.int32)
        numbers[held] = np.arange(len(held))
        yield Group(numbers, len(held), [(i, numbers[items[i]], weights[items[i]]) for i in chosen])


def _packed(items: list[np.ndarray]) -> Iterator[list[int]]:
    chosen, count = [], 0
    for i, terms in enumerate(items):
        if chosen and count + len(terms) > GROUP_TERMS:
            yield chosen
            chosen, count = [], 0
        chosen.append(i)
        count += len(terms)
    if chosen:
        yield chosen


def _search_chunk(ids: list, n: np.ndarray, docs, terms, tfs, groups: list[Group], best: list[Best], n_docs: int, n_words: int) -> None:
    norms = 100 - 50 + 50 * n * n_docs // n_words
    for group in groups:
        numbers = group.numbers[terms]
        inside = numbers >= 0
        if not inside.any():
            continue
        tree = Tree(docs[inside], numbers[inside], tfs[inside], norms, group.n_terms)
        weights = np.zeros((len(group.items), group.n_terms), np.int64)
        for row, (_, held, given) in zip(weights, group.items, strict=True):
            row[held] = given
        bounds = weights.astype(np.float64) @ tree.bounds.T
        for row, bound, (item, _, _) in zip(weights, bounds, group.items, strict=True):
            tree.search(bound.tolist(), row, ids, best[item])


def _candidates(vectors: DataFrame, items: list, vocabulary: dict[bytes, int], df: np.ndarray, n_docs: int, n_words: int, k: int, item_type) -> DataFrame:
    """item_id, item_key, doc_id, score: each task's k best documents of every item."""
    numbered = [np.array([vocabulary[bytes(t)] for t in r["terms"]], np.int64) for r in items]
    labels = [(r["item_id"], r["item_key"]) for r in items]
    groups = vectors.sparkSession.sparkContext.broadcast((labels, list(_groups(numbered, df, n_docs))))
    doc_type = vectors.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("item_id", item_type), T.StructField("item_key", T.StringType()), T.StructField("doc_id", doc_type), T.StructField("score", T.LongType()),
    ])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, docs, entries = [], 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # a batch is cut where a chunk is full
                part = batch.slice(at, max(1, CHUNK_DOCS - docs))
                held.append(part)
                at, docs, entries = at + part.num_rows, docs + part.num_rows, entries + len(part.column(2).flatten())
                if docs >= CHUNK_DOCS or entries >= CHUNK_ENTRIES:
                    yield pa.Table.from_batches(held)
                    held, docs, entries = [], 0, 0
        if held:
            yield pa.Table.from_batches(held)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, mine = groups.value
        best = [Best(k) for _ in labels]
        for chunk in chunks(batches):
            terms, tfs = chunk.column("terms").combine_chunks(), chunk.column("tfs").combine_chunks()
            sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (terms, tfs)]
            docs = np.repeat(np.arange(chunk.num_rows), sizes)
            _search_chunk(chunk.column("doc_id").to_pylist(), chunk.column("n").to_numpy(), docs, *flat, mine, best, n_docs, n_words)
        for label, found in zip(labels, best, strict=True):
            if found.rows:
                rows = [{"item_id": label[0], "item_key": label[1], "doc_id": d, "score": s} for s, d in found.rows]
                yield pa.RecordBatch.from_pylist(rows, arrow_schema)

    arrow_schema = to_arrow_schema(schema)
    return vectors.filter(F.size("terms") > 0).mapInArrow(search, schema)


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring documents of every item, whole texts on both sides.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))), its share of a document
    (1000000000 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L; an item's
    terms count once each. Only scores above 0 are returned; equal scores rank
    by the smaller ``doc_id``, null first. Null and empty texts have no terms:
    such items have no rows, such documents do not count in N. Every row of
    ``docs`` is a document of its own; repeated rows of ``items`` are one item,
    rows of one id with other texts are searched apart. Other columns are left
    alone.

    The documents are read once per block of items (2^18 terms); a task then
    holds one tree at a time and sends ``k`` rows an item.
    """
    wanted = materialize(_item_terms(items, item_id, item_text), "items")
    blocks = _blocks(wanted)
    found = size = None
    for block in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item_key"), F.lit(blocks)) == block).collect()  # at most BLOCK_TERMS terms
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
        vectors = materialize(_vectors(docs, vocabulary, id_col, text_col), "vectors")
        size = size or vectors.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row per term of the block
            df[r["t"]] = r["count"]
        part = _candidates(vectors, rows, vocabulary, df, size["docs"], size["words"] or 1, k, wanted.schema["item_id"].dataType)
        found = part if found is None else found.unionAll(part)
    ranked = top_per_group(found, ["item_key"], [F.col("score").desc(), F.col("doc_id").asc_nulls_first()], k, salt_on=["doc_id"])
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
