"""BM25 over a whole table of chunks and a whole table of queries.

k1/b are the usual published values; idf is ln(1 + (N - df + .5)/(df + .5)).

The postings are stored bucketed by chunk. A search then joins the (small)
query terms to them where they lie, sums per (query, chunk) without a shuffle
and sends on only each task's k best per query. A hot term is spread over all
buckets with its chunks.

A table of many query terms would make a row of each (query, posting). It is
broadcast in counted blocks instead, and one scan over the chunks' bags sums
each block's scores in arrays of bounded size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.ranking import bucket_salt, top_per_group, whole_buckets
from corpusloom.operators.dense import SCORES, _least
from corpusloom.session import input_bytes, materialize, scratch_path

K1, B = 1.2, 0.75
DIGITS = 6
SLACK = 1e-5  # keeps documents that tie after rounding
BUCKET_BYTES = 8 << 20  # a task holds a score for each (query, chunk) of its bucket
PUSHED_TERMS = 1000  # query terms that are joined to the postings; their distinct ones are handed to the scan as a filter
BLOCK_TERMS = 1 << 19  # (query, term) rows of a broadcast block
BLOCK_HITS = 1 << 21  # hits that a task holds for a block
CHUNKS = 2048  # chunks that are scored at once
PAIRS = 1 << 20  # (query, posting) pairs that are summed at once
SEED_POSTINGS = 100  # postings per wanted hit that are read to find a floor


@dataclass(frozen=True)
class Bm25Index:
    postings: DataFrame  # term, chunk_id, tf, len - bucketed by chunk_id, ordered by term in a bucket
    terms: DataFrame  # term, df, max_impact
    n_chunks: int
    avg_len: float
    table: str
    bags: DataFrame | None = None  # chunk_id, bag: array<struct<term, tf, len>> - one row a chunk

    def drop(self) -> None:
        self.postings.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")


def impact(tf: Column, length: Column, avg_len: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(float(avg_len or 1.0))))


def bags(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """chunk_id, len, bag: each text tokenised once, terms counted inside the row."""
    toks = chunks.select(F.col(id_col).alias("chunk_id"), T.tokens(F.col(text_col)).alias("_t"))
    return toks.select("chunk_id", F.size("_t").alias("len"), T.term_counts(F.col("_t")).alias("bag"))


def build_bm25_index(
    chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", buckets: int | None = None
) -> Bm25Index:
    """Write the bucketed postings in one pass over the texts, then the term table and the bags (no exchange).

    Corpus totals are observed while the postings are written.
    """
    spark = chunks.sparkSession
    if buckets is None:
        buckets = whole_buckets(spark, -(-input_bytes(chunks) // BUCKET_BYTES))
    seen = Observation()
    counted = bags(chunks, id_col, text_col).observe(
        seen, F.count(F.lit(1)).alias("n"), F.sum("len").alias("tokens")
    )
    rows = counted.select("chunk_id", "len", F.inline("bag")).select("term", "chunk_id", "tf", "len")
    table = f"corpusloom_postings_{uuid.uuid4().hex}"
    writer = rows.repartition(buckets, "chunk_id").write.bucketBy(buckets, "chunk_id").sortBy("term").format("parquet")
    writer = writer.option("parquet.bloom.filter.enabled#term", "true")
    writer.option("path", scratch_path(spark, "bm25-postings")).saveAsTable(table)
    n, tokens = int(seen.get["n"]), int(seen.get["tokens"] or 0)
    avg_len = tokens / n if n else 0.0
    postings = spark.table(table)
    stats = postings.groupBy("term").agg(
        F.count("*").alias("df"), F.max(impact(F.col("tf"), F.col("len"), avg_len)).alias("max_impact")
    )
    by_chunk = postings.groupBy("chunk_id").agg(F.collect_list(F.struct("term", "tf", "len")).alias("bag"))
    return Bm25Index(postings, materialize(stats, "bm25-terms"), n, avg_len, table, materialize(by_chunk, "bm25-bags"))


def weighted_terms(index: Bm25Index, queries: DataFrame, text_col: str = "text") -> DataFrame:
    """query_id, term, df, weight (qtf x idf) and bound (largest possible share of a score)."""
    n = F.lit(float(index.n_chunks))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    counted = queries.select("query_id", F.inline(T.term_counts(T.tokens(F.col(text_col)))))
    return (
        counted.withColumnRenamed("tf", "qtf")
        .join(index.terms, "term")
        .withColumn("weight", F.col("qtf") * idf)
        .withColumn("bound", F.col("weight") * F.col("max_impact"))
        .select("query_id", "term", "df", "weight", "bound")
    )


def _sum_shares(index: Bm25Index, joined: DataFrame, out: str) -> DataFrame:
    share = F.col("weight") * impact(F.col("tf"), F.col("len"), index.avg_len)
    return joined.groupBy("query_id", "chunk_id").agg(F.sum(share).alias(out))


def _score(index: Bm25Index, terms: DataFrame, out: str = "score") -> DataFrame:
    """Scores of every (query, chunk) that shares one of ``terms``.

    Few distinct terms are named to the scan, which then reads only the pages
    of its ordered files that can hold them; the result is the same without.
    """
    named = [r["term"] for r in terms.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    postings = index.postings.filter(F.col("term").isin(named)) if len(named) <= PUSHED_TERMS else index.postings
    return _sum_shares(index, postings.join(terms.select("query_id", "term", "weight"), "term"), out)


def _complete(index: Bm25Index, pairs: DataFrame, terms: DataFrame, out: str) -> DataFrame:
    """Scores of given (query, chunk) pairs over ``terms``: only those postings are looked up."""
    wanted = pairs.select("query_id", "chunk_id").join(terms.select("query_id", "term", "weight"), "query_id")
    return _sum_shares(index, wanted.join(index.postings, ["chunk_id", "term"]), out)


def bm25_search(
    index: Bm25Index, queries: DataFrame, k: int = 20, text_col: str = "text", prune: bool = False
) -> DataFrame:
    """query_id, chunk_id, score, rank: the exact top ``k`` per query.

    All (posting, query) pairs are summed in one pass: few query terms are
    joined to the postings, more go to the bags (``_scan``). ``prune`` asks for the
    form that finds the same result with fewer pairs, see ``_pruned``: it pays
    for query tables whose hot terms would pair with most chunks.
    """
    terms = materialize(weighted_terms(index, queries, text_col), "bm25-query")
    if not prune and index.bags is not None:
        n = terms.count()
        if n > PUSHED_TERMS:
            return top_per_group(_scan(index, terms, k, n), ["query_id"], [F.desc("score"), F.asc("chunk_id")], k, salt_on=["chunk_id"])
    scored = _pruned(index, terms, k) if prune else _score(index, terms)
    rounded = scored.withColumn("score", F.round("score", DIGITS))
    return top_per_group(rounded, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k, salt_on=bucket_salt("chunk_id"))


@dataclass(frozen=True)
class QueryBlock:
    """The terms of some queries, sorted by query, with the terms as codes."""

    queries: pa.Array
    starts: np.ndarray  # of each query's terms, and the end of the last
    codes: np.ndarray
    weights: np.ndarray
    words: list[str]


def _query_block(terms: DataFrame) -> QueryBlock:
    rows = terms.select("query_id", "term", "weight").toArrow().sort_by("query_id").combine_chunks()
    ids = rows["query_id"].to_numpy()
    codes, words = pd.factorize(rows["term"].to_numpy())
    opens = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, dtype=np.int64)
    queries = pa.array(ids[opens], rows["query_id"].type)
    return QueryBlock(queries, np.append(opens, len(ids)), codes, rows["weight"].to_numpy(), list(words))


def _slices(block: QueryBlock, pairs: np.ndarray, chunks: int) -> Iterator[tuple[int, int]]:
    """Ranges of queries with at most PAIRS pairs (or one query) and SCORES scores."""
    ends, most, at = np.append(0, np.cumsum(pairs))[block.starts], max(1, SCORES // chunks), 0
    while at < len(block.queries):
        to = int(np.searchsorted(ends, ends[at] + PAIRS, side="right")) - 1
        to = min(max(to, at + 1), at + most, len(block.queries))
        yield at, to
        at = to


def _best_of_chunks(block: QueryBlock, owner: np.ndarray, codes: np.ndarray, impacts: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray) -> pd.DataFrame:
    """row (of the query), chunk_id, score: each query's best ``k`` of these chunks; ties go to the smaller id.

    ``owner``, ``codes`` and ``impacts`` are the postings. Chunks without a term
    of the query are no hits; scores below its floor may be left out.
    """
    order = np.argsort(codes, kind="stable")
    owner, impacts = owner[order], impacts[order]
    held = np.bincount(codes, minlength=len(block.words))
    first = np.cumsum(held) - held
    pairs = held[block.codes]
    parts = []
    for lo, hi in _slices(block, pairs, len(ids)):
        at, to = block.starts[lo], block.starts[hi]
        n = pairs[at:to]
        place = np.arange(n.sum()) + np.repeat(first[block.codes[at:to]] - np.cumsum(n) + n, n)
        row = np.repeat(np.arange(hi - lo), np.diff(block.starts[lo : hi + 1]))
        share = np.repeat(block.weights[at:to], n) * impacts[place]
        scores = np.bincount(np.repeat(row * len(ids), n) + owner[place], share, (hi - lo) * len(ids)).reshape(hi - lo, len(ids))
        least = floors[lo:hi]
        if len(ids) > k:
            least = np.maximum(least, _least(scores, k))
        rows, cols = np.nonzero((scores >= least[:, None] - 2 * 10.0**-DIGITS) & (scores > 0))
        rounded = np.floor(scores[rows, cols] * 10.0**DIGITS + 0.5) / 10.0**DIGITS
        parts.append(_best_rows(pd.DataFrame({"row": rows + lo, "chunk_id": ids[cols], "score": rounded}), k))
    return pd.concat(parts)


def _best_rows(found: pd.DataFrame, k: int) -> pd.DataFrame:
    found = found.sort_values(["row", "score", "chunk_id"], ascending=[True, False, True], kind="stable")
    return found[found.groupby("row").cumcount() < k]


def _scan(index: Bm25Index, terms: DataFrame, k: int, n: int) -> DataFrame:
    """Each task's best ``k`` chunks per query, rounded: one scan over the bags for each block of query terms."""
    n_queries = terms.select("query_id").distinct().count()
    parts = max(-(-n // BLOCK_TERMS), -(-n_queries * k // BLOCK_HITS))
    tagged = terms.withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    hits = None
    for part in range(parts):
        found = _scan_block(index, tagged.filter(F.col("_part") == part), k)
        found = materialize(found, "bm25-hits") if parts > 1 else found
        hits = found if hits is None else hits.unionByName(found)
    return hits


def _scan_block(index: Bm25Index, terms: DataFrame, k: int) -> DataFrame:
    shared, avg_len = index.bags.sparkSession.sparkContext.broadcast(_query_block(terms)), float(index.avg_len or 1.0)
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((terms, "query_id"), (index.bags, "chunk_id"))]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = shared.value, None
        floors = np.full(len(block.queries), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNKS):
                part = batch.slice(at, CHUNKS)
                bags = part.column(1)
                rows = bags.flatten()
                words = pa.array(block.words, rows.field("term").type)
                codes = pc.fill_null(pc.index_in(rows.field("term"), value_set=words), -1).to_numpy(zero_copy_only=False)
                known = codes >= 0
                if not known.any():
                    continue
                owner = np.repeat(np.arange(len(bags)), pc.list_value_length(bags).to_numpy(zero_copy_only=False))
                tf, size = (rows.field(c).to_numpy(zero_copy_only=False)[known].astype(np.float64) for c in ("tf", "len"))
                impacts = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / avg_len))
                ids = part.column(0).to_numpy(zero_copy_only=False)
                found = _best_of_chunks(block, owner[known], codes[known], impacts, ids, k, floors)
                best = found if best is None else _best_rows(pd.concat([best, found]), k)
                full = best[best.groupby("row").cumcount() == k - 1]
                floors[full["row"].to_numpy()] = full["score"].to_numpy()
        if best is not None and len(best):
            columns = [block.queries.take(pa.array(best["row"])), pa.array(best["chunk_id"], batch.column(0).type), pa.array(best["score"])]
            yield pa.record_batch(columns, ["query_id", "chunk_id", "score"])

    return index.bags.select("chunk_id", "bag").mapInArrow(search, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")


def _pruned(index: Bm25Index, terms: DataFrame, k: int) -> DataFrame:
    """Candidates that can reach the top ``k``, fully scored (the MaxScore bound).

    1. The rarest terms of each query name some chunks; the full scores of the
       best of them give a floor under the final k-th score.
    2. Terms whose joint upper bound stays below the floor cannot lift a chunk
       into the result by themselves: only the other terms' postings are joined.
    3. Pairs that can still reach the floor get the remaining terms looked up.
    """
    rare_first = Window.partitionBy("query_id").orderBy("df", "term")
    before = F.sum("df").over(rare_first.rowsBetween(Window.unboundedPreceding, -1))
    seeds = terms.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < k * SEED_POSTINGS)
    best = top_per_group(_score(index, seeds), ["query_id"], [F.desc("score"), F.asc("chunk_id")], 2 * k)
    sure = top_per_group(_complete(index, best, terms, "score"), ["query_id"], [F.desc("score")], k)
    floor = sure.groupBy("query_id").agg(
        F.when(F.count("*") == k, F.min("score")).otherwise(0.0).alias("floor")
    )
    weak_first = Window.partitionBy("query_id").orderBy("bound", "term")
    judged = materialize(
        terms.join(floor, "query_id").withColumn("weak", F.sum("bound").over(weak_first) < F.col("floor") - SLACK),
        "bm25-judged",
    )
    weak = judged.filter("weak")
    limits = judged.groupBy("query_id").agg(
        F.first("floor").alias("floor"),
        F.sum(F.when(F.col("weak"), F.col("bound")).otherwise(0.0)).alias("rest_bound"),
    )
    strong = (
        _score(index, judged.filter("not weak"), "part")
        .join(limits, "query_id")
        .filter(F.col("part") + F.col("rest_bound") >= F.col("floor") - SLACK)
        .select("query_id", "chunk_id", "part")
    )
    candidates = materialize(strong, "bm25-candidates")
    rest = _complete(index, candidates, weak, "rest")
    return candidates.join(rest, ["query_id", "chunk_id"], "left").select(
        "query_id", "chunk_id", (F.col("part") + F.coalesce("rest", F.lit(0.0))).alias("score")
    )
