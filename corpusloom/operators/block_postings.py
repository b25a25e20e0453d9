"""BM25 over postings in blocks with the largest impact of each: exact top-k that reads hot terms in part.

Chunks are dealt into small tiles by their hash; a block holds one term's
postings in one tile. Blocks are stored in buckets of tiles, so a hot
term is spread over all of them, and bounds and scores are summed where the
blocks lie. A search first adds up, per query and tile,
the largest shares its terms can have there (block heads only, the postings
are not read). The tiles with the highest bounds are scored and give each query
a floor; of all other tiles only those are scored whose bound reaches it. The
(query, tile) rows with the query's terms move to the blocks, never the blocks
to them, whatever the size of the query table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.ranking import bucket_salt, top_per_group, whole_buckets
from corpusloom.operators.sparse import DIGITS, SLACK, Bm25Index, bags, impact, weighted_terms
from corpusloom.session import materialize, scratch_path

#: Chunks in a tile, on average; a block has at most as many postings as its tile has chunks.
TILE_ROWS = 128
#: Tiles that are scored to find a query's floor.
SEED_TILES = 8
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: Postings in a bucket; its task holds a score for each (query, chunk) that it scores.
BUCKET_POSTINGS = 1 << 20


@dataclass(frozen=True)
class BlockIndex:
    blocks: DataFrame  # tile, term, max_impact, postings: array<struct<chunk_id, tf, len>> - bucketed by tile
    terms: DataFrame  # term, df, max_impact
    n_chunks: int
    avg_len: float
    table: str
    buckets: int

    def drop(self) -> None:
        self.blocks.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")

    @property
    def totals(self) -> Bm25Index:
        """The corpus figures in the form that the query weights need."""
        return Bm25Index(self.blocks, self.terms, self.n_chunks, self.avg_len, self.table)


def build_block_index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", buckets: int | None = None, tile_rows: int = TILE_ROWS) -> BlockIndex:
    """Tokenise every text once, then store the blocks and the term table; postings are shuffled once, into their buckets.

    Chunks with null or empty text count in the corpus and have no postings.
    """
    spark = chunks.sparkSession
    stored = materialize(bags(chunks, id_col, text_col), "bm25-bags")
    total = stored.agg(F.count("*").alias("n"), F.sum("len").alias("tokens"), F.sum(F.size("bag")).alias("postings")).first()
    n = total["n"]
    avg_len = (total["tokens"] or 0) / n if n else 0.0
    if buckets is None:
        buckets = whole_buckets(spark, -(-(total["postings"] or 0) // BUCKET_POSTINGS))
    tile = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, -(-n // tile_rows)))).cast("int").alias("tile")
    rows = stored.select(tile, "chunk_id", "len", F.inline("bag")).repartition(buckets, "tile")
    share = impact(F.col("tf"), F.col("len"), avg_len)
    blocks = rows.groupBy("tile", "term").agg(
        F.max(share).alias("max_impact"), F.sort_array(F.collect_list(F.struct("chunk_id", "tf", "len"))).alias("postings")
    )
    table = f"corpusloom_blocks_{uuid.uuid4().hex}"
    writer = blocks.write.bucketBy(buckets, "tile").sortBy("term", "tile").format("parquet")
    writer.option("path", scratch_path(spark, "bm25-blocks")).saveAsTable(table)
    held = spark.table(table)
    terms = held.groupBy("term").agg(F.sum(F.size("postings")).alias("df"), F.max("max_impact").alias("max_impact"))
    return BlockIndex(held, materialize(terms, "bm25-terms"), n, avg_len, table, buckets)


def tile_bounds(index: BlockIndex, terms: DataFrame) -> DataFrame:
    """query_id, tile, bound: no chunk of the tile can score higher. Reads block heads, no postings."""
    heads = index.blocks.select("term", "tile", "max_impact")
    joined = heads.join(terms.select("query_id", "term", "weight"), "term")
    return joined.groupBy("query_id", "tile").agg(F.sum(F.col("weight") * F.col("max_impact")).alias("bound"))


def wanted_blocks(index: BlockIndex, pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """The blocks of (query, tile) pairs with the query's weights: the blocks stay in their buckets.

    Both sides of the join lie by tile. That two keys may be met where one of
    them puts the rows is a setting of the session, which is told so.
    """
    index.blocks.sparkSession.conf.set(ALL_KEYS, "false")
    lists = terms.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("_terms"))
    moved = pairs.select("query_id", "tile").join(lists, "query_id").repartition(index.buckets, "tile")
    asked = moved.select("query_id", "tile", F.inline("_terms"))
    return index.blocks.select("tile", "term", "postings").join(asked, ["tile", "term"])


def _scored(index: BlockIndex, pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, tile, chunk_id, score of all chunks in the given (query, tile) pairs that hold a term of the query."""
    held = wanted_blocks(index, pairs, terms).select("query_id", "tile", "weight", F.inline("postings"))
    share = F.col("weight") * impact(F.col("tf"), F.col("len"), index.avg_len)
    return held.groupBy("query_id", "tile", "chunk_id").agg(F.round(F.sum(share), DIGITS).alias("score"))


def block_search(index: BlockIndex, queries: DataFrame, k: int = 20, text_col: str = "text", seed_tiles: int = SEED_TILES) -> DataFrame:
    """query_id, chunk_id, score, rank: the exact top ``k`` per query, as ``sparse.bm25_search`` finds it.

    A chunk lies in one tile, so a tile's scores are final. Ties fall to the
    smaller id; queries without a known term have no rows.
    """
    terms = materialize(weighted_terms(index.totals, queries, text_col), "bm25-query")
    where = bucket_salt("tile")
    bounds = materialize(tile_bounds(index, terms), "bm25-bounds")
    seeds = materialize(top_per_group(bounds, ["query_id"], [F.desc("bound"), F.asc("tile")], seed_tiles, salt_on=where), "bm25-seeds")
    best = [F.desc("score"), F.asc("chunk_id")]
    first = materialize(top_per_group(_scored(index, seeds, terms), ["query_id"], best, k, salt_on=where).drop("rank"), "bm25-first")
    floor = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(0.0).alias("floor"))
    rest = bounds.join(seeds.select("query_id", "tile"), ["query_id", "tile"], "left_anti").join(floor, "query_id")
    rest = materialize(rest.filter(F.col("bound") >= F.col("floor") - SLACK).select("query_id", "tile"), "bm25-rest")
    return top_per_group(first.unionByName(_scored(index, rest, terms)), ["query_id"], best, k, salt_on=where).drop("tile")
