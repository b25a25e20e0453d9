"""Nearest neighbours by cosine or inner product over whole query tables.

Two physical forms share one block kernel (a matrix product that emits only
each query's best k of the block):

* few queries, proven by a count against ``BLOCK_BYTES``: the query block is
  broadcast and every corpus partition is scanned once, without a shuffle;
* more queries: both sides are grouped by *cell* (nearest of a bounded set of
  pivots). Queries visit their nearest cells by equi-join to learn a floor; then
  one bounded block of queries after the other is broadcast and compared where
  the corpus lies with the cells whose angle bound can still beat it - exact.
  Cells and their query lists are split into blocks of bounded size, so a cell
  that holds a third of all vectors is spread like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.ranking import top_per_group
from corpusloom.session import materialize

BLOCK_BYTES = 16 << 20
CELL_ROWS = 8192
QUERY_ROWS = 32768
MAX_CELLS = 1024
EXACT_ROWS = 16384  # vectors of a cell in an exact search, which sends a query to every cell that it cannot rule out
SCORES = 4 << 20  # cells of one score matrix in a task
PAIRS = 1 << 14  # pairs whose vectors are laid side by side for their exact score
FOUND = 1 << 20  # hits that a task holds before it keeps each query's best
DIGITS = 6
HITS = "query_id {q}, chunk_id {c}, score double"


def _matrix(vectors: pd.Series, metric: str) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    if metric == "cosine":
        n = np.linalg.norm(m, axis=1, keepdims=True)
        m = m / np.where(n == 0, 1.0, n)
    return m


def _least(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row a bound that at least ``k`` of its scores reach: the k-th of the maxima of groups of columns."""
    width = scores.shape[1] // (4 * k)
    if width > 1:
        groups = scores.shape[1] // width
        scores = np.fmax.reduce(scores[:, : groups * width].reshape(len(scores), groups, width), axis=2)
    known = np.where(np.isnan(scores), -np.inf, scores)
    return np.partition(known, known.shape[1] - k, axis=1)[:, known.shape[1] - k]


def _block_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, floors: np.ndarray | None = None) -> pd.DataFrame:
    """Best k corpus rows of this block per query; ties go to the smaller id.

    Queries are taken in slices, so that a score matrix never exceeds SCORES
    cells. Scores below a query's floor may be left out. Only the scores that
    reach the bound, and those that rounding can lift to it, are looked at one by one.
    """
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    per_slice = max(1, SCORES // max(1, len(c_ids)))
    parts = []
    for at in range(0, len(q_ids), per_slice):
        scores = q[at : at + per_slice] @ c.T
        if scores.shape[1] > k:
            least = _least(scores, k)
            if floors is not None:
                least = np.maximum(least, floors[at : at + per_slice])
            rows, cols = np.nonzero(scores >= least[:, None] - 2 * 10.0**-DIGITS)
        else:
            rows, cols = np.nonzero(np.ones_like(scores, dtype=bool))
        found = pd.DataFrame({"row": rows, "chunk_id": c_ids[cols], "score": np.round(scores[rows, cols], DIGITS)})
        found = found.sort_values(["row", "score", "chunk_id"], ascending=[True, False, True], kind="stable")
        found = found[found.groupby("row").cumcount() < k]
        ids = q_ids[at : at + per_slice][found["row"]]
        parts.append(pd.DataFrame({"query_id": ids, "chunk_id": found["chunk_id"], "score": found["score"]}))
    return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})


def _schema(queries: DataFrame, corpus: DataFrame) -> str:
    return HITS.format(
        q=queries.schema["query_id"].dataType.simpleString(),
        c=corpus.schema["chunk_id"].dataType.simpleString(),
    )


def _rank(hits: DataFrame, k: int) -> DataFrame:
    return top_per_group(hits, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def _scan(queries: DataFrame, corpus: DataFrame, k: int, metric: str) -> DataFrame:
    block = queries.select("query_id", "embedding").toPandas()
    shared = corpus.sparkSession.sparkContext.broadcast(
        (block["query_id"].to_numpy(), _matrix(block["embedding"], metric))
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q = shared.value
        best: pd.DataFrame | None = None
        floors: np.ndarray | None = None
        for batch in batches:
            if not len(batch):
                continue
            found = _block_top(q_ids, q, batch["chunk_id"].to_numpy(), _matrix(batch["embedding"], metric), k, floors)
            best = found if best is None else pd.concat([best, found])
            best = best.sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True])
            best = best[best.groupby("query_id").cumcount() < k]
            full = best[best.groupby("query_id").cumcount() == k - 1].set_index("query_id")["score"]
            floors = full.reindex(q_ids).fillna(-np.inf).to_numpy()
        if best is not None:
            yield best

    return corpus.select("chunk_id", "embedding").mapInPandas(search, _schema(queries, corpus))


def pick_pivots(corpus: DataFrame, n_rows: int, most: int = MAX_CELLS) -> np.ndarray:
    """At most MAX_CELLS corpus vectors in hash order: a bounded, repeatable choice."""
    n = max(1, min(MAX_CELLS, most, int(n_rows**0.5)))
    rows = corpus.orderBy(F.xxhash64("chunk_id"), "chunk_id").select("embedding").limit(n).toPandas()
    return _matrix(rows["embedding"], "cosine")


def assign_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot's number ``cell`` and the ``angle`` to it."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("cell int, angle double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        cos = np.clip(_matrix(vectors, "cosine") @ shared.value.T, -1.0, 1.0)
        cell = cos.argmax(axis=1)
        return pd.DataFrame({"cell": cell, "angle": np.arccos(cos[np.arange(len(cell)), cell])})

    return df.withColumn("_at", nearest("embedding")).select("*", "_at.cell", "_at.angle").drop("_at")


@dataclass(frozen=True)
class Cells:
    """A corpus by cell: the rows, and the at most MAX_CELLS pivots with sizes and radii."""

    rows: DataFrame  # chunk_id, embedding, cell, angle
    pivots: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray


def build_cells(corpus: DataFrame, exact: bool = False) -> Cells:
    """Cells of about the square root's number of vectors, or of EXACT_ROWS (16 cells at least) for an exact search."""
    n = corpus.count()
    pivots = pick_pivots(corpus, n, max(16, -(-n // EXACT_ROWS)) if exact else MAX_CELLS)
    rows = assign_cells(corpus.select("chunk_id", "embedding"), pivots)
    rows = materialize(rows.sortWithinPartitions("cell") if exact else rows, "dense-cells")  # a batch then holds few cells
    sizes, radii = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots))
    for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect():
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["radius"]
    return Cells(rows, pivots, sizes, radii)


def _nearest(angles: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Mask of each row's nearest cells that together hold ``k`` vectors."""
    order = np.argsort(angles, axis=1, kind="stable")
    counts = sizes[order]
    before = np.cumsum(counts, axis=1) - counts
    mask = np.zeros(angles.shape, dtype=bool)
    np.put_along_axis(mask, order, (before < k) & (counts > 0), axis=1)
    return mask


def _route(queries: DataFrame, cells: Cells, choose: Callable[..., np.ndarray], *more: str) -> DataFrame:
    """queries with ``cells``, the numbers of the cells that ``choose`` marks for each row."""
    shared = queries.sparkSession.sparkContext.broadcast((cells.pivots, cells.sizes, cells.radii))

    @F.pandas_udf("array<int>")
    def pick(vectors: pd.Series, *columns: pd.Series) -> pd.Series:
        pivots, sizes, radii = shared.value
        angles = np.arccos(np.clip(_matrix(vectors, "cosine") @ pivots.T, -1.0, 1.0))
        mask = choose(angles, sizes, radii, *columns)
        return pd.Series([np.flatnonzero(row).astype(np.int32) for row in mask])

    return queries.withColumn("cells", pick.asNondeterministic()("embedding", *more))


def _visit(cells: Cells, routed: DataFrame, k: int) -> DataFrame:
    """Top k per query within each of its cells, block by block.

    The block number of a corpus row is its hash modulo the cell's block count;
    queries are copied to every block of their cells and split themselves by
    hash, so no group exceeds about CELL_ROWS vectors and QUERY_ROWS queries.
    """
    spark = routed.sparkSession
    load = routed.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()
    blocks = [
        (r["cell"], max(1, -(-int(cells.sizes[r["cell"]]) // CELL_ROWS)), -(-r["count"] // QUERY_ROWS)) for r in load
    ]
    plan = F.broadcast(spark.createDataFrame(blocks, "cell int, c_blocks int, q_blocks int"))  # MAX_CELLS rows at most
    left = (
        routed.select("query_id", "embedding", F.explode("cells").alias("cell"))
        .join(plan, "cell")
        .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("q_blocks")).cast("int"))
        .withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1)))
        .select("cell", "cb", "qb", "query_id", "embedding")
    )
    right = (
        cells.rows.join(plan, "cell")
        .withColumn("cb", F.pmod(F.xxhash64("chunk_id"), F.col("c_blocks")).cast("int"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
        .select("cell", "cb", "qb", "chunk_id", "embedding")
    )

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        return _block_top(
            q["query_id"].to_numpy(), _matrix(q["embedding"], "cosine"),
            c["chunk_id"].to_numpy(), _matrix(c["embedding"], "cosine"), k,
        )

    keys = ["cell", "cb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, _schema(routed, cells.rows))


def _found(at: np.ndarray, q: np.ndarray, narrow: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, floors: np.ndarray) -> Iterator[pd.DataFrame]:
    """row, chunk_id, score of the queries ``at`` and the vectors that can be among their best ``k``.

    Single precision names the pairs, double precision scores them.
    """
    slack = c.shape[1] * 1.2e-7 + 1e-6 + 2 * 10.0**-DIGITS
    c_narrow, per_slice = c.astype(np.float32), max(1, SCORES // len(c_ids))
    for lo in range(0, len(at), per_slice):
        mine = at[lo : lo + per_slice]
        scores = narrow[mine] @ c_narrow.T
        wanted = scores >= (floors[mine] - slack)[:, None].astype(np.float32)
        if scores.shape[1] > k and np.count_nonzero(wanted) > 4 * k * len(mine):
            wanted &= scores >= (_least(scores, k) - np.float32(slack))[:, None]
        rows, cols = np.nonzero(wanted)
        for i in range(0, len(rows), PAIRS):
            r, v = mine[rows[i : i + PAIRS]], cols[i : i + PAIRS]
            exact = np.round(np.einsum("ij,ij->i", q[r], c[v]), DIGITS)
            yield pd.DataFrame({"row": r, "chunk_id": c_ids[v], "score": exact})


def _scan_cells(queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """Best ``k`` of each task for a bounded block of ``queries(query_id, embedding, floor)``, stored.

    The block is broadcast and no vector is shuffled. A cell is compared with
    the queries whose floor it can still reach: no member of a cell is closer
    to a query than the query's angle to the pivot less the cell's radius.
    """
    block = queries.select("query_id", "embedding", "floor").toPandas()
    if not len(block):
        return queries.sparkSession.createDataFrame([], _schema(queries, cells.rows))
    value = block["query_id"].to_numpy(), _matrix(block["embedding"], "cosine"), block["floor"].to_numpy(), cells.pivots, cells.radii
    shared = queries.sparkSession.sparkContext.broadcast(value)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q, known, pivots, radii = shared.value
        floors, narrow = known.copy(), q.astype(np.float32)
        found: list[pd.DataFrame] = []
        for batch in batches:
            for cell, rows in batch.groupby("cell"):
                reach = np.cos(np.maximum(0.0, np.arccos(np.clip(q @ pivots[cell], -1.0, 1.0)) - radii[cell]))
                at = np.flatnonzero(reach >= floors - 1e-6)
                for more in _found(at, q, narrow, rows["chunk_id"].to_numpy(), _matrix(rows["embedding"], "cosine"), k, floors):
                    found.append(more)
                    if sum(map(len, found)) > FOUND:
                        found = [_best_rows(found, k)]
                        full = found[0][found[0].groupby("row").cumcount() == k - 1]
                        floors[full["row"]] = np.maximum(floors[full["row"]], full["score"])
        if found:
            best = _best_rows(found, k)
            yield pd.DataFrame({"query_id": q_ids[best["row"]], "chunk_id": best["chunk_id"], "score": best["score"]})

    hits = materialize(cells.rows.select("chunk_id", "embedding", "cell").mapInPandas(search, _schema(queries, cells.rows)), "dense-hits")
    shared.destroy()
    return hits


def _best_rows(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    rows = pd.concat(found).sort_values(["row", "score", "chunk_id"], ascending=[True, False, True])
    return rows[rows.groupby("row").cumcount() < k]


def _by_cells(queries: DataFrame, corpus: DataFrame, k: int, n: int, dim: int) -> DataFrame:
    """Exact: the nearest cells give a floor, then the corpus is scanned for each block of queries.

    What is shuffled are the vectors once and the hits that reach the floor, so
    disk grows with the rows and not with the pairs of cells.
    """
    cells = build_cells(corpus, exact=True)
    near = _route(
        queries.select("query_id", "embedding"), cells, lambda angles, sizes, radii: _nearest(angles, sizes, k)
    )
    near = materialize(near, "dense-near")
    first = materialize(_visit(cells, near, k), "dense-first")
    floor = (
        _rank(first, k)
        .groupBy("query_id")
        .agg(F.when(F.count("*") == k, F.min("score")).otherwise(-2.0).alias("floor"))
    )

    judged = materialize(near.select("query_id", "embedding").join(floor, "query_id"), "dense-floors")
    parts = -(-n * dim * 8 // BLOCK_BYTES)
    tagged = judged.withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    hits = None
    for part in range(parts):
        found = _scan_cells(tagged.filter(F.col("_part") == part), cells, k)
        hits = found if hits is None else hits.unionByName(found)
    return hits


def dense_search(
    queries: DataFrame, corpus: DataFrame, k: int = 20, metric: str = "cosine", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """query_id, chunk_id, score, rank: the exact top ``k`` per query.

    ``queries(query_id, embedding)``, ``corpus(chunk_id, embedding)``. Scores
    are rounded so that ties fall to the smaller id whatever the blocking.
    """
    first = queries.select(F.size("embedding").alias("dim")).first()  # one row; counting needs no vectors
    if first is None:
        return corpus.sparkSession.createDataFrame([], _schema(queries, corpus) + ", rank int")
    n, dim = queries.count(), first["dim"]
    if n * dim * 8 <= block_bytes:
        return _rank(_scan(queries, corpus, k, metric), k)
    if metric == "cosine":
        return _rank(_by_cells(queries, corpus, k, n, dim), k)
    return _rank(_in_blocks(queries, corpus, k, metric, block_bytes, n, dim), k)


def _in_blocks(
    queries: DataFrame, corpus: DataFrame, k: int, metric: str, block_bytes: int, n: int, dim: int
) -> DataFrame:
    """Inner product has no angle bound: one corpus scan per bounded query block."""
    parts = -(-n * dim * 8 // max(1, block_bytes // 2))
    tagged = queries.withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    hits = None
    for part in range(parts):
        found = _scan(tagged.filter(F.col("_part") == part), corpus, k, metric)
        hits = found if hits is None else hits.unionByName(found)
    return hits


def dense_search_approx(queries: DataFrame, corpus: DataFrame, k: int = 20, n_probe: int = 8) -> DataFrame:
    """Approximate form: only the ``n_probe`` nearest cells of each query are visited."""
    cells = build_cells(corpus)

    def probe(angles: np.ndarray, sizes: np.ndarray, radii: np.ndarray) -> np.ndarray:
        return _nearest(angles, np.minimum(sizes, 1), n_probe)  # a cell counts once

    routed = materialize(_route(queries.select("query_id", "embedding"), cells, probe), "dense-visits")
    return _rank(_visit(cells, routed, k), k)
