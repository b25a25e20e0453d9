"""Split documents into retrieval chunks, row by row without any shuffle.

Fixed windows are a projection. The other strategies fold over the parts of a
text, which appended arrays make quadratic in one text; they are an Arrow table
function that streams a text's chunks out while it goes. No strategy regroups
chunks, so a hot source or a very long text never gathers more than its own row
in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.functions import text as T
from corpusloom.functions.vectors import hashed_matrix
from corpusloom.operators import chunk_streams

CHUNK = "struct<text:string,index:int,start:int,end:int,section:string>"
#: Chunks, and characters of chunks, that leave the table function together.
OUT_ROWS, OUT_CHARS = 4096, 1 << 22


@dataclass(frozen=True)
class ChunkConfig:
    size: int = 512
    overlap: int = 64
    min_size: int = 100
    max_size: int = 1500
    threshold: float = 0.5

    @property
    def step(self) -> int:
        return max(1, self.size - self.overlap)


def _chunk(text: Column, index: Column, start: Column, end: Column, section: Column | None = None) -> Column:
    return F.struct(
        text.alias("text"),
        index.cast("int").alias("index"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        (F.lit("") if section is None else section).alias("section"),
    )


def _no_chunks() -> Column:
    return F.array().cast(f"array<{CHUNK}>")


def _windows(t: Column, size: int, step: int, minimum: int) -> Column:
    """ARRAY<STRUCT<text, start, end>>: stripped windows of at least ``minimum`` characters.

    The text is cut once into blocks of one step; a window is a few blocks
    joined. Cost is linear in the text (a substring per window would walk the
    text from its beginning each time).
    """
    per_window = -(-size // step)

    def build(blocks: Column) -> Column:
        def within(n: Column) -> Column:
            last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")

            def window(i: Column) -> Column:
                raw = F.left(F.array_join(F.slice(blocks, i + 1, per_window), ""), F.lit(size))
                return F.struct(
                    T.strip(raw).alias("text"), (i * step).alias("start"), F.least(n, i * step + size).alias("end")
                )

            return F.filter(
                F.transform(F.sequence(F.lit(0), last), window),
                lambda w: F.length(w["text"]) >= max(1, minimum),
            )

        return T.let(F.length(t), within)

    return T.let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), build)


def _numbered(windows: Column) -> Column:
    return F.transform(windows, lambda w, i: _chunk(w["text"], i, w["start"], w["end"]))


def fixed_chunks(c: Column, cfg: ChunkConfig) -> Column:
    """Sliding windows; short windows are skipped and do not count."""
    return T.let(
        T.clean_text(c),
        lambda t: F.when(t == "", _no_chunks()).otherwise(_numbered(_windows(t, cfg.size, cfg.step, cfg.min_size))),
    )


def hashed_sentence_encoder(sentences: list[list[str]]) -> np.ndarray:
    return hashed_matrix(pa.array(sentences, pa.list_(pa.string())), 256)


def _streamed(docs: DataFrame, strategy: str, cfg: ChunkConfig, text_col: str, encoder) -> DataFrame:
    """Chunks of ``docs`` by the table function; the other columns go along in Arrow, not as Python values."""
    others = [f for f in docs.schema.fields if f.name != text_col]
    added = [st.StructField(text_col, st.StringType()), *[st.StructField(f"chunk_{c}", st.IntegerType()) for c in ("index", "start", "end")]]
    schema = st.StructType([*others, *added, st.StructField("section", st.StringType())])
    names, arrow = [f.name for f in others], to_arrow_schema(schema)
    arrow_added = pa.schema(list(arrow)[len(names) :])

    class Chunker:
        def __init__(self):
            self.encode = None

        def chunks(self, texts: list[str | None]) -> Iterator[tuple[int, chunk_streams.Chunk]]:
            given = [(row, text) for row, text in enumerate(texts) if text is not None]
            if strategy == "semantic" and encoder is not None:
                self.encode = self.encode or encoder()
                found = chunk_streams.encoded_chunks([t for _, t in given], self.encode, cfg)
            else:
                one = chunk_streams.recursive_chunks if strategy in ("recursive", "semantic") else chunk_streams.markdown_chunks
                found = (one(text, cfg) for _, text in given)
            for (row, _), stream in zip(given, found, strict=True):
                for piece in stream:
                    yield row, piece

        def eval(self, batch: pa.RecordBatch):
            rows, pieces, chars = [], [], 0

            def table() -> pa.Table:
                columns = list(zip(*pieces, strict=True)) or [()] * len(arrow_added)
                arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow_added, strict=True)]
                kept = batch.select(names).take(pa.array(rows, pa.int64())).columns if names else []
                return pa.Table.from_arrays([*kept, *arrays], names=arrow.names)

            for row, piece in self.chunks(batch.column(text_col).to_pylist()):
                rows.append(row)
                pieces.append(piece)
                chars += len(piece[0])
                if len(rows) >= OUT_ROWS or chars >= OUT_CHARS:
                    yield table()
                    rows, pieces, chars = [], [], 0
            yield table()

    return F.arrow_udtf(Chunker, returnType=schema)(docs.asTable())


def chunk(
    docs: DataFrame,
    strategy: str = "markdown",
    cfg: ChunkConfig | None = None,
    text_col: str = "text",
    encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
) -> DataFrame:
    """Documents to chunks; every other column of ``docs`` is kept.

    Adds ``chunk_index, chunk_start, chunk_end, section`` and replaces the text
    column by the chunk text. An unknown strategy means ``markdown``; semantic
    chunking without an encoder falls back to recursive, and so does every text
    that the encoder fails on. A null text has no chunks.
    """
    cfg = cfg or ChunkConfig()
    if strategy != "fixed":
        return _streamed(docs, strategy, cfg, text_col, encoder)
    others = [x for x in docs.columns if x != text_col]
    return docs.select(*others, F.explode(fixed_chunks(F.col(text_col), cfg)).alias("_c")).select(
        *others,
        F.col("_c.text").alias(text_col),
        F.col("_c.index").alias("chunk_index"),
        F.col("_c.start").alias("chunk_start"),
        F.col("_c.end").alias("chunk_end"),
        F.col("_c.section").alias("section"),
    )


def legacy_windows(docs: DataFrame, size: int, overlap: int, text_col: str = "text") -> DataFrame:
    """Older window form: no cleaning, no minimum size; size <= 0 keeps the text whole."""
    t = T.strip(F.coalesce(F.col(text_col), F.lit("")))
    if size <= 0:
        chunks = F.array(_chunk(t, F.lit(0), F.lit(0), F.length(t)))
    else:
        chunks = _numbered(_windows(t, size, max(1, size - max(0, overlap)), 1))
    others = [x for x in docs.columns if x != text_col]
    return docs.withColumn("_c", F.explode(F.when(t == "", _no_chunks()).otherwise(chunks))).select(
        *others,
        F.col("_c.text").alias(text_col),
        F.col("_c.index").alias("chunk_index"),
        F.col("_c.start").alias("chunk_start"),
        F.col("_c.end").alias("chunk_end"),
    )
