"""Header metadata of parsed documents and the fixed index-row layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# ---- fixed values -------------------------------------------------------
HEADER_CHARS = 2000
DOI = r"(?U)\b(10\.\d{4,}/[^\s]+)\b"
YEAR = r"((?:19|20)(?U:\d{2}))"
KEYWORDS_ZH = r"(?s)关键词[：:](.*?)(?:\n|摘要|Abstract)"
KEYWORDS_EN = r"(?isu)Keywords?[：:](.+?)(?:\n\n|Introduction|Background)"
TITLE_CHARS = (10, 150)
NOT_A_TITLE = ["http", "doi", "DOI"]
FIELD_CHARS = {"title": 500, "year": 10, "doi": 250, "keywords": 1000, "indexed_at": 32}
# -------------------------------------------------------------------------


def _first(c: Column, pattern: str) -> Column:
    """First match of group 1, NULL when there is none."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lit(0))


def _keyword_list(raw: Column, splitter: str, below: int) -> Column:
    parts = F.transform(F.split(T.strip(raw), splitter), T.strip)
    kept = F.filter(parts, lambda k: (k != "") & (F.length(k) < below))
    return F.when(F.size(kept) > 0, kept)


def header_metadata(text: Column, filename: Column) -> Column:
    """STRUCT<doi, year, keywords, title> read from the first 2000 characters."""

    def read(h: Column) -> Column:
        lines = F.filter(F.transform(F.split(h, "\n"), T.strip), lambda x: x != "")
        first = F.get(lines, F.lit(0))
        rejected = F.lit(False)
        for prefix in NOT_A_TITLE:
            rejected = rejected | first.startswith(prefix)
        low, high = TITLE_CHARS
        fits = (F.length(first) > low) & (F.length(first) < high) & ~rejected
        stem = F.regexp_replace(F.regexp_replace(filename, "^[a-f0-9]{8}_", ""), r"(?i)\.pdf$", "")
        zh = _keyword_list(_first(h, KEYWORDS_ZH), r"(?U)[;；,，\s]+", 20)
        en = _keyword_list(_first(h, KEYWORDS_EN), "[;,]+", 50)
        return F.struct(
            F.rtrim(_first(h, DOI), F.lit(".,;")).alias("doi"),
            _first(h, YEAR).alias("year"),
            F.coalesce(zh, en).alias("keywords"),
            F.when(fits, first).when(stem != "", stem).alias("title"),
        )

    return T.let(F.left(text, F.lit(HEADER_CHARS)), read)


def extract_metadata(docs: DataFrame, text_col: str = "text", name_col: str = "source") -> DataFrame:
    return docs.withColumn("_m", header_metadata(F.col(text_col), F.col(name_col))).select(
        *docs.columns, "_m.doi", "_m.year", "_m.keywords", "_m.title"
    )


def keywords_json(keywords: Column) -> Column:
    """JSON list with a blank after each comma, non-ASCII kept; NULL list gives []."""
    quoted = F.transform(
        F.coalesce(keywords, F.array().cast("array<string>")),
        lambda k: F.get(F.regexp_extract_all(F.to_json(F.array(k)), F.lit(r"(?s)^\[(.*)\]$"), F.lit(1)), F.lit(0)),
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def to_index_rows(chunks: DataFrame) -> DataFrame:
    """Collection rows: term text, original text, defaults and field limits."""

    def cut(name: str, c: Column) -> Column:
        return F.left(F.coalesce(c, F.lit("")), F.lit(FIELD_CHARS[name])).alias(name)

    return chunks.select(
        *[c for c in ("chunk_id", "doc_id", "embedding", "section", "error_message") if c in chunks.columns],
        F.array_join(T.tokens(F.col("text")), " ").alias("text"),
        F.col("text").alias("original_text"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("path", F.lit("")).alias("path"),
        cut("title", F.col("title")),
        cut("year", F.col("year")),
        cut("doi", F.col("doi")),
        cut("keywords", keywords_json(F.col("keywords"))),
        F.coalesce("chunk_index", F.lit(0)).cast("int").alias("chunk_index"),
        cut("indexed_at", F.col("indexed_at").cast("string")),
    )
