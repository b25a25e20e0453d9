"""Benchmark decontamination with a broadcast hash set of word windows, in SQL functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what separates words, and the letters that are folded
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Windows in one broadcast; a larger benchmark is dealt into several, each with a scan of its own.
BROADCAST_WINDOWS = 200_000


def words_of(text: Column) -> Column:
    """Words of the text with A-Z lower-cased; null has none."""
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(F.coalesce(folded, F.lit("")), SEPARATORS), "")


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """k, key, win, items: the distinct windows; an item of fewer words is one window of k words."""
    items = benchmark.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    cut = items.withColumn("k", F.least(F.size("w"), F.lit(window))).select(
        "item", "k", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.slice("w", i, F.col("k")))).alias("win")
    )
    return cut.groupBy("k", "win").agg(F.collect_set("item").alias("items")).withColumn("key", F.xxhash64("win"))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, items, spans, contaminated; one row per input row.

    The words of a document are read as ``window`` shifted columns, one row per
    position; the hash of a window meets the broadcast set and the words behind
    an equal hash are compared. ``spans`` holds (pos, len) of the occurrences,
    0-based in words. A document is contaminated if at least one word in twenty
    is hit. Null and empty texts have no words and no hits; items without words
    have no window; repeated rows each get their row. Only hits are shuffled,
    by document and text.
    """
    windows = item_windows(benchmark, item_id, item_text, window)
    lengths = sorted(r["k"] for r in windows.select("k").distinct().collect())
    blocks = max(1, -(-windows.count() // BROADCAST_WINDOWS)) if lengths else 0
    doc = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), words_of(F.col(text_col)).alias("w"))
    shifted = F.arrays_zip(*[F.slice("w", j + 1, F.size("w")).alias(f"w{j}") for j in range(window)])
    placed = doc.select("doc_id", "text_hash", F.posexplode(shifted).alias("pos", "at"))
    hits = None
    for k in lengths:
        row = [F.col(f"at.w{j}") for j in range(k)]
        keyed = placed.filter(row[-1].isNotNull()).select("doc_id", "text_hash", "pos", F.array(*row).alias("seen"), F.xxhash64(*row).alias("key"))
        for block in range(blocks):
            part = windows.filter((F.col("k") == k) & (F.pmod("key", F.lit(blocks)) == block)).select("key", "win", "items")
            found = keyed.join(F.broadcast(part), "key").filter(F.col("seen") == F.col("win"))
            found = found.select("doc_id", "text_hash", F.struct(F.col("pos"), F.lit(k).alias("len")).alias("span"), "items")
            hits = found if hits is None else hits.union(found)
    n_words = doc.select("doc_id", "text_hash", F.size("w").cast("bigint").alias("n_words"))
    if hits is None:
        empty = n_words.withColumn("items", F.array().cast(windows.schema["items"].dataType))
        empty = empty.withColumn("spans", F.array().cast("array<struct<pos:int,len:int>>"))
        return _judged(empty, F.lit(0))
    by_doc = hits.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.array_sort(F.collect_set("span")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    joined = n_words.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a.n + F.greatest(F.lit(0), s.pos + s.len - F.greatest(a.end, s.pos))).alias("n"),
            F.greatest(a.end, s.pos + s.len).alias("end"),
        ),
        lambda a: a.n,
    )
    whole = joined.select(
        "doc_id", "text_hash", "n_words",
        F.coalesce("items", F.array().cast(windows.schema["items"].dataType)).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<pos:int,len:int>>")).alias("spans"),
    )
    return _judged(whole, covered)


def _judged(rows: DataFrame, covered: Column) -> DataFrame:
    hit = F.col("n_hit")
    return rows.withColumn("n_hit", covered.cast("bigint")).select(
        "doc_id", "text_hash", "n_words", "n_hit", "items", "spans",
        ((hit > 0) & (hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = find_contamination(docs, benchmark, id_col, text_col, **names).filter("contaminated")
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    same = docs[id_col].eqNullSafe(F.col("_bad_id")) & (F.xxhash64(docs[text_col]) == F.col("_bad_hash"))
    return docs.join(bad, same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``docs`` with the hit words, and the separators after them, cut out of the texts."""
    found = find_contamination(docs, benchmark, id_col, text_col, **names).filter("n_hit > 0")
    found = found.select(F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash"), F.col("spans").alias("_spans"))
    found = found.dropDuplicates(["_hit_id", "_hit_hash"])
    same = docs[id_col].eqNullSafe(F.col("_hit_id")) & (F.xxhash64(docs[text_col]) == F.col("_hit_hash"))
    text = F.col(text_col)
    words, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD)
    hit = F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s.pos, s.pos + s.len - 1))))
    kept = F.filter(
        F.transform(F.arrays_zip(words.alias("w"), F.slice(gaps, 2, F.size(gaps)).alias("g")), lambda x, i: F.struct(x.w.alias("w"), x.g.alias("g"), i.alias("i"))),
        lambda x: ~F.array_contains(hit, x.i),
    )
    cut = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(kept, lambda x: F.concat(x.w, F.coalesce(x.g, F.lit("")))), ""))
    return docs.join(found, same, "left").withColumn(text_col, F.when(F.col("_spans").isNull(), text).otherwise(cut)).drop("_hit_id", "_hit_hash", "_spans")
