"""Embedding tables with a content-addressed cache."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.vectors import DEFAULT_DIM, hashed_embedding, model_embedding
from corpusloom.session import materialize

Model = Callable[[], Callable[[list[str]], np.ndarray]]


def instructed(query: Column, instruction: str) -> Column:
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), query)


def embed(
    df: DataFrame,
    text_col: str = "text",
    model: Model | None = None,
    dim: int = DEFAULT_DIM,
    instruction: str | None = None,
    batch_size: int = 32,
    error_col: str | None = None,
) -> DataFrame:
    """Adds ``embedding`` (unit length; of a NULL text empty). Queries pass an ``instruction``, documents none.

    With ``error_col`` a text that the model fails on does not end the job: its
    vector is empty and the column holds the message, null for all others.
    """
    c = F.col(text_col)
    if instruction:
        c = instructed(c, instruction)
    none = F.array().cast("array<float>")
    if error_col and model:
        done = df.withColumn("_done", model_embedding(c, model, batch_size, errors=True))
        vector = F.when(F.col(text_col).isNull(), none).otherwise(F.coalesce("_done.vector", none))
        return done.withColumn("embedding", vector).withColumn(error_col, F.col("_done.error")).drop("_done")
    if error_col:
        df = df.withColumn(error_col, F.lit(None).cast("string"))
    vector = model_embedding(c, model, batch_size) if model else hashed_embedding(T.tokens(c), dim)
    return df.withColumn("embedding", vector).withColumn("embedding", F.when(F.col(text_col).isNull(), none).otherwise(F.col("embedding")))


def _age(now: Column) -> Column:
    """Seconds since ``created_at``; both may come with or without a time zone."""
    return now.cast("timestamp").cast("double") - F.col("created_at").cast("timestamp").cast("double")


def live_entries(cache: DataFrame, model_id: str, now: Column, ttl_seconds: float | None) -> DataFrame:
    """Entries of this model that are not expired at ``now``."""
    own = cache.filter(F.col("model_id") == model_id)
    if ttl_seconds is None:
        return own
    return own.filter(_age(now) <= ttl_seconds)


def embed_with_cache(
    df: DataFrame,
    cache: DataFrame,
    model_id: str,
    now: Column,
    ttl_seconds: float | None = None,
    text_col: str = "text",
    **embed_args,
) -> tuple[DataFrame, DataFrame]:
    """(rows with ``embedding`` and ``cache_hit``, new cache entries).

    Only texts without a live entry are shuffled: anti-join by hash, one text
    per missing hash, embed it once. The new vectors are stored before both
    results use them, so the model never runs twice. Rows get their vector back
    by hash; that side is unique per hash, so a text that makes up a third of
    all rows is skew on one join side only, which the adaptive join splits. A
    NULL text keeps its row, with an empty vector and no cache entry.
    """
    hashed = df.withColumn("text_sha256", F.sha2(F.col(text_col), 256))
    live = live_entries(cache, model_id, now, ttl_seconds).select("text_sha256", "embedding")
    live = live.dropDuplicates(["text_sha256"])
    missing = hashed.select("text_sha256", text_col).filter(F.col(text_col).isNotNull()).join(live, "text_sha256", "left_anti")
    texts = missing.groupBy("text_sha256").agg(F.any_value(text_col).alias(text_col))
    embedded = embed(texts, text_col, **embed_args)
    fresh = materialize(
        embedded.select("text_sha256", "embedding", F.length(text_col).alias("text_len")), "embedded-misses"
    )
    known = live.withColumn("cache_hit", F.lit(True)).unionByName(
        fresh.select("text_sha256", "embedding", F.lit(False).alias("cache_hit"))
    )
    rows = hashed.join(known, "text_sha256", "left").withColumns(
        {"embedding": F.coalesce("embedding", F.array().cast("array<float>")), "cache_hit": F.coalesce("cache_hit", F.lit(False))}
    )
    entries = fresh.select(
        F.lit(model_id).alias("model_id"),
        "text_sha256",
        "embedding",
        "text_len",
        now.cast("timestamp").alias("created_at"),
    )
    return rows, entries


def cache_invalidate(cache: DataFrame, model_id: str) -> DataFrame:
    """Opening the cache with another model drops everything of the old one."""
    return cache.filter(F.col("model_id") == model_id)


def cache_expire(cache: DataFrame, now: Column, ttl_seconds: float) -> tuple[DataFrame, DataFrame]:
    """(kept entries, one row with the number of expired ones)."""
    age = _age(now)
    ttl = F.coalesce(F.col("ttl"), F.lit(float(ttl_seconds))) if "ttl" in cache.columns else F.lit(float(ttl_seconds))
    return cache.filter(age <= ttl), cache.agg(F.count_if(age > ttl).alias("expired"))


def cache_stats(cache: DataFrame, ttl_seconds: float | None = None) -> DataFrame:
    return cache.groupBy("model_id").agg(
        F.count("*").alias("total"),
        F.sum("text_len").alias("total_chars"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
        F.lit(ttl_seconds).cast("double").alias("ttl_seconds"),
    )
