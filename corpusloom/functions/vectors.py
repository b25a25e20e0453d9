"""Vector arithmetic on ARRAY columns and the model-free text embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_DIM = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine; unequal lengths or a zero vector give 0."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (length == 0), F.lit(0.0)).otherwise(
        dot(a, b) / length
    )


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: (x / n).cast("float")))


def _bucket(term: str, dim: int) -> int:
    return int(hashlib.md5(term.encode("utf-8")).hexdigest()[:8], 16) % dim


def hashed_matrix(tokens: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of unit-length bucket counts; each distinct term is hashed once a batch."""
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(tokens), dim), dtype=np.float64)
    if lengths.sum() == 0:
        return out
    coded = tokens.flatten().dictionary_encode()
    buckets = np.fromiter((_bucket(t, dim) for t in coded.dictionary.to_pylist()), dtype=np.int64, count=len(coded.dictionary))
    rows = np.repeat(np.arange(len(tokens)), lengths)
    out = np.bincount(rows * dim + buckets[coded.indices.to_numpy()], minlength=out.size).reshape(out.shape)
    norms = np.sqrt((out.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return out / np.where(norms == 0, 1.0, norms)


def hashed_embedding(toks: Column, dim: int = DEFAULT_DIM) -> Column:
    """Hashed term-frequency vector of a token array, unit length.

    Marked non-deterministic, as every embedding: an optimizer that copies the
    expression (the filter it infers below an explode, say) would run it twice.
    """

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = hashed_matrix(batch, dim).astype(np.float32)
            yield pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * dim, found.ravel())

    return embed.asNondeterministic()(toks)


def bisected(run: Callable[[list[str]], Iterable], texts: list[str]) -> tuple[list, list[str | None]]:
    """Results and errors of a batch call: a batch that raises is halved until the texts that raise stand alone."""
    try:
        found = list(run(texts))
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} results for {len(texts)} texts")
        return found, [None] * len(texts)
    except Exception as failed:  # noqa: BLE001 - whatever the model raises belongs to its text
        if len(texts) <= 1:
            return [None] * len(texts), [f"{type(failed).__name__}: {failed}"] * len(texts)
        half = len(texts) // 2
        left, right = bisected(run, texts[:half]), bisected(run, texts[half:])
        return left[0] + right[0], left[1] + right[1]


def model_embedding(
    c: Column, factory: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = 32, errors: bool = False
) -> Column:
    """Embed texts with a user model; ``factory`` runs once per Python worker.

    With ``errors`` the result is a struct (vector, error): a text that the
    model fails on has no vector and the message, all others of its batch have
    theirs. Without it the failure ends the job.
    """

    def rows(encode: Callable[[list[str]], np.ndarray], texts: list[str]) -> list[np.ndarray]:
        m = np.asarray(encode(texts), dtype=np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return list((m / np.where(n == 0, 1.0, n)).astype(np.float32))

    def cut(batch: pd.Series) -> Iterator[list[str]]:
        for at in range(0, len(batch), batch_size):
            yield [t or "" for t in batch.iloc[at : at + batch_size]]

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for batch in batches:
            yield pd.Series([v for texts in cut(batch) for v in rows(encode, texts)])

    @F.pandas_udf("vector array<float>, error string")
    def embed_apart(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = factory()
        for batch in batches:
            done = [bisected(lambda texts: rows(encode, texts), texts) for texts in cut(batch)]
            yield pd.DataFrame({"vector": [v for vs, _ in done for v in vs], "error": [e for _, es in done for e in es]}, dtype=object)

    return (embed_apart if errors else embed).asNondeterministic()(c)
