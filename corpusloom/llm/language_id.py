"""Language identification with string kernels.

Two texts are compared by the blended-spectrum presence kernel: the number of
distinct character n-grams (2 to 4) that both hold, divided by the geometric
mean of their own numbers. A bounded sample of labelled texts gives Nystrom
landmarks; one-versus-rest ridge regression is fitted on the landmark features.
Since the kernel is linear in presence, the landmark expansion folds into one
weight per n-gram and language, and a batch of texts is scored by one matrix
product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.workers import give_back

SIZES = (2, 3, 4)
#: n-grams are folded into 2**BITS buckets.
BITS = 18
#: Bounds of the fit: labelled texts and landmarks in all, shared evenly by the languages.
SAMPLE_TEXTS = 1600
LANDMARKS = 320
RIDGE = 1e-3
UNDETERMINED = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point to lower-cased letter, 32 for everything that is no letter."""
    if not _LETTERS:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = ord(c.lower()[0])
        _LETTERS.append(table)
    return _LETTERS[0]


def gram_buckets(text: str | None, piece: int = 1 << 20) -> np.ndarray | None:
    """Buckets of all n-grams of the whole text, with repeats; None if it is null or has no letter."""
    if not text:
        return None
    table, step, found, letters = _letters(), max(SIZES) - 1, [], False
    for at in range(0, len(text), piece):
        part = text[at : at + piece + step]
        codes = table[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        letters = letters or bool((codes != 32).any())
        hashed = codes
        for n in range(2, max(SIZES) + 1):
            if len(codes) < n:
                break
            hashed = hashed[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]
            if n in SIZES:
                found.append(((hashed ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    if not letters:
        return None
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


@dataclass
class KernelModel:
    """languages, bucket -> column (-1: in no landmark), weights (column x language), offsets."""

    languages: list[str]
    column: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def score(self, texts: list[str | None], block: int = 64) -> tuple[list[str], list[float]]:
        names, scores = [], []
        width = len(self.weights)
        seen = np.zeros(1 << BITS, dtype=bool)
        for at in range(0, len(texts), block):
            part = texts[at : at + block]
            rows = np.zeros((len(part), width + 1), dtype=np.float32)
            own = np.ones(len(part))
            known = np.zeros(len(part), dtype=bool)
            for i, text in enumerate(part):
                ids = gram_buckets(text)
                if ids is None:
                    continue
                known[i] = True
                rows[i, self.column[ids]] = 1
                seen[ids] = True
                own[i] = max(1, np.count_nonzero(seen))
                seen[ids] = False
            values = (rows[:, :width] @ self.weights) / np.sqrt(own)[:, None] + self.offset
            if not self.languages:
                known[:] = False
                values = np.zeros((len(part), 1))
            best = values.argmax(axis=1)
            top = np.clip(values[np.arange(len(part)), best], 0.0, 1.0)
            names += [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
            scores += [float(t) if k else 0.0 for t, k in zip(top, known, strict=True)]
        return names, scores


def fit(samples: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """Model of (language, distinct buckets) pairs; the first texts of each language are the landmarks."""
    languages = sorted({name for name, _ in samples})
    if not languages:
        return KernelModel([], np.zeros(1 << BITS, dtype=np.int32), np.zeros((0, 1), dtype=np.float32), np.zeros(1))
    share = max(1, landmarks // len(languages))
    chosen: list[np.ndarray] = []
    for name in languages:
        chosen += [ids for label, ids in samples if label == name][:share]
    vocabulary = np.unique(np.concatenate(chosen))
    column = np.full(1 << BITS, -1, dtype=np.int32)
    column[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)

    def presence(texts: list[np.ndarray]) -> np.ndarray:
        rows = np.zeros((len(texts), len(vocabulary) + 1), dtype=np.float32)
        for i, ids in enumerate(texts):
            rows[i, column[ids]] = 1
            rows[i] /= np.sqrt(np.float32(max(1, len(ids))))  # in place: the rows are the largest thing on the driver
        return rows[:, :-1]

    marks = presence(chosen)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > values.max() * 1e-8
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = np.vstack([presence([ids for _, ids in samples[at : at + 100]]) @ marks.T for at in range(0, len(samples), 100)]) @ root
    features = np.hstack([features, np.ones((len(samples), 1))])
    target = np.array([[float(label == name) for name in languages] for label, _ in samples])
    penalty = ridge * len(samples) * np.eye(features.shape[1])
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(features.T @ features + penalty, features.T @ target)
    weights = marks.T @ (root @ solved[:-1])
    return KernelModel(languages, column, weights.astype(np.float32), solved[-1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_TEXTS) -> KernelModel:
    """Fit on a bounded sample of the labelled rows that are not held out.

    Distinct texts are counted by language and size of their hash. The counts
    give each language the least power of two below which enough distinct texts
    lie (or all it has); of these the smallest hashes are taken. So a hot
    language or a much-copied text costs no more than any other, copies take no
    other text's place, and the sample is the same however the table is
    partitioned.
    """
    labelled = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h")
    ).filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    place = F.pmod("h", F.lit(1 << 30))
    sizes = labelled.select("lang", "h").distinct().groupBy("lang", F.length(F.bin(place)).alias("bits")).count()
    counts: dict[str, dict[int, int]] = {}
    for r in sizes.collect():  # at most 30 rows per language
        counts.setdefault(r["lang"], {})[r["bits"]] = r["count"]
    if not counts:
        return fit([])
    each = max(2, sample // len(counts))
    bound = {}
    for lang, by_bits in counts.items():
        held = 0
        for bits in sorted(by_bits):
            held, bound[lang] = held + by_bits[bits], 1 << bits
            if held >= each:
                break
    below = place < F.try_element_at(F.create_map(*[F.lit(x) for pair in bound.items() for x in pair]), F.col("lang"))
    distinct = labelled.filter(below).groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"))
    first = Window.partitionBy("lang").orderBy(place, "h")
    picked = distinct.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= each)

    @F.pandas_udf("array<int>")
    def distinct_buckets(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(gram_buckets(t)).astype(np.int32) for t in texts])

    # picked: at most `sample` rows, which bounds the broadcast
    chosen = labelled.join(F.broadcast(picked.select("lang", "h", "doc_id", "n")), ["lang", "h", "doc_id"]).dropDuplicates(["lang", "h"])
    rows = chosen.select("lang", "n", distinct_buckets("text").alias("ids")).toPandas().sort_values(["lang", "n"])
    return fit([(r.lang, np.asarray(r.ids)) for r in rows.itertuples()])


def predict(docs: DataFrame, model: KernelModel, text_col: str = "text") -> Column:
    """Struct (lang_pred, score) of a text column; `und` and 0 for null texts and texts without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = shared.value.score(texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})
        give_back()

    return scored.asNondeterministic()(F.col(text_col))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row per input row.

    Whole texts are read. Null and empty texts and texts without letters are
    `und` with score 0, as is every text when no row is labelled. Null ids are
    not held out and not learnt from. Repeated rows are kept; ties between
    languages go to the alphabetically first.
    """
    model = train(docs, id_col, text_col, lang_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), predict(docs, model, text_col).alias("p")
    ).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """Rows of ``docs`` with a determined language, all columns as they were.

    Where no row is labelled nothing is learnt, and texts with a letter stay.
    """
    model = train(docs, id_col, text_col, lang_col)
    if not model.languages:
        return docs.filter(F.col(text_col).rlike(r"\p{L}"))
    names = docs.columns
    row = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), predict(docs, model, text_col).alias("p"))
    return row.filter(F.col("p.lang_pred") != UNDETERMINED).select("row.*")
