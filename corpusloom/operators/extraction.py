"""Dictionary entities with offsets, dosages and keywords.

Entities need the places of all matches of many patterns, which SQL's pattern
functions only give by matching twice; they are found in Arrow batches with the
patterns compiled once. Dosages and keywords are plain column expressions.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import lexicon as L

ENTITY = (
    "array<struct<entity_type:string,normalized:string,text:string,start_pos:int,end_pos:int,confidence:double>>"
)


ENTITY_FIELDS = {
    "entity_type": pa.string(), "normalized": pa.string(), "text": pa.string(),
    "start_pos": pa.int32(), "end_pos": pa.int32(), "confidence": pa.float64(),
}
#: Characters of text whose entities are found before they become an Arrow array.
SLICE_CHARS = 1 << 20


def folded(text: str) -> str:
    """Lower case of the same length, so that offsets stay true.

    The rare texts whose lower case is longer have their ASCII letters lowered only.
    """
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


_ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def fold_pattern(pattern: str) -> str:
    """Lower-cased pattern; escapes such as \\S keep their letter."""
    return re.sub(r"(\\.)|([^\\]+)", lambda m: m.group(1) or m.group(2).lower(), pattern)


def _needed(pattern: str) -> list[str] | None:
    """The alternatives of a pattern that is nothing but words, one of which a match must hold."""
    return None if set(pattern) & set(r"\^$.[](){}+*?") else pattern.split("|")


class EntityFinder:
    """The pattern table, compiled once: entities of a text in the order of the table."""

    def __init__(self, patterns: dict[str, list[tuple[str, str]]]):
        self.kinds = [
            (kind, [(name, re.compile(fold_pattern(p)), _needed(fold_pattern(p))) for p, name in rows])
            for kind, rows in patterns.items()
        ]

    def find(self, text: str | None) -> list[tuple]:
        """(entity_type, normalized, text, start_pos, end_pos, confidence); in a category, one name at one start counts once."""
        if not text:
            return []
        low, out = folded(text), []
        for kind, rows in self.kinds:
            seen = set()
            for name, pattern, words in rows:
                if words is not None and not any(w in low for w in words):
                    continue
                for m in pattern.finditer(low):
                    start, stop = m.span()
                    if (name, start) not in seen:
                        seen.add((name, start))
                        out.append((kind, name, text[start:stop], start, stop, L.ENTITY_CONFIDENCE))
        return out


def entities_of(text: Column, patterns: dict[str, list[tuple[str, str]]] | None = None) -> Column:
    """ARRAY of entity structs in the order of the pattern table; empty for NULL.

    The patterns are compiled once per worker and run over Arrow batches; only
    SLICE_CHARS of text and their entities are Python objects at a time.
    """
    table = patterns or L.ENTITY_PATTERNS

    @F.arrow_udf(ENTITY)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = EntityFinder(table)
        for batch in batches:
            parts = [_entity_lists(finder, texts) for texts in _texts(batch)]
            yield pa.concat_arrays(parts) if parts else _entity_lists(finder, [])
            del parts
            pa.default_memory_pool().release_unused()

    return find.asNondeterministic()(text)


def _texts(batch: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch, about SLICE_CHARS at a time."""
    texts, size = [], 0
    for text in batch:
        texts.append(text.as_py())
        size += len(texts[-1] or "")
        if size >= SLICE_CHARS:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def _entity_lists(finder: EntityFinder, texts: list[str | None]) -> pa.Array:
    found = [finder.find(t) for t in texts]
    columns = list(zip(*[e for row in found for e in row], strict=True)) or [[]] * len(ENTITY_FIELDS)
    entities = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, ENTITY_FIELDS.values(), strict=True)], list(ENTITY_FIELDS))
    return pa.ListArray.from_arrays(pa.array(accumulate(map(len, found), initial=0), pa.int32()), entities)


def extract_entities(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", patterns=None
) -> DataFrame:
    """id, entity_type, normalized, text, start_pos, end_pos, confidence; also for streams."""
    return docs.select(id_col, entities_of(F.col(text_col), patterns).alias("_e")).select(id_col, F.inline("_e"))


def entity_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", patterns=None) -> DataFrame:
    """Counts per category and in total, zero for texts without any; no shuffle."""
    found = docs.select(id_col, entities_of(F.col(text_col), patterns).alias("_e"))
    kinds = list(patterns or L.ENTITY_PATTERNS)

    def count(kind: str) -> Column:
        return F.size(F.filter("_e", lambda e: e["entity_type"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in kinds]
    return found.select(id_col, *counts, F.size("_e").cast("bigint").alias("total"))


def entities_json(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", patterns=None) -> DataFrame:
    """One JSON object per text: category to list of entities."""
    found = docs.select(id_col, entities_of(F.col(text_col), patterns).alias("_e"))

    def of(kind: str) -> Column:
        return F.transform(
            F.filter("_e", lambda e: e["entity_type"] == kind),
            lambda e: F.struct(
                e["text"].alias("text"), F.lit(kind).alias("type"), e["normalized"].alias("normalized"),
                e["confidence"].alias("confidence"), F.create_map().cast("map<string,string>").alias("attributes"),
            ),
        )

    kinds = list(patterns or L.ENTITY_PATTERNS)
    return found.select(id_col, F.to_json(F.struct(*[of(k).alias(k) for k in kinds])).alias("entities"))


def extract_dosages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos, amount, unit for every number with a dose unit."""
    c, pattern = F.col(text_col), F.lit("(?iu)(?U)" + L.DOSAGE_PATTERN)
    pairs = F.arrays_zip(
        F.regexp_extract_all(c, pattern, F.lit(1)).alias("amount"),
        F.regexp_extract_all(c, pattern, F.lit(2)).alias("unit"),
    )
    return docs.select(id_col, F.posexplode(pairs).alias("pos", "_d")).select(
        id_col, "pos", F.col("_d.amount").cast("double").alias("amount"), F.col("_d.unit").alias("unit")
    )


def medical_keywords(c: Column) -> Column:
    """Distinct keywords: disease-like runs, dose units alone, common words."""
    runs = [F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in L.KEYWORD_RUNS]
    units = F.regexp_extract_all(c, F.lit("(?U)" + L.KEYWORD_UNIT), F.lit(1))
    common = F.filter(F.array(*[F.lit(t) for t in L.KEYWORD_TERMS]), lambda t: F.contains(c, t))
    return F.array_distinct(F.flatten(F.array(*runs, units, common)))
