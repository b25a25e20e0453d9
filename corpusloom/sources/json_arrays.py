"""One JSON array in one file, read by many tasks.

A JSON array has no line ends to cut at. Spark's text reader cuts the file at
closing braces instead, wherever its splits lie; such a brace may stand inside
a string. A first pass tells for every split where it ends if it begins outside
a string, and if it begins inside one; these few numbers, taken in order, give
each split's true state. The second pass cuts the splits at the elements'
borders. Only elements that lie across splits are put together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MARK = re.compile(r'\\.|["{}\[\]]', re.DOTALL)
Split = tuple[str, int]


def walk(text: str, inside: bool, depth: int) -> tuple[bool, int, int]:
    """State after ``text``: inside a string, depth, and the least depth on the way."""
    least = depth
    for found in _MARK.finditer(text):
        mark = found.group()
        if mark == '"':
            inside = not inside
        elif not inside and mark in "{[":
            depth += 1
        elif not inside and mark in "}]":
            depth -= 1
            least = min(least, depth)
    return inside, depth, least


def elements(text: str, inside: bool, depth: int, begun: bool) -> Iterator[tuple[bool, bool, str]]:
    """(begins here, ends here, text) of the objects of the outermost array in a part of the file.

    ``begun`` tells that the part begins within an element.
    """
    start, first = (0 if begun else None), begun
    for found in _MARK.finditer(text):
        mark = found.group()
        if mark == '"':
            inside = not inside
        elif not inside and mark in "{[":
            if depth == 1 and mark == "{":
                start, first = found.start(), False
            depth += 1
        elif not inside and mark in "}]":
            depth -= 1
            if depth == 1 and start is not None:
                yield not first, True, text[start : found.end()]
                start, first = None, False
    if start is not None:
        yield not first, False, text[start:]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Split, Iterator[str]]]:
    """The splits of a task in the order of reading, each as its pieces with their closing braces."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for split, mine in groupby(rows, itemgetter(0, 1)):
        yield split, (value + "}" for _, _, value in mine)


def _states(spark: SparkSession, pieces: DataFrame) -> dict[Split, tuple[bool, int, int | None]]:
    """Split -> (inside a string, depth, start of the split in which the open element begins); a row per split reaches the driver."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), texts in _texts(batches):
            ends = [(False, 0, 0), (True, 0, 0)]
            for text in texts:
                moved = [walk(text, inside, depth) for inside, depth, _ in ends]
                ends = [(i, d, min(least, low)) for (i, d, low), (_, _, least) in zip(moved, ends, strict=True)]
            row = {"file": file, "block": block}
            for h, (inside, depth, least) in enumerate(ends):
                row |= {f"inside{h}": inside, f"depth{h}": depth, f"least{h}": least}
            yield pa.RecordBatch.from_pylist([row])

    schema = "file string, block long, " + ", ".join(f"inside{h} boolean, depth{h} long, least{h} long" for h in (0, 1))
    found: dict[Split, tuple[bool, int, int | None]] = {}
    for file, rows in groupby(sorted(pieces.mapInArrow(summarise, schema).collect()), itemgetter("file")):
        inside, depth, owner = False, 0, None
        for r in rows:
            found[file, r["block"]] = inside, depth, owner
            h = int(inside)
            # back at the array's own depth, the open element has ended, and another one may be open at the end
            if depth + r[f"least{h}"] <= 1:
                owner = r["block"]
            inside, depth = r[f"inside{h}"], depth + r[f"depth{h}"]
            owner = owner if depth > 1 else None
    return found


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The objects of the JSON arrays in the files below ``path``, one row each, by ``schema``.

    Files of any size are read by as many tasks as they have splits. Elements
    other than objects are passed over; an object that does not fit the schema
    gives nulls, as with Spark's own reader. Order is not kept.
    """
    pieces = spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    states = spark.sparkContext.broadcast(_states(spark, pieces))  # one entry per split

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "owner", "block", "place", "value"]
        for (file, block), texts in _texts(batches):
            inside, depth, owner = states.value[file, block]
            held: list[list] = []  # pieces of the open element
            place = 0
            for text in texts:
                begun, out = depth > 1, []
                for begins, ends, part in elements(text, inside, depth, begun):
                    if begins:
                        owner, held = block, []
                        place += 1
                    elif owner is None:  # inside an array among the elements
                        continue
                    held.append(part)
                    if ends:
                        whole = owner == block
                        out.append((file, None if whole else owner, block, 0 if not whole else place, "".join(held)))
                        held, owner = [], None
                inside, depth, _ = walk(text, inside, depth)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
            if held:  # goes on in the next split
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((file, owner, block, place, "".join(held)), kinds, strict=True)], names)

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    found = pieces.mapInArrow(cut, "file string, owner long, block long, place long, value string")
    whole = found.filter("owner IS NULL").select("value")
    parts = found.filter("owner IS NOT NULL").groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("block", "value"))).alias("p"))
    joined = parts.filter(F.col("p")[0].block == F.col("owner")).select(F.array_join(F.transform("p", lambda x: x.value), "").alias("value"))
    return whole.unionAll(joined).select(F.from_json("value", schema).alias("e")).select("e.*")
