"""A Bloom filter of fixed largest size that tasks use to leave out rows before a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.workers import lean

SEGMENT_BITS = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = x >> np.uint64(30)
        y ^= x
        y *= np.uint64(0xBF58476D1CE4E5B9)
        y ^= y >> np.uint64(27)
        y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


class HashFilter:
    """Bloom filter of 64-bit hashes, in segments that their upper bits choose (so these must be spread evenly); at most ``most`` bits."""

    def __init__(self, n: int, most: int):
        self.digits, self.k = 0, 4
        while SEGMENT_BITS << self.digits < min(16 * n, most):
            self.digits += 1
        self.words = np.zeros(SEGMENT_BITS // 64 << self.digits, dtype=np.uint64)

    def segment(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.digits) if self.digits else np.zeros_like(hashes)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Bits within the segment."""
        step = mix(hashes) | np.uint64(1)
        with np.errstate(over="ignore"):
            return (hashes[:, None] + step[:, None] * np.arange(self.k, dtype=np.uint64)) & np.uint64(SEGMENT_BITS - 1)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes) + self.segment(hashes)[:, None] * np.uint64(SEGMENT_BITS)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def bloom_of(hashes: DataFrame, most: int) -> HashFilter:
    """Filter of the column ``hash`` (bigint) of a stored table; segments are filled by tasks."""
    filled = HashFilter(hashes.count(), most)
    digits = filled.digits
    segment = F.shiftrightunsigned("hash", 64 - digits).cast("int") if digits else F.lit(0)

    @lean
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, now, bits = HashFilter(0, most), None, None
        packed = lambda: pa.record_batch([pa.array([now], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["segment", "bits"])
        for batch in batches:
            segments, places = batch.column(0).to_numpy(), one.places(batch.column(1).to_numpy().view(np.uint64))
            for key in np.unique(segments).tolist():
                if key != now:
                    if bits is not None:
                        yield packed()
                    now, bits = key, np.zeros(SEGMENT_BITS, dtype=bool)
                bits[places[segments == key]] = True
        if bits is not None:
            yield packed()

    dealt = hashes.select(segment.alias("segment"), "hash").repartition("segment").sortWithinPartitions("segment")
    width = SEGMENT_BITS // 64
    for row in dealt.mapInArrow(fill, "segment int, bits binary").toLocalIterator():  # at most ``most`` bits
        filled.words[row["segment"] * width : (row["segment"] + 1) * width] = np.frombuffer(row["bits"], dtype="<u8")
    return filled
