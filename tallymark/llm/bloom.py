"""A Bloom filter of fixed size over a column of 64-bit hashes, built in slices on the executors.

The filter is the same size for any input, so it may be broadcast. What it lets through by mistake costs work
only; callers stay exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.words import map_partition

SLICES = 256  #: by the top eight bits of the hash


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions of each hash, within its slice of ``bits`` bits (a power of two)."""
    mask = np.uint64(bits - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(27)) & mask).astype(np.int64)


def build(hashes: DataFrame, bits: int) -> bytes:
    """The filter over the single long column of ``hashes``; ``bits`` in all, a power of two of at least 2048."""
    per = bits // SLICES
    name = hashes.columns[0]

    def rows(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            slices = (values >> np.uint64(56)).astype(np.int64)
            for s in np.unique(slices).tolist():
                bitmap = held.setdefault(s, np.zeros(per, bool))
                for at in places(values[slices == s], per):
                    bitmap[at] = True
        for s, bitmap in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(bitmap).tobytes()], pa.binary())], ["slice", "bitmap"])

    sliced = hashes.select(name).repartition(F.shiftrightunsigned(name, 56))
    out = np.zeros((SLICES, per // 8), np.uint8)
    for row in map_partition(sliced, rows, "slice int, bitmap binary").collect():  # at most one row per slice
        out[row[0]] = np.frombuffer(row[1], np.uint8)
    return out.tobytes()


def contains(filter_bytes: bytes, hashes: np.ndarray) -> np.ndarray:
    bitmap = np.frombuffer(filter_bytes, np.uint8)
    per = len(bitmap) * 8 // SLICES
    base = (hashes >> np.uint64(56)).astype(np.int64) * per
    found = np.ones(len(hashes), bool)
    for at in places(hashes, per):
        at = at + base
        found &= (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return found
