"""Words of whole Arrow text columns as numpy arrays, without a Python object per word.

A batch is worked through in chunks of a few megabytes of whole documents, so that memory follows the
chunk (or the longest single document), not the batch.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallymark.llm.shipping import ship

CHUNK_BYTES = 4 << 20


def byte_table(separators: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(separators, np.uint8)] = True
    return table


#: Separators of `[^\x20\x09-\x0D]+` and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, as bytes of UTF-8.
WHITE = byte_table(b" \t\n\v\f\r")
NOT_ALNUM = byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Masks of the first bytes of a block.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@dataclass
class Words:
    """The words of some documents, one after the other."""

    ids: np.ndarray  #: of each word, its place in ``names``
    first: np.ndarray  #: of each document, its first word; one more entry for the end
    names: pa.Array  #: the distinct words, as bytes
    begin: np.ndarray  #: of each word, its first byte in ``data``
    length: np.ndarray  #: bytes of each word
    data: np.ndarray  #: the bytes of the texts, lower-cased if that was asked for
    text: np.ndarray  #: of each document, its first byte in ``data``; one more entry for the end

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word: its length and its blocks of eight bytes, scrambled one into the other."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        blocks = np.ndarray(len(self.data) + 1, "<u8", padded.data, strides=(1,))  # the eight bytes from every byte on
        out = mix(self.length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        active, done = np.arange(len(self.length)), 0
        while len(active):
            left = self.length[active] - done
            block = blocks[self.begin[active] + done] & FIRST_BYTES[np.minimum(left, 8)]
            out[active] = mix(out[active] ^ mix(block + np.uint64(0xD1B54A32D192ED03)))
            active, done = active[left > 8], done + 8
        return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with its nulls as empty texts."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()).fill_null("")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls, and where each text starts in them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of whole texts of about ``limit`` bytes together, each with the place of its first text."""
    if not len(texts):
        return
    offsets = raw(texts)[1]
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, texts.slice(at, end - at)
        at = end


def split(texts: pa.Array, separators: np.ndarray, lower: bool = False, named: bool = True) -> Words:
    """The words between separators; a word never reaches from one document into the next.

    Without ``named`` the distinct words are not sought: ``names`` is empty and ``ids`` only has the length.
    """
    data, offsets = raw(texts)
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    starts[heads] = inside[heads]
    begin = np.flatnonzero(starts)
    if not named:
        last = inside.copy()
        last[:-1] &= ~inside[1:] | starts[1:]
        length = np.flatnonzero(last) + 1 - begin
        return Words(begin, np.searchsorted(begin, offsets), pa.array([], pa.large_binary()), begin, length, data, offsets)
    place = np.cumsum(inside, dtype=np.int64)
    bounds = np.append(place[begin] - 1, place[-1] if len(place) else 0)
    names = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[inside])])
    coded = names.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(ids, np.searchsorted(begin, offsets), coded.dictionary, begin, np.diff(bounds), data, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Of every place, a hash of the ``width`` hashes from there; places near the end wrap and are for the caller to leave out."""
    out = np.zeros_like(hashes)
    for k in range(width):
        out = mix(out + np.roll(hashes, -k) + np.uint64(0x9E3779B97F4A7C15))
    return out


def give_back() -> None:
    """Free memory goes back from a worker that will be reused to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # not glibc; its allocator decides


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Every Arrow batch of a partition through ``rows``."""

    def partition(batches):
        for batch in batches:
            yield from rows(batch)

    return map_partition(df, partition, schema)


def map_partition(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Every partition, as an iterator of Arrow batches, through ``rows``."""
    ship(df.sparkSession)
    return df.mapInArrow(rows, schema)
