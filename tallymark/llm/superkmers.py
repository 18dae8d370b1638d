"""Substring dedup by super-k-mers: windows of words that sit elsewhere too are found bucket by bucket and removed.

The minimiser of a window is the least hash of its runs of ``MINIMISER`` words. Consecutive windows that share
it travel as one packed string (their words, joined) to the bucket of that minimiser, where sorting the windows
counts them exactly. Equal windows have equal minimisers, so every copy of a window is met in its bucket.

- A first pass counts minimisers. Strings whose minimiser occurs once cannot hold a repeated window and stay
  where they are; a Bloom filter of fixed size tells which (its mistakes send a string that need not go).
- A minimiser with more than ``HOT`` strings (a passage or copies in many documents) would make one bucket as
  large as the corpus has such documents. Its strings are counted by their 128-bit digests with map-side
  aggregation instead. All windows of a string that occurs twice are repeated; those of strings that occur once
  are counted singly, by digest, against the windows of each distinct string.
- Documents are met again by key and hash of the text, so rows with the same id are kept apart or are alike.

Cases: null and empty texts have no words; a text of fewer words than a window keeps all; the same row twice
loses all its windows in both; windows are judged on the input; an empty table gives an empty result; only key
and text are read, so other columns can have any name. A document is one row.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm import bloom
from tallymark.llm.vocabulary import send, write_shared
from tallymark.llm.words import WHITE, Words, chunks, column, map_arrow, map_partition, runs, split

WIDTH = 35
MINIMISER = 8
HOT = 2000
REPEATED_BITS, HOT_BITS = 1 << 27, 1 << 22


def window_minimisers(words: Words, width: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: the hash of its run, whether a window starts there, and the minimiser of that window (else 0)."""
    end = np.repeat(words.first[1:], np.diff(words.first))
    valid = np.arange(len(words.ids)) + width <= end
    hashes = runs(words.hashes(), size)
    least, span, have = hashes, width - size + 1, 1
    while have < span:
        step = min(have, span - have)
        least, have = np.minimum(least, np.roll(least, -step)), have + step
    return hashes, valid, np.where(valid, least, np.uint64(0))


def minimiser_places(words: Words, width: int, size: int) -> np.ndarray:
    """The minimiser at every place that is the least of some window; one that fills a string alone still counts each of its places."""
    hashes, _, least = window_minimisers(words, width, size)
    most, span, have = least, width - size + 1, 1
    while have < span:
        step = min(have, span - have)
        most, have = np.maximum(most, np.roll(most, step)), have + step
    return hashes[(hashes == most) & (most > 0)]


def super_kmers(words: Words, width: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of consecutive windows of a document with one minimiser: first window, number of windows, minimiser."""
    _, valid, least = window_minimisers(words, width, size)
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    heads = words.first[:-1][np.diff(words.first) > 0]
    fresh[heads] |= valid[heads]
    first = np.flatnonzero(fresh)
    run = np.cumsum(fresh)[valid] - 1
    return first, np.bincount(run, minlength=len(first)), least[first]


def repeated_windows(strings: dict[bytes, int], width: int) -> dict[bytes, list[int]]:
    """Of each distinct packed string with its number of copies: the windows that occur twice or more in the bucket."""
    found: dict[bytes, set[int]] = {s: set() for s in strings}
    each = []
    for string, copies in strings.items():
        ends = [-1, *(i for i, c in enumerate(string) if c == 32), len(string)]
        if copies > 1:
            found[string].update(range(len(ends) - width))
        each.extend((string[ends[i] + 1 : ends[i + width]], string, i) for i in range(len(ends) - width))
    each.sort(key=lambda x: x[0])
    for (a, s, i), (b, t, j) in zip(each, each[1:]):
        if a == b:
            found[s].add(i)
            found[t].add(j)
    return {s: sorted(places) for s, places in found.items()}


def spans(windows: list[int], start: int, width: int) -> list[tuple[int, int]]:
    """Word spans of windows in order, touching ones joined."""
    out: list[tuple[int, int]] = []
    for i in windows:
        if out and start + i <= out[-1][1]:
            out[-1] = (out[-1][0], start + i + width)
        else:
            out.append((start + i, start + i + width))
    return out


def repeated_spans(docs: DataFrame, key: str, text: str, width: int, size: int, hot: int) -> DataFrame:
    """Per document with any: ``_key``, ``_hash``, ``_spans`` (word spans covered by repeated windows, in no order)."""
    spark = docs.sparkSession
    picked = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    kind = picked.schema["_key"].dataType.simpleString()

    def count(batch):
        for _, texts in chunks(column(batch, "_text")):
            minimisers, n = np.unique(minimiser_places(split(texts, WHITE, named=False), width, size), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(minimisers.view(np.int64)), pa.array(n)], ["mini", "n"])

    counted = write_shared(map_arrow(picked.select("_text"), count, "mini long, n long").groupBy("mini").agg(F.sum("n").alias("n")).filter("n > 1"), "minimisers")
    sent = send(spark, (bloom.build(counted.select("mini"), REPEATED_BITS), bloom.build(counted.filter(F.col("n") > hot).select("mini"), HOT_BITS)))

    def pack(batch):
        repeated, many = sent.value
        for at, texts in chunks(column(batch, "_text")):
            words = split(texts, WHITE)
            first, n, minimiser = super_kmers(words, width, size)
            go = bloom.contains(repeated, minimiser)
            first, n, minimiser = first[go], n[go], minimiser[go]
            crowded = bloom.contains(many, minimiser)
            document = np.searchsorted(words.first, first, "right") - 1
            names, ids = words.names.to_pylist(), words.ids
            held = [[], [], [], [], [], []]  # hot, bucket, packed, document, start, windows
            for a, k, m, d, alone in zip(first.tolist(), n.tolist(), minimiser.view(np.int64).tolist(), document.tolist(), crowded.tolist()):
                string = [names[i] for i in ids[a : a + k + width - 1].tolist()]
                start = a - int(words.first[d])
                for column_, value in zip(held, (alone, m, b" ".join(string), at + d, start, k)):
                    column_.append(value)
            rows = pa.array(held[3], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(held[0], pa.bool_()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.binary()), batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(x, pa.int32()) for x in held[4:])],
                ["hot", "bucket", "packed", "_key", "_hash", "start", "windows"],
            )

    packed = write_shared(map_arrow(picked, pack, f"hot boolean, bucket long, packed binary, _key {kind}, _hash long, start int, windows int"), "super-kmers", compression="zstd")

    def sort(batches):
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        held: list[list] = [[], [], [], []]
        for _, group in groupby(rows(), key=lambda r: r[0]):
            group = list(group)
            if len(group) < 2 and group[0][1].count(b" ") < width:
                continue
            copies: dict[bytes, int] = {}
            for r in group:
                copies[r[1]] = copies.get(r[1], 0) + 1
            found = repeated_windows(copies, width)
            for _, string, doc, text_hash, start in group:
                for a, b in spans(found[string], start, width):
                    for column_, value in zip(held, (doc, text_hash, a, b)):
                        column_.append(value)
            if len(held[0]) > 20_000:
                yield batch_of(held)
                held = [[], [], [], []]
        yield batch_of(held)

    arrow_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def batch_of(held):
        return pa.RecordBatch.from_arrays([pa.array(held[0], arrow_kind), pa.array(held[1], pa.int64()), pa.array(held[2], pa.int32()), pa.array(held[3], pa.int32())], ["_key", "_hash", "begin", "end"])

    buckets = packed.filter(~F.col("hot")).select("bucket", "packed", "_key", "_hash", "start").repartition("bucket").sortWithinPartitions("bucket")
    cold = map_partition(buckets, sort, f"_key {kind}, _hash long, begin int, end int")
    strings = packed.filter("hot").select(F.unhex(F.md5("packed")).alias("digest"), "packed", "_key", "_hash", "start", "windows")
    place = F.struct("_key", "_hash", "start")
    known = strings.groupBy("digest").agg(F.count("*").alias("copies"), F.min("packed").alias("packed"), F.min(place).alias("_place"))
    several = strings.join(known.filter("copies > 1").select("digest"), "digest")
    whole = several.select("_key", "_hash", F.col("start").alias("begin"), (F.col("start") + F.col("windows") + width - 1).alias("end"))

    def windows(batch):
        held = [[], [], [], [], []]  # digest, copies, key, hash, start
        for copies, string, doc, text_hash, start in zip(*(c.to_pylist() for c in batch.columns)):
            words = string.split(b" ")
            for i in range(len(words) - width + 1):
                for column_, value in zip(held, (hashlib.md5(b" ".join(words[i : i + width])).digest(), copies, doc, text_hash, start + i)):
                    column_.append(value)
        kinds = [pa.binary(), pa.int64(), arrow_kind, pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(held, kinds)], ["window", "copies", "_key", "_hash", "begin"])

    each = known.select("copies", "packed", "_place.*")
    each = write_shared(map_arrow(each, windows, f"window binary, copies long, _key {kind}, _hash long, begin int"), "hot-windows")
    twice = each.groupBy("window").agg(F.sum("copies").alias("copies")).filter("copies > 1").select("window")
    single = each.filter("copies = 1").join(twice, "window").select("_key", "_hash", "begin", (F.col("begin") + width).alias("end"))
    warm = whole.unionByName(single)
    return cold.unionByName(warm).groupBy("_key", "_hash").agg(F.collect_set(F.struct("begin", "end")).alias("_spans"))


def removed(count: int, found) -> np.ndarray:
    edge = np.zeros(count + 1, np.int64)
    for s in found or ():
        edge[s["begin"]] += 1
        edge[s["end"]] -= 1
    return np.cumsum(edge)[:count] > 0


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, size: int = MINIMISER, hot: int = HOT) -> DataFrame:
    """Per document: key, n_words, n_removed, kept (its remaining words, joined by one space)."""
    found = repeated_spans(docs, key, text, width, size, hot)
    picked = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_text_hash"), F.col(text).alias("_text"))
    joined = picked.join(found, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_text_hash") == F.col("_hash")), "left").select("_id", "_text", "_spans")

    def rows(batch):
        for at, texts in chunks(column(batch, "_text")):
            kept, n, cut = [], [], []
            for whole, found in zip(texts.to_pylist(), batch.column(2).slice(at, len(texts)).to_pylist()):
                words = whole.encode().split()
                gone = removed(len(words), found)
                n.append(len(words))
                cut.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if cut[-1] else words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [key, "n_words", "n_removed", "kept"]
            )

    return map_arrow(joined, rows, f"{key} {docs.schema[key].dataType.simpleString()}, n_words long, n_removed long, kept string")
