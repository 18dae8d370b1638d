"""Jaccard self-join of documents on word shingles, by prefixes with token combinations for frequent tokens.

Documents with equal shingle sets are one node. Tokens (shingle hashes) are ordered by class, each class by hash: those
met in one set first, then rare ones, then frequent ones (met in ``FREQUENT`` sets or more). So a set with enough tokens
of its own has no others in its prefix, and indexes nothing. Two sets that link share a token of their prefixes, and two
if the prefixes are one longer:

- if their first shared token is rare, both index it singly;
- if not, all shared tokens are frequent, and they share a pair of frequent tokens of their extended prefixes. Sets
  with at most ``MOST_FREQUENT`` frequent tokens there index pairs; the few with more (sets that consist of
  frequent tokens, as those of large groups of copies do) would have too many pairs and are met by single ones.

A first pass counts all tokens (by 40 bits, sorted and packed by their top bits, so that they take few bytes); each
class is told by a Bloom filter of fixed size. What a filter lets through by mistake is of a higher class for every set
alike, so the order stays one and the result exact.

No group is expanded into all its pairs: each member is paired with the least of its group and verified exactly.
Before whole sets are fetched, a pair must pass a bound from parity bitmaps: each differing bit needs a token that
only one of the two sets has.
Those links make components. Groups whose members are in one component are done. In the others, members of different
components are compared inside the task by sizes, places and bitmaps of a bit a token, which travel with
them; only pairs that pass all three bounds are written (as 64-bit references, packed by their first half and each
once per task) and verified: first the few that would join a group's members, then, with the new components, all that
are left between components. A large group is cut into blocks of ``SIDE`` members, and each pair of blocks is a unit
of work of its own. A reference that two sets should share only adds pairs to verify.

Cases: a null or empty text has an empty set, links with nothing and is its own component; fewer words than a
shingle make one shingle of all of them; equal rows are in one component; a null id counts as no id (its
component's least id is that of others, or null); an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm import bloom
from tallymark.llm.components import connected_components
from tallymark.llm.vocabulary import Scratch, send, write_shared
from tallymark.llm.words import LOWER, WHITE, chunks, column, map_arrow, map_partition, mix, runs, split

WIDTH, PERCENT = 5, 75
FREQUENT = 16  #: sets that a frequent token is met in, at least
MOST_FREQUENT = 24
AT_A_TIME = 8 << 20  #: bytes of texts whose sets are held together
SIDE = 2000  #: members of a block of a large group
BITS = 1 << 27
BITS_PER_TOKEN = 4  #: of a parity bitmap, about
PACKED = 2_000_000  #: prefix tokens of a bucket of the counting pass, about
NODE = "node binary, n int"


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = split(texts, WHITE, lower=True, named=False)
    hashes = words.hashes() if len(words.ids) else np.zeros(0, np.uint64)
    whole = runs(hashes, width)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        else:
            out.append(runs(hashes[a:b], b - a)[:1] + np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def node_of(tokens: np.ndarray) -> bytes | None:
    return hashlib.md5(tokens.tobytes()).digest() if len(tokens) else None


def parity(tokens: np.ndarray) -> bytes:
    """A bitmap in which every token turns one bit over; its length is a power of two that grows with the set."""
    bits = 1 << max(8, (BITS_PER_TOKEN * len(tokens) - 1).bit_length())
    turned = np.bincount(((tokens * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(turned.astype(bool)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ, the longer one folded to the other's length."""
    x, y = sorted((a, b), key=len)
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(np.frombuffer(y, np.uint8).reshape(-1, len(x))).tobytes()
    return (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` shares with any set that it links with."""
    return -(-percent * n // 100)


LOW = np.uint64((1 << 40) - 1)


def prefix(tokens: np.ndarray, kinds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rare tokens of the prefix and their places, frequent tokens of the prefix, frequent tokens of the prefix longer by one.

    ``kinds``: 0 for tokens met in one set, which are left out, 1 for rare and 2 for frequent ones.
    """
    order = np.argsort(kinds, kind="stable")
    size = len(tokens) - least_overlap(len(tokens), percent) + 1
    first, longer = order[:size], order[: size + 1]
    places = np.flatnonzero(kinds[first] == 1)
    return tokens[first[places]], places, tokens[first[kinds[first] == 2]], tokens[longer[kinds[longer] == 2]]


def fold(bitmap: bytes, n: int) -> bytes:
    """A bitmap brought down to about a bit for each of ``n`` tokens."""
    size = 1 << max(5, (n - 1).bit_length() - 3)
    return np.bitwise_xor.reduce(np.frombuffer(bitmap, np.uint8).reshape(-1, size)).tobytes() if len(bitmap) > size else bitmap


def bits_apart(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Bits in which one bitmap (of a power of two of bytes) differs from each of others, those folded to their common length."""
    width = min(len(one), others.shape[1])
    a = np.bitwise_xor.reduce(one.reshape(-1, width)) if len(one) > width else one
    b = np.bitwise_xor.reduce(others.reshape(len(others), -1, width), axis=1) if others.shape[1] > width else others
    return np.bitwise_count(b ^ a).sum(1, dtype=np.int64)


def pair_keys(frequent: np.ndarray) -> np.ndarray:
    """One key per pair of frequent tokens."""
    pairs = np.array(list(combinations(range(len(frequent)), 2)), np.int64).reshape(-1, 2)
    return mix(mix(frequent[pairs[:, 0]]) + frequent[pairs[:, 1]])


class Join:
    """One self-join; its steps share the documents and the parameters."""

    def __init__(self, docs: DataFrame, key: str, text: str, width: int, percent: int):
        self.docs, self.width, self.percent = docs.select(F.col(key).alias("key"), F.col(text).alias("text")), width, percent
        self.kind = self.docs.schema["key"].dataType.simpleString()
        self.scratch = Scratch(docs.sparkSession)

    def each(self, rows, schema: str) -> DataFrame:
        """``rows(nodes, sets)`` over the distinct sets of every batch, some megabytes of texts at a time."""
        width = self.width

        def batchwise(batch):
            seen: set[bytes] = set()
            for _, texts in chunks(column(batch, "text"), AT_A_TIME):
                part: dict[bytes, np.ndarray] = {}
                for tokens in shingle_sets(texts, width):
                    node = node_of(tokens)
                    if node is not None and node not in seen:
                        part[node] = tokens
                seen.update(part)
                yield from rows(list(part), list(part.values()))

        return map_arrow(self.docs.select("text"), batchwise, schema)

    def sets(self) -> DataFrame:
        """key, hash (of the text), node, n and bitmap of every document."""
        width = self.width

        def rows(batch):
            nodes, sizes, bitmaps = [], [], []
            for _, texts in chunks(column(batch, "text")):
                for tokens in shingle_sets(texts, width):
                    nodes.append(node_of(tokens))
                    sizes.append(len(tokens))
                    bitmaps.append(parity(tokens))
            names = ["key", "hash", "node", "n", "bitmap"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bitmaps, pa.binary())], names)

        hashed = self.docs.select("key", "text", F.xxhash64("text").alias("hash"))
        return write_shared(map_arrow(hashed, rows, f"key {self.kind}, hash long, {NODE}, bitmap binary"), "sets")

    def classes(self, total: int):
        """Filters over the tokens met in two sets or more, and in ``FREQUENT`` or more."""
        parts = 256
        while parts * PACKED < total:
            parts *= 2
        width = np.uint64(40 - (parts.bit_length() - 1))

        def pack(nodes, sets):
            found = np.sort(np.concatenate([t & LOW for t in sets])) if sets else np.zeros(0, np.uint64)
            place = (found >> width).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
            # Byte by byte, so that the leading bytes of sorted tokens compress away.
            planes = [part.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].T.tobytes() for part in np.split(found, first[1:])] if len(first) else []
            yield pa.RecordBatch.from_arrays([pa.array(place[first].astype(np.int32)), pa.array(planes, pa.binary())], ["part", "planes"])

        def count(batches):
            held: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for place, planes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if place not in held:
                        yield from again_in(held)
                        held = {place: []}
                    wide = np.zeros((len(planes) // 5, 8), np.uint8)
                    wide[:, 3:] = np.frombuffer(planes, np.uint8).reshape(5, -1).T
                    held[place].append(wide.view(">u8").ravel().astype(np.uint64))
            yield from again_in(held)

        def again_in(held):
            for parts_ in held.values():
                tokens, times = np.unique(np.concatenate(parts_), return_counts=True)
                again = times > 1
                yield pa.RecordBatch.from_arrays([pa.array(mix(tokens[again]).view(np.int64)), pa.array(times[again] >= FREQUENT)], ["token", "frequent"])

        packed = self.each(pack, "part int, planes binary").repartition("part").sortWithinPartitions("part")
        again = self.scratch.write(map_partition(packed, count, "token long, frequent boolean"), "tokens")
        spark = self.docs.sparkSession
        filters = [send(spark, bloom.build(some.select("token"), BITS)) for some in (again, again.filter("frequent"))]
        self.scratch.drop("tokens")
        return filters

    def groups(self, again, often) -> DataFrame:
        """Index rows: kind (0 rare token, 1 pair, 2 frequent token), token, node, n, pos (in the prefix), big."""
        percent = self.percent

        def index(nodes, sets):
            kinds, tokens, places, big, at = [], [], [], [], []
            hashed = mix(np.concatenate(sets) & LOW) if sets else np.zeros(0, np.uint64)
            met = bloom.contains(again.value, hashed)
            every = met.astype(np.int8)
            every[met] += bloom.contains(often.value, hashed[met])
            ends = np.cumsum([len(t) for t in sets])
            for i, t in enumerate(sets):
                rare, placed, frequent, longer = prefix(t, every[ends[i] - len(t) : ends[i]], percent)
                many = len(longer) > MOST_FREQUENT
                pairs = pair_keys(longer) if len(longer) > 1 and not many else np.zeros(0, np.uint64)
                for kind, some in enumerate((rare, pairs, frequent)):
                    at.append(placed if kind == 0 else np.zeros(len(some), np.int64))
                    tokens.append(some)
                    kinds.append(np.full(len(some), kind, np.int8))
                    places.append(np.full(len(some), i))
                    big.append(np.full(len(some), many))
            if not sets:
                return
            place = pa.array(np.concatenate(places))
            n = pa.array([len(t) for t in sets], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(kinds)), pa.array(np.concatenate(tokens).view(np.int64)), pa.array(nodes, pa.binary()).take(place), n.take(place), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(big))],
                ["kind", "token", "node", "n", "pos", "big"],
            )

        return self.scratch.write(self.each(index, f"kind byte, token long, {NODE}, pos int, big boolean"), "index", compression="zstd")

    def paired(self, index: DataFrame) -> DataFrame:
        """Index rows of groups of two nodes or more, each with the least node of its group (a big one, for frequent tokens)."""
        rare = index.filter("kind = 0").repartition("token").sortWithinPartitions("token", "node")

        def shared(batches):
            left = None
            for batch in batches:
                table = pa.Table.from_batches([batch] if left is None else [*left.to_batches(), batch])
                token = table.column("token").to_numpy()
                cut = int(np.searchsorted(token, token[-1])) if len(token) else 0
                yield from least(table.slice(0, cut), token[:cut])
                left = table.slice(cut)
            if left is not None:
                yield from least(left, left.column("token").to_numpy())

        def least(table, token):
            if not len(token):
                return
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(start, len(token)))
            nodes = table.column("node").combine_chunks()
            several = np.array([nodes[a].as_py() != nodes[a + s - 1].as_py() if s > 1 else False for a, s in zip(start.tolist(), size.tolist())], bool)
            keep = np.flatnonzero(np.repeat(several, size))
            head = np.repeat(start, size)[keep]
            first = pa.array(head)
            out = table.take(pa.array(keep)).append_column("pivot", nodes.take(first))
            out = out.append_column("pivot_n", table.column("n").take(first)).append_column("pivot_pos", table.column("pos").take(first))
            yield from out.combine_chunks().to_batches()

        fields = f"kind byte, token long, {NODE}, pos int, big boolean, pivot binary, pivot_n int, pivot_pos int"
        first = map_partition(rare, shared, fields)
        often = index.filter("kind > 0")
        candidate = F.when((F.col("kind") == 1) | F.col("big"), F.struct("node", "n"))
        pivots = often.groupBy("kind", "token").agg(F.min(candidate).alias("_pivot"), F.min("node").alias("_a"), F.max("node").alias("_b")).filter("_pivot is not null and _a <> _b")
        second = often.join(pivots, ["kind", "token"]).select("kind", "token", "node", "n", "pos", "big", F.col("_pivot.node").alias("pivot"), F.col("_pivot.n").alias("pivot_n"), F.lit(0).alias("pivot_pos"))
        groups = self.scratch.write(first.unionByName(second), "groups", compression="zstd")
        self.scratch.drop("index")
        return groups

    def verified(self, pairs: DataFrame, bitmaps: DataFrame) -> DataFrame:
        """Of distinct pairs (u, v) of references, the pairs of nodes that link, by their whole sets; most others end at the bound from their bitmaps.

        One text of each node in question is split into words again; a filter over the texts' hashes spares the others.
        """
        percent = self.percent
        known = bitmaps.groupBy("node").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap")).withColumn("ref", F.xxhash64("node"))
        left, right = known.toDF("left", "n", "a", "u"), known.toDF("right", "m", "b", "v")
        near = pairs.join(left, "u").join(right, "v").filter("left <> right")
        near = near.select(F.least("left", "right").alias("u"), F.greatest("left", "right").alias("v"), "n", "m", "a", "b")

        def possible(batch):
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3))
            apart = np.array([differing(a, b) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64)
            both = (n + m - apart) // 2
            kept = batch.filter(pa.array(100 * both >= percent * (n + m - both), pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], ["u", "v"])

        pairs = self.scratch.write(map_arrow(near, possible, "u binary, v binary"), "pairs")

        width = self.width

        def whole(batch):
            for _, part in chunks_of(batch, bloom.contains(some.value, batch.column(1).to_numpy().view(np.uint64))):
                sets = shingle_sets(part, width)
                yield pa.RecordBatch.from_arrays([pa.array([node_of(t) for t in sets], pa.binary()), pa.array([t.tobytes() for t in sets], pa.binary())], ["node", "tokens"])

        def chunks_of(batch, keep):
            return chunks(column(batch.filter(pa.array(keep, pa.bool_())), "text"))

        wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        texts = wanted.join(bitmaps.select("node", "hash"), "node").groupBy("node").agg(F.min("hash").alias("hash")).select("hash")
        some = send(self.docs.sparkSession, bloom.build(texts, BITS))
        hashed = self.docs.select("text", F.xxhash64("text").alias("hash"))
        sets = map_arrow(hashed, whole, "node binary, tokens binary").filter("node is not null").groupBy("node").agg(F.first("tokens").alias("tokens"))

        def compare(batch):
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], ["u", "v"])

        left = pairs.join(sets.toDF("u", "left"), "u")
        both = left.join(sets.toDF("v", "right"), "v").select("u", "v", "left", "right")
        links = self.scratch.write(map_arrow(both, compare, "u binary, v binary"), "links")
        self.scratch.drop("pairs")
        return links

    def may_link(self, n: str, m: str, pos: str = "0", other: str = "0"):
        """Can sets of these sizes link, if the first token they share stands at these places?"""
        # Products of sizes pass 32 bits.
        n, m, pos, other = (F.expr(x).cast("long") for x in (n, m, pos, other))
        room = F.least(n - pos, m - other)
        return (100 * F.least(n, m) >= self.percent * F.greatest(n, m)) & ((100 + self.percent) * room >= self.percent * (n + m))

    def open_pairs(self, labelled: DataFrame, bitmaps: DataFrame, spanning: bool = False) -> DataFrame:
        """Pairs of references (u, v) of groups whose members are in different components, those that no bound excludes, each once.

        With ``spanning`` only as many of them as would join a unit's members if all linked, the most alike ones first.
        """
        percent = self.percent
        keys = ["kind", "token"]
        open_groups = labelled.groupBy(*keys).agg(F.min("label").alias("_a"), F.max("label").alias("_b"), F.count("*").alias("members")).filter("_a <> _b")
        one = bitmaps.groupBy("node").agg(F.first("bitmap").alias("bitmap"))
        rows = labelled.join(open_groups.select(*keys, "members"), keys).join(one, "node")
        # Members fall into blocks; every pair of blocks, a block with itself included, is worked through by one task.
        blocks = F.ceil(F.col("members") / SIDE).cast("int")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        rows = rows.select(
            *keys,
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            "block", "n", "pos", "big", F.xxhash64("label").alias("label"), F.xxhash64("node").alias("ref"), "bitmap",
        )

        unit = [*keys, "low", "high"]

        def starts(table) -> np.ndarray:
            """Where units begin."""
            new = np.zeros(max(0, len(table) - 1), bool)
            for c in unit:
                column_ = table.column(c).to_numpy()
                new |= column_[1:] != column_[:-1]
            return np.flatnonzero(np.concatenate([[True], new])) if len(table) else np.zeros(0, np.int64)

        def cross(batches):
            left, found = None, []
            for batch in batches:
                table = pa.Table.from_batches([batch] if left is None else [*left.to_batches(), batch])
                cut = int(starts(table)[-1]) if len(table) else 0
                found.append(pairs_in(table.slice(0, cut)))
                left = table.slice(cut)
                if sum(map(len, found)) > 1_000_000:
                    yield packed(np.unique(np.concatenate(found), axis=0))
                    found = []
            if left is not None:
                found.append(pairs_in(left))
            if found:
                yield packed(np.unique(np.concatenate(found), axis=0))

        def pairs_in(table):
            start = starts(table)
            out = [np.zeros((0, 2), np.int64)]
            for a, s in zip(start.tolist(), np.diff(np.append(start, len(table))).tolist()):
                if s > 1:
                    out += pairs_of(table.slice(a, s))
            return np.concatenate(out)

        def pairs_of(part):
            """Of the members of one unit, the pairs across components that every bound allows; sets of one bitmap length at a time."""
            n, pos, label, ref, block = (part.column(c).to_numpy().astype(np.int64) for c in ("n", "pos", "label", "ref", "block"))
            big = part.column("big").to_numpy().astype(bool)
            kind, low, high = (part.column(c)[0].as_py() for c in ("kind", "low", "high"))
            maps = [np.frombuffer(fold(m, k), np.uint8) for m, k in zip(part.column("bitmap").to_pylist(), n.tolist())]
            width = np.array([len(m) for m in maps])
            by_width = {w: (np.flatnonzero(width == w), np.stack([maps[i] for i in np.flatnonzero(width == w)])) for w in np.unique(width).tolist()}
            out, joined = [], label.copy()
            for i in range(len(n)):
                if block[i] != low:
                    continue  # of two blocks, those of the first against those of the second
                for w, (others, stacked) in by_width.items():
                    good = (label[others] != label[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))
                    good &= (100 + percent) * np.minimum(n[others] - pos[others], n[i] - pos[i]) >= percent * (n[others] + n[i])
                    good &= others > i if low == high else block[others] == high
                    if kind == 2 and not big[i]:
                        good &= big[others]  # the others meet by pairs of tokens
                    some = np.flatnonzero(good)
                    if not len(some):
                        continue
                    if spanning:
                        some = some[joined[others[some]] != joined[i]]
                        if not len(some):
                            continue
                    total = n[others[some]] + n[i]
                    both = (total - bits_apart(maps[i], stacked[some])) // 2
                    fits = 100 * both >= percent * (total - both)
                    partners = others[some[fits]]
                    if spanning and len(partners):
                        # One partner for each other component, the most alike; they count as joined from here on.
                        by_likeness = np.argsort(-(both[fits] / (total[fits] - both[fits])), kind="stable")
                        partners = partners[by_likeness]
                        partners = partners[np.sort(np.unique(joined[partners], return_index=True)[1])]
                        joined[np.isin(joined, joined[partners])] = joined[i]
                    v = ref[partners]
                    if len(v):
                        out.append(np.stack([np.minimum(v, ref[i]), np.maximum(v, ref[i])], 1))
            return out

        def packed(pairs):
            first = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]])) if len(pairs) else np.zeros(0, np.int64)
            ends = (np.append(first, len(pairs)) * 8).astype(np.int64)
            many = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(pairs[:, 1]))])
            return pa.RecordBatch.from_arrays([pa.array(pairs[first, 0]), many.cast(pa.binary())], ["u", "many"])

        def merge(batches):
            at, held = None, []
            for batch in batches:
                for u, many in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if u != at and held:
                        yield unpacked(at, held)
                        held = []
                    at = u
                    held.append(many)
            if held:
                yield unpacked(at, held)

        def unpacked(u, held):
            v = np.unique(np.frombuffer(b"".join(held), np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(v), u)), pa.array(v)], ["u", "v"])

        lists = map_partition(rows.repartition(*unit).sortWithinPartitions(*unit), cross, "u long, many binary")
        return map_partition(lists.repartition("u").sortWithinPartitions("u"), merge, "u long, v long")

    def labels(self, sets: DataFrame) -> DataFrame:
        """``node``, ``label`` of every node with a link to another one."""
        total = sets.agg(F.sum("n")).first()[0] or 0
        bitmaps = sets.filter("node is not null").select("node", "n", "bitmap", "hash")
        groups = self.paired(self.groups(*self.classes(total)))

        def ordered(a: str, b: str) -> list:
            return [F.least(F.xxhash64(a), F.xxhash64(b)).alias("u"), F.greatest(F.xxhash64(a), F.xxhash64(b)).alias("v")]

        star = groups.filter("node <> pivot").filter(self.may_link("n", "pivot_n", "pos", "pivot_pos")).select(*ordered("node", "pivot")).distinct()
        star = self.scratch.write(star, "star")
        links = self.verified(star, bitmaps)
        labels = self.scratch.write(connected_components(links, self.scratch.write), "labels")
        self.scratch.drop("stars")
        tried = star
        # Pairs that would join the members of open groups, then all that are left between components.
        for spanning in (True, False):
            labelled = groups.select("kind", "token", "node", "n", "pos", "big").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            more = self.scratch.write(self.open_pairs(labelled, bitmaps, spanning).join(tried, ["u", "v"], "left_anti"), "open-pairs")
            found = self.verified(more, bitmaps)
            known = labels.select(F.col("node").alias("u"), F.col("label").alias("v"))
            labels = connected_components(known.union(found), self.scratch.write)
            labels = self.scratch.write(labels, "labels") if spanning else write_shared(labels, "labels")
            self.scratch.drop("stars")
            tried = tried.union(more)
        self.scratch.drop()
        return labels


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per document: key, ``_hash`` (of its text), n_shingles, ``_label`` (of its class; null for empty sets), component_id."""
    join = Join(docs, key, text, width, percent)
    sets = join.sets()
    labels = join.labels(sets)
    rows = sets.select("key", "hash", "node", F.col("n").cast("long").alias("n_shingles"))
    worded = rows.filter("node is not null").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = worded.groupBy("label").agg(F.min("key").alias("component_id"))
    joined = worded.join(least, "label").select("key", "hash", "n_shingles", "label", "component_id")
    empty = rows.filter("node is null").select("key", "hash", "n_shingles", F.lit(None).cast("binary").alias("label"), F.col("key").alias("component_id"))
    return joined.unionByName(empty).toDF(key, "_hash", "n_shingles", "_label", "component_id")


def keep_one_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class, that with the least id (then the least text hash), with all its columns; documents without words all stay."""
    classes = near_duplicate_classes(docs, key, text, **options)
    first = classes.filter("_label is not null").groupBy("_label").agg(F.min(F.struct(F.col(key).alias("key"), F.col("_hash").alias("hash"))).alias("_first"))
    first = first.select(F.col("_first.key").alias("_key"), F.col("_first.hash").alias("_hash"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), docs[key].alias("_id"), F.xxhash64(docs[text]).alias("_text_hash"))
    wordless = F.coalesce(F.trim(F.translate(F.col("_row")[text], "\t\n\x0b\x0c\r", " ")), F.lit("")) == ""
    kept = rows.filter(~wordless).join(first, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    # The same row may stand there twice.
    order = Window.partitionBy("_id", "_text_hash").orderBy(F.to_json("_row"))
    one = kept.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1")
    return one.select("_row").union(rows.filter(wordless).select("_row")).select("_row.*")
