"""BPE with content-defined chunk reuse: chunks that documents share are encoded once, and the joins of chunks are repaired.

A rolling hash over ``WINDOW`` bytes cuts each text where its value says so, so that equal passages get equal
chunks wherever they stand. A first pass counts the chunks' digests. Chunks found once are encoded where they are
read, a run of them in one piece; chunks found again go to a table of distinct chunks, each encoded once, and come back
to their documents by digest. Documents that share nothing are finished in the first place and are never shuffled.

A chunk that ends within a word has other tokens there than the whole text. So of every piece, the words at its
edges (before its first and after its last blank) stay open. Pieces are joined by re-encoding the open edges that
meet, and where a piece has no blank at all, on through it to the next, until a blank bounds the window on either
side: from there on the pieces' tokens and those of the whole text agree exactly, as this kind of tokenizer never
looks past a blank (``agrees_at_blanks`` refuses others). Tests compare with the library on whole texts.

What chunks are shared is told to the scan by a Bloom filter of fixed size: a chunk that it takes for shared by
mistake is encoded in the table as well. A document is put together in one task; memory follows the longest one.

Cases: a null or empty text has no tokens and decodes to no text; texts with special strings get their ids, as the
library's default has it; equal rows, null ids and repeated ids are each encoded; an empty table gives an empty
result; only key and text are read, so other columns can have any name.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallymark.llm import bloom
from tallymark.llm import vocabulary as V
from tallymark.llm.words import chunks, column, give_back, map_arrow, map_partition, mix, raw

WINDOW, LEAST, MOST, MASK = 16, 128, 4096, 511  #: bytes; about MASK bytes between two cuts
BITS = 1 << 27
BLANKS = [b" ", b"\n", b"\t", b"\r", b"\v", b"\f"]
BLANK = re.compile(rb"[ \n\t\r\v\f]")
REMEMBERED, LONGEST_REMEMBERED = 200_000, 64  #: words of a worker, beside those of the batch at hand, and bytes of one
SEEN = 200_000  #: digests of contents that a task has sent already

GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


# --- chunks ------------------------------------------------------------------------------------------------------


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Of each text, where its chunks end, in bytes of the whole column; the last one is the end of the text."""
    rolled = np.zeros(len(data), np.uint32)
    for k in range(min(WINDOW, len(data))):
        rolled[k:] += GEAR[data[: len(data) - k]] << np.uint32(k)
    head = np.append((data & 0xC0) != 0x80, True)
    found = np.flatnonzero((rolled >> np.uint32(20)) & np.uint32(MASK) == 0) + 1
    while len(back := found[~head[found]]):  # not within a character
        found[~head[found]] = back + 1
    places = found.tolist()
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        ends, at = [], a
        while b - at > LEAST:
            i = bisect.bisect_left(places, at + LEAST)
            end = places[i] if i < len(places) else b
            if end > at + MOST:
                end = at + MOST
                while not head[end]:
                    end += 1
            if end >= b:
                break
            ends.append(end)
            at = end
        out.append([*ends, b] if b > a else [])
    return out


def digests_of(data: memoryview, first: int, ends: list[int]) -> list[bytes]:
    return [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip([first, *ends[:-1]], ends)]


def edges(piece: bytes) -> tuple[bytes, bytes, bytes, bool]:
    """Before the first blank, from there to the last one, after it; and whether there is no blank at all."""
    found = BLANK.search(piece)
    if found is None:
        return piece, b"", b"", True
    first, last = found.start(), max(piece.rfind(c) for c in BLANKS) + 1
    return piece[:first], piece[first:last], piece[last:], False


# --- encoding inside tasks -----------------------------------------------------------------------------------------


class Encoder:
    """A worker's encoder: pieces through the words they are made of, of which it remembers a bounded number."""

    def __init__(self, path: str):
        self.path = path
        self.known: dict[bytes, bytes] = {}
        size = V.tokenizer(path).get_vocab_size(with_added_tokens=True)
        tokens = [V.tokenizer(path).id_to_token(i) or "" for i in range(size)]
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.shown = pa.array(tokens, pa.large_string()).cast(pa.large_binary())
        self.decimal = pa.array([str(i) for i in range(size)], pa.large_string()).cast(pa.large_binary())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (or pieces that blanks bound), one after the other, and where each one ends."""
        words, direct = V.pretokens_of(texts, self.path)
        names = words.names.cast(pa.large_binary()).to_pylist()
        known = self.known
        for name in names:
            if name not in known:
                known[name] = np.array(V.ids_of(name, self.path), self.kind).tobytes()
        lists = [known[name] for name in names]
        if len(known) > REMEMBERED:
            often = np.flatnonzero(np.bincount(words.ids, minlength=len(names)) > 1).tolist()[:REMEMBERED]
            self.known = {names[i]: lists[i] for i in often if len(names[i]) <= LONGEST_REMEMBERED}
        width = self.kind.itemsize
        size = np.fromiter(map(len, lists), np.int64, len(lists)) // width
        flat = np.frombuffer(b"".join(lists), self.kind)
        begin = np.cumsum(size) - size
        per = size[words.ids]
        ends = np.concatenate([[0], np.cumsum(per)])
        ids = flat[np.arange(ends[-1]) + np.repeat(begin[words.ids] - ends[:-1], per)]
        bounds = ends[words.first]
        if direct:
            parts = [np.array(direct[i], self.kind) if i in direct else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            return joined(parts, self.kind)
        return ids, bounds


def joined(parts: list[np.ndarray], kind) -> tuple[np.ndarray, np.ndarray]:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), ends


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def sha(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t).hexdigest() for t in texts.cast(pa.large_binary()).to_pylist()], pa.string())


def text_of(ids: np.ndarray, ends: np.ndarray, names: pa.Array) -> pa.Array:
    """The names of the ids of each run, joined by one blank."""
    lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), names.take(pa.array(ids.astype(np.int32))))
    return pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))


def as_digests(path: str, ids: np.ndarray, ends: np.ndarray) -> dict[str, pa.Array]:
    own = encoder(path)
    return {"n_tokens": pa.array(np.diff(ends)), "ids_sha256": sha(text_of(ids, ends, own.decimal)), "decoded_sha256": sha(text_of(ids, ends, own.shown))}


def as_ids(path: str, ids: np.ndarray, ends: np.ndarray) -> dict[str, pa.Array]:
    return {"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))}


DIGESTS, IDS = "n_tokens long, ids_sha256 string, decoded_sha256 string", "ids array<int>"


# --- the steps -----------------------------------------------------------------------------------------------------


def agrees_at_blanks(path: str) -> bool:
    """Does the tokenizer give the same ids when a text is cut at blanks? Probed with the classes of its pattern."""
    t = V.tokenizer(path)
    probes = ["a b", "it 's I 'm", "1 2 34 5", "! ? ...", "a  b", "x \n y", "é ́ é İ", "A\tB", "<|endoftext|> a", "don 't 'll", "a1 !b"]
    ids = lambda text: t.encode(text, add_special_tokens=False).ids
    for probe in probes:
        for i, c in enumerate(probe):
            if c in " \t\n" and not ids(probe) == ids(probe[:i]) + ids(probe[i:]) == ids(probe[: i + 1]) + ids(probe[i + 1 :]):
                return False
    return True


def counted(texts: DataFrame) -> DataFrame:
    """``digest`` of every chunk that stands in the corpus twice or more."""

    def rows(batch):
        for _, some in chunks(column(batch, "text")):
            data, offsets = raw(some)
            view = memoryview(np.ascontiguousarray(data))
            times: dict[bytes, int] = {}
            for first, ends in zip(offsets[:-1].tolist(), cuts(data, offsets)):
                for digest in digests_of(view, first, ends):
                    times[digest] = times.get(digest, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(times), pa.binary()), pa.array(list(times.values()), pa.int64())], ["digest", "n"])

    every = map_arrow(texts.select("text"), rows, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    return every.filter("n > 1").select("digest")


def filter_of(shared: DataFrame):
    def rows(batch):
        yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(d[:8], "little", signed=True) for d in batch.column(0).to_pylist()], pa.int64())], ["h"])

    return V.send(shared.sparkSession, bloom.build(map_arrow(shared, rows, "h long"), BITS))


#: What the second pass writes: whole documents (key, result), pieces of others (part, row, seq; own ones with ids and
#: edges, shared ones with a digest), and contents of shared chunks (digest, content).
PIECE = "part int, row long, seq int, digest binary, head binary, ids binary, tail binary, solid boolean, content binary"
PIECE_NAMES = [f.split()[0] for f in PIECE.split(", ")]


def scanned(docs: DataFrame, shared, path: str, kind: str, result: Callable, schema: str) -> DataFrame:
    result_names = [f.split()[0] for f in schema.split(", ")]
    names = ["key", *PIECE_NAMES, *result_names]

    def partition(batches):
        part, row, seen = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            keys = batch.column(0)
            for at, texts in chunks(column(batch, "text")):
                data, offsets = raw(texts)
                view = memoryview(np.ascontiguousarray(data))
                ends = cuts(data, offsets)
                found = [digests_of(view, first, e) for first, e in zip(offsets[:-1].tolist(), ends)]
                flat = np.frombuffer(b"".join(d for some in found for d in some), "<u8")[::2]
                hits = bloom.contains(shared.value, flat) if len(flat) else np.zeros(0, bool)
                whole, pieces, spans, contents = [], [], [], []
                place = 0
                for i, digests in enumerate(found):
                    own = hits[place : place + len(digests)]
                    place += len(digests)
                    if not own.any():
                        whole.append(i)
                        continue
                    begin, seq, run = int(offsets[i]), 0, int(offsets[i])
                    for digest, end, again in zip(digests, ends[i], own.tolist()):
                        if again:
                            if run < begin:
                                pieces.append((i, seq, None))
                                spans.append((run, begin))
                                seq += 1
                            pieces.append((i, seq, digest))
                            seq, run = seq + 1, end
                            if digest not in seen:
                                if len(seen) >= SEEN:
                                    seen.clear()
                                seen.add(digest)
                                contents.append((digest, bytes(view[begin:end])))
                        begin = end
                    if run < begin:
                        pieces.append((i, seq, None))
                        spans.append((run, begin))
                own_keys = keys.slice(at, len(texts))
                if whole:
                    ids, bounds = encoder(path).encode(texts.take(pa.array(whole)))
                    yield filled({"key": own_keys.take(pa.array(whole)), **result(path, ids, bounds)}, len(whole))
                if pieces:
                    parted = [edges(bytes(view[a:b])) for a, b in spans]
                    inner = iter(packed(parted, path))
                    outer = iter(parted)
                    cells = [(*((e[0], next(inner), e[2], e[3]) if d is None and (e := next(outer)) is not None else (None,) * 4),) for _, _, d in pieces]
                    head, ids, tail, solid = zip(*cells)
                    which = pa.array([p[0] for p in pieces])
                    yield filled(
                        {
                            "key": own_keys.take(which),
                            "part": pa.array(np.full(len(pieces), part, np.int32)),
                            "row": pa.array(np.array([row + p[0] for p in pieces], np.int64)),
                            "seq": pa.array([p[1] for p in pieces], pa.int32()),
                            "digest": pa.array([p[2] for p in pieces], pa.binary()),
                            "head": pa.array(head, pa.binary()),
                            "ids": pa.array(ids, pa.binary()),
                            "tail": pa.array(tail, pa.binary()),
                            "solid": pa.array(solid, pa.bool_()),
                        },
                        len(pieces),
                    )
                if contents:
                    yield filled({"digest": pa.array([c[0] for c in contents], pa.binary()), "content": pa.array([c[1] for c in contents], pa.binary())}, len(contents))
                row += len(texts)
        give_back()

    def filled(columns: dict, n: int) -> pa.RecordBatch:
        types = {"key": key_type, "part": pa.int32(), "row": pa.int64(), "seq": pa.int32(), "solid": pa.bool_(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
        if schema == IDS:
            types["result_ids"] = pa.list_(pa.int32())
        renamed = {("result_ids" if k == "ids" and pa.types.is_list(v.type) else k): v for k, v in columns.items()}
        arrays = [renamed.get(name, None) for name in out_names]
        return pa.RecordBatch.from_arrays([a if a is not None else pa.nulls(n, types.get(name, pa.binary())) for a, name in zip(arrays, out_names)], out_names)

    key_type = to_arrow_type(docs.schema["key"].dataType)
    out_names = [n if n != "ids" or i < len(PIECE_NAMES) + 1 else "result_ids" for i, n in enumerate(names)]
    out = f"key {kind}, {PIECE}, " + (schema if schema != IDS else "result_ids array<int>")
    return map_partition(docs, partition, out)


def packed(parted: list[tuple], path: str) -> list[bytes]:
    """The ids of the inner parts of pieces, as bytes."""
    own = encoder(path)
    ids, ends = own.encode(pa.array([p[1].decode() for p in parted], pa.large_string()))
    whole, width = ids.tobytes(), own.kind.itemsize
    return [whole[a * width : b * width] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def encoded(contents: DataFrame, path: str) -> DataFrame:
    """Every distinct shared chunk, encoded once: digest, head, ids, tail, solid."""

    def rows(batch):
        for at in range(0, batch.num_rows, 5000):
            some = batch.slice(at, 5000)
            parted = [edges(c) for c in some.column(1).to_pylist()]
            columns = [some.column(0), *(pa.array(x, pa.binary()) for x in ([p[0] for p in parted], packed(parted, path), [p[2] for p in parted]))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([p[3] for p in parted], pa.bool_())], ["digest", "head", "ids", "tail", "solid"])

    one = contents.groupBy("digest").agg(F.first("content").alias("content"))
    return map_arrow(one, rows, "digest binary, head binary, ids binary, tail binary, solid boolean")


def assembled(pieces: DataFrame, path: str, kind: str, result: Callable, schema: str) -> DataFrame:
    """Documents from their pieces: open edges that meet are encoded anew, from blank to blank."""

    def partition(batches):
        at, key, open_, parts, ready, size = None, None, b"", [], [], 0
        own = encoder(path)
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("part", "row", "head", "ids", "tail", "solid")]
            keys = batch.column(0)
            for i, (part, row, head, ids, tail, solid) in enumerate(zip(*(c.to_pylist() for c in columns))):
                if (part, row) != at:
                    if at is not None:
                        ready.append((key, [*parts, open_]))
                        if size > 8 << 20 or len(ready) >= 5000:
                            yield finished(own, ready)
                            ready, size = [], 0
                    at, key, open_, parts = (part, row), keys.slice(i, 1), b"", []
                open_ += head
                if not solid:
                    parts += [open_, ids]
                    open_ = tail
                    size += len(ids)
        if at is not None:
            ready.append((key, [*parts, open_]))
            yield finished(own, ready)
        give_back()

    def finished(own: Encoder, ready: list) -> pa.RecordBatch:
        windows = [w.decode() for _, parts in ready for w in parts[::2]]
        ids, ends = own.encode(pa.array(windows, pa.large_string()))
        bounds = ends.tolist()
        place, docs = 0, []
        for _, parts in ready:
            run = []
            for k, part in enumerate(parts):
                if k % 2:
                    run.append(np.frombuffer(part, own.kind))
                else:
                    run.append(ids[bounds[place] : bounds[place + 1]])
                    place += 1
            docs.append(np.concatenate(run))
        keys = pa.concat_arrays([k for k, _ in ready])
        columns = result(path, *joined(docs, own.kind))
        return pa.RecordBatch.from_arrays([keys, *columns.values()], ["key", *columns])

    ordered = pieces.repartition("part", "row").sortWithinPartitions("part", "row", "seq")
    return map_partition(ordered, partition, f"key {kind}, {schema}")


def _run(docs: DataFrame, key: str, text: str, path: str | None, result: Callable, schema: str) -> DataFrame:
    path = path or V.default_path()
    if not agrees_at_blanks(path):
        raise ValueError("the tokenizer's tokens depend on what stands beyond a blank")
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema["key"].dataType.simpleString()
    shared = filter_of(V.write_shared(counted(docs), "shared-chunks"))
    table = V.write_shared(scanned(docs, shared, path, kind, result, schema), "pieces", compression="zstd")
    names = [f.split()[0] for f in schema.split(", ")]
    stored = ["result_ids" if schema == IDS else n for n in names]
    whole = table.filter("part is null and content is null").select("key", *stored).toDF("key", *names)
    contents = encoded(table.filter("content is not null").select("digest", "content"), path)
    fields = ["key", "part", "row", "seq", "head", "ids", "tail", "solid"]
    own = table.filter("part is not null and digest is null").select(*fields)
    refs = table.filter("part is not null and digest is not null").select("key", "part", "row", "seq", "digest")
    pieces = own.unionByName(refs.join(contents, "digest").select(*fields))
    return whole.union(assembled(pieces, path, kind, result, schema)).withColumnRenamed("key", key)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per document: key, ids."""
    return _run(docs, key, text, path, as_ids, IDS)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per document: key, n_tokens, and digests of its ids and of the text that they decode to."""
    return _run(docs, key, text, path, as_digests, DIGESTS)


def decode(coded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Per document: key, text (its tokens joined by one blank, as the library decodes without a decoder); null ids give an empty text."""
    path = path or V.default_path()

    def rows(batch):
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            lists = some.column(1).cast(pa.list_(pa.int32())).fill_null([])
            ends = lists.offsets.to_numpy()
            text = text_of(lists.flatten().to_numpy(), (ends - ends[0]).astype(np.int64), encoder(path).shown)
            yield pa.RecordBatch.from_arrays([some.column(0), text.cast(pa.string())], [key, "text"])

    picked = coded.select(key, ids)
    return map_arrow(picked, rows, f"{key} {picked.schema[key].dataType.simpleString()}, text string")
