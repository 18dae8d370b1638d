"""Byte-level BPE by DuckDB inside the tasks: recursive queries merge, an ordered aggregation decodes.

Each task keeps an in-memory database of its own with two tables made from the rank file: ``vocab`` and
``merges`` (every pair of tokens whose bytes together are a token; its rank is that token's id). The distinct
pre-tokens of a chunk become token-position rows; the recursive query joins neighbours with ``merges`` and
contracts the leftmost pair of least rank of every word, round by round, until no word has a pair left. Its first
member contracts all pairs of bytes at once that no earlier merge can break (``Ranks.sure``). A word that is a token
itself takes no round. Words found are remembered, those used of late, to a bounded number. Each round rewrites all
words that still change, so words of more than ``LONG_WORD`` bytes, whose rounds would be as many as their bytes,
are contracted by the same rule with a heap.

Cases: a null or empty text has no tokens and decodes to no bytes; rows with the same id are each encoded; an
empty table gives an empty result; only key and text are read, so other columns can have any name. No shuffle:
a row is encoded in the task that reads it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tallymark.llm import pretokens
from tallymark.llm.words import chunks, column, give_back, map_partition

LONG_WORD = 256
CHUNK_BYTES = 1 << 20  #: of texts encoded together: splitting them takes many times as much memory
REMEMBERED, LONGEST_REMEMBERED = 150_000, 64  #: words of each of two generations beside those of the chunk at hand, and bytes of one
NO_RANK = 1 << 40
#: Rows of one recursive query, about, and tokens of one decoding query: what keeps them within the database's memory.
ROUND_ROWS, DECODED = 1_500_000, 400_000

#: A token stands at the place of its first byte; ``after`` is the place of the next.
CONTRACT = """
WITH RECURSIVE tokens(round, word, pos, after, id) AS (
    SELECT 0, word, pos, after, id FROM start WHERE NOT gone
    UNION ALL
    SELECT round + 1, word, pos, CASE WHEN pos = hit THEN (least & 1023)::SMALLINT ELSE after END, CASE WHEN pos = hit THEN (least >> 30)::INTEGER ELSE id END
    FROM (SELECT tokens.*, least, (least >> 20) & 1023 AS hit, (least >> 10) & 1023 AS merged
          FROM tokens
          JOIN (SELECT l.word, min((merges.id::BIGINT << 30) | (l.pos::BIGINT << 20) | (r.pos::BIGINT << 10) | r.after::BIGINT) AS least
                FROM tokens AS l
                JOIN tokens AS r ON r.word = l.word AND r.pos = l.after
                JOIN merges ON merges.l = l.id AND merges.r = r.id
                GROUP BY l.word) AS best USING (word))
    WHERE pos <> merged
)
SELECT word, id
FROM tokens JOIN (SELECT word, max(round) AS round FROM tokens GROUP BY word) USING (word, round)
ORDER BY word, pos
"""

DECODE = "SELECT doc, string_agg(hex, '' ORDER BY pos) AS hex FROM ids JOIN vocab USING (id) GROUP BY doc"


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Ranks:
    """The rank file of one worker: tokens, and the pairs that make one."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        found = []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    found.append((left, right, rank))
        l, r, m = (pa.array(x, pa.int32()) for x in zip(*found))
        self.merged = {(a, b): c for a, b, c in found}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.merges = pa.table({"l": l, "r": r, "id": m})
        self.vocab = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        # Of two bytes: the rank of their token, if no merge of that token has a lower one; the least rank of any merge of a token
        # that ends in the first with the second alone; the least rank of any merge of the first alone with one that begins with the second.
        self.pairs, self.left, self.right = (np.full((256, 256), NO_RANK) for _ in range(3))
        tokens = {rank: token for token, rank in self.ranks.items()}
        lower = {part for a, b, rank in found for part in (a, b) if rank < part}
        for a, b, rank in found:
            x, y = tokens[a], tokens[b]
            if len(x) == len(y) == 1 and rank not in lower:
                self.pairs[x[0], y[0]] = rank
            if len(y) == 1:
                self.left[x[-1], y[0]] = min(self.left[x[-1], y[0]], rank)
            if len(x) == 1:
                self.right[x[0], y[0]] = min(self.right[x[0], y[0]], rank)
        self.known: dict[bytes, bytes] = {}  #: ids of words used of late, as bytes of 32-bit numbers
        self.older: dict[bytes, bytes] = {}  #: and of the generation before

    def sure(self, data: np.ndarray, same: np.ndarray) -> np.ndarray:
        """The token that each byte and the next are certain to be merged into, else ``NO_RANK``; ``same`` where both are of one word.

        No merge of a lower rank can take the first byte with what ends before it, or the second with what begins after
        it (nor one of the same rank further left), so both are still there when their rank's turn comes; and no merge of
        their token has a lower rank, so nothing changes if it is there before.
        """
        rank = np.where(same, self.pairs[data[:-1], data[1:]], NO_RANK)
        taken = np.zeros(len(rank), bool)
        taken[1:] |= same[:-1] & (self.left[data[:-2], data[1:-1]] <= rank[1:])
        taken[:-1] |= same[1:] & (self.right[data[1:-1], data[2:]] < rank[:-1])
        rank[taken] = NO_RANK
        return rank


class Codec:
    """The database of one partition; it goes when the partition ends, so that a reused worker holds only the words it remembers."""

    def __init__(self, path: str):
        import duckdb

        own = self.own = ranks(path)
        self.ranks, self.merged, self.byte_ids = own.ranks, own.merged, own.byte_ids
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "150MB"})
        merges, vocab = own.merges, own.vocab  # noqa: F841  read by their names
        self.db.execute("CREATE TABLE merges AS FROM merges")
        self.db.execute("CREATE TABLE vocab AS FROM vocab")

    def close(self) -> None:
        self.db.close()
        give_back()

    def heap(self, word: bytes) -> list[int]:
        """The same contraction for one long word: pairs in a heap by rank and position, neighbours linked."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(self.merged[p], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.merged]
        heapq.heapify(queue)
        while queue:
            rank, i, left, right = heapq.heappop(queue)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := (ids[a], ids[b])) in self.merged:
                    heapq.heappush(queue, (self.merged[p], a, *p))
        return [x for x, y in zip(ids, alive) if y]

    def start(self, words: list[bytes]) -> pa.Table:
        """The bytes of words of two bytes or more: the first of a pair that is sure to be merged has its token, the second is marked as gone."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        pos = (np.arange(len(data)) - (np.cumsum(size) - size)[word]).astype(np.int16)
        ids, after, gone = self.byte_ids[data], pos + np.int16(1), np.zeros(len(data), bool)
        rank = self.own.sure(data, word[1:] == word[:-1])
        hit = np.flatnonzero(rank < NO_RANK)
        ids[hit], after[hit], gone[hit + 1] = rank[hit], after[hit] + 1, True
        return pa.table({"word": word, "pos": pos, "after": after, "id": ids, "gone": gone})

    def encode_words(self, words: list[bytes]) -> None:
        """Remember the ids of words that are not known yet."""
        known, older = self.own.known, self.own.older
        rest = []
        for word in words:
            if word in known:
                continue
            ids = older.get(word)
            if ids is not None:
                known[word] = ids
            elif (whole := self.ranks.get(word)) is not None:
                known[word] = whole.to_bytes(4, "little")
            elif len(word) > LONG_WORD:
                known[word] = np.array(self.heap(word), np.int32).tobytes()
            else:
                rest.append(word)
        # A word of n bytes leaves at most n * (n + 1) / 2 rows over all rounds.
        rows = np.cumsum([len(w) ** 2 for w in rest])
        at = 0
        while at < len(rest):
            end = max(at + 1, int(np.searchsorted(rows, (rows[at - 1] if at else 0) + ROUND_ROWS, "right")))
            some, at = rest[at:end], end
            self.db.register("start", self.start(some))
            done = self.db.sql(CONTRACT).to_arrow_table()
            self.db.unregister("start")
            ids = done.column("id").to_numpy().astype(np.int32).tobytes()
            ends = (4 * np.searchsorted(done.column("word").to_numpy(), np.arange(len(some) + 1))).tolist()
            for w, name in enumerate(some):
                known[name] = ids[ends[w] : ends[w + 1]]

    def forget(self, names: list[bytes]) -> None:
        """Long words go with their chunk; of the others a generation that is full becomes the older one, which goes."""
        own = self.own
        for word in names:
            if len(word) > LONGEST_REMEMBERED:
                del own.known[word]
        if len(own.known) > REMEMBERED:
            own.known, own.older = {}, own.known

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text ends."""
        words = pretokens.split(texts, "byte")
        names = words.names.to_pylist()
        self.encode_words(names)
        lists = [self.own.known[w] for w in names]
        size = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        flat = np.frombuffer(b"".join(lists), np.int32)
        self.forget(names)
        begin = np.cumsum(size) - size
        per = size[words.ids]
        ends = np.concatenate([[0], np.cumsum(per)])
        return flat[np.arange(ends[-1]) + np.repeat(begin[words.ids] - ends[:-1], per)], ends[words.first]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        count = np.diff(ends)
        out = [b""] * len(count)
        doc = np.repeat(np.arange(len(count), dtype=np.int32), count)
        for at in range(0, len(ids), DECODED):
            part = ids[at : at + DECODED]
            self.db.register("ids", pa.table({"doc": doc[at : at + DECODED], "pos": np.arange(len(part), dtype=np.int32), "id": part}))
            done = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("ids")
            for d, text in zip(done.column("doc").to_pylist(), done.column("hex").to_pylist()):
                out[d] += bytes.fromhex(text)
        return out


@lru_cache(1)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def with_codec(df: DataFrame, path: str, rows, schema: str) -> DataFrame:
    """``rows(codec, batch)`` over every batch, with one codec a partition."""

    def partition(batches):
        own = Codec(path)
        try:
            for batch in batches:
                yield from rows(own, batch)
        finally:
            own.close()

    return map_partition(df, partition, schema)


def _keyed(docs: DataFrame, key: str, text: str):
    picked = docs.select(key, text)
    return picked, f"{key} {picked.schema[key].dataType.simpleString()}"


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per document: key, ids."""
    path = path or default_path()

    def rows(codec, batch):
        for at, texts in chunks(column(batch, text), CHUNK_BYTES):
            ids, ends = codec.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists], [key, "ids"])

    picked, first = _keyed(docs, key, text)
    return with_codec(picked, path, rows, f"{first}, ids array<int>")


def decode(coded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Per document: key, content (its bytes); null ids decode to no bytes."""
    path = path or default_path()

    def rows(codec, batch):
        lists = batch.column(1).cast(pa.list_(pa.int32())).fill_null([])
        for at in range(0, len(lists), 500):
            some = lists.slice(at, 500)
            ends = some.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, 500), pa.array(codec.decode(some.flatten().to_numpy(), ends - ends[0]), pa.binary())], [key, "content"]
            )

    picked, first = _keyed(coded, key, ids)
    return with_codec(picked, path, rows, f"{first}, content binary")


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per document: n_tokens, digests of its ids and of the bytes that they decode to, and the ids themselves if asked for."""
    path = path or default_path()

    def sha(values: list[bytes]) -> pa.Array:
        return pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())

    def rows(codec, batch):
        for at, texts in chunks(column(batch, text), CHUNK_BYTES):
            ids, ends = codec.encode(texts)
            lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pc.cast(pa.array(ids), pa.large_string()))
            columns = {
                key: batch.column(0).slice(at, len(texts)),
                "n_tokens": pa.array(np.diff(ends)),
                "ids_sha256": sha(pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.large_binary()).to_pylist()),
                "decoded_sha256": sha(codec.decode(ids, ends)),
            }
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    picked, first = _keyed(docs, key, text)
    return with_codec(picked, path, rows, f"{first}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
