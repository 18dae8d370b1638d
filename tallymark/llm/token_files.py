"""Token-id files: ids ranked by frequency, in byte-aligned codes of 1 to 4 bytes with separate control bytes.

Ids are replaced by their rank in the whole corpus, so that the frequent ones take one byte. Four lengths of two
bits stand in each control byte, apart from the data bytes; a table of 256 rows turns control bytes into lengths,
and numpy gathers the values of a whole block at once. Blocks of whole documents in ascending order of their ids
are the rows of Parquet files (so that Spark commits, retries and reads them); the ranks lie beside them.

Cases: a null or empty text is its end id alone; a null document id comes first; rows with the same id are
ordered by length and checksum of their ids; an empty table gives an empty folder of blocks; other columns are
not read. A document lies within one block, however long.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm import vocabulary as V
from tallymark.llm.words import chunks, column, map_arrow, map_partition
from tallymark.session import shared_folder

BLOCK_IDS = 1 << 20
BLOCKS = "part int, before long, keys array<long>, counts array<int>, control binary, data binary"
#: Of each control byte, the bytes of its four values.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control and data bytes of runs of values, and where each run starts in both. A run starts with a new control byte."""
    values = values.astype("<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    quads = (counts + 3) // 4
    first = np.concatenate([[0], np.cumsum(quads)])
    ends = np.concatenate([[0], np.cumsum(counts)])
    slot = np.arange(len(values)) + np.repeat(first[:-1] * 4 - ends[:-1], counts)
    padded = np.zeros(first[-1] * 4, np.uint8)
    padded[slot] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    bytes_at = np.concatenate([[0], np.cumsum(code, dtype=np.int64) + np.arange(1, len(code) + 1)])
    return control, data, first, bytes_at[ends]


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of all runs, by table lookup."""
    counts = counts.astype(np.int64)
    first = np.concatenate([[0], np.cumsum((counts + 3) // 4)])
    ends = np.concatenate([[0], np.cumsum(counts)])
    slot = np.arange(ends[-1]) + np.repeat(first[:-1] * 4 - ends[:-1], counts)
    length = LENGTHS[control].ravel()[slot]
    at = np.cumsum(length, dtype=np.int64) - length
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    out = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        out[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def gather(lists: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists at ``ids``, one after the other, and the length of each."""
    size = np.array([len(x) for x in lists], np.int64)
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    start = np.cumsum(size) - size
    per = size[ids]
    ends = np.cumsum(per)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start[ids] - (ends - per), per)], per


def rank_table(words: DataFrame) -> np.ndarray:
    """Token ids by falling frequency over the whole corpus; at most as many rows as the vocabulary has ids."""
    counted = words.select(F.explode("ids").alias("id"), "n").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()
    ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
    return ids[np.lexsort((ids, -n))].astype(np.uint32)


def write_token_files(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 1) -> None:
    """Write ``folder/blocks`` and ``folder/ranks``. Document ids are integers."""
    spark = docs.sparkSession
    path = path or V.default_path()
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    words = V.vocabulary(docs, path, "text", end_id)
    ranked = rank_table(words)
    spark.createDataFrame(pa.table({"rank": np.arange(len(ranked)), "id": ranked.astype(np.int64)})).write.parquet(f"{folder}/ranks")
    sent = V.send(spark, (V.head_of(words), ranked))
    # Parts are ranges of document ids with about as many documents each; only their bounds reach the driver.
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = F.percentile_approx("key", [k / parts for k in range(1, parts)], 100 * parts)
    bounds = np.array(docs.agg(quantiles).first()[0] or [], np.int64)

    def ready(value):
        table, ranked = value
        rank = np.zeros(int(ranked.max(initial=0)) + 1, np.uint32)
        rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
        return V.Head(table, path), rank

    def encode(batch):
        head, rank = V.on_worker(sent, ready)
        keys = batch.column(0)
        for at, texts in chunks(column(batch, "text")):
            words, direct = V.pretokens_of(texts, path)
            lists = [head.ids(name) for name in words.names.to_pylist()]
            # The end id, and the ids of texts encoded whole, stand for a last pre-token of their document.
            last = np.full(len(texts), len(lists))
            lists.append(np.array([end_id], np.int32))
            for i, ids in direct.items():
                last[i] = len(lists)
                lists.append(np.array([*ids, end_id], np.int32))
            ids, per = gather(lists, np.insert(words.ids, words.first[1:], last))
            count = np.concatenate([[0], np.cumsum(per)])[words.first + np.arange(len(words.first))]
            counts = np.diff(count)
            control, data, c, d = pack(rank[ids], counts)
            own = keys.slice(at, len(texts)).to_pylist()
            place = [0 if k is None else int(np.searchsorted(bounds, k, "right")) for k in own]
            flat, control, data = ids.astype("<u4"), control.tobytes(), data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(place, pa.int32()),
                    pa.array(own, pa.int64()),
                    pa.array(counts, pa.int32()),
                    pa.array([zlib.crc32(flat[count[i] : count[i + 1]]) for i in range(len(own))], pa.int64()),
                    pa.array([control[c[i] : c[i + 1]] for i in range(len(own))], pa.binary()),
                    pa.array([data[d[i] : d[i + 1]] for i in range(len(own))], pa.binary()),
                ],
                ["part", "key", "n", "crc", "control", "data"],
            )

    coded = map_arrow(docs, encode, "part int, key long, n int, crc long, control binary, data binary")
    ordered = coded.repartition("part").sortWithinPartitions("part", F.col("key").asc_nulls_first(), "n", "crc")
    map_partition(ordered, blocks, BLOCKS).write.parquet(f"{folder}/blocks")


def blocks(batches):
    """Runs of whole documents of one part, with the number of ids of that part before them. A part lies in one task."""
    part, before, held, size = None, 0, [], 0

    def block():
        keys, counts, control, data = zip(*held)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()),
                pa.array([before], pa.int64()),
                pa.array([list(keys)], pa.list_(pa.int64())),
                pa.array([list(counts)], pa.list_(pa.int32())),
                pa.array([b"".join(control)], pa.binary()),
                pa.array([b"".join(data)], pa.binary()),
            ],
            ["part", "before", "keys", "counts", "control", "data"],
        )

    for batch in batches:
        for p, *row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5))):
            if held and (p != part or size + row[1] > BLOCK_IDS):
                yield block()
                before, held, size = before + size, [], 0
            if p != part:
                part, before = p, 0
            held.append(row)
            size += row[1]
    if held:
        yield block()


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: doc_id, start, ids (decoded by table lookup)."""
    return _decoded(spark, folder, "ids array<long>", lambda ids: pa.array(ids.astype(np.int64)), pa.list_(pa.int64()))


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, from the files."""
    return _decoded(spark, folder, "n_tokens long, ids_crc32 long", None, None)


def _decoded(spark: SparkSession, folder: str, fields: str, value, kind) -> DataFrame:
    schema = T.StructType.fromDDL(BLOCKS)
    stored = spark.read.schema(schema).parquet(f"{folder}/blocks")
    # One number per part; there are four times as many parts as shuffle partitions.
    each = sorted((r[0], r[1]) for r in stored.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))).collect())
    offset, total = {}, 0
    for part, size in each:
        offset[part], total = total, total + size
    ranks = spark.read.parquet(f"{folder}/ranks").toArrow()
    table = np.zeros(ranks.num_rows, "<u4")
    table[ranks.column("rank").to_numpy()] = ranks.column("id").to_numpy()
    sent = V.send(spark, table)

    def rows(batch):
        table = sent.value
        for part, before, keys, counts, control, data in zip(*(batch.column(i).to_pylist() for i in range(6))):
            counts = np.array(counts, np.int64)
            ids = table[unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), counts)]
            ends = np.concatenate([[0], np.cumsum(counts)])
            start = pa.array(ends[:-1] + offset[part] + before)
            if value is None:
                crc = [zlib.crc32(ids[ends[i] : ends[i + 1]]) for i in range(len(counts))]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), start, pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
            else:
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), value(ids)).cast(kind)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), start, lists], ["doc_id", "start", "ids"])

    return map_arrow(stored, rows, f"doc_id long, start long, {fields}")


def file_round_trip(docs: DataFrame, **names: str) -> DataFrame:
    """Write the files to the shared folder and return what is read back."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, folder, **names)
    return token_digests(spark, folder)
