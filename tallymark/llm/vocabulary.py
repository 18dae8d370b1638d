"""The distinct pre-tokens of a corpus with their counts and their token ids, each encoded once, and a bounded head of them.

The table of all distinct pre-tokens is written to the shared folder. Only its head is ever broadcast: the most
frequent pre-tokens, at most ``HEAD`` of them.
"""

from __future__ import annotations

import os
import uuid
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import pretokens
from tallymark.llm.words import chunks, column, map_arrow
from tallymark.session import shared_folder

#: Pre-tokens that are broadcast, at most; about 30 bytes each on the wire.
HEAD = 400_000
#: Pre-tokens hold no white space, so names that begin with it are free for single ids.
SINGLE = b" #"


def write_shared(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a table to the folder that all executors share, and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one computation in the shared folder, deleted once what is made of them has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, label: str, **options: str) -> DataFrame:
        path = f"{self.folder}/{label}/{uuid.uuid4().hex}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """The tables of some labels, or all."""
        for name in [f"{self.folder}/{label}" for label in labels] or [self.folder]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies, for ``str.translate``."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def ids_of(name: bytes, path: str) -> list[int]:
    """The token ids of one pre-token, by the library's model."""
    if name.startswith(SINGLE):
        return [int(name[len(SINGLE) :])]
    return [t.id for t in tokenizer(path).model.tokenize(name.decode("latin-1").translate(byte_letters()))]


def direct_ids(text: str, path: str) -> list[int]:
    """The ids of a whole text that may hold special strings, by the library."""
    return tokenizer(path).encode(text, add_special_tokens=False).ids


def pretokens_of(texts: pa.Array, path: str):
    """Pre-tokens of a chunk, and the ids of its texts that may hold special strings (by place; their pre-tokens are left out)."""
    lower, direct = pretokens.normalised(texts, tokenizer(path))
    words = pretokens.split(lower, "word")
    return words, {i: direct_ids(texts[i].as_py(), path) for i in np.flatnonzero(direct).tolist()}


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def vocabulary(docs: DataFrame, path: str, text: str = "text", end_id: int | None = None) -> DataFrame:
    """Every distinct pre-token with its count over all documents and its ids, as a written table.

    Ids of texts with special strings, and ``end_id`` once per document, are counted under names of their own.
    """

    def count(batch):
        for _, texts in chunks(column(batch, text)):
            words, direct = pretokens_of(texts, path)
            total = np.bincount(words.ids, minlength=len(words.names))
            extra: dict[bytes, int] = {}
            for ids in direct.values():
                for i in ids:
                    extra[SINGLE + str(i).encode()] = extra.get(SINGLE + str(i).encode(), 0) + 1
            if end_id is not None:
                name = SINGLE + str(end_id).encode()
                extra[name] = extra.get(name, 0) + len(texts)
            yield pa.RecordBatch.from_arrays([words.names.cast(pa.binary()), pa.array(total)], ["name", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(list(extra), pa.binary()), pa.array(list(extra.values()), pa.int64())], ["name", "n"])

    def encode(batch):
        ids = [ids_of(name, path) for name in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], ["name", "n", "ids"])

    counted = map_arrow(docs.select(text), count, "name binary, n long").groupBy("name").agg(F.sum("n").alias("n"))
    return write_shared(map_arrow(counted, encode, "name binary, n long, ids array<int>"), "vocabulary")


def head_of(words: DataFrame, most: int = HEAD) -> pa.Table:
    """The most frequent pre-tokens, at most ``most``: all those from the least frequency band that fits."""
    band = F.floor(F.log2("n") * 8)
    sizes = sorted(((r[0], r[1]) for r in words.groupBy(band).count().collect()), reverse=True)  # a few hundred bands
    total, least = 0, None
    for value, size in sizes:
        if total + size > most:
            break
        total, least = total + size, value
    if least is None:
        return words.limit(0).select("name", "ids").toArrow()
    return words.filter(band >= least).select("name", "ids").toArrow()


class Head:
    """The head on a worker: ids of known pre-tokens; others are encoded and remembered, to a bounded number."""

    REMEMBERED = 200_000

    def __init__(self, table: pa.Table, path: str):
        self.path = path
        lists = table.column("ids").combine_chunks()
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        self.known = {name: flat[offsets[i] : offsets[i + 1]] for i, name in enumerate(table.column("name").to_pylist())}
        self.more: dict[bytes, np.ndarray] = {}

    def ids(self, name: bytes) -> np.ndarray:
        found = self.known.get(name)
        if found is None:
            found = self.more.get(name)
            if found is None:
                if len(self.more) >= self.REMEMBERED:
                    self.more.clear()
                found = self.more[name] = np.array(ids_of(name, self.path), np.int32)
        return found


_HEADS: dict[int, object] = {}


def on_worker(broadcast, build):
    """``build(broadcast.value)`` once per worker; only the latest is held."""
    key = broadcast._jbroadcast.id() if getattr(broadcast, "_jbroadcast", None) else id(broadcast.value)
    if key not in _HEADS:
        _HEADS.clear()
        _HEADS[key] = build(broadcast.value)
    return _HEADS[key]


def send(spark: SparkSession, value):
    return spark.sparkContext.broadcast(value)
