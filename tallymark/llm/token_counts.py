"""Tokens per document from counts of pieces: each distinct pre-token is encoded once, no list of ids is made per document.

Every distinct pre-token of the corpus gets its number of pieces. That table is joined to the pre-token
frequencies of each document and summed. For the most frequent pre-tokens (a bounded head) the join is a
broadcast lookup inside the scan; only the frequencies of the others are shuffled to the whole table.

Cases: a null or empty text has no bytes and no tokens; texts that may hold special strings are encoded whole by
the library, as its default has it; rows with the same id and text give one row each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm import vocabulary as V
from tallymark.llm.words import chunks, column, map_arrow, raw

LIMIT = 2048


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT, head: int = V.HEAD) -> DataFrame:
    """Per document: key, n_bytes, n_tokens, over_limit."""
    path = path or V.default_path()
    words = V.vocabulary(docs, path, text)
    table = V.head_of(words, head)
    names, sizes = table.column("name").to_pylist(), np.diff(table.column("ids").combine_chunks().offsets.to_numpy())
    names_out = [key, "_hash", "_name", "_bytes", "_n"]
    sent = V.send(docs.sparkSession, dict(zip(names, sizes.tolist())))

    def rows(batch):
        keys = batch.column(batch.schema.get_field_index(key))
        known = sent.value
        for at, texts in chunks(column(batch, text)):
            words, direct = V.pretokens_of(texts, path)
            found = words.names.to_pylist()
            pieces = np.array([known.get(w, -1) for w in found], np.int64)
            per = pieces[words.ids] if len(found) else np.zeros(0, np.int64)
            total = np.concatenate([[0], np.cumsum(np.maximum(per, 0))])
            base = total[words.first[1:]] - total[words.first[:-1]]
            for i, ids in direct.items():
                base[i] = len(ids)
            plain = texts.to_pylist()
            hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in plain], np.uint64).view(np.int64)
            size = np.diff(raw(texts)[1])
            own = keys.slice(at, len(texts))
            # The row of the document itself: no pre-token is called this, and each document has its own.
            none = pa.array([b" %d" % h for h in hashes.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([own, pa.array(hashes), none, pa.array(size), pa.array(base)], names_out)
            rare = np.flatnonzero(per < 0)
            if len(rare):
                document = np.searchsorted(words.first, rare, "right") - 1
                pair, times = np.unique(document * len(found) + words.ids[rare], return_counts=True)
                doc, word = pair // len(found), pair % len(found)
                yield pa.RecordBatch.from_arrays(
                    [own.take(pa.array(doc)), pa.array(hashes[doc]), words.names.take(pa.array(word)).cast(pa.binary()), pa.nulls(len(doc), pa.int64()), pa.array(times)],
                    names_out,
                )

    picked = docs.select(key, text)
    counted = map_arrow(picked, rows, f"{key} {picked.schema[key].dataType.simpleString()}, _hash long, _name binary, _bytes long, _n long")
    pieces = words.select(F.col("name").alias("_name"), F.size("ids").alias("_pieces"))
    joined = counted.join(pieces, "_name", "left").select(key, "_hash", "_bytes", (F.col("_n") * F.coalesce("_pieces", F.lit(1))).alias("_tokens"))
    by_doc = joined.groupBy(key, "_hash").agg(F.max("_bytes").alias("n_bytes"), F.sum("_tokens").alias("_tokens"), F.count("_bytes").alias("_rows"))
    one_each = by_doc.withColumn("n_tokens", F.expr("_tokens div _rows")).withColumn("_each", F.explode(F.array_repeat(F.lit(1), F.col("_rows").cast("int"))))
    return one_each.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
