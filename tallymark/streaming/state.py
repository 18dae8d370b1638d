"""State of a stream as tables per micro-batch, read over a bounded number of folders.

A batch writes what it changed, and with it a share of all keys: those whose hash names this batch of the
cycle. After one cycle every key has been written again, so the last ``CYCLE`` batches hold the whole state.
A retried batch overwrites only its own folder, and folders older than two cycles are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CYCLE = 20


def read_state(spark: SparkSession, folder: str, name: str, key: str, schema: str | StructType, batch: int) -> DataFrame:
    """Latest stored rows per key from the batches before ``batch``."""
    paths = [f"{folder}/{name}/batch={b}" for b in range(max(0, batch - CYCLE), batch)]
    if not paths:
        return spark.createDataFrame([], schema)
    fields = StructType(list((StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields)).add("batch", "long")
    stored = spark.read.schema(fields).option("basePath", f"{folder}/{name}").parquet(*paths)
    newest = stored.groupBy(key).agg(F.max("batch").alias("batch"))
    return stored.join(newest, [key, "batch"], "left_semi").drop("batch")


def in_turn(key: str, batch: int) -> Column:
    """Is the key one of those that this batch writes again?"""
    return F.pmod(F.xxhash64(key), F.lit(CYCLE)) == batch % CYCLE


def write_state(rows: DataFrame, folder: str, name: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")


def delete_superseded(spark: SparkSession, folder: str, name: str, batch: int) -> None:
    """Delete the folder that left the reach of every later batch (two cycles back, so that a retry still finds its own)."""
    old = batch - 2 * CYCLE
    if old >= 0:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/batch={old}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
