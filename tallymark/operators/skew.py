"""Ordered per-key work that survives a hot key.

A window partitioned by product or user runs each key in one task. When a single key can hold a
third of all rows that task never ends, so rows of hot keys are cut into time-ordered blocks:

1. count rows per key (partial aggregation, one small row per key leaves each task);
2. for hot keys only, number the rows: count per (key, time bucket, part), prefix-sum the counts of the
   buckets and those of the parts of each bucket, and add the row number inside the part. A part is one
   time and one range of ids, so a bulk load stamped with one time is many parts. Sums over all earlier
   rows come the same way. Rows without a time come first, as they do in a plain window;
3. block = position // block size. The last ``halo`` rows of a block are repeated in the next one,
   so a frame of up to ``halo`` preceding rows sees exactly the rows it needs.

Rows of ordinary keys stay in block 0 and are shuffled once; with no hot key at all, adaptive
execution drops the other branch. The list of hot keys has at most (all rows / hot_rows) entries;
whether it is broadcast is left to Spark, which knows its size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SkewPolicy:
    hot_rows: int = 2_000_000
    block_rows: int = 500_000


DEFAULT_POLICY = SkewPolicy()
SUM_TYPE = "decimal(38,6)"


def minute_of(column: str) -> Column:
    """Minute of a timestamp as text: order-preserving in every time zone, daylight saving included."""
    return F.left(F.col(column).cast("string"), F.lit(16))


def hot_keys(df: DataFrame, key: str, policy: SkewPolicy) -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > policy.hot_rows).select(key, F.lit(True).alias("_hot"))


def matching(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Inner join on columns that may be null, keeping the left ones."""
    other = right.select(*[F.col(c).alias(f"_right{c}") if c in names else F.col(c) for c in right.columns])
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"_right{c}"))
    return left.join(other, on).drop(*[f"_right{c}" for c in names])


def numbered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    sums: dict[str, Column] | None = None,
    ids_per_part: int = 100_000,
) -> DataFrame:
    """Adds ``_pos``, the 0-based position of each row inside its key group, in ``order``.

    For each entry of ``sums`` it adds ``before_<name>``, the total over all earlier rows. ``bucket``
    must not decrease along ``order`` (a truncated timestamp), and the last column of ``order`` is a
    whole number. No task numbers more than ``ids_per_part`` ids of one time; the prefix sums run over
    one row per bucket of a key and over one row per part of a bucket.
    """
    sums = sums or {}
    ids = F.floor(F.col(order[-1]) / ids_per_part).alias("ids")
    df = df.withColumns(
        {"_bucket": bucket, "_part": F.struct(*order[:-1], ids), **{f"_in_{n}": v.cast(SUM_TYPE) for n, v in sums.items()}}
    )
    zero = F.lit(0)
    measures = ["_n", *[f"_s_{n}" for n in sums]]

    def before(window) -> list[Column]:
        frame = window.rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(m).over(frame), zero).alias(f"_before{m}") for m in measures]

    counts = df.groupBy(*keys, "_bucket", "_part").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_in_{n}").alias(f"_s_{n}") for n in sums]
    )
    parts = counts.select(*keys, "_bucket", "_part", *before(Window.partitionBy(*keys, "_bucket").orderBy("_part")))
    totals = counts.groupBy(*keys, "_bucket").agg(*[F.sum(m).alias(m) for m in measures])
    buckets = totals.select(*keys, "_bucket", *before(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket")))
    buckets = buckets.withColumnsRenamed({f"_before{m}": f"_earlier{m}" for m in measures})
    offsets = matching(parts, buckets, [*keys, "_bucket"]).select(
        *keys, "_bucket", "_part", *[(F.col(f"_before{m}") + F.col(f"_earlier{m}")).alias(f"_offset{m}") for m in measures]
    )
    inside = Window.partitionBy(*keys, "_bucket", "_part").orderBy(*order)
    above = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumns(
        {"_rn": F.row_number().over(inside), **{f"_a_{n}": F.coalesce(F.sum(f"_in_{n}").over(above), zero) for n in sums}}
    )
    placed = matching(placed, offsets, [*keys, "_bucket", "_part"])
    return placed.withColumns(
        {
            "_pos": F.col("_offset_n") + F.col("_rn") - 1,
            **{f"before_{n}": (F.col(f"_offset_s_{n}") + F.col(f"_a_{n}")).cast(SUM_TYPE) for n in sums},
        }
    ).drop("_bucket", "_part", "_rn", "_offset_n", *[f"{tag}_{n}" for n in sums for tag in ("_in", "_offset_s", "_a")])


def with_blocks(
    df: DataFrame,
    key: str,
    order: list[str],
    bucket: Column,
    halo: int = 0,
    sums: dict[str, Column] | None = None,
    policy: SkewPolicy = DEFAULT_POLICY,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Adds ``_block``, ``_halo`` and, per entry of ``sums``, ``before_<name>``.

    Follow with windows over (key, _block) in ``order`` and drop rows where ``_halo`` is true.
    ``before_<name>`` is the total over the key's earlier rows for hot keys, and null for others, whose
    block is whole. ``sizes`` may name a cheaper table with at least as many rows per key to find the
    hot keys in.
    """
    sums = sums or {}
    if policy.block_rows <= halo:
        raise ValueError("a block must be longer than its halo")
    df = df.where(F.col(key).isNotNull())
    marked = df.join(hot_keys(df if sizes is None else sizes, key, policy), key, "left")

    cold = marked.where(F.col("_hot").isNull()).drop("_hot")
    cold = cold.withColumns(
        {
            "_block": F.lit(0).cast("long"),
            "_halo": F.lit(False),
            **{f"before_{n}": F.lit(None).cast(SUM_TYPE) for n in sums},
        }
    )
    warm = numbered(marked.where(F.col("_hot")).drop("_hot"), [key], order, bucket, sums)
    near_end = F.col("_pos") % policy.block_rows >= policy.block_rows - halo
    copies = F.when(near_end, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    warm = (
        warm.withColumn("_copy", F.explode(copies))
        .withColumn("_block", F.floor(F.col("_pos") / policy.block_rows).cast("long") + F.col("_copy"))
        .withColumn("_halo", F.col("_copy") == 1)
        .drop("_copy", "_pos")
    )
    return cold.unionByName(warm)


def running_sum(
    df: DataFrame,
    key: str,
    order: list[str],
    bucket: Column,
    value: Column,
    name: str,
    policy: SkewPolicy = DEFAULT_POLICY,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running total of ``value`` per key, exact for hot keys too."""
    df = df.withColumn("_v", value.cast("decimal(20,6)"))
    blocked = with_blocks(df, key, order, bucket, sums={"v": F.col("_v")}, policy=policy, sizes=sizes)
    frame = Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.coalesce(F.col("before_v") + F.col("_v"), F.sum("_v").over(frame))
    return blocked.withColumn(name, total).drop("_v", "_block", "_halo", "before_v")


def sequence_ids(df: DataFrame, order: list[str], bucket: Column, name: str, start: Column | int = 1) -> DataFrame:
    """Gap-free ids over the whole table in ``order``, without passing it through one task."""
    start = start if isinstance(start, Column) else F.lit(start)
    return numbered(df, [], order, bucket).withColumn(name, F.col("_pos") + start).drop("_pos")
