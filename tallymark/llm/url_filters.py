"""URL filters over dated lists: entries become validity intervals, and every capture is judged by those active at its fetch.

A list is a log of dated entries (list, pattern, added or removed). The log of one pattern turns into disjoint
intervals; a capture meets, for each pattern that its URL has (its host, each parent domain, and the host with
each leading part of the path), at most one interval of each list: the one as of its fetch time. The as-of join is
an equi-join on pattern and time bucket with a range condition, so a host with a third of all captures is an
ordinary skewed join that Spark can split, and nothing is collected per host.

Cases: of entries with one list, pattern and time, a removal wins; adding what is listed or removing what is not
changes nothing; an interval without an end stays open; a fetch at the moment of an addition is inside, at that of
a removal outside; a null URL, host or time meets no entry; the same capture twice gives two rows; an empty list
blocks nothing. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 7 * 86400
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def patterns_of(url: Column) -> Column:
    """All patterns that a URL has: host, parent domains of two labels or more, and host with each leading folder of its path."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    folders = F.split(path_of(url), "/")
    paths = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(folders) - 1, F.lit(2))), lambda i: F.concat(host_of(url), F.array_join(F.slice(folders, F.lit(1), i), "/"), F.lit("/"))
    )
    paths = F.when(F.size(folders) > 2, paths).otherwise(F.array().cast("array<string>"))
    return F.when(host_of(url) != "", F.array_distinct(F.concat(domains, paths))).otherwise(F.array().cast("array<string>"))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``list``, ``pattern``, ``since``, ``until`` (null: still listed) from entries ``list``, ``pattern``, ``added``, ``at``."""
    one = entries.dropna(subset=["list", "pattern", "added", "at"]).groupBy("list", "pattern", "at").agg(F.min("added").alias("added"))
    by_time = Window.partitionBy("list", "pattern").orderBy("at")
    changes = one.withColumn("_before", F.lag("added").over(by_time)).filter(F.coalesce("_before", F.lit(False)) != F.col("added"))
    return changes.withColumn("until", F.lead("at").over(by_time)).filter("added").select("list", "pattern", F.col("at").alias("since"), "until")


def bucket(at: Column) -> Column:
    return F.floor(F.unix_timestamp(at) / BUCKET_SECONDS)


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", at: str = "fetched_at") -> DataFrame:
    """Per capture: key, host, time, number of active entries, their lists, and whether it is blocked."""
    span = captures.agg(F.min(bucket(F.col(at))), F.max(bucket(F.col(at)))).first()
    first, last = (int(x) if x is not None else 0 for x in span)
    rows = captures.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(at).alias("_at"))
    # Buckets of the captures only, so that open intervals are not spread over all time.
    held = validity_intervals(entries).withColumn("_from", F.greatest(bucket(F.col("since")), F.lit(first))).withColumn("_to", F.least(F.coalesce(bucket(F.col("until")), F.lit(last)), F.lit(last)))
    held = held.filter("_from <= _to").withColumn("_bucket", F.explode(F.sequence("_from", "_to")))
    looked = rows.withColumn("_pattern", F.explode(F.concat(F.array(F.lit(None).cast("string")), patterns_of(F.col("_url"))))).withColumn("_bucket", bucket(F.col("_at")))
    # The row without a pattern stands for the capture; it gets a key of its own so that such rows do not meet in one task.
    own = F.concat(F.lit(" "), F.xxhash64("_key", "_url", "_at").cast("string"))
    looked = looked.withColumn("pattern", F.coalesce("_pattern", own))
    met = looked.join(held, (looked["pattern"] == held["pattern"]) & (looked["_bucket"] == held["_bucket"]) & (looked["_at"] >= held["since"]) & (held["until"].isNull() | (looked["_at"] < held["until"])), "left")
    by_capture = met.groupBy("_key", "_url", "_at").agg(
        F.sum(F.when(F.col("_pattern").isNull(), 1).otherwise(0)).alias("_rows"),
        F.count_distinct("list", held["pattern"]).alias("n_entries"),
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
    )
    each = by_capture.withColumn("_one", F.explode(F.array_repeat(F.lit(1), F.col("_rows").cast("int"))))
    return each.select(F.col("_key").alias(key), host_of(F.col("_url")).alias("host"), F.col("_at").alias(at), "n_entries", "lists", (F.col("n_entries") > 0).alias("blocked"))
