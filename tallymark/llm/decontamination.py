"""Benchmark decontamination: a hash set of the normalised n-grams of the test items, looked up by every training window.

DataFrame functions only. The distinct test windows are broadcast where their counted number is at most
``BROADCAST_WINDOWS``; beyond it only places and hashes of windows are shuffled, and what they meet is joined back to
the texts. A window of a document that meets a test window by its 64-bit hash is verified word by word. Spans of verified windows are merged, and cut from the texts or used to
drop the documents.

Cases: a null or empty text has no words and is clean; an item without words has no windows; an item without an
id counts under the empty id; rows with the same id and text are judged alike and all kept, rows with the same id
and another text each by itself; an empty benchmark leaves every document clean; extra columns pass through
``remove_spans`` and ``clean_documents`` whatever they are called. A document is one row throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 10  #: words of a window
#: Distinct test windows that are broadcast, about 300 bytes each.
BROADCAST_WINDOWS = 200_000
SPANS = "array<struct<start:int,end:int>>"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Only A-Z; ``lower`` is quicker and the same where all characters are ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def windows_of(words: Column, width: Column | int) -> Column:
    """The hash of every window, in order."""
    last = F.size(words) - width
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(words, i + 1, width)))
    )


def test_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Distinct windows of the items: hash, words, and the ids of their items."""
    worded = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("_item"), words_of(F.col(text)).alias("_words"))
    worded = worded.filter(F.size("_words") > 0).withColumn("_width", F.least(F.size("_words"), F.lit(width)))
    each = worded.select("_item", F.explode(F.transform(F.sequence(F.lit(1), F.size("_words") - F.col("_width") + 1), lambda i: F.slice("_words", i, F.col("_width")))).alias("_window"))
    return each.groupBy("_window").agg(F.collect_set("_item").alias("_items")).select(F.xxhash64("_window").alias("_hash"), "_window", "_items")


def merged(spans: Column | str) -> Column:
    """Sorted spans with those that touch or overlap made one."""

    def joined(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return (
            F.when(F.size(done) == 0, F.array(span).cast(SPANS))
            .when(span["start"] <= last["end"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown).cast(SPANS)))
            .otherwise(F.concat(done, F.array(span).cast(SPANS)))
        )

    return F.aggregate(spans, F.array().cast(SPANS), joined)


def span_report(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH
) -> DataFrame:
    """One row per document: key, ``_text_hash``, n_words, ``spans`` (merged word spans that are hit), ``items`` (sorted ids)."""
    tests = test_windows(benchmark, item, item_text, width)
    # At most ``width`` rows: how many test windows there are of each length.
    counted = {r[0]: r[1] for r in tests.groupBy(F.size("_window")).count().collect()}
    widths = sorted(counted)
    if sum(counted.values()) > BROADCAST_WINDOWS:
        return _shuffled_report(docs, tests, widths, key, text)
    worded = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_text_hash"), words_of(F.col(text)).alias("_words"))
    # The first entry stands for the document itself; then come the windows of each length.
    hashed = worded.withColumn("_all", F.concat(F.array(F.lit(None).cast("bigint")), *(windows_of(F.col("_words"), w) for w in widths)))
    # Outer, so that no filter on the array's size is inferred, which would hash every window again in the scan.
    looked = hashed.select("_key", "_text_hash", "_words", F.posexplode_outer("_all").alias("_at", "_hash"))
    met = looked.join(F.broadcast(tests), "_hash", "left")
    n, long = F.size("_words"), F.size("_window")
    skipped, before = F.lit(1), F.lit(1)
    for w in widths:
        skipped = F.when(long > w, before + F.greatest(n - w + 1, F.lit(0))).otherwise(skipped)
        before = before + F.greatest(n - w + 1, F.lit(0))
    met = met.withColumn("_start", F.col("_at") - skipped)
    inside = F.col("_start").between(0, n - long)
    same = F.when(inside, F.slice("_words", F.greatest(F.col("_start"), F.lit(0)) + 1, F.greatest(long, F.lit(0))) == F.col("_window"))
    met = met.filter((F.col("_at") == 0) | same).select(
        "_key",
        "_text_hash",
        F.when(F.col("_at") == 0, n).alias("_n"),
        F.when(F.col("_at") > 0, F.struct(F.col("_start").alias("start"), (F.col("_start") + long).alias("end"))).alias("_span"),
        F.when(F.col("_at") > 0, F.col("_items")).alias("_items"),
    )
    by_doc = met.groupBy("_key", "_text_hash").agg(
        F.max("_n").cast("long").alias("n_words"),
        F.count("_n").alias("_rows"),
        F.sort_array(F.collect_set("_span")).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("items"),
    )
    repeated = by_doc.select("_key", "_text_hash", "n_words", merged("_spans").alias("spans"), "items", F.explode(F.array_repeat(F.lit(1), F.col("_rows").cast("int"))))
    return repeated.select(F.col("_key").alias(key), "_text_hash", "n_words", "spans", "items")


def _shuffled_report(docs: DataFrame, tests: DataFrame, widths: list[int], key: str, text: str) -> DataFrame:
    """``span_report`` by a shuffled join. A reference that two documents should share only adds candidates to verify."""
    reference = F.xxhash64(key, text).alias("_ref")
    words = words_of(F.col(text))
    each = F.concat(*(F.transform(windows_of(F.col("_words"), w), lambda h, i: F.struct(i.alias("start"), h.alias("hash"))) for w in widths))
    # Outer, as in ``span_report``.
    looked = docs.select(reference, words.alias("_words")).select("_ref", F.explode_outer(each).alias("_at"))
    looked = looked.select("_ref", F.col("_at.start").alias("start"), F.col("_at.hash").alias("_hash"))
    met = looked.join(tests, "_hash").groupBy("_ref").agg(F.collect_set(F.struct("start", F.col("_window").alias("window"), F.col("_items").alias("items"))).alias("_met"))
    whole = docs.select(reference, F.col(key).alias("_key"), F.xxhash64(text).alias("_text_hash"), F.col(text).alias("_text"))
    found = whole.join(met, "_ref", "left").withColumn("_words", words_of(F.col("_text")))
    same = F.filter("_met", lambda m: F.slice("_words", m["start"] + 1, F.size(m["window"])) == m["window"])
    found = found.select("_key", "_text_hash", F.size("_words").cast("long").alias("n_words"), F.coalesce(same, F.array()).alias("_hits"))
    spans = F.array_sort(F.array_distinct(F.transform("_hits", lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.size(m["window"])).alias("end")))))
    items = F.array_sort(F.array_distinct(F.flatten(F.array_distinct(F.transform("_hits", lambda m: m["items"])))))
    return found.select(F.col("_key").alias(key), "_text_hash", "n_words", merged(spans).alias("spans"), items.alias("items"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """Per document: words, hit words, items with occurring windows and the digest of their ids."""
    found = span_report(docs, benchmark, **names)
    hit = F.aggregate("spans", F.lit(0), lambda total, s: total + s["end"] - s["start"]).cast("long")
    return found.select(
        names.get("key", "doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def _with_spans(docs: DataFrame, benchmark: DataFrame, key: str, text: str, **names: str) -> DataFrame:
    """Every document as one struct ``_row`` beside its hit spans (null where clean)."""
    found = span_report(docs, benchmark, key=key, text=text, **names).filter(F.size("spans") > 0)
    found = found.select(F.col(key).alias("_key"), "_text_hash", "spans").distinct()
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), docs[key].alias("_id"), F.xxhash64(docs[text]).alias("_hash"))
    return rows.join(found, rows["_id"].eqNullSafe(found["_key"]) & (rows["_hash"] == found["_text_hash"]), "left")


def clean_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """The documents without a test window, with their columns as they were."""
    return _with_spans(docs, benchmark, key, text, **names).filter(F.col("spans").isNull()).select("_row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """All documents, with the words of test windows cut out; what stands between words stays."""
    found = _with_spans(docs, benchmark, key, text, **names)
    whole = F.col("_row")[text]
    words, gaps = F.regexp_extract_all(whole, F.lit(r"[A-Z[^\x00-\x2F\x3A-\x60\x7B-\x7F]]+"), F.lit(0)), F.split(whole, r"[A-Z[^\x00-\x2F\x3A-\x60\x7B-\x7F]]+", -1)

    def shown(i: Column) -> Column:
        hit = F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"]))
        return F.concat(F.get(gaps_col, i), F.when(hit, F.lit("")).otherwise(F.coalesce(F.get(words_col, i), F.lit(""))))

    found = found.withColumn("_w", F.when(F.col("spans").isNotNull(), words)).withColumn("_g", F.when(F.col("spans").isNotNull(), gaps))
    words_col, gaps_col = F.col("_w"), F.col("_g")
    cut = F.array_join(F.transform(F.sequence(F.lit(0), F.size("_g") - 1), shown), "")
    text_out = F.when(F.col("spans").isNull(), whole).otherwise(cut)
    return found.select(F.col("_row").withField(text, text_out).alias("_row")).select("_row.*")
