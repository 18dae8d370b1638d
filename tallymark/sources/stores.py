"""Table readers, writers, upserts, audit lines and business keys over Parquet folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators.analytics import normalised_status
from tallymark.operators.consensus import latest
from tallymark.operators.skew import sequence_ids
from tallymark.schemas import TABLES
from tallymark.sources.documents import first_given

# Fallbacks of a stored scan.
DEFAULT_NAME = "Packaged Commodity Product"
DEFAULT_CATEGORY = "Packaged Foods"
DEFAULT_SCORE = 0.85
UID_PREFIX = "LM-2026-"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A business table with its declared schema, so no schema inference pass runs."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """The same table from a relational store, read in parallel ranges of a numeric key."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options
    )
    return reader.load()


def conform(df: DataFrame, name: str) -> DataFrame:
    """Casts to the table's schema; columns an older file lacks come out null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[name].fields
        ]
    )


def padded(number: Column, width: int = 6) -> Column:
    """Zero-padded text; longer numbers keep all their digits."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def scan_uid(number: Column) -> Column:
    return F.concat(F.lit(UID_PREFIX), padded(number))


def verification_id(uid: Column) -> Column:
    suffix = F.replace(F.replace(uid, F.lit("LM-"), F.lit("")), F.lit("2026-"), F.lit(""))
    return F.concat(F.lit("LM-VERIFY-2026-"), suffix)


def standin_gtin(scan_id: Column) -> Column:
    """Ledger key of a citizen scan with no readable code."""
    return F.concat(F.lit("CITIZEN-"), padded(scan_id))


def ledger_key(gtin: Column, role: Column, scan_id: Column) -> Column:
    given = F.nullif(F.trim(gtin), F.lit(""))
    return F.coalesce(given, F.when(role == "citizen", standin_gtin(scan_id)))


def assign_uids(submissions: DataFrame, highest: Column | int, order: list[str], bucket: Column) -> DataFrame:
    """Next free ids for submissions that carry no uid of their own; given uids are kept.

    ``order`` must be unique per row; numbering runs over time buckets, never through one task.
    """
    given = F.coalesce(
        F.when(F.startswith("scan_id_text", F.lit(UID_PREFIX)), F.col("scan_id_text")),
        F.nullif("scan_uid", F.lit("")),
    )
    marked = submissions.withColumn("_given", given)
    fresh = sequence_ids(marked.where(F.col("_given").isNull()), order, bucket, "_next", 1)
    highest = highest if isinstance(highest, Column) else F.lit(highest)
    numbered = fresh.withColumn("scan_uid", scan_uid(F.col("_next") + highest)).drop("_next")
    kept = marked.where(F.col("_given").isNotNull()).withColumn("scan_uid", F.col("_given"))
    return numbered.unionByName(kept).drop("_given")


def normalise_scans(raw: DataFrame) -> DataFrame:
    """Flat columns of a stored scan, each from its first given source."""
    return raw.select(
        "scan_id",
        "scan_uid",
        F.coalesce(first_given(F.col("product_name"), F.col("product_title"), F.col("details_name")), F.lit(DEFAULT_NAME)).alias("product_name"),
        F.coalesce(first_given(F.col("product_category"), F.col("category")), F.lit(DEFAULT_CATEGORY)).alias("category"),
        F.coalesce("scan_type", F.lit("manual")).alias("scan_type"),
        normalised_status(F.col("compliance_status"), F.col("final_result")).alias("compliance_status"),
        F.coalesce(
            first_given(F.col("overall_confidence"), F.col("compliance_confidence"), F.col("ocr_confidence")),
            F.lit(DEFAULT_SCORE),
        ).cast("double").alias("confidence_score"),
        F.coalesce(first_given(F.col("scanned_image_url"), F.col("gallery_url")), F.lit("")).alias("image_url"),
        "created_at",
    )


def creation_audit(scans: DataFrame) -> DataFrame:
    """One SCAN_CREATED line per stored scan."""
    return scans.select(
        "scan_uid",
        F.lit("system").alias("username"),
        F.lit("SCAN_CREATED").alias("action"),
        F.lit(None).cast("string").alias("old_value"),
        F.col("compliance_status").alias("new_value"),
        F.concat(F.col("scan_type"), F.lit(" scan: "), F.col("product_name")).alias("reason"),
        F.col("created_at").alias("logged_at"),
    )


def append(df: DataFrame, folder: str, name: str, day_of: str | None = None) -> None:
    """Append-only write; with ``day_of`` the table is partitioned by day and files are grouped by it."""
    if day_of:
        df = df.withColumn("day", F.to_date(day_of))
        df.write.mode("append").partitionBy("day").parquet(f"{folder}/{name}")
    else:
        df.write.mode("append").parquet(f"{folder}/{name}")


def save_scans(raw: DataFrame, folder: str) -> DataFrame:
    """Normalises and appends scans, and logs their creation."""
    scans = normalise_scans(raw)
    append(scans, folder, "scans", "created_at")
    append(creation_audit(scans), folder, "audit_log", "logged_at")
    return scans


def upsert(old: DataFrame, new: DataFrame, key: str, newest: str, tiebreak: str) -> DataFrame:
    """Last write wins per key. New rows beat old ones at the same time."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    order = [F.col(newest).desc(), F.col("_side").desc(), F.col(tiebreak).desc()]
    return latest(both, key, 1, *order).drop("_side", "recency")


def insert_absent(old: DataFrame, new: DataFrame, key: str, first: str) -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks; the first one per key when ``new`` repeats it."""
    once = latest(new, key, 1, F.col(first)).drop("recency")
    return once.join(old.select(key), key, "left_anti")


def audit_page(audit: DataFrame, limit: int = 50) -> DataFrame:
    return audit.orderBy(F.col("logged_at").desc(), F.col("scan_uid").desc()).limit(limit)


def expiry_register(expiry: DataFrame) -> DataFrame:
    """Stored shape of expiry results: whole days, and SAFE where no status was found."""
    return expiry.select(
        "scan_uid",
        "product_name",
        F.coalesce(F.date_format("expiry_date", "dd/MM/yyyy"), F.lit("Undeclared")).alias("expiry_date"),
        F.coalesce(F.col("days_remaining").cast("int"), F.lit(0)).alias("days_remaining"),
        F.coalesce("status", F.lit("SAFE")).alias("status"),
    )


def export_register(register: DataFrame, folder: str, as_csv: bool = False) -> None:
    """Docket export: one register line per scan, partitioned by verdict colour."""
    writer = register.write.mode("overwrite").partitionBy("verdict_color")
    writer.option("header", True).csv(folder) if as_csv else writer.parquet(folder)
