"""Stored scan documents: JSON text beside flat columns, opened into typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.schemas import SCAN_DOCUMENT

FLAT = ["product_name", "product_category", "scan_type", "compliance_status"]


def open_documents(bronze: DataFrame) -> DataFrame:
    """Parses ``raw_data`` once. A document that is not JSON leaves ``doc`` null."""
    readable = F.try_parse_json("raw_data").isNotNull()
    return bronze.withColumn("doc", F.when(readable, F.from_json("raw_data", SCAN_DOCUMENT, {"mode": "PERMISSIVE"})))


def first_given(*candidates: Column) -> Column:
    """First candidate that is neither missing, empty nor zero."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")).isin("", "0", "0.0"), None).otherwise(c) for c in candidates])


def scans_of(opened: DataFrame) -> DataFrame:
    """One typed scan per document; unreadable documents fall back to their flat columns."""
    return opened.select(
        "scan_id",
        "scan_uid",
        *[F.coalesce(F.col(f"doc.{name}"), F.col(name)).alias(name) for name in FLAT],
        F.coalesce("doc.source", F.lit("inspector")).alias("source"),
        F.col("doc").isNull().alias("from_flat_columns"),
        F.coalesce(F.size("doc.violations"), F.col("violations_count")).alias("violations_count"),
    )


def fields_of(opened: DataFrame) -> DataFrame:
    """Long form: one row per declared field."""
    return opened.where(F.col("doc.fields").isNotNull()).select(
        "scan_id", F.explode("doc.fields").alias("field_name", "f")
    ).select("scan_id", "field_name", "f.extracted_value", "f.extraction_method", "f.confidence")


def violations_of(opened: DataFrame) -> DataFrame:
    return opened.where(F.col("doc.violations").isNotNull()).select(
        "scan_id", F.explode("doc.violations").alias("v")
    ).select("scan_id", "v.field_name", "v.violation_type", "v.severity")
