"""Inspector reviews: the latest review of a scan overrides its verdict and single fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators.analytics import normalised_status
from tallymark.operators.consensus import latest


def latest_review(reviews: DataFrame) -> DataFrame:
    return latest(reviews, "scan_id", 1, F.col("reviewed_at").desc(), F.col("review_id").desc()).drop("recency")


def apply_verdicts(scans: DataFrame, reviews: DataFrame) -> DataFrame:
    """Scans with the status of their latest overriding review; a blank override changes nothing."""
    told = reviews.where(F.coalesce("verdict_override", F.lit("")) != "")
    last = latest_review(told).select(
        "scan_id", normalised_status(F.col("verdict_override")).alias("_verdict"), F.col("inspector").alias("reviewed_by")
    )
    return (
        scans.join(last, "scan_id", "left")
        .withColumn("compliance_status", F.coalesce("_verdict", "compliance_status"))
        .drop("_verdict")
    )


def apply_fields(fields: DataFrame, overrides: DataFrame) -> DataFrame:
    """Long-form fields with the latest override per (scan, field); unknown fields are not added."""
    keyed = overrides.withColumn("_key", F.struct("scan_id", "field_name"))
    last = latest(keyed, "_key", 1, F.col("reviewed_at").desc(), F.col("review_id").desc()).select(
        "scan_id", "field_name", F.col("new_value").alias("_value"), F.lit(True).alias("_hit")
    )
    return (
        fields.join(last, ["scan_id", "field_name"], "left")
        .withColumns(
            {
                "extracted_value": F.when(F.col("_hit"), F.col("_value")).otherwise(F.col("extracted_value")),
                "extraction_method": F.when(F.col("_hit"), "inspector_override").otherwise(F.col("extraction_method")),
                "confidence": F.when(F.col("_hit"), F.lit(1.0)).otherwise(F.col("confidence")),
            }
        )
        .drop("_value", "_hit")
    )


def review_audit(scans: DataFrame, reviews: DataFrame) -> DataFrame:
    """Audit lines for reviews; the old value is the status before the review."""
    old = scans.select("scan_id", F.col("compliance_status").alias("old_value"))
    return reviews.join(old, "scan_id").select(
        "scan_id",
        F.col("inspector").alias("username"),
        F.lit("INSPECTOR_REVIEW").alias("action"),
        "old_value",
        F.coalesce(F.nullif("verdict_override", F.lit("")), "old_value").alias("new_value"),
        F.col("reviewed_at").alias("logged_at"),
    )
