"""Public verification profile of a scan: sanitised columns, a status label and a score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.sources.stores import verification_id

# What a profile shows for a declaration nobody made.
UNDECLARED = {
    "product_name": "Packaged Commodity",
    "manufacturer_address": "Undeclared",
    "net_quantity": "Not Declared",
    "mrp": "Not Declared",
    "selling_price": "N/A",
    "manufacture_date": "Undeclared",
    "expiry_date": "Refer packaging declaration",
    "batch_number": "Undeclared",
    "consumer_care": "Undeclared",
    "country_of_origin": "India",
}


def public_profiles(scans: DataFrame, violations: DataFrame) -> DataFrame:
    counts = violations.groupBy("scan_id").agg(F.count(F.lit(1)).alias("violations_count"))
    status = F.lower(F.coalesce(F.nullif("compliance_status", F.lit("")), F.lit("non_compliant")))
    label = (
        F.when(status == "compliant", "COMPLIANT")
        .when(status.contains("partial") | status.contains("undetermined"), "PARTIALLY COMPLIANT")
        .otherwise("NON-COMPLIANT")
    )
    score = F.when(label == "COMPLIANT", F.lit(100)).otherwise(
        F.greatest(F.lit(10), F.lit(100) - F.col("violations_count") * 20)
    )
    shown = [
        (F.coalesce(F.nullif(name, F.lit("")), F.lit(default)) if name in scans.columns else F.lit(default)).alias(name)
        for name, default in UNDECLARED.items()
    ]
    joined = scans.join(counts, "scan_id", "left").withColumn("violations_count", F.coalesce("violations_count", F.lit(0)))
    return joined.select(
        verification_id(F.col("scan_uid")).alias("verification_id"),
        "scan_uid",
        *shown,
        label.alias("status_label"),
        score.cast("long").alias("compliance_score"),
        "violations_count",
        F.col("created_at").alias("inspected_at"),
    )
