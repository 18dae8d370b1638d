"""Per-product compliance ledger: totals, tier counts, batch breakdown, listing and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators.consensus import consensus, is_compliant, latest, settled

TIERS = ["ar_verified", "reference_object", "package_dimension", "dpi_estimated"]
PLACEHOLDER = "GTIN-"
NO_BATCH = "unspecified"


def known_tier(tier: Column) -> Column:
    """Unknown or missing tiers count as the uncalibrated one."""
    return F.when(tier.isin(TIERS[:3]), tier).otherwise(TIERS[3])


def tier_counts() -> list[Column]:
    tier = known_tier(F.col("calibration_tier"))
    return [F.count_if(tier == name).alias(f"{name}_count") for name in TIERS]


def status_counts() -> list[Column]:
    good = is_compliant(F.col("compliance_status"))
    return [
        F.count(F.lit(1)).alias("total_scans"),
        F.count_if(good).alias("compliant_scans"),
        F.count_if(~good).alias("non_compliant_scans"),
    ]


def ledger_totals(scans: DataFrame) -> DataFrame:
    """Counts and descriptive columns per product in one partial-aggregated pass."""
    when = F.struct("created_at", "scan_id")
    name, category = F.nullif(F.col("product_name"), F.lit("")), F.nullif(F.col("category"), F.lit(""))
    real = name.isNotNull() & ~name.contains(PLACEHOLDER)
    return (
        scans.where(F.col("gtin").isNotNull())
        .groupBy("gtin")
        .agg(
            *status_counts(),
            *tier_counts(),
            F.coalesce(
                F.min_by(name, F.when(real, when)), F.max_by(name, F.when(name.isNotNull(), when))
            ).alias("product_name"),
            F.min_by(category, F.when(category.isNotNull(), when)).alias("category"),
            F.max_by("scan_id", when).alias("last_scan_id"),
            F.max("created_at").alias("last_scanned_at"),
        )
    )


def build_ledger(scans: DataFrame) -> DataFrame:
    """One row per product. Both sides are hashed on gtin, so the join adds no shuffle."""
    return ledger_totals(scans).join(consensus(scans), "gtin")


def batch_code(code: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(code), F.lit("")), F.lit(NO_BATCH))


def batch_breakdown(scans: DataFrame) -> DataFrame:
    """Per product and batch, with an unweighted verdict."""
    grouped = (
        scans.where(F.col("gtin").isNotNull())
        .withColumn("batch_code", batch_code(F.col("batch_code")))
        .groupBy("gtin", "batch_code")
        .agg(*status_counts(), *tier_counts(), F.max("created_at").alias("last_scanned_at"))
    )
    share = F.col("compliant_scans") / F.col("total_scans")
    return grouped.withColumn("current_verdict", settled(share))


def calibration_breakdown(scans: DataFrame) -> DataFrame:
    """Tier counts per product as columns."""
    return (
        scans.where(F.col("gtin").isNotNull())
        .select("gtin", known_tier(F.col("calibration_tier")).alias("tier"))
        .groupBy("gtin")
        .pivot("tier", TIERS)
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )


def list_ledger(ledger: DataFrame, verdict: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of the ledger, most recently scanned first."""
    chosen = ledger.where(F.col("current_verdict") == verdict.lower()) if verdict else ledger
    return chosen.orderBy(F.col("last_scanned_at").desc(), "gtin").offset(offset).limit(limit)


def scan_history(scans: DataFrame, n: int = 50) -> DataFrame:
    """Newest ``n`` scans of every product."""
    return latest(scans.where(F.col("gtin").isNotNull()), "gtin", n, F.col("created_at").desc(), F.col("scan_id").desc())
