"""Weighted consensus: many scans of one product become a verdict and a confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.rounding import round_even
from tallymark.functions.trust import DEFAULT_CONFIDENCE, MAX_WEIGHT, role_weight, tier_weight

EVIDENCE_LIMIT = 100

# Share of compliant weight that settles a verdict.
COMPLIANT_FROM = 0.75
NON_COMPLIANT_TO = 0.25


def is_compliant(status: Column) -> Column:
    """Any status other than ``compliant``, missing ones included, speaks against the product."""
    return F.coalesce(F.lower(status) == "compliant", F.lit(False))


def with_evidence(scans: DataFrame) -> DataFrame:
    """Adds exact decimal evidence columns: weight, and weighted confidence for and against."""
    weight = tier_weight(F.col("calibration_tier")) * role_weight(F.col("user_role"))
    confidence = F.coalesce(F.col("confidence").cast("decimal(7,4)"), F.lit(DEFAULT_CONFIDENCE).cast("decimal(7,4)"))
    score = (weight * confidence).cast("decimal(12,6)")
    zero = F.lit(0).cast("decimal(12,6)")
    good = is_compliant(F.col("compliance_status"))
    return scans.withColumns(
        {
            "ev_weight": weight.cast("decimal(12,6)"),
            "ev_for": F.when(good, score).otherwise(zero),
            "ev_against": F.when(good, zero).otherwise(score),
        }
    )


def settled(ratio: Column) -> Column:
    return (
        F.when(ratio >= COMPLIANT_FROM, "compliant").when(ratio <= NON_COMPLIANT_TO, "non_compliant").otherwise("disputed")
    )


def verdict_of(score_for: Column, score_against: Column) -> Column:
    total = (score_for + score_against).cast("double")
    ratio = score_for.cast("double") / F.nullif(total, F.lit(0.0))
    return F.when(ratio.isNull(), "compliant").otherwise(settled(ratio))


def confidence_of(score_for: Column, score_against: Column, weight: Column, n: Column) -> Column:
    """0.10 to 1.00: sharpness of the split, quality of the evidence, and how much there is."""
    total = (score_for + score_against).cast("double")
    ratio = score_for.cast("double") / F.nullif(total, F.lit(0.0))
    sharp = F.abs(ratio - 0.5) * 2.0
    quality = F.least(F.lit(1.0), weight.cast("double") / F.nullif(n, F.lit(0)) / MAX_WEIGHT)
    volume = F.least(F.lit(1.0), 0.40 + 0.15 * n)
    raw = F.when(settled(ratio) == "disputed", 0.40 + 0.30 * quality + 0.20 * volume).otherwise(
        0.40 * sharp + 0.35 * quality + 0.25 * volume
    )
    bounded = F.greatest(F.lit(0.10), F.least(F.lit(1.0), round_even(raw, 4)))
    return F.when(n == 0, F.lit(1.0)).when(ratio.isNull(), F.lit(0.50)).otherwise(bounded)


def consensus_by(evidence: DataFrame, *keys: str) -> DataFrame:
    """Consensus per key over the rows given; sums are decimal, so row order cannot matter."""
    sums = evidence.groupBy(*keys).agg(
        F.sum("ev_for").alias("_for"),
        F.sum("ev_against").alias("_against"),
        F.sum("ev_weight").alias("_weight"),
        F.count(F.lit(1)).alias("evidence_count"),
    )
    return sums.select(
        *keys,
        "evidence_count",
        verdict_of(F.col("_for"), F.col("_against")).alias("current_verdict"),
        confidence_of(F.col("_for"), F.col("_against"), F.col("_weight"), F.col("evidence_count")).alias(
            "rolling_confidence"
        ),
    )


def latest(df: DataFrame, key: str, n: int, *newest_first: Column) -> DataFrame:
    """Newest ``n`` rows per key. Spark trims each task to n per key before the shuffle."""
    window = Window.partitionBy(key).orderBy(*newest_first)
    return df.withColumn("recency", F.row_number().over(window)).where(F.col("recency") <= n)


def latest_evidence(scans: DataFrame, n: int = EVIDENCE_LIMIT) -> DataFrame:
    named = scans.where(F.col("gtin").isNotNull())
    return latest(named, "gtin", n, F.col("created_at").desc(), F.col("scan_id").desc())


def consensus(scans: DataFrame, n: int = EVIDENCE_LIMIT) -> DataFrame:
    """Verdict per product from its latest ``n`` scans."""
    slim = scans.select("gtin", "scan_id", "created_at", "compliance_status", "calibration_tier", "user_role", "confidence")
    return consensus_by(with_evidence(latest_evidence(slim, n)), "gtin")
