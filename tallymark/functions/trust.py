"""Trust weights of evidence, reputation tiers and experience-point changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Evidence weight per calibration tier and per submitter role.
TIER_WEIGHTS = {
    "ar_verified": "2.0",
    "reference_object": "1.4",
    "package_dimension": "1.1",
    "dpi_estimated": "0.7",
}
ROLE_WEIGHTS = {
    "inspector": "1.6",
    "admin": "1.6",
    "viewer": "0.9",
    "anonymous": "0.8",
}
MAX_WEIGHT = 3.2
DEFAULT_CONFIDENCE = "0.95"

# Reputation tier by lowest experience points, highest first.
REPUTATION_TIERS = [
    (500, "Master Metrologist"),
    (200, "Vigilant Citizen"),
    (50, "Citizen Scout"),
    (0, "Probationary Citizen"),
]
LOWEST_REPUTATION = "Restricted Submitter"

# Starting balance and experience-point changes.
XP_START = 100
XP_CLAIM_VERIFIED = 50
XP_CLAIM_REFUTED = -25
XP_VIOLATION_FOUND = 20
XP_CLEAN_SCAN = 0
XP_TAMPERED = -100


def lookup(key: Column, table: dict[str, str], default: str, cast: str) -> Column:
    """Small fixed table as one CASE expression, so it stays inside generated code."""
    expr = F.lit(None)
    for name, value in reversed(list(table.items())):
        expr = F.when(key == name, F.lit(value)).otherwise(expr)
    return F.coalesce(expr, F.lit(default)).cast(cast)


def tier_weight(tier: Column) -> Column:
    return lookup(F.lower(tier), TIER_WEIGHTS, TIER_WEIGHTS["dpi_estimated"], "decimal(3,1)")


def role_weight(role: Column) -> Column:
    return lookup(F.lower(role), ROLE_WEIGHTS, ROLE_WEIGHTS["anonymous"], "decimal(3,1)")


def reputation_tier(xp: Column) -> Column:
    expr = F.lit(LOWEST_REPUTATION)
    for floor, name in reversed(REPUTATION_TIERS):
        expr = F.when(xp >= floor, F.lit(name)).otherwise(expr)
    return expr


def xp_change(has_claim: Column, claim_verified: Column, status: Column, tampered: Column) -> Column:
    """Points one citizen submission earns; a failed hash check overrides everything else."""
    return (
        F.when(tampered, F.lit(XP_TAMPERED))
        .when(has_claim & claim_verified, F.lit(XP_CLAIM_VERIFIED))
        .when(has_claim, F.lit(XP_CLAIM_REFUTED))
        .when(status == "non_compliant", F.lit(XP_VIOLATION_FOUND))
        .otherwise(F.lit(XP_CLEAN_SCAN))
        .cast("long")
    )


def xp_message_type(has_claim: Column, claim_verified: Column, status: Column, tampered: Column) -> Column:
    return (
        F.when(tampered, "tampering_detected")
        .when(has_claim & claim_verified, "violation_confirmed")
        .when(has_claim, "claim_refuted")
        .when(status == "non_compliant", "violation_confirmed")
        .otherwise("system_notice")
    )
