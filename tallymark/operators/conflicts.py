"""Rolling ledger state per scan, and the conflicts a scan raises against the state before it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators.consensus import EVIDENCE_LIMIT, confidence_of, is_compliant, verdict_of, with_evidence
from tallymark.operators.ledger import TIERS, known_tier
from tallymark.operators.skew import DEFAULT_POLICY, SkewPolicy, minute_of, with_blocks

HIGH_PRECISION = ["ar_verified", "reference_object"]
OFFICIALS = ["inspector", "admin"]
ORDER = ["created_at", "scan_id"]


@dataclass(frozen=True)
class ConflictConfig:
    confidence_drop: float = 0.20
    steep_drop: float = 0.25
    tier_escalation: bool = True
    verdict_flip: bool = True
    disputed: bool = True


DEFAULT_CONFIG = ConflictConfig()


def rolling_state(
    scans: DataFrame,
    policy: SkewPolicy = DEFAULT_POLICY,
    evidence: int = EVIDENCE_LIMIT,
    order: list[str] = ORDER,
    bucket: Column | None = None,
) -> DataFrame:
    """Every scan with the product's state just before it and just after it.

    State is the consensus over the latest ``evidence`` scans plus lifetime tier counts. All frames
    share one sort; hot products are cut into blocks that repeat the rows a frame can reach.
    """
    rows = with_evidence(scans.where(F.col("gtin").isNotNull())).withColumn("_tier", known_tier(F.col("calibration_tier")))
    of_tier = {name: (F.col("_tier") == name).cast("long") for name in TIERS}
    bucket = minute_of("created_at") if bucket is None else bucket
    blocked = with_blocks(rows, "gtin", order, bucket, halo=evidence, sums=of_tier, policy=policy)
    ordered = Window.partitionBy("gtin", "_block").orderBy(*order)
    up_to_here = ordered.rowsBetween(Window.unboundedPreceding, 0)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, -1)

    # Sliding sums as differences of exact running sums: each row costs the same whatever the frame.
    parts = {"for": "ev_for", "against": "ev_against", "weight": "ev_weight"}
    counts = {
        f"prior_{name}": F.coalesce(F.col(f"before_{name}").cast("long"), F.sum(of_tier[name]).over(so_far), F.lit(0))
        for name in TIERS
    }
    running = blocked.withColumns(
        {**{f"_sum_{p}": F.sum(c).over(up_to_here) for p, c in parts.items()}, "_rn": F.row_number().over(ordered), **counts}
    )

    def back(column: str, rows: int) -> Column:
        return F.coalesce(F.lag(column, rows).over(ordered), F.lit(0))

    slid = {}
    for part in parts:
        column = f"_sum_{part}"
        slid[f"_{part}_new"] = F.col(column) - back(column, evidence)
        slid[f"_{part}_old"] = back(column, 1) - back(column, evidence + 1)
    slid["_n_new"] = F.least(F.col("_rn"), F.lit(evidence))
    slid["_n_old"] = F.least(F.col("_rn") - 1, F.lit(evidence))
    wide = running.withColumns(slid).where(~F.col("_halo"))
    old = [F.col(f"_{part}_old") for part in ("for", "against", "weight", "n")]
    new = [F.col(f"_{part}_new") for part in ("for", "against", "weight", "n")]
    first = F.col("_n_old") == 0
    return wide.select(
        *scans.columns,
        F.when(~first, verdict_of(*old[:2])).alias("prior_verdict"),
        F.when(~first, confidence_of(*old)).alias("prior_confidence"),
        verdict_of(*new[:2]).alias("new_verdict"),
        confidence_of(*new).alias("new_confidence"),
        *counts,
    )


def dominant_prior_tier(counts: dict[str, Column]) -> Column:
    """Tier with the largest count; ties go to the more precise tier."""
    most = F.greatest(*counts.values())
    return F.coalesce(*[F.when(count == most, F.lit(name)) for name, count in counts.items()])


def exactly(value: Column) -> Column:
    """A confidence as text with its four decimals."""
    return value.cast("decimal(6,4)").cast("string")


def discrepancy_reason(kind: Column, status: Column, tier: Column, role: Column) -> Column:
    """Why a scan conflicts, in one sentence for the person who re-inspects."""
    prior, new = F.col("prior_verdict"), F.col("new_verdict")
    before = F.concat(F.lit("the consensus before was "), prior, F.lit(" at confidence "), exactly(F.col("prior_confidence")))
    return (
        F.when(kind == "sensor_tier_escalation", F.concat(F.lit("a precise "), tier, F.lit(" scan found "), status, F.lit(" where no depth scan had been made; "), before))
        .when(kind == "verdict_inversion", F.concat(F.lit("a scan by "), role, F.lit(" with "), tier, F.lit(" found "), status, F.lit(" and the verdict is now "), new, F.lit("; "), before))
        .when(kind == "consensus_disputed", F.concat(F.lit("contradicting scans leave the verdict disputed; "), before))
        .when(kind == "confidence_drop", F.concat(F.lit("a scan that found "), status, F.lit(" brought confidence down to "), exactly(F.col("new_confidence")), F.lit("; "), before))
    )


def with_conflict(state: DataFrame, config: ConflictConfig = DEFAULT_CONFIG) -> DataFrame:
    """Adds conflict_type, priority, prior_tier and discrepancy_reason; all null where the scan raises no conflict.

    The first matching rule wins: tier escalation, verdict inversion, disputed consensus,
    confidence drop. A product's first scan has no prior state and never conflicts.
    """
    prior, new = F.col("prior_verdict"), F.col("new_verdict")
    status = F.when(is_compliant(F.col("compliance_status")), "compliant").otherwise("non_compliant")
    tier = F.coalesce(F.col("calibration_tier"), F.lit("dpi_estimated"))
    role = F.coalesce(F.col("user_role"), F.lit("anonymous"))
    precise = tier.isin(HIGH_PRECISION)
    uncalibrated = (F.col("prior_ar_verified") == 0) & (F.col("prior_dpi_estimated") > 0)
    drop = F.col("prior_confidence") - F.col("new_confidence")

    escalated = F.lit(config.tier_escalation) & precise & uncalibrated
    worse = (prior == "compliant") & ((status == "non_compliant") | (new == "non_compliant"))
    better = (prior == "non_compliant") & ((status == "compliant") | (new == "compliant"))
    grave = role.isin(OFFICIALS) | precise | (new == "non_compliant")
    flips = F.lit(config.verdict_flip)

    rules = [
        (escalated & (prior == "compliant") & (status == "non_compliant"), "sensor_tier_escalation", F.lit("critical")),
        (escalated & (prior == "non_compliant") & (status == "compliant"), "sensor_tier_escalation", F.lit("high")),
        (flips & worse, "verdict_inversion", F.when(grave, "critical").otherwise("high")),
        (flips & better, "verdict_inversion", F.lit("high")),
        (
            F.lit(config.disputed) & (new == "disputed") & (prior != "disputed"),
            "consensus_disputed",
            F.when(precise, "high").otherwise("medium"),
        ),
        (
            (F.round(drop, 6) >= config.confidence_drop) & (status != prior),
            "confidence_drop",
            F.when(F.round(drop, 6) >= config.steep_drop, "high").otherwise("medium"),
        ),
    ]
    found = F.coalesce(
        *[
            F.when(prior.isNotNull() & test, F.struct(F.lit(kind).alias("conflict_type"), level.alias("priority")))
            for test, kind, level in rules
        ]
    )
    counts = {name: F.col(f"prior_{name}") for name in TIERS}
    return state.withColumn("_found", found).withColumns(
        {
            "conflict_type": F.col("_found.conflict_type"),
            "priority": F.col("_found.priority"),
            "prior_tier": F.when(F.col("_found").isNotNull(), dominant_prior_tier(counts)),
            "discrepancy_reason": discrepancy_reason(F.col("_found.conflict_type"), status, tier, role),
        }
    ).drop("_found")
