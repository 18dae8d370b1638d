"""Re-inspection tickets: spawned by conflicts, listed by urgency, updated, counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators.ledger import NO_BATCH, batch_code

# Urgency order of ticket priorities; anything else sorts last.
URGENCY = {"critical": 1, "high": 2, "medium": 3, "low": 4}
CLOSED = ["resolved", "dismissed"]
ACTIVE = ["open", "investigating"]


def spawn_tickets(conflicts: DataFrame) -> DataFrame:
    """One open ticket per conflicting scan, numbered from the product code and the scan time."""
    code = F.trim("gtin")
    suffix = F.when(F.length(code) >= 6, F.right(code, F.lit(6))).otherwise(code)
    stamp = F.date_format("created_at", "yyyyMMddHHmmss")
    batch = batch_code(F.col("batch_code"))
    return conflicts.where(F.col("conflict_type").isNotNull()).select(
        F.concat(F.lit("RIT-"), suffix, F.lit("-"), stamp).alias("ticket_number"),
        code.alias("gtin"),
        F.nullif(batch, F.lit(NO_BATCH)).alias("batch_code"),
        F.col("scan_id").alias("trigger_scan_id"),
        "prior_verdict",
        F.round("prior_confidence", 4).alias("prior_confidence"),
        F.col("prior_tier").alias("prior_calibration_tier"),
        "new_verdict",
        F.round("new_confidence", 4).alias("new_confidence"),
        F.coalesce("calibration_tier", F.lit("dpi_estimated")).alias("new_calibration_tier"),
        "conflict_type",
        "discrepancy_reason",
        "priority",
        F.lit("open").alias("status"),
        "created_at",
        F.col("created_at").alias("updated_at"),
    )


def urgency(priority):
    rank = F.lit(5)
    for name, order in URGENCY.items():
        rank = F.when(priority == name, F.lit(order)).otherwise(rank)
    return rank


def list_tickets(
    tickets: DataFrame,
    status: str | None = None,
    priority: str | None = None,
    gtin: str | None = None,
    source: str | None = None,
    search: str | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """One page of tickets, most urgent first. ``status='active'`` means neither closed state."""
    if status and status.lower() == "active":
        tickets = tickets.where(~F.col("status").isin(CLOSED))
    elif status and status.lower() != "all":
        tickets = tickets.where(F.col("status") == status.lower())
    if priority and priority.lower() != "all":
        tickets = tickets.where(F.col("priority") == priority.lower())
    if gtin:
        tickets = tickets.where(F.col("gtin") == gtin.strip())
    if source and source.lower() != "all":
        tickets = tickets.where(F.col("source") == source.lower())
    if search and search.strip():
        needle = F.lit(search.strip().lower())
        hits = [F.contains(F.lower(F.coalesce(c, F.lit(""))), needle) for c in ("ticket_number", "gtin", "product_name")]
        tickets = tickets.where(hits[0] | hits[1] | hits[2])
    return (
        tickets.orderBy(urgency(F.col("priority")), F.col("created_at").desc(), F.col("trigger_scan_id").desc())
        .offset(offset)
        .limit(limit)
    )


def ticket_summary(tickets: DataFrame) -> DataFrame:
    """Enforcement queue counters in one pass."""
    status, priority = F.col("status"), F.col("priority")
    live = status.isin(ACTIVE)
    return tickets.agg(
        F.count(F.lit(1)).alias("total_tickets"),
        F.count_if(status == "open").alias("open_tickets"),
        F.count_if((priority == "critical") & live).alias("critical_tickets"),
        F.count_if((priority == "high") & live).alias("high_tickets"),
        F.count_if(status == "investigating").alias("investigating_tickets"),
        F.count_if(status == "resolved").alias("resolved_tickets"),
    )


def update_tickets(tickets: DataFrame, updates: DataFrame) -> DataFrame:
    """Applies updates to tickets; only supplied values change, and of several the latest supplied one counts.

    ``updates`` has trigger_scan_id (a ticket's unique key), status, assigned_to, resolution_notes
    and updated_at; any number of rows per ticket. Closing a ticket stamps resolved_at with the time of
    its last closing update.
    """
    status = F.lower(F.nullif("status", F.lit("")))

    def last(value):
        # Null times come first; equal times are decided by the value, so the result is one.
        return F.max(F.when(value.isNotNull(), F.struct(F.col("updated_at").alias("at"), value.alias("value"))))["value"]

    new = updates.groupBy("trigger_scan_id").agg(
        last(status).alias("_status"),
        last(F.col("assigned_to")).alias("_assigned"),
        last(F.col("resolution_notes")).alias("_notes"),
        F.max("updated_at").alias("_at"),
        F.max(F.when(status.isin(CLOSED), F.col("updated_at"))).alias("_closed_at"),
    )
    for name, kind in (("assigned_to", "string"), ("resolution_notes", "string"), ("resolved_at", "timestamp_ntz")):
        if name not in tickets.columns:
            tickets = tickets.withColumn(name, F.lit(None).cast(kind))
    return (
        tickets.join(new, "trigger_scan_id", "left")
        .withColumns(
            {
                "status": F.coalesce("_status", "status"),
                "assigned_to": F.coalesce("_assigned", "assigned_to"),
                "resolution_notes": F.coalesce("_notes", "resolution_notes"),
                "resolved_at": F.when(F.col("_status").isin(CLOSED), F.col("_closed_at")).otherwise(F.col("resolved_at")),
                "updated_at": F.coalesce("_at", "updated_at"),
            }
        )
        .drop("_status", "_assigned", "_notes", "_at", "_closed_at")
    )


def with_trigger(tickets: DataFrame, scans: DataFrame, violations: DataFrame) -> DataFrame:
    """Tickets with their trigger scan and its violations; missing source and claim come from the scan."""
    nested = violations.groupBy("scan_id").agg(
        F.array_sort(F.collect_list(F.struct("field_name", "violation_type", "severity"))).alias("violations")
    )
    scan = scans.select(
        F.col("scan_id").alias("trigger_scan_id"),
        F.lit(True).alias("_found"),
        F.col("claimed_violation_type").alias("_claim"),
        F.when(F.col("user_role") == "citizen", "citizen").otherwise("inspector").alias("_source"),
    )
    for name in ("source", "claimed_violation_type"):
        if name not in tickets.columns:
            tickets = tickets.withColumn(name, F.lit(None).cast("string"))
    claim = F.when(F.col("_found"), F.col("_claim")).otherwise(F.col("claimed_violation_type"))
    return (
        tickets.join(scan, "trigger_scan_id", "left")
        .join(nested.withColumnRenamed("scan_id", "trigger_scan_id"), "trigger_scan_id", "left")
        .withColumn("source", F.coalesce("_source", "source", F.lit("inspector")))
        .withColumn("claimed_violation_type", claim)
        .withColumn("violations_count", F.coalesce(F.nullif(F.size("violations"), F.lit(-1)), F.lit(0)))
        .drop("_claim", "_source", "_found")
    )
