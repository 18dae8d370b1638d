"""Citizen submissions: claims, tamper checks, experience points, gates and notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.trust import XP_START, reputation_tier, xp_change, xp_message_type
from tallymark.operators.consensus import latest
from tallymark.operators.skew import DEFAULT_POLICY, SkewPolicy, minute_of, running_sum

AUTO_REPORT_CONFIDENCE = 0.70


def normalised_claim(claim: Column) -> Column:
    return F.translate(F.lower(F.trim(claim)), "- ", "__")


def supports(claim: Column, field: Column, kind: Column) -> Column:
    """Does a violation of this field and type bear the claim out?"""
    field, kind = F.lower(F.coalesce(field, F.lit(""))), F.lower(F.coalesce(kind, F.lit("")))

    def says(text: Column, word: str) -> Column:
        return F.contains(text, F.lit(word))

    return (
        (says(claim, "mrp") & says(field, "mrp"))
        | (says(claim, "font") & (says(kind, "font") | says(kind, "undersized")))
        | (says(claim, "origin") & says(field, "origin"))
        | F.contains(kind, claim)
        | F.contains(field, claim)
    )


def verify_claims(scans: DataFrame, violations: DataFrame) -> DataFrame:
    """Citizen scans with has_claim and claim_verified. The join and the grouping share one shuffle."""
    citizens = scans.where(F.col("user_role") == "citizen").withColumn(
        "claim", F.nullif(normalised_claim(F.col("claimed_violation_type")), F.lit(""))
    )
    found = violations.select("scan_id", F.col("field_name").alias("_field"), F.col("violation_type").alias("_kind"))
    # Scans are unique by id; grouping by all their columns lets the join's shuffle serve for the grouping.
    columns = citizens.columns
    judged = citizens.join(found, "scan_id", "left").withColumn(
        "_proof", F.coalesce(supports(F.col("claim"), F.col("_field"), F.col("_kind")) & F.col("_field").isNotNull(), F.lit(False))
    )
    return (
        judged.groupBy(*columns)
        .agg(F.bool_or("_proof").alias("claim_verified"))
        .withColumn("has_claim", F.col("claim").isNotNull())
        .drop("claim")
    )


def xp_events(verified: DataFrame) -> DataFrame:
    """One experience-point event per citizen scan."""
    facts = (F.col("has_claim"), F.col("claim_verified"), F.col("compliance_status"), F.coalesce("tampered", F.lit(False)))
    return verified.select(
        "user_id",
        "scan_id",
        "created_at",
        xp_change(*facts).alias("xp_change"),
        xp_message_type(*facts).alias("notification_type"),
    )


def xp_balance(events: DataFrame, policy: SkewPolicy = DEFAULT_POLICY, sizes: DataFrame | None = None) -> DataFrame:
    """Running balance per user after each event; busy users are cut into blocks.

    ``sizes`` may name the raw submissions, so that finding busy users does not repeat the claim checks.
    """
    order = ["created_at", "scan_id"]
    summed = running_sum(
        events, "user_id", order, minute_of("created_at"), F.col("xp_change"), "_sum", policy, sizes
    )
    return summed.withColumn("xp", (F.col("_sum") + XP_START).cast("long")).drop("_sum")


def user_balances(users: DataFrame, events: DataFrame) -> DataFrame:
    """Every user with the current balance and reputation tier."""
    sums = events.groupBy("user_id").agg(F.sum("xp_change").alias("_sum"))
    return (
        users.join(sums, "user_id", "left")
        .withColumn("xp", F.lit(XP_START) + F.coalesce("_sum", F.lit(0)))
        .withColumn("reputation_tier", reputation_tier(F.col("xp")))
        .drop("_sum")
    )


def admit(submissions: DataFrame, balances: DataFrame) -> DataFrame:
    """Drops submissions of users whose balance is negative."""
    return submissions.join(balances.where(F.col("xp") < 0).select("user_id"), "user_id", "left_anti")


def latest_notifications(events: DataFrame, n: int = 50) -> DataFrame:
    """Newest ``n`` notifications of each user."""
    return latest(events, "user_id", n, F.col("created_at").desc(), F.col("scan_id").desc())


def mark_read(notifications: DataFrame, reads: DataFrame) -> DataFrame:
    """Sets is_read where a read request names the notification and its own user."""
    asked = reads.select("user_id", "scan_id").distinct().withColumn("_read", F.lit(True))
    return (
        notifications.join(asked, ["user_id", "scan_id"], "left")
        .withColumn("is_read", F.coalesce("_read", "is_read"))
        .drop("_read")
    )


def triage(state: DataFrame, tickets: DataFrame | None = None) -> DataFrame:
    """Citizen scans: report at once when no ticket was raised and the ledger is confident.

    Without ``tickets`` the state's own conflict_type tells whether one was raised.
    """
    rows = state.where(F.col("user_role") == "citizen")
    if tickets is None:
        rows = rows.withColumn("_ticket", F.when(F.col("conflict_type").isNotNull(), F.lit(True)))
    else:
        raised = tickets.select(F.col("trigger_scan_id").alias("scan_id"), F.lit(True).alias("_ticket"))
        rows = rows.join(raised, "scan_id", "left")
    sure = F.col("_ticket").isNull() & (F.coalesce("new_confidence", F.lit(0.0)) >= AUTO_REPORT_CONFIDENCE)
    return rows.withColumn("handling", F.when(sure, "auto_report").otherwise("manual_review")).drop("_ticket")


def tamper_audit(manifest: DataFrame, files: DataFrame, content: Column) -> DataFrame:
    """Client hash against the hash of what arrived; blank client hashes are not checked.

    The hash is taken before the join, so file bodies are never shuffled.
    """
    hashed = files.select("file_id", F.sha2(content.cast("binary"), 256).alias("server_sha256"))
    client = F.lower(F.trim("client_sha256"))
    return manifest.join(hashed, "file_id").select(
        "file_id",
        "server_sha256",
        F.nullif(client, F.lit("")).alias("client_sha256"),
        F.when(F.coalesce(F.nullif(client, F.lit("")), F.col("server_sha256")) != F.col("server_sha256"), "tampered")
        .when(F.coalesce(client, F.lit("")) == "", "unchecked")
        .otherwise("verified")
        .alias("integrity"),
    )
