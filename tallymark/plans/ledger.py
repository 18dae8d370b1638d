"""Ledger, consensus, conflict and ticket queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators.conflicts import rolling_state, with_conflict
from tallymark.operators.consensus import latest_evidence
from tallymark.operators.ledger import batch_breakdown, build_ledger, calibration_breakdown, list_ledger, scan_history
from tallymark.operators.tickets import list_tickets, spawn_tickets, ticket_summary, update_tickets, with_trigger
from tallymark.plans.check_sql import EVIDENCE_VIEW, ROLLING_VIEWS, confidence, verdict
from tallymark.plans.registry import query
from tallymark.sources.fixtures import Tables

LEDGER_VIEWS = {
    **EVIDENCE_VIEW,
    "e_ledger": f"""SELECT t.*, c.evidence_count, c.current_verdict, c.rolling_confidence FROM (
        SELECT gtin, count(*) AS total_scans, count(*) FILTER (compliance_status = 'compliant') AS compliant_scans,
          count(*) FILTER (compliance_status <> 'compliant') AS non_compliant_scans,
          count(*) FILTER (calibration_tier = 'ar_verified') AS ar_verified_count,
          count(*) FILTER (calibration_tier = 'reference_object') AS reference_object_count,
          count(*) FILTER (calibration_tier = 'package_dimension') AS package_dimension_count,
          count(*) FILTER (calibration_tier = 'dpi_estimated') AS dpi_estimated_count,
          coalesce(first(product_name ORDER BY created_at, scan_id) FILTER (product_name NOT LIKE '%GTIN-%'),
                   last(product_name ORDER BY created_at, scan_id) FILTER (product_name IS NOT NULL)) AS product_name,
          first(category ORDER BY created_at, scan_id) FILTER (category IS NOT NULL) AS category,
          last(scan_id ORDER BY created_at, scan_id) AS last_scan_id, max(created_at) AS last_scanned_at
        FROM v_scans GROUP BY gtin) t JOIN (
        SELECT gtin, count(*) AS evidence_count, {verdict('sum(sf)', 'sum(sa)')} AS current_verdict,
          {confidence('sum(sf)', 'sum(sa)', 'sum(w)', 'count(*)')} AS rolling_confidence
        FROM e_evidence WHERE recency <= 100 GROUP BY gtin) c USING (gtin)""",
}


@query("ledger_consensus", "SELECT * FROM e_ledger", LEDGER_VIEWS)
def ledger_consensus(t: Tables) -> DataFrame:
    return build_ledger(t.scans)


@query(
    "ledger_page",
    """SELECT gtin, current_verdict, rolling_confidence, last_scanned_at FROM e_ledger WHERE current_verdict = 'disputed'
       ORDER BY last_scanned_at DESC, gtin LIMIT 20 OFFSET 5""",
    LEDGER_VIEWS,
)
def ledger_page(t: Tables) -> DataFrame:
    page = list_ledger(build_ledger(t.scans), verdict="disputed", limit=20, offset=5)
    return page.select("gtin", "current_verdict", "rolling_confidence", "last_scanned_at")


@query(
    "ledger_batches",
    """SELECT gtin, CASE WHEN trim(coalesce(batch_code, '')) = '' THEN 'unspecified' ELSE trim(batch_code) END AS batch_code,
         count(*) AS total_scans, count(*) FILTER (compliance_status = 'compliant') AS compliant_scans,
         count(*) FILTER (compliance_status <> 'compliant') AS non_compliant_scans,
         count(*) FILTER (calibration_tier = 'ar_verified') AS ar_verified_count,
         count(*) FILTER (calibration_tier = 'reference_object') AS reference_object_count,
         count(*) FILTER (calibration_tier = 'package_dimension') AS package_dimension_count,
         count(*) FILTER (calibration_tier = 'dpi_estimated') AS dpi_estimated_count,
         max(created_at) AS last_scanned_at,
         CASE WHEN 4 * count(*) FILTER (compliance_status = 'compliant') >= 3 * count(*) THEN 'compliant'
              WHEN 4 * count(*) FILTER (compliance_status = 'compliant') <= count(*) THEN 'non_compliant'
              ELSE 'disputed' END AS current_verdict
       FROM v_scans GROUP BY 1, 2""",
)
def ledger_batches(t: Tables) -> DataFrame:
    return batch_breakdown(t.scans)


@query(
    "ledger_calibration",
    """SELECT gtin, count(*) FILTER (calibration_tier = 'ar_verified') AS ar_verified,
         count(*) FILTER (calibration_tier = 'reference_object') AS reference_object,
         count(*) FILTER (calibration_tier = 'package_dimension') AS package_dimension,
         count(*) FILTER (calibration_tier = 'dpi_estimated') AS dpi_estimated FROM v_scans GROUP BY gtin""",
)
def ledger_calibration(t: Tables) -> DataFrame:
    return calibration_breakdown(t.scans)


@query("latest_evidence", "SELECT gtin, scan_id, recency FROM e_evidence WHERE recency <= 100", EVIDENCE_VIEW)
def latest_evidence_query(t: Tables) -> DataFrame:
    return latest_evidence(t.scans.select("gtin", "scan_id", "created_at")).select("gtin", "scan_id", "recency")


@query(
    "scan_history",
    "SELECT gtin, scan_id, scan_type, compliance_status, batch_code, created_at FROM e_evidence WHERE recency <= 50",
    EVIDENCE_VIEW,
)
def scan_history_query(t: Tables) -> DataFrame:
    return scan_history(t.scans).select("gtin", "scan_id", "scan_type", "compliance_status", "batch_code", "created_at")


@query(
    "rolling_ledger",
    """SELECT gtin, scan_id, prior_verdict, prior_confidence, new_verdict, new_confidence, c_ar AS prior_ar_verified,
         c_ref AS prior_reference_object, c_pkg AS prior_package_dimension, c_dpi AS prior_dpi_estimated FROM e_rolling""",
    ROLLING_VIEWS,
)
def rolling_ledger(t: Tables) -> DataFrame:
    state = rolling_state(t.scans)
    return state.select("gtin", "scan_id", *[c for c in state.columns if c.startswith(("prior_", "new_"))])


def tickets(t: Tables) -> DataFrame:
    return spawn_tickets(with_conflict(rolling_state(t.scans)))


@query("conflict_tickets", "SELECT * FROM e_tickets", ROLLING_VIEWS)
def conflict_tickets(t: Tables) -> DataFrame:
    return tickets(t)


def worked_tickets(t: Tables) -> DataFrame:
    """Tickets after enforcement updates; the updates are a projection of the scans."""
    role = F.col("user_role")
    updates = t.scans.where(role.isin("inspector", "admin", "viewer")).select(
        F.col("scan_id").alias("trigger_scan_id"),
        F.when(role == "inspector", "investigating").when(role == "admin", "Resolved").otherwise("dismissed").alias("status"),
        F.concat(F.lit("officer "), (F.col("user_id") % 3).cast("string")).alias("assigned_to"),
        F.when(role == "admin", "label corrected").alias("resolution_notes"),
        (F.col("created_at") + F.expr("INTERVAL 3 DAYS")).alias("updated_at"),
    )
    return update_tickets(tickets(t), updates)


@query("ticket_updates", "SELECT * FROM e_worked", ROLLING_VIEWS)
def ticket_updates(t: Tables) -> DataFrame:
    return worked_tickets(t)


@query(
    "ticket_queue",
    """SELECT ticket_number, trigger_scan_id, priority, status FROM e_worked WHERE status NOT IN ('resolved', 'dismissed')
       ORDER BY CASE priority WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END,
         created_at DESC, trigger_scan_id DESC LIMIT 50""",
    ROLLING_VIEWS,
)
def ticket_queue(t: Tables) -> DataFrame:
    page = list_tickets(worked_tickets(t), status="active")
    return page.select("ticket_number", "trigger_scan_id", "priority", "status")


@query(
    "ticket_summary",
    """SELECT count(*) AS total_tickets, count(*) FILTER (status = 'open') AS open_tickets,
         count(*) FILTER (priority = 'critical' AND status IN ('open', 'investigating')) AS critical_tickets,
         count(*) FILTER (priority = 'high' AND status IN ('open', 'investigating')) AS high_tickets,
         count(*) FILTER (status = 'investigating') AS investigating_tickets,
         count(*) FILTER (status = 'resolved') AS resolved_tickets FROM e_worked""",
    ROLLING_VIEWS,
)
def ticket_summary_query(t: Tables) -> DataFrame:
    return ticket_summary(worked_tickets(t))


@query(
    "ticket_detail",
    """SELECT k.ticket_number, k.trigger_scan_id, k.priority, s.scan_type IS NOT NULL AS has_scan,
         CASE WHEN s.user_role = 'citizen' THEN 'citizen' ELSE 'inspector' END AS source, s.claimed_violation_type,
         CAST(coalesce(v.n, 0) AS INT) AS violations_count, v.listed AS violation_list
       FROM e_tickets k JOIN v_scans s ON s.scan_id = k.trigger_scan_id
       LEFT JOIN (SELECT scan_id, count(*) AS n, string_agg(field_name || ':' || violation_type || ':' || severity, ',' ORDER BY field_name, violation_type, severity) AS listed
                  FROM v_violations GROUP BY scan_id) v ON v.scan_id = k.trigger_scan_id""",
    ROLLING_VIEWS,
)
def ticket_detail(t: Tables) -> DataFrame:
    full = with_trigger(tickets(t), t.scans, t.violations)
    text = F.transform("violations", lambda v: F.concat_ws(":", v.field_name, v.violation_type, v.severity))
    return full.select(
        "ticket_number",
        "trigger_scan_id",
        "priority",
        F.lit(True).alias("has_scan"),
        "source",
        "claimed_violation_type",
        "violations_count",
        F.array_join(text, ",").alias("violation_list"),
    )
