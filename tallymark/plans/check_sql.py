"""SQL pieces shared by several checks, written independently of the operators."""

TIER_W = (
    "CASE calibration_tier WHEN 'ar_verified' THEN 2.0 WHEN 'reference_object' THEN 1.4 "
    "WHEN 'package_dimension' THEN 1.1 ELSE 0.7 END"
)
ROLE_W = "CASE user_role WHEN 'inspector' THEN 1.6 WHEN 'admin' THEN 1.6 WHEN 'viewer' THEN 0.9 ELSE 0.8 END"


def half_even(value: str, scale: int) -> str:
    return f"CAST(round_even(CAST({value} AS DECIMAL(28,12)), {scale}) AS DOUBLE)"


def verdict(good: str, bad: str) -> str:
    ratio = f"(CAST({good} AS DOUBLE) / nullif(CAST({good} AS DOUBLE) + CAST({bad} AS DOUBLE), 0))"
    return (
        f"CASE WHEN {ratio} IS NULL THEN 'compliant' WHEN {ratio} >= 0.75 THEN 'compliant' "
        f"WHEN {ratio} <= 0.25 THEN 'non_compliant' ELSE 'disputed' END"
    )


def confidence(good: str, bad: str, weight: str, n: str) -> str:
    ratio = f"(CAST({good} AS DOUBLE) / nullif(CAST({good} AS DOUBLE) + CAST({bad} AS DOUBLE), 0))"
    quality = f"least(1.0, CAST({weight} AS DOUBLE) / {n} / 3.2)"
    volume = f"least(1.0, 0.40 + 0.15 * {n})"
    raw = (
        f"CASE WHEN {ratio} > 0.25 AND {ratio} < 0.75 THEN 0.40 + 0.30 * {quality} + 0.20 * {volume} "
        f"ELSE 0.40 * abs({ratio} - 0.5) * 2.0 + 0.35 * {quality} + 0.25 * {volume} END"
    )
    return f"CASE WHEN {ratio} IS NULL THEN 0.5 ELSE greatest(0.1, least(1.0, {half_even(raw, 4)})) END"


EVIDENCE_VIEW = {
    "e_evidence": f"""SELECT *, CAST({TIER_W} * {ROLE_W} AS DECIMAL(12,6)) AS w,
        CASE WHEN compliance_status = 'compliant' THEN CAST({TIER_W} * {ROLE_W} * confidence AS DECIMAL(12,6)) ELSE 0 END AS sf,
        CASE WHEN compliance_status = 'compliant' THEN 0 ELSE CAST({TIER_W} * {ROLE_W} * confidence AS DECIMAL(12,6)) END AS sa,
        row_number() OVER (PARTITION BY gtin ORDER BY created_at DESC, scan_id DESC) AS recency
        FROM v_scans""",
}

_ROLLING = """SELECT *,
    sum(sf) OVER cur AS sf1, sum(sa) OVER cur AS sa1, sum(w) OVER cur AS w1, count(*) OVER cur AS n1,
    sum(sf) OVER old AS sf0, sum(sa) OVER old AS sa0, sum(w) OVER old AS w0, count(*) OVER old AS n0,
    count(*) FILTER (calibration_tier = 'ar_verified') OVER hist AS c_ar,
    count(*) FILTER (calibration_tier = 'reference_object') OVER hist AS c_ref,
    count(*) FILTER (calibration_tier = 'package_dimension') OVER hist AS c_pkg,
    count(*) FILTER (calibration_tier = 'dpi_estimated') OVER hist AS c_dpi
  FROM e_evidence
  WINDOW cur AS (PARTITION BY gtin ORDER BY created_at, scan_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW),
         old AS (PARTITION BY gtin ORDER BY created_at, scan_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING),
         hist AS (PARTITION BY gtin ORDER BY created_at, scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

_CONFLICT_KIND = """CASE
    WHEN prior_verdict IS NULL THEN NULL
    WHEN calibration_tier IN ('ar_verified','reference_object') AND c_ar = 0 AND c_dpi > 0
         AND ((prior_verdict = 'compliant' AND st = 'non_compliant') OR (prior_verdict = 'non_compliant' AND st = 'compliant')) THEN 'sensor_tier_escalation'
    WHEN prior_verdict = 'compliant' AND 'non_compliant' IN (st, new_verdict) THEN 'verdict_inversion'
    WHEN prior_verdict = 'non_compliant' AND 'compliant' IN (st, new_verdict) THEN 'verdict_inversion'
    WHEN new_verdict = 'disputed' AND prior_verdict <> 'disputed' THEN 'consensus_disputed'
    WHEN round(prior_confidence - new_confidence, 6) >= 0.20 AND st <> prior_verdict THEN 'confidence_drop' END"""

ROLLING_VIEWS = {
    **EVIDENCE_VIEW,
    "e_windows": _ROLLING,
    "e_rolling": f"""SELECT *, CASE WHEN n0 > 0 THEN {verdict('sf0', 'sa0')} END AS prior_verdict,
        CASE WHEN n0 > 0 THEN {confidence('sf0', 'sa0', 'w0', 'n0')} END AS prior_confidence,
        {verdict('sf1', 'sa1')} AS new_verdict, {confidence('sf1', 'sa1', 'w1', 'n1')} AS new_confidence,
        CASE WHEN compliance_status = 'compliant' THEN 'compliant' ELSE 'non_compliant' END AS st
        FROM e_windows""",
    "e_kinds": f"SELECT *, {_CONFLICT_KIND} AS conflict_type FROM e_rolling",
    "e_tickets": """SELECT 'RIT-' || right(gtin, 6) || '-' || strftime(created_at, '%Y%m%d%H%M%S') AS ticket_number, gtin,
        nullif(trim(coalesce(batch_code, '')), '') AS batch_code, scan_id AS trigger_scan_id, prior_verdict, prior_confidence,
        CASE greatest(c_ar, c_ref, c_pkg, c_dpi) WHEN c_ar THEN 'ar_verified' WHEN c_ref THEN 'reference_object'
             WHEN c_pkg THEN 'package_dimension' ELSE 'dpi_estimated' END AS prior_calibration_tier,
        new_verdict, new_confidence, calibration_tier AS new_calibration_tier, conflict_type,
        CASE conflict_type
          WHEN 'sensor_tier_escalation' THEN 'a precise ' || calibration_tier || ' scan found ' || st || ' where no depth scan had been made; '
          WHEN 'verdict_inversion' THEN 'a scan by ' || user_role || ' with ' || calibration_tier || ' found ' || st || ' and the verdict is now ' || new_verdict || '; '
          WHEN 'consensus_disputed' THEN 'contradicting scans leave the verdict disputed; '
          ELSE 'a scan that found ' || st || ' brought confidence down to ' || CAST(CAST(new_confidence AS DECIMAL(6,4)) AS VARCHAR) || '; ' END
          || 'the consensus before was ' || prior_verdict || ' at confidence ' || CAST(CAST(prior_confidence AS DECIMAL(6,4)) AS VARCHAR) AS discrepancy_reason,
        CASE conflict_type
          WHEN 'sensor_tier_escalation' THEN CASE WHEN prior_verdict = 'compliant' THEN 'critical' ELSE 'high' END
          WHEN 'verdict_inversion' THEN CASE WHEN prior_verdict = 'compliant' AND (user_role IN ('inspector','admin')
               OR calibration_tier IN ('ar_verified','reference_object') OR new_verdict = 'non_compliant') THEN 'critical' ELSE 'high' END
          WHEN 'consensus_disputed' THEN CASE WHEN calibration_tier IN ('ar_verified','reference_object') THEN 'high' ELSE 'medium' END
          ELSE CASE WHEN round(prior_confidence - new_confidence, 6) >= 0.25 THEN 'high' ELSE 'medium' END END AS priority,
        'open' AS status, created_at, created_at AS updated_at
        FROM e_kinds WHERE conflict_type IS NOT NULL""",
    # The state an enforcement team leaves tickets in: derived from the trigger scan, so it is repeatable.
    "e_worked": """SELECT k.* EXCLUDE (status, updated_at),
        CASE s.user_role WHEN 'inspector' THEN 'investigating' WHEN 'admin' THEN 'resolved' WHEN 'viewer' THEN 'dismissed' ELSE k.status END AS status,
        CASE WHEN s.user_role IN ('inspector', 'admin', 'viewer') THEN 'officer ' || CAST(s.user_id % 3 AS VARCHAR) END AS assigned_to,
        CASE WHEN s.user_role = 'admin' THEN 'label corrected' END AS resolution_notes,
        CASE WHEN s.user_role IN ('admin', 'viewer') THEN s.created_at + INTERVAL 3 DAY END AS resolved_at,
        CASE WHEN s.user_role IN ('inspector', 'admin', 'viewer') THEN s.created_at + INTERVAL 3 DAY ELSE k.updated_at END AS updated_at
        FROM e_tickets k JOIN v_scans s ON s.scan_id = k.trigger_scan_id""",
}
