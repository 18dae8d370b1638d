"""Explicit schemas of the business tables and of the stored scan document."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


S, L, I, D, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()

FIELD = _struct(
    ("extracted_value", S),
    ("extraction_method", S),
    ("confidence", D),
    ("bbox", T.ArrayType(I)),
)
VIOLATION = _struct(
    ("field_name", S), ("violation_type", S), ("severity", S), ("details", S), ("rule_reference", S)
)
SCAN_DOCUMENT = _struct(
    ("product_name", S),
    ("product_category", S),
    ("scan_type", S),
    ("compliance_status", S),
    ("final_result", S),
    ("source", S),
    ("claimed_violation_type", S),
    ("confidence_metrics", _struct(("overall_confidence", D), ("compliance_confidence", D), ("ocr_confidence", D))),
    ("fields", T.MapType(S, FIELD)),
    ("violations", T.ArrayType(VIOLATION)),
)

TABLES: dict[str, T.StructType] = {
    "scans": _struct(
        ("scan_id", L), ("scan_uid", S), ("gtin", S), ("batch_code", S), ("product_name", S), ("category", S),
        ("scan_type", S), ("source", S), ("user_id", L), ("user_role", S), ("calibration_tier", S),
        ("compliance_status", S), ("confidence", D), ("claimed_violation_type", S), ("created_at", TS),
    ),
    "fields": _struct(
        ("scan_id", L), ("field_name", S), ("extracted_value", S), ("extraction_method", S), ("confidence", D),
        ("x", I), ("y", I), ("w", I), ("h", I),
    ),
    "violations": _struct(
        ("scan_id", L), ("field_name", S), ("violation_type", S), ("severity", S), ("details", S), ("rule_reference", S)
    ),
    "tokens": _struct(
        ("scan_id", L), ("token_id", L), ("text", S), ("x", I), ("y", I), ("w", I), ("h", I), ("confidence", D), ("engine", S)
    ),
    "reviews": _struct(
        ("review_id", L), ("scan_id", L), ("inspector", S), ("verdict_override", S), ("comments", S), ("reviewed_at", TS)
    ),
    "audit_log": _struct(
        ("scan_uid", S), ("username", S), ("action", S), ("old_value", S), ("new_value", S), ("reason", S), ("logged_at", TS)
    ),
    "expiry_records": _struct(
        ("scan_uid", S), ("product_name", S), ("expiry_date", S), ("days_remaining", I), ("status", S),
        ("recommendation", S), ("created_at", TS),
    ),
    "notifications": _struct(
        ("user_id", L), ("scan_id", L), ("notification_type", S), ("xp_change", L), ("is_read", B), ("created_at", TS)
    ),
}

# Allowed states of the enumerated columns.
DOMAINS = {
    "scan_type": ["manual", "batch", "ecommerce", "multi_side"],
    "compliance_status": ["compliant", "non_compliant", "partial_review_needed", "inconclusive_partial_crop"],
    "violation_type": ["missing", "incorrect_format", "undersized_font"],
    "severity": ["critical", "high", "medium", "low"],
    "priority": ["critical", "high", "medium", "low"],
    "ticket_status": ["open", "investigating", "resolved", "dismissed"],
    "conflict_type": ["sensor_tier_escalation", "verdict_inversion", "consensus_disputed", "confidence_drop"],
    "notification_type": ["violation_confirmed", "claim_refuted", "system_notice", "tampering_detected"],
    "user_role": ["inspector", "admin", "viewer", "citizen"],
}
