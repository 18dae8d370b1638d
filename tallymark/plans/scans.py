"""Whole label scans: text blocks to fields to verdict to ledger, without ready-made fields in between."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators import classify, rules
from tallymark.plans.labels import LABEL_VIEWS, scaled
from tallymark.plans.registry import query
from tallymark.plans.tokens import CLASS_VIEWS, tokens
from tallymark.sources.fixtures import Tables

OWN_VIEWS = {
    **CLASS_VIEWS,
    "e_read": """SELECT d.scan_id, d.field_name, trim(d.extracted_value) AS extracted_value, 'ocr_proximity' AS extraction_method, CAST(d.confidence AS DOUBLE) AS confidence, CAST(d.y2 - d.y AS DOUBLE) AS h
      FROM e_final d WHERE d.accepted""",
}
# The label views once more, over the fields that were read; the origin is settled already.
READ_VIEWS = {f"{name}3": re.sub(r"\b(e_\w+)\b", r"\g<1>3", body).replace("v_fields", "e_read") for name, body in LABEL_VIEWS.items() if name not in ("e_place", "e_origin", "e_val")}
READ_VIEWS["e_found3"] = re.sub(r", p\.country.*?p\.src", "", READ_VIEWS["e_found3"]).replace("LEFT JOIN e_place3 p ON p.scan_id = c.scan_id", "")
READ_VIEWS["e_val3"] = """SELECT *, CASE WHEN field_name = 'manufacture_date' AND trim(coalesce(extracted_value, '')) = '' THEN exp_value ELSE extracted_value END AS val,
    CASE WHEN field_name = 'manufacture_date' AND trim(coalesce(extracted_value, '')) = '' THEN exp_h ELSE h END AS hh, coalesce(confidence, 0.0) AS cc FROM e_found3"""
SCAN_VIEWS = {**OWN_VIEWS, **READ_VIEWS}


def read_fields(t: Tables) -> DataFrame:
    """Accepted fields of every label with the height of the box around the blocks that each was read from."""
    found = classify.classify_labels(tokens(t)).where("accepted")
    return found.select(
        "scan_id",
        "field_name",
        F.trim("extracted_value").alias("extracted_value"),
        "confidence",
        (F.col("box.y2") - F.col("box.y")).alias("h"),
        F.lit("ocr_proximity").alias("extraction_method"),
    )


def scanned(t: Tables) -> DataFrame:
    return rules.evaluate(scaled(t), read_fields(t))


@query(
    "label_scan_verdicts",
    "SELECT scan_id, compliance_status, total_violations, high_count, medium_count FROM e_status3",
    SCAN_VIEWS,
)
def label_scan_verdicts(t: Tables) -> DataFrame:
    def count(key: str):
        return F.coalesce(F.try_element_at("severity_counts", F.lit(key)), F.lit(0))

    done = rules.summaries(scanned(t))
    return done.select("scan_id", "compliance_status", "total_violations", count("high").alias("high_count"), count("medium").alias("medium_count"))


@query("label_scan_violations", "SELECT * FROM e_viol3", SCAN_VIEWS)
def label_scan_violations(t: Tables) -> DataFrame:
    return rules.violations_of(scanned(t))
