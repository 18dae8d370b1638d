"""Label rule, font, gap and origin queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators import geo, rules
from tallymark.operators.fonts import height_mm, pixel_scale, required_height
from tallymark.plans.check_sql import half_even
from tallymark.plans.registry import query
from tallymark.rules import gazetteer as G
from tallymark.rules.packs import LABEL_RULES, Rule
from tallymark.session import shared_folder
from tallymark.sources.fixtures import Tables
from tallymark.sources.rule_packs import list_rules, load_rules, rules_table, store_rules


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def word_pattern(word: str) -> str:
    import re

    return quoted(r"\b" + re.escape(word) + r"\b")


def origin_sql(text: str) -> str:
    """The inference as one CASE per list, entry by entry, returning country|evidence|confidence|source."""

    def entry(country: str, kind: str, conf: float, source: str) -> str:
        return f"'{country}|{kind}|{conf}|' || {source}"

    low = f"lower({text})"
    named = (
        f"lower(trim(regexp_split_to_array(trim(regexp_extract({text}, "
        r"'(?i)(?:Country\s+of\s+Origin|Made\s+in|Product\s+of)[\s:\-]*([A-Za-z\s]+)', 1)), '[\n\r,;.]')[1]))"
    )
    explicit = " ".join(
        f"WHEN {named} = {quoted(k)} THEN {entry(v, 'explicit_label', 0.98, quoted('Explicit declaration'))}"
        for k, v in G.EXPLICIT.items()
    )
    states = " ".join(
        f"WHEN regexp_matches({low}, {word_pattern(k)}) THEN {entry('India', 'state', 0.95, quoted('State: ' + v))}"
        for k, v in G.STATES.items()
    )
    code = r"'(?i)\b(" + "|".join(G.STATE_CODES) + r")\s*[\-:\s]\s*([1-9][0-9]{5})\b'"
    code_of = f"upper(regexp_extract({text}, {code}, 1))"
    codes = " ".join(
        f"WHEN {code_of} = '{k}' THEN {entry('India', 'state', 0.95, quoted(v + ' (' + k + '-'))} || regexp_extract({text}, {code}, 2) || ')'"
        for k, v in G.STATE_CODES.items()
    )
    cities = " ".join(
        f"WHEN regexp_matches({low}, {word_pattern(k)}) THEN {entry('India', 'city', 0.92, quoted('City: ' + k.title() + ', ' + v))}"
        for k, v in G.CITIES.items()
    )
    pin = r"regexp_extract(" + text + r", '\b([1-9][0-9]{2}\s?[0-9]{3})\b', 1)"
    pins = (
        f"WHEN regexp_matches({low}, '{'|'.join(G.ADDRESS_WORDS)}') AND {pin} <> '' "
        f"THEN {entry('India', 'pincode', 0.88, quoted('PIN Code: '))} || replace({pin}, ' ', '')"
    )
    foreign = " ".join(
        f"WHEN regexp_matches({low}, {word_pattern(k)}) THEN {entry(v, 'state', 0.9, quoted(k.title() + ', ' + v))}"
        for k, v in G.FOREIGN.items()
    )
    keyword = rf"WHEN regexp_matches({low}, '\bindia\b') THEN {entry('India', 'explicit_label', 0.85, quoted('India keyword'))}"
    return f"CASE {explicit} {states} {codes} {cities} {pins} {foreign} {keyword} END"


ORIGIN_VIEW = {"e_origin": f"SELECT product_id, address_text, {origin_sql('address_text')} AS found FROM v_labels"}


@query(
    "origin_inference",
    """SELECT product_id, split_part(found, '|', 1) AS country, split_part(found, '|', 2) AS evidence_type,
      CAST(split_part(found, '|', 3) AS DOUBLE) AS confidence, split_part(found, '|', 4) AS inferred_from FROM e_origin WHERE found IS NOT NULL""",
    ORIGIN_VIEW,
)
def origin_inference(t: Tables) -> DataFrame:
    found = geo.with_origin(t.labels.select("product_id", "address_text"), "address_text").where(F.col("origin").isNotNull())
    return found.select("product_id", *[f"origin.{c}" for c in ("country", "evidence_type", "confidence", "inferred_from")])


@query(
    "origin_mix",
    """SELECT coalesce(split_part(found, '|', 1), 'unknown') AS country, coalesce(split_part(found, '|', 2), 'none') AS evidence_type,
      count(*) AS text_count FROM e_origin GROUP BY 1, 2""",
    ORIGIN_VIEW,
)
def origin_mix(t: Tables) -> DataFrame:
    return geo.origin_mix(t.labels, "address_text")


LISTING_ORIGIN_VIEWS = {
    "e_cand": r"""SELECT l.product_id, coalesce(nullif(l.country_of_origin, ''), l.spec_origin) AS stated,
        regexp_extract(l.description, '(?i)\b(?:made\s+in|product\s+of)\s+([A-Za-z\s]+)', 0) AS made,
        regexp_extract(l.description, '(?i)\bmanufactured\s+in\s+([A-Za-z\s]+)', 0) AS built,
        coalesce(nullif(l.manufacturer_address, ''), l.manufacturer, '') AS maker, b.address_text AS panel
      FROM v_listings l JOIN v_labels b USING (product_id)""",
    "e_judged": "SELECT *, "
    + ", ".join(f"{origin_sql(c)} AS {n}" for c, n in (("made", "g2"), ("built", "g3"), ("maker", "g4"), ("panel", "g5")))
    + f", {origin_sql(chr(39) + 'Country of Origin: ' + chr(39) + ' || stated')} AS g1 FROM e_cand",
}


@query(
    "listing_origin",
    """SELECT product_id,
      CASE WHEN stated IS NOT NULL THEN coalesce(split_part(g1, '|', 1), trim(stated)) ELSE coalesce(split_part(g2, '|', 1), split_part(g3, '|', 1), split_part(g4, '|', 1), split_part(g5, '|', 1), 'India') END AS origin_country,
      CASE WHEN stated IS NOT NULL THEN 'explicit_declaration' WHEN g2 IS NOT NULL THEN 'made_in_statement' WHEN g3 IS NOT NULL THEN 'manufactured_in_statement'
           WHEN g4 IS NOT NULL THEN 'manufacturer_' || split_part(g4, '|', 2) WHEN g5 IS NOT NULL THEN 'packaging_label_' || split_part(g5, '|', 2) ELSE 'default_presumption' END AS origin_evidence,
      CASE WHEN stated IS NOT NULL THEN CASE WHEN g1 IS NULL THEN 0.95 ELSE 0.98 END WHEN g2 IS NOT NULL THEN 0.92 WHEN g3 IS NOT NULL THEN 0.90
           WHEN g4 IS NOT NULL THEN CAST(split_part(g4, '|', 3) AS DOUBLE) WHEN g5 IS NOT NULL THEN CAST(split_part(g5, '|', 3) AS DOUBLE) ELSE 0.5 END AS origin_confidence
    FROM e_judged""",
    LISTING_ORIGIN_VIEWS,
)
def listing_origin(t: Tables) -> DataFrame:
    panels = t.labels.select("product_id", F.col("address_text").alias("panel_address"))
    resolved = geo.resolve_origin(t.listings.join(panels, "product_id", "left"))
    return resolved.select("product_id", "origin_country", "origin_evidence", "origin_confidence")


# Label evaluation. The pooled text of a label is its printed lines, joined.
SCALE_SQL = f"""CASE WHEN ar_px_per_mm > 0 THEN {half_even('ar_px_per_mm', 4)} WHEN ar_mm_per_px > 0 THEN {half_even('1.0 / CAST(ar_mm_per_px AS DOUBLE)', 4)}
      WHEN circle_px > 0 THEN {half_even('CAST(circle_px AS DOUBLE) / CAST(circle_mm AS DOUBLE)', 4)} WHEN package_width_mm > 0 THEN {half_even('CAST(image_width_px AS DOUBLE) / CAST(package_width_mm AS DOUBLE)', 4)}
      ELSE {half_even('CAST(300 AS DOUBLE) / 25.4', 4)} END"""
NEED_SQL = """CASE WHEN field_name = 'net_quantity' AND net_quantity_g IS NOT NULL THEN
        CASE WHEN net_quantity_g <= 50 THEN 1.5 WHEN net_quantity_g <= 200 THEN 2.0 WHEN net_quantity_g <= 1000 THEN 4.0 ELSE 6.0 END
      WHEN package_width_mm > 0 THEN CASE WHEN package_width_mm * package_width_mm * 0.015 <= 100 THEN 1.0 WHEN package_width_mm * package_width_mm * 0.015 <= 500 THEN 2.0
        WHEN package_width_mm * package_width_mm * 0.015 <= 2500 THEN 4.0 ELSE 6.0 END ELSE 2.0 END"""


def _rule_rows() -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS ord, '{r.field_name}' AS field_name, '{r.severity_if_missing}' AS sev, '{r.rule_reference}' AS ref" for i, r in enumerate(LABEL_RULES)
    )


def _format_case() -> str:
    return "CASE field_name " + " ".join(
        f"WHEN '{r.field_name}' THEN regexp_matches(val, {quoted('(?i)' + r.format_pattern)})" for r in LABEL_RULES
    ) + " END"


LABEL_VIEWS = {
    **ORIGIN_VIEW,
    "e_place": """SELECT product_id AS scan_id, split_part(found, '|', 1) AS country, split_part(found, '|', 2) AS kind, CAST(split_part(found, '|', 3) AS DOUBLE) AS conf,
        split_part(found, '|', 4) AS src FROM e_origin""",
    "e_scale": f"SELECT *, {SCALE_SQL} AS px_per_mm FROM v_camera",
    "e_rule_rows": _rule_rows(),
    "e_found": """SELECT c.scan_id, c.px_per_mm, c.net_quantity_g, c.package_width_mm, r.*, f.extracted_value, f.extraction_method, f.confidence, f.h,
        x.extracted_value AS exp_value, x.h AS exp_h, m.h AS maker_h, p.country, p.kind, p.conf, p.src
      FROM e_scale c CROSS JOIN e_rule_rows r LEFT JOIN v_fields f ON f.scan_id = c.scan_id AND f.field_name = r.field_name
      LEFT JOIN v_fields x ON x.scan_id = c.scan_id AND x.field_name = 'expiry_date'
      LEFT JOIN v_fields m ON m.scan_id = c.scan_id AND m.field_name = 'manufacturer_name_address'
      LEFT JOIN e_place p ON p.scan_id = c.scan_id""",
    "e_val": """SELECT *, CASE WHEN field_name = 'country_of_origin' THEN CASE WHEN country IS NOT NULL THEN 'Country of Origin: ' || country END
          WHEN field_name = 'manufacture_date' AND trim(coalesce(extracted_value, '')) = '' THEN exp_value ELSE extracted_value END AS val,
        CASE WHEN field_name = 'country_of_origin' THEN CASE WHEN country IS NOT NULL THEN maker_h END
          WHEN field_name = 'manufacture_date' AND trim(coalesce(extracted_value, '')) = '' THEN exp_h ELSE h END AS hh,
        CASE WHEN field_name = 'country_of_origin' THEN CASE WHEN country IS NOT NULL THEN greatest(0.92, conf) ELSE 0.0 END ELSE coalesce(confidence, 0.0) END AS cc
      FROM e_found""",
    "e_checks": f"""SELECT *, trim(coalesce(val, '')) <> '' AS present, trim(coalesce(val, '')) <> '' AND {_format_case()} AS format_valid,
        CASE WHEN trim(coalesce(val, '')) <> '' THEN {half_even('CAST(hh AS DOUBLE) / px_per_mm', 2)} END AS measured_mm,
        CASE WHEN trim(coalesce(val, '')) <> '' AND hh IS NOT NULL THEN CAST({NEED_SQL} AS DOUBLE) END AS required_mm FROM e_val""",
    "e_viol": """SELECT scan_id, field_name, 'missing' AS violation_type, sev AS severity, ref AS rule_reference FROM e_checks WHERE NOT present
      UNION ALL SELECT scan_id, field_name, 'incorrect_format', CASE WHEN field_name IN ('mrp', 'manufacture_date') THEN 'high' ELSE 'medium' END, ref FROM e_checks WHERE present AND NOT format_valid
      UNION ALL SELECT scan_id, field_name, 'undersized_font', 'medium', 'Rule 7' FROM e_checks WHERE measured_mm < required_mm""",
    "e_status": """SELECT c.scan_id, CASE WHEN coalesce(v.fatal, 0) > 0 THEN 'non_compliant' WHEN coalesce(v.n, 0) > 0 THEN 'inconclusive_partial_crop'
          WHEN c.ai OR c.unsure THEN 'partial_review_needed' ELSE 'compliant' END AS compliance_status, CAST(coalesce(v.n, 0) AS INT) AS total_violations,
        CAST(coalesce(v.n_missing, 0) AS INT) AS missing_count, CAST(coalesce(v.n_format, 0) AS INT) AS format_count, CAST(coalesce(v.n_font, 0) AS INT) AS font_count,
        CAST(coalesce(v.n_high, 0) AS INT) AS high_count, CAST(coalesce(v.n_medium, 0) AS INT) AS medium_count, c.ai AS ai_used
      FROM (SELECT scan_id, bool_or(coalesce(extraction_method, '') IN ('genai_fallback', 'genai_primary', 'genai_targeted')) AS ai, bool_or(cc < 0.70) AS unsure FROM e_checks GROUP BY 1) c
      LEFT JOIN (SELECT scan_id, count(*) AS n, count(*) FILTER (violation_type <> 'missing' OR field_name IN ('mrp', 'manufacture_date')) AS fatal,
          count(*) FILTER (violation_type = 'missing') AS n_missing, count(*) FILTER (violation_type = 'incorrect_format') AS n_format, count(*) FILTER (violation_type = 'undersized_font') AS n_font,
          count(*) FILTER (severity = 'high') AS n_high, count(*) FILTER (severity = 'medium') AS n_medium
        FROM e_viol GROUP BY 1) v USING (scan_id)""",
}


def scaled(t: Tables) -> DataFrame:
    """Labels with their pixel scale."""
    scale = pixel_scale(
        *[F.col(c) for c in ("ar_px_per_mm", "ar_mm_per_px", "circle_px", "circle_mm", "image_width_px", "package_width_mm")]
    )
    return t.camera.withColumn("scale", scale).select(
        "scan_id",
        "scale.px_per_mm",
        F.col("scale.method").alias("calibration_method"),
        F.col("scale.tier").alias("calibration_tier"),
        F.col("net_quantity_g").cast("double").alias("net_quantity_g"),
        F.col("package_width_mm").cast("double").alias("package_width_mm"),
    )


def evaluated(t: Tables) -> DataFrame:
    return rules.evaluate(scaled(t), t.fields)


@query(
    "label_checks",
    "SELECT scan_id, field_name, present, format_valid, measured_mm >= required_mm AS font_compliant, measured_mm, required_mm FROM e_checks",
    LABEL_VIEWS,
)
def label_checks(t: Tables) -> DataFrame:
    return rules.checks_of(evaluated(t))


@query("label_violations", "SELECT * FROM e_viol", LABEL_VIEWS)
def label_violations(t: Tables) -> DataFrame:
    return rules.violations_of(evaluated(t))


@query("label_verdicts", "SELECT * FROM e_status", LABEL_VIEWS)
def label_verdicts(t: Tables) -> DataFrame:
    def count(of: str, key: str) -> F.Column:
        return F.coalesce(F.try_element_at(of, F.lit(key)), F.lit(0))

    return rules.summaries(evaluated(t)).select(
        "scan_id",
        "compliance_status",
        "total_violations",
        count("type_counts", "missing").alias("missing_count"),
        count("type_counts", "incorrect_format").alias("format_count"),
        count("type_counts", "undersized_font").alias("font_count"),
        count("severity_counts", "high").alias("high_count"),
        count("severity_counts", "medium").alias("medium_count"),
        "ai_used",
    )


@query(
    "rule_fail_rates",
    """SELECT field_name, count(*) AS labels, count(*) FILTER (NOT present) AS missing, count(*) FILTER (present AND NOT format_valid) AS bad_format,
      count(*) FILTER (measured_mm < required_mm) AS undersized FROM e_checks GROUP BY 1""",
    LABEL_VIEWS,
)
def rule_fail_rates(t: Tables) -> DataFrame:
    return rules.fail_rates(evaluated(t))


@query(
    "verdict_mix_by_calibration",
    """SELECT CASE WHEN ar_px_per_mm > 0 OR ar_mm_per_px > 0 THEN 'ar_verified' WHEN circle_px > 0 THEN 'reference_object' WHEN package_width_mm > 0 THEN 'package_dimension' ELSE 'dpi_estimated' END AS calibration_tier,
      compliance_status, count(*) AS label_count FROM e_scale JOIN e_status USING (scan_id) GROUP BY 1, 2""",
    LABEL_VIEWS,
)
def verdict_mix(t: Tables) -> DataFrame:
    return evaluated(t).groupBy("calibration_tier", "compliance_status").agg(F.count(F.lit(1)).alias("label_count"))


# A rule pack of a shop of its own, stored as a file and read back.
SHOP_PACK = [
    Rule("mrp", "medium", "Shop rule 1", r"[0-9]"),
    Rule("net_quantity", "low", "Shop rule 2", r"\bkg\b", mandatory=False),
    Rule("consumer_care_details", "high", "Shop rule 3", None),
    Rule("expiry_date", "medium", "Shop rule 4", r"20[0-9]{2}"),
]


@query(
    "pack_file_violations",
    f"""WITH found AS (SELECT c.scan_id, r.*, coalesce(f.extracted_value, '') AS val FROM v_camera c
        CROSS JOIN ({" UNION ALL ".join(f"SELECT {quoted(r.field_name)} AS field_name, {quoted(r.severity_if_missing)} AS sev, {quoted(r.rule_reference)} AS ref, {r.mandatory} AS must, {quoted('(?i)' + (r.format_pattern or ''))} AS pat" for r in SHOP_PACK)}) r
        LEFT JOIN v_fields f ON f.scan_id = c.scan_id AND f.field_name = r.field_name)
    SELECT scan_id, field_name, 'missing' AS violation_type, sev AS severity, ref AS rule_reference FROM found WHERE must AND trim(val) = ''
    UNION ALL SELECT scan_id, field_name, 'incorrect_format', CASE WHEN field_name IN ('mrp', 'manufacture_date') THEN 'high' ELSE 'medium' END, ref FROM found WHERE trim(val) <> '' AND NOT regexp_matches(val, pat)""",
)
def pack_file_violations(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/pack-{uuid.uuid4().hex}"
    store_rules(t.spark, path, SHOP_PACK)
    checked = rules.evaluate(scaled(t), t.fields, load_rules(t.spark, path))
    return rules.violations_of(checked).where("violation_type <> 'undersized_font'")


@query(
    "font_heights",
    f"""SELECT f.scan_id, f.field_name, {half_even('CAST(f.h AS DOUBLE) / c.px_per_mm', 2)} AS measured_mm, CAST({NEED_SQL} AS DOUBLE) AS required_mm
    FROM v_fields f JOIN e_scale c USING (scan_id)""",
    LABEL_VIEWS,
)
def font_heights(t: Tables) -> DataFrame:
    joined = t.fields.join(scaled(t), "scan_id")
    return joined.select(
        "scan_id",
        "field_name",
        height_mm(F.col("h"), F.col("px_per_mm")).alias("measured_mm"),
        required_height(F.col("field_name"), F.col("net_quantity_g"), F.col("package_width_mm")).alias("required_mm"),
    )


@query(
    "label_gaps",
    r"""WITH w AS (SELECT s.scan_id, s.field_name, f.extracted_value, CASE WHEN s.field_name = 'country_of_origin' THEN true
          ELSE trim(coalesce(f.extracted_value, '')) = '' OR f.extraction_method = 'not_found' OR f.confidence < 0.65 END AS weak,
        regexp_extract(coalesce(f.extracted_value, ''), '(\d{1,2}[/\.-]\d{1,2}[/\.-]\d{2,4})', 1) AS d
      FROM (SELECT scan_id, unnest(['manufacturer_name_address', 'net_quantity', 'mrp', 'manufacture_date', 'consumer_care_details', 'country_of_origin', 'expiry_date']) AS field_name FROM v_camera) s
      LEFT JOIN v_fields f USING (scan_id, field_name)),
    c AS (SELECT scan_id, max(d) FILTER (field_name = 'manufacture_date') = max(d) FILTER (field_name = 'expiry_date') AND max(d) FILTER (field_name = 'manufacture_date') <> '' AS clash,
      bool_or(weak) FILTER (field_name <> 'expiry_date') AS any_weak FROM w GROUP BY 1)
    SELECT scan_id, string_agg(field_name, ',' ORDER BY field_name) FILTER ((field_name <> 'expiry_date' AND weak) OR (field_name = 'expiry_date' AND ((weak AND any_weak) OR clash))
        OR (field_name = 'manufacture_date' AND clash)) AS gap_list, clash AS date_collision FROM w JOIN c USING (scan_id) GROUP BY scan_id, clash""",
)
def label_gaps(t: Tables) -> DataFrame:
    found = rules.gaps(t.camera.select("scan_id"), t.fields)
    return found.select("scan_id", F.array_join(F.array_sort("gaps"), ",").alias("gap_list"), "date_collision")


@query(
    "extraction_methods",
    """SELECT extraction_method, count(*) AS field_count, count(*) FILTER (trim(extracted_value) <> '') AS found,
      count(*) FILTER (trim(extracted_value) = '') AS missing FROM v_fields GROUP BY 1""",
)
def extraction_methods(t: Tables) -> DataFrame:
    return rules.method_breakdown(t.fields)


@query(
    "field_summary",
    """SELECT scan_id, string_agg(field_name, ',' ORDER BY field_name) FILTER (ok) AS found_list, string_agg(field_name, ',' ORDER BY field_name) FILTER (NOT ok) AS missing_list FROM (
      SELECT scan_id, field_name, trim(extracted_value) <> '' AS ok FROM v_fields WHERE field_name <> 'expiry_date'
      UNION ALL SELECT scan_id, 'country_of_origin', false FROM v_camera) GROUP BY 1""",
)
def field_summary(t: Tables) -> DataFrame:
    made = rules.field_summary(t.fields)
    return made.select(
        "scan_id",
        F.nullif(F.array_join("found_fields", ","), F.lit("")).alias("found_list"),
        F.nullif(F.array_join(F.array_sort("missing_fields"), ","), F.lit("")).alias("missing_list"),
    )


@query(
    "rule_registry_usage",
    """SELECT r.field_name, r.sev AS severity_if_missing, r.ref AS rule_reference, coalesce(v.n, 0) AS violation_count FROM e_rule_rows r
    LEFT JOIN (SELECT field_name, count(*) AS n FROM v_violations GROUP BY 1) v USING (field_name)
    UNION ALL SELECT 'expiry_date', 'low', 'Rule 6(1)(d)', 0""",
    LABEL_VIEWS,
)
def rule_registry_usage(t: Tables) -> DataFrame:
    table = list_rules(rules_table(t.spark, load_rules(t.spark)), "declaration")
    counts = t.violations.groupBy("field_name").agg(F.count(F.lit(1)).alias("n"))
    return table.join(counts, "field_name", "left").select(
        "field_name", "severity_if_missing", "rule_reference", F.coalesce("n", F.lit(0)).alias("violation_count")
    )
