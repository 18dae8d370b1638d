"""Rule evaluation: declared fields of a label against a rule pack.

Fields are grouped once per label into a map. Every rule is then a column expression over that row,
so all rules, the violations, the summary and the verdict cost a single shuffle.

Arrays that are costly to build are opened with the outer generators: the inner ones make Spark test
the array for emptiness below the projection, which would build it twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators.fonts import height_mm, required_height
from tallymark.operators.geo import declaration, infer_country, let
from tallymark.rules.packs import AI_METHODS, CORE_FIELDS, CRITICAL_FIELDS, FONT_RULE, LABEL_RULES, Rule

LOW_CONFIDENCE = 0.70
GAP_CONFIDENCE = 0.65
INFERRED_FLOOR = 0.92
FIELD_PARTS = ["extracted_value", "extraction_method", "confidence", "h"]
SLASHED_DATE = r"(\d{1,2}[/\.-]\d{1,2}[/\.-]\d{2,4})"
EXPIRY_WORDS = r"(?i)\b(?:exp(?:iry)?|use\s*by|best\s*before|bbe|valid\s*till|consume\s*by)\b"


def fields_map(fields: DataFrame, names: list[str]) -> DataFrame:
    """One row per label with a struct column per field name; repeated fields keep the most confident."""
    best = F.struct("confidence", "extracted_value", "extraction_method", "h")
    return (
        fields.where(F.col("field_name").isin(names))
        .groupBy("scan_id")
        .agg(*[F.max(F.when(F.col("field_name") == name, best)).alias(f"f_{name}") for name in names])
    )


def present(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


def infer_missing(wide: DataFrame, text_pool: str | None = None) -> DataFrame:
    """Fills a missing origin from the maker's address, else from the label's pooled text."""
    origin, maker = F.col("f_country_of_origin"), F.col("f_manufacturer_name_address.extracted_value")
    sources = [F.coalesce(maker, F.lit(""))] + ([F.coalesce(F.col(text_pool), F.lit(""))] if text_pool else [])
    found = F.coalesce(*[infer_country(s) for s in sources])
    absent = ~present(origin.extracted_value) | (F.coalesce(origin.extraction_method, F.lit("")) == "not_found")
    inferred = let(
        found,
        lambda g: F.when(
            g.isNotNull(),
            F.struct(
                F.greatest(F.lit(INFERRED_FLOOR), g.confidence).alias("confidence"),
                declaration(g).alias("extracted_value"),
                F.lit("geo_intelligence_domestic_mfr").alias("extraction_method"),
                F.col("f_manufacturer_name_address.h").alias("h"),
            ),
        ),
    )
    return wide.withColumn("f_country_of_origin", F.when(absent, F.coalesce(inferred, origin)).otherwise(origin))


def _violation(rule: Rule, kind: str, severity: str, reference: str) -> Column:
    return F.struct(
        F.lit(rule.field_name).alias("field_name"),
        F.lit(kind).alias("violation_type"),
        F.lit(severity).alias("severity"),
        F.lit(reference).alias("rule_reference"),
    )


def _check(rule: Rule, expiry_known: bool) -> Column:
    """One rule on one label: what was found, and up to two violations."""
    own = F.col(f"f_{rule.field_name}")
    value, height = own.extracted_value, own.h
    if rule.field_name == "manufacture_date" and expiry_known:
        other = F.col("f_expiry_date")
        borrow = ~present(value) & present(other.extracted_value)
        value = F.when(borrow, other.extracted_value).otherwise(value)
        height = F.when(borrow, other.h).otherwise(height)
    here = present(value)
    valid = here & (F.rlike(value, F.lit("(?i)" + rule.format_pattern)) if rule.format_pattern else F.lit(True))
    measured = F.when(here, height_mm(height, F.col("px_per_mm")))
    required = required_height(F.lit(rule.field_name), F.col("net_quantity_g"), F.col("package_width_mm"))
    tall = F.when(measured.isNotNull(), measured >= required)
    format_severity = "high" if rule.field_name in CRITICAL_FIELDS else "medium"
    none = F.lit(None)
    missing = F.when(~here, _violation(rule, "missing", rule.severity_if_missing, rule.rule_reference)) if rule.mandatory else none
    faults = F.array(
        missing,
        F.when(here & ~valid, _violation(rule, "incorrect_format", format_severity, rule.rule_reference)),
        F.when(~tall, _violation(rule, "undersized_font", "medium", FONT_RULE)),
    )
    return F.struct(
        F.lit(rule.field_name).alias("field_name"),
        here.alias("present"),
        valid.alias("format_valid"),
        tall.alias("font_compliant"),
        measured.alias("measured_mm"),
        F.when(measured.isNotNull(), required).alias("required_mm"),
        F.array_compact(faults).alias("violations"),
    )


def overall_status(violations: Column, ai_used: Column, unsure: Column) -> Column:
    """Bad format or print, or a missing price or date, fails; other gaps are inconclusive."""
    fatal = F.exists(
        violations, lambda v: (v.violation_type != "missing") | v.field_name.isin(CRITICAL_FIELDS)
    )
    return (
        F.when(fatal, "non_compliant")
        .when(F.size(violations) > 0, "inconclusive_partial_crop")
        .when(ai_used | unsure, "partial_review_needed")
        .otherwise("compliant")
    )


def evaluate(labels: DataFrame, fields: DataFrame, rules: list[Rule] = LABEL_RULES, text_pool: str | None = None) -> DataFrame:
    """Checks, violations and verdict per label.

    ``labels`` has scan_id, px_per_mm, net_quantity_g and package_width_mm; a label with no fields at
    all is evaluated too.
    """
    names = [r.field_name for r in rules]
    wanted = list(dict.fromkeys([*names, "expiry_date", "manufacturer_name_address"]))
    wide = labels.join(fields_map(fields, wanted), "scan_id", "left")
    if "country_of_origin" in names:
        wide = infer_missing(wide, text_pool)
    used = [F.col(f"f_{n}") for n in names]
    ai = F.lit(False)
    unsure = F.lit(False)
    for own in used:
        ai = ai | F.coalesce(own.extraction_method.isin(AI_METHODS), F.lit(False))
        unsure = unsure | (F.coalesce(own.confidence, F.lit(0.0)) < LOW_CONFIDENCE)
    checked = wide.withColumn("checks", F.array(*[_check(r, True) for r in rules])).withColumns(
        {"ai_used": ai, "unsure": unsure}
    )
    checked = checked.withColumn("violations", F.flatten(F.transform("checks", lambda c: c.violations)))
    return checked.withColumn(
        "compliance_status", overall_status(F.col("violations"), F.col("ai_used"), F.col("unsure"))
    )


def checks_of(evaluated: DataFrame) -> DataFrame:
    return evaluated.select("scan_id", F.inline_outer("checks")).drop("violations")


def violations_of(evaluated: DataFrame) -> DataFrame:
    return evaluated.select("scan_id", F.inline_outer("violations")).where(F.col("field_name").isNotNull())


def count_map(violations: Column, part: str, keys: list[str]) -> Column:
    """How many violations carry each value; only values that occur are kept."""
    entries = F.array(
        *[
            F.struct(F.lit(k).alias("key"), F.size(F.filter(violations, lambda v: v[part] == k)).alias("value"))
            for k in keys
        ]
    )
    return F.map_from_entries(F.filter(entries, lambda e: e.value > 0))


def summaries(evaluated: DataFrame) -> DataFrame:
    """Per label: verdict, number of violations, and counts by type and severity."""
    found = F.col("violations")
    return evaluated.select(
        "scan_id",
        "compliance_status",
        F.size(found).alias("total_violations"),
        count_map(found, "violation_type", ["missing", "incorrect_format", "undersized_font"]).alias("type_counts"),
        count_map(found, "severity", ["critical", "high", "medium", "low"]).alias("severity_counts"),
        "ai_used",
    )


def fail_rates(evaluated: DataFrame) -> DataFrame:
    """How often each rule finds a fault, over all labels."""
    long = evaluated.select(F.inline_outer("checks"))
    return long.groupBy("field_name").agg(
        F.count(F.lit(1)).alias("labels"),
        F.count_if(~F.col("present")).alias("missing"),
        F.count_if(F.col("present") & ~F.col("format_valid")).alias("bad_format"),
        F.count_if(~F.col("font_compliant")).alias("undersized"),
    )


def gaps(labels: DataFrame, fields: DataFrame, text_pool: str | None = None) -> DataFrame:
    """Per label: core fields that are absent or weak, the expiry date where it matters, and date clashes.

    One date printed as both manufacture and expiry is trusted for neither: both become gaps and
    date_collision is set.
    """
    names = [*CORE_FIELDS, "expiry_date"]
    wide = labels.join(fields_map(fields, names), "scan_id", "left")

    def weak(name: str) -> Column:
        own = F.col(f"f_{name}")
        return (
            ~present(own.extracted_value)
            | (F.coalesce(own.extraction_method, F.lit("not_found")) == "not_found")
            | (F.coalesce(own.confidence, F.lit(0.0)) < GAP_CONFIDENCE)
        )

    def shaped(name: str) -> Column:
        return F.nullif(F.regexp_extract(F.col(f"f_{name}.extracted_value"), SLASHED_DATE, 1), F.lit(""))

    core = F.array_compact(F.array(*[F.when(weak(n), F.lit(n)) for n in CORE_FIELDS]))
    clash = F.coalesce(shaped("manufacture_date") == shaped("expiry_date"), F.lit(False))
    expiry = F.col("f_expiry_date")
    no_expiry = ~present(expiry.extracted_value) | (F.coalesce(expiry.confidence, F.lit(0.0)) < GAP_CONFIDENCE)
    hinted = F.rlike(F.coalesce(F.col(text_pool), F.lit("")), F.lit(EXPIRY_WORDS)) if text_pool else F.lit(False)
    extra = F.array_compact(
        F.array(
            F.when((no_expiry & ((F.size(core) > 0) | hinted)) | clash, F.lit("expiry_date")),
            F.when(clash, F.lit("manufacture_date")),
        )
    )
    return wide.select("scan_id", F.array_union(core, extra).alias("gaps"), clash.alias("date_collision"))


def method_breakdown(fields: DataFrame) -> DataFrame:
    """How many fields each extraction method supplied, and how many of them are filled."""
    return fields.groupBy(F.coalesce("extraction_method", F.lit("not_found")).alias("extraction_method")).agg(
        F.count(F.lit(1)).alias("field_count"),
        F.count_if(present(F.col("extracted_value"))).alias("found"),
        F.count_if(~present(F.col("extracted_value"))).alias("missing"),
    )


def field_summary(fields: DataFrame, required: list[str] = CORE_FIELDS) -> DataFrame:
    """Per label: the required fields found, and those missing. Only the fixed names are collected."""
    found = fields.where(present(F.col("extracted_value")) & (F.col("extraction_method") != "not_found"))
    names = F.array_sort(F.collect_set(F.when(F.col("field_name").isin(required), F.col("field_name"))))
    listed = fields.select("scan_id").distinct().join(
        found.groupBy("scan_id").agg(names.alias("found_fields")), "scan_id", "left"
    )
    got = F.coalesce("found_fields", F.array().cast("array<string>"))
    return listed.select(
        "scan_id",
        got.alias("found_fields"),
        F.array_except(F.array(*[F.lit(r) for r in required]), got).alias("missing_fields"),
    )
