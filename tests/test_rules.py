"""Label rules, print heights, dates, amounts, codes, origin and cross-checks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallymark.functions import amounts, codes, dates
from tallymark.operators import crosscheck, geo, rules
from tallymark.operators.fonts import height_mm, pixel_scale, required_height
from tallymark.rules.packs import BUILTIN_RULES

FIELDS = "scan_id long, field_name string, extracted_value string, extraction_method string, confidence double, h int"
GOOD = {
    "mrp": "MRP Rs. 120.00 (Inclusive of all taxes)",
    "net_quantity": "Net Wt. 500 g",
    "manufacture_date": "Mfg Date: 12/2025",
    "manufacturer_name_address": "Manufactured by XYZ Foods Pvt. Ltd., Plot No 45, Pune",
    "consumer_care_details": "Consumer Care: 1800-123-4567",
    "country_of_origin": "Country of Origin: India",
}


def judge(spark, fields, px_per_mm=None, quantity=None, pack=None, **kwargs):
    rows = [(1, n, *(v if isinstance(v, tuple) else (v, "ocr_tesseract", 0.95, None))) for n, v in fields.items()]
    labels = spark.createDataFrame([(1, px_per_mm, quantity, None)], "scan_id long, px_per_mm double, net_quantity_g double, package_width_mm double")
    return rules.evaluate(labels, spark.createDataFrame(rows, FIELDS), **({"rules": pack} if pack else {}), **kwargs).first()


def found(row):
    return sorted((v.field_name, v.violation_type, v.severity) for v in row.violations)


def test_complete_label_is_compliant(spark):
    row = judge(spark, GOOD)
    assert (row.compliance_status, found(row)) == ("compliant", [])


def test_missing_price_fails_and_missing_care_is_inconclusive(spark):
    no_price = judge(spark, {k: v for k, v in GOOD.items() if k != "mrp"})
    assert (no_price.compliance_status, found(no_price)) == ("non_compliant", [("mrp", "missing", "high")])
    no_care = judge(spark, {k: v for k, v in GOOD.items() if k != "consumer_care_details"})
    assert (no_care.compliance_status, found(no_care)) == ("inconclusive_partial_crop", [("consumer_care_details", "missing", "medium")])


def test_bad_format(spark):
    row = judge(spark, {**GOOD, "mrp": "one hundred"})
    assert (row.compliance_status, found(row)) == ("non_compliant", [("mrp", "incorrect_format", "high")])


def test_small_print(spark):
    row = judge(spark, {**GOOD, "net_quantity": ("Net Wt. 500 g", "ocr_tesseract", 0.95, 20)}, px_per_mm=10.0, quantity=500.0)
    assert found(row) == [("net_quantity", "undersized_font", "medium")]
    assert row.compliance_status == "non_compliant"


def test_machine_filled_or_unsure_needs_review(spark):
    assert judge(spark, {**GOOD, "mrp": (GOOD["mrp"], "genai_fallback", 0.95, None)}).compliance_status == "partial_review_needed"
    assert judge(spark, {**GOOD, "mrp": (GOOD["mrp"], "ocr_tesseract", 0.69, None)}).compliance_status == "partial_review_needed"


def test_expiry_stands_in_for_manufacture_date(spark):
    fields = {k: v for k, v in GOOD.items() if k != "manufacture_date"} | {"expiry_date": "Use By: 15/04/2026"}
    assert found(judge(spark, fields)) == []


def test_origin_comes_from_the_makers_address(spark):
    fields = {k: v for k, v in GOOD.items() if k != "country_of_origin"}
    row = judge(spark, fields)
    assert found(row) == []
    assert row.f_country_of_origin.extracted_value == "Country of Origin: India (Inferred from Location: Pune, Maharashtra)"


def test_optional_rule_is_not_missing(spark):
    assert found(judge(spark, GOOD, pack=BUILTIN_RULES)) == []


def test_label_without_fields(spark):
    labels = spark.createDataFrame([(9, None, None, None)], "scan_id long, px_per_mm double, net_quantity_g double, package_width_mm double")
    row = rules.evaluate(labels, spark.createDataFrame([], FIELDS)).first()
    assert (row.compliance_status, len(row.violations)) == ("non_compliant", 6)


@pytest.mark.parametrize(
    "field, quantity, width, expected",
    [
        ("net_quantity", 0.0, None, 1.5), ("net_quantity", 50.0, None, 1.5), ("net_quantity", 50.5, None, 2.0),
        ("net_quantity", 200.0, None, 2.0), ("net_quantity", 1000.0, 10.0, 4.0), ("net_quantity", 1001.0, None, 6.0),
        ("net_quantity", None, 50.0, 1.0), ("mrp", 5.0, 100.0, 2.0), ("mrp", None, None, 2.0), ("mrp", None, 500.0, 6.0),
    ],
)
def test_required_heights(spark, field, quantity, width, expected):
    need = required_height(F.lit(field), F.lit(quantity).cast("double"), F.lit(width).cast("double"))
    assert spark.range(1).select(need).first()[0] == expected


def test_pixel_scale_precedence(spark):
    null = F.lit(None).cast("double")

    def scale(*values):
        return spark.range(1).select(pixel_scale(*[null if v is None else F.lit(v) for v in values]).alias("s")).first().s

    assert scale(12.5, 0.1, 300.0, 25.0, 1000, 80.0).px_per_mm == 12.5
    assert scale(None, 0.08, 300.0, 25.0, 1000, 80.0).px_per_mm == 12.5
    assert tuple(scale(0.0, None, 242.6, 24.26, 1000, 80.0)) == (10.0, "hough_circle_reference", "reference_object")
    assert tuple(scale(None, None, None, None, 1000, 80.0)) == (12.5, "manual_package_width", "package_dimension")
    assert tuple(scale(None, None, None, None, 1000, None)) == (11.811, "uncalibrated_default_dpi", "dpi_estimated")
    assert spark.range(1).select(height_mm(F.lit(0), F.lit(10.0))).first()[0] == 0.0


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, t string")
    return [r.r for r in df.select("i", build(F.col("t")).alias("r")).orderBy("i").collect()]


def test_label_dates(spark):
    texts = ["12/03/2026", "2026-03-12", "exp 03/2026", "24 Oct 2026", "31 Oct 2026", "October 2026", "31/02/2026", "30.13.2026", "sept 2026", "x", None]
    d = dt.date
    assert column(spark, texts, dates.label_date) == [
        d(2026, 3, 12), d(2026, 3, 12), d(2026, 3, 28), d(2026, 10, 24), d(2026, 10, 28), d(2026, 10, 28), d(2026, 2, 28), None, d(2026, 9, 28), None, None,
    ]


def test_date_declarations(spark):
    today = F.lit("2026-06-01").cast("date")
    texts = ["PKD 01/02/26 USE BY 01/05/26", "Use by 10/2026", "Mfg JAN 2025", "EXP 31/02/2026", "", "5 mar 25"]
    got = column(spark, texts, lambda t: dates.date_declaration(t, today))
    d = dt.date
    assert [tuple(g) for g in got] == [
        (d(2026, 2, 1), d(2026, 5, 1), True, "EXPIRED"),
        (None, d(2026, 10, 1), False, "VALID"),
        (d(2025, 1, 1), None, False, "VALID"),
        (None, None, False, "NO_VALID_DATE"),
        (None, None, False, "VALID"),
        (d(2025, 3, 5), None, False, "VALID"),
    ]


def test_amounts(spark):
    texts = ["Net Wt. 500 g", "1.5 kg", "2 L", "750ml", "12 pcs", "about 64", "none"]
    assert column(spark, texts, amounts.quantity_value) == [500.0, 1500.0, 2000.0, 750.0, 12.0, 64.0, None]
    assert column(spark, texts, amounts.quantity_unit) == ["g", "g", "ml", "ml", "pcs", None, None]
    assert column(spark, ["₹1,299.50", "Rs. 40", "x"], amounts.price) == [1299.5, 40.0, None]
    assert column(spark, ["MRP: 45.00 incl", "was 12.50 today", "99", "a very long text with 99", ""], amounts.listing_price) == [45.0, 12.5, 99.0, None, None]


def test_codes(spark):
    cases = [
        ("8901030999999", "EAN-13", "8901030999999"), ("012345678905", "UPC_A", "012345678905"), ("12345670", "EAN8", "12345670"),
        ("10012345678902", "ITF-14", "10012345678902"), ("https://id.gs1.org/01/08901030999999", "QRCODE", "08901030999999"),
        ("(01)08901030999999(10)BATCH123", "DATAMATRIX", "08901030999999"), (" 8901030999999 ", "QRCODE", "8901030999999"),
        ("https://example.com", "QRCODE", None), ("123456789", "QRCODE", None),
    ]
    df = spark.createDataFrame(cases, "t string, f string, expected string")
    assert all(r.got == r.expected for r in df.select("expected", codes.gtin(F.col("t"), F.col("f")).alias("got")).collect())


def test_batch_codes(spark):
    texts = ["B.No: B4208", "Batch No. 89A/1", "Lot: 09/25-A.", "BATCH: L24-001", "Batch Date", "nothing here"]
    assert column(spark, texts, codes.batch_code) == ["B4208", "89A/1", "09/25-A", "L24-001", None, None]


def test_origin_tiers(spark):
    texts = [
        "Made in India", "COUNTRY OF ORIGIN: italy, EU", "Unit 9, HR-123501", "Works at Navi Mumbai", "Plot 12, Sector 5, 400057",
        "Vevey, Switzerland", "for india only", "Made in Wonderland, New Delhi", "nowhere", "", "Dairy of new south wales", "12 400057",
    ]
    got = column(spark, texts, geo.infer_country)
    assert [g and (g.country, g.inferred_from, g.confidence) for g in got] == [
        ("India", "Explicit declaration", 0.98), ("Italy", "Explicit declaration", 0.98), ("India", "Haryana (HR-123501)", 0.95),
        ("India", "City: Mumbai, Maharashtra", 0.92), ("India", "PIN Code: 400057", 0.88), ("Switzerland", "Switzerland, Switzerland", 0.9),
        ("India", "India keyword", 0.85), ("India", "State: Delhi", 0.95), None, None, ("United Kingdom", "Wales, United Kingdom", 0.9), None,
    ]


def test_cross_checks(spark):
    web = [
        (1, "500 g", "Rs. 50", None, "India", "Sunrise Foods Ltd"),
        (2, "75 g", None, "60", "Italy", "Alpha Pvt Ltd"),
        (3, None, None, None, None, None),
    ]
    pack = [
        (1, "net_quantity", "0.5 kg", "ocr"), (1, "mrp", "MRP Rs. 45.00", "ocr"), (1, "country_of_origin", "Made in INDIA", "ocr"), (1, "manufacturer_name_address", "Sunrise Mills", "ocr"),
        (2, "net_quantity", "75 ml", "ocr"), (2, "mrp", "MRP 90", "webpage_extracted"), (2, "country_of_origin", "France", "ocr"), (2, "manufacturer_name_address", "Beta Private Limited", "ocr"),
        (3, "net_quantity", "10 g", "ocr"),
    ]
    listings = spark.createDataFrame(web, "product_id long, net_quantity string, mrp string, selling_price string, country_of_origin string, manufacturer string")
    fields = spark.createDataFrame(pack, "product_id long, field_name string, extracted_value string, extraction_method string")
    got = {(r.product_id, r.field_name): r.status for r in crosscheck.cross_validate(listings, fields).collect()}
    assert got == {
        (1, "net_quantity"): "MATCH", (1, "mrp"): "WARNING", (1, "country_of_origin"): "MATCH", (1, "manufacturer_name_address"): "MATCH",
        (2, "net_quantity"): "MISMATCH", (2, "mrp"): "ONLINE_ONLY", (2, "country_of_origin"): "MISMATCH", (2, "manufacturer_name_address"): "WARNING",
        (3, "net_quantity"): "PACKAGING_ONLY",
    }
