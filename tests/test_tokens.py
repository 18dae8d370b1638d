"""Text blocks: scores, headings, neighbours, classification and engine merging."""

import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import classify as C
from tallymark.operators import tokens as T
from tallymark.rules.lexicon import FIELDS

RAW = "scan_id long, token_id long, text string, x int, y int, w int, h int, confidence double, engine string"

SAMPLES = [
    ("mrp", "MRP Rs. 120.00 (Inclusive of all taxes)"), ("mrp", "M.R.P. ₹ 49"), ("mrp", "Maximum Retail Price: Rs.250"),
    ("net_quantity", "Net Wt. 500 g"), ("net_quantity", "Net Weight: 1 kg"), ("net_quantity", "Contents: 200 ml"), ("net_quantity", "Nett Wt 250gms"),
    ("manufacture_date", "Mfg. Date: 12/2025"), ("manufacture_date", "Manufactured on Jan 2026"), ("manufacture_date", "Packed on 15/03/2025"),
    ("manufacture_date", "Date of Mfg: 10/2025"), ("expiry_date", "Use By: 15/04/2026"), ("expiry_date", "Best Before: 06-2026"),
    ("expiry_date", "Expiry Date: 31/12/2026"), ("expiry_date", "BBE: Oct 2025"), ("manufacturer_name_address", "Manufactured by XYZ Foods Pvt. Ltd."),
    ("manufacturer_name_address", "Marketed by ABC Beverages Private Limited"), ("manufacturer_name_address", "Packed by Sunshine Industries, Mumbai"),
    ("manufacturer_name_address", "Plot No. 45, Industrial Area, Pune"), ("consumer_care_details", "Consumer Care: 1800-123-4567 (Toll Free)"),
    ("consumer_care_details", "Customer Helpline No. 022-66778899"), ("consumer_care_details", "support@example.com"),
    ("consumer_care_details", "www.brand.in"), ("country_of_origin", "Country of Origin: India"), ("country_of_origin", "Made in India"),
    ("country_of_origin", "Product of India"),
]


def labels(spark, *blocks):
    """Each label is a list of (text, x, y, w, h)."""
    rows = [(s, i, t, x, y, w, h, 0.95, "paddleocr") for s, label in enumerate(blocks) for i, (t, x, y, w, h) in enumerate(label)]
    return T.clean_tokens(spark.createDataFrame(rows, RAW))


def classified(spark, *blocks):
    got = {}
    for r in C.classify(labels(spark, *blocks)).collect():
        if r.accepted:
            got[(r.scan_id, r.field_name)] = r.extracted_value
    return got


def test_value_box_holds_the_blocks_of_the_value(spark):
    inline = [("MRP Rs. 45.00", 10, 10, 90, 21), ("w", 400, 400, 9, 9)]
    two = [("MRP", 10, 10, 40, 20), ("45.00 incl.", 60, 4, 80, 30), ("far 1.00", 900, 900, 9, 9)]
    alone = [("Net Wt", 10, 10, 60, 20), ("500 g", 80, 12, 50, 16)]
    below = [("MRP", 10, 10, 40, 20), ("Rs. 45.00", 12, 45, 80, 18)]
    free = [("made of 1 thing", 5, 5, 50, 12), ("www.brand.in", 7, 300, 70, 13)]
    got = {(r.scan_id, r.field_name): (r.extracted_value, tuple(r.box)) for r in C.classify(labels(spark, inline, two, alone, below, free)).collect() if r.accepted}
    assert got[0, "mrp"][1] == (10.0, 10.0, 100.0, 31.0)
    assert got[1, "mrp"][1] == (10.0, 4.0, 140.0, 34.0)  # heading and value
    assert got[2, "net_quantity"][1] in ((10.0, 10.0, 130.0, 30.0), (80.0, 12.0, 130.0, 28.0))
    assert got[3, "mrp"][1][3] == 63.0
    assert got[4, "consumer_care_details"][1] == (7.0, 300.0, 77.0, 313.0)  # no heading


def test_samples_score_best_for_their_field(spark):
    df = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(SAMPLES)], "i long, f string, text string")
    scored = df.select("i", "f", "text", *[C.score(f, F.col("text")).alias(f) for f in FIELDS]).collect()
    for r in scored:
        assert r[r.f] >= 0.80, (r.text, r.asDict())
        assert r[r.f] == max(r[f] for f in FIELDS if f != "country_of_origin" or r.f == f), r.text


@pytest.mark.parametrize(
    "field, text",
    [
        ("net_quantity", "Serving size 25 g"), ("net_quantity", "USP Rs. 0.14/g"), ("net_quantity", "Protein 7 g"),
        ("manufacture_date", "MRP 12/2025"), ("manufacture_date", "Use by 12/12/2025"), ("expiry_date", "PKD 12/12/2025"), ("mrp", " "),
    ],
)
def test_vetoed_texts_score_nothing(spark, field, text):
    assert spark.range(1).select(C.score(field, F.lit(text))).first()[0] == 0.0


def test_value_right_of_and_below_a_heading(spark):
    got = classified(
        spark,
        [("MRP", 10, 20, 50, 25), ("Rs. 250.00", 70, 20, 90, 25)],
        [("MANUFACTURED BY:", 10, 20, 180, 25), ("Organic Foods Pvt. Ltd., Pune 411001", 10, 55, 300, 25)],
        [("MRP Rs. 99.00", 10, 20, 120, 25)],
    )
    assert got[(0, "mrp")] == "MRP Rs. 250.00"
    assert "Organic Foods Pvt. Ltd." in got[(1, "manufacturer_name_address")]
    assert "Pune 411001" in got[(1, "manufacturer_name_address")]
    assert {f for s, f in got if s == 2} == {"mrp"}


def test_one_printed_date_is_not_both_dates(spark):
    got = classified(spark, [("PKD.", 10, 20, 50, 20), ("USE BY", 10, 50, 60, 20), ("16/10/25", 100, 20, 80, 20)])
    assert "16/10/25" in got[(0, "manufacture_date")]
    assert (0, "expiry_date") not in got


def test_origin_is_inferred_and_missing_fields_are_listed(spark):
    tokens = labels(spark, [("Manufactured by Sun Foods Pvt Ltd, Haryana", 10, 10, 200, 20)], [("hello", 1, 1, 9, 9)])
    final = {(r.scan_id, r.field_name): r.extracted_value for r in C.classify_labels(tokens).collect() if r.accepted}
    assert final[(0, "country_of_origin")].startswith("Country of Origin: India")
    failed = {(r.scan_id, r.field_name) for r in C.failed_fields(tokens).collect()}
    assert {f for s, f in failed if s == 1} == set(FIELDS)
    merged = {(r.scan_id, r.field_name): r for r in C.merge_fields(tokens).collect()}
    assert len(merged) == 14
    assert merged[(0, "manufacturer_name_address")].extraction_method == "ocr_paddle"
    assert merged[(1, "mrp")].extraction_method == "not_found"


def iou(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return 0.0 if w <= 0 or h <= 0 else w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def test_engine_merge_equals_greedy_matching(spark):
    rng = random.Random(5)
    rows, expected = [], set()
    for scan in range(25):
        tess = [(i, (rng.randint(0, 400), rng.randint(0, 300), rng.randint(40, 260), rng.randint(30, 120)), rng.random()) for i in range(12)]
        easy = [
            (100 + i, tuple(max(1, v + rng.randint(-25, 25)) for v in rng.choice(tess)[1]), rng.random()) for i in range(12)
        ]
        rows += [(scan, i, "t", *b, c, "tesseract") for i, b, c in tess] + [(scan, i, "e", *b, c, "easyocr") for i, b, c in easy]
        taken, lost = set(), set()
        for e, box, conf in easy:
            best = max(((iou(box, tb), -t) for t, tb, _ in tess if t not in taken), default=(0, 0))
            if best[0] >= 0.35:
                t = -best[1]
                taken.add(t)
                lost.add(t if conf >= next(c for i, _, c in tess if i == t) else e)
        expected |= {(scan, i) for i, _, _ in tess + easy if i not in lost}
    merged = T.merge_engines(spark.createDataFrame(rows, RAW))
    assert {(r.scan_id, r.token_id) for r in merged.collect()} == expected


def test_neighbours_equal_brute_force(spark):
    rng = random.Random(9)
    label = [("MRP" if i % 5 == 0 else f"w{i}", rng.randint(0, 1500), rng.randint(0, 1500), rng.randint(5, 120), rng.randint(5, 60)) for i in range(80)]
    tokens = labels(spark, label)
    anchors = tokens.where("text = 'MRP'").withColumns({"field_name": F.lit("mrp"), "anchor_order": F.lit(1), "ratio": F.lit(1.0)})
    got = {}
    for r in T.near_tokens(anchors, tokens).collect():
        got.setdefault(r.token_id, []).append((r.near_rank, r.near_id))
    for a, (text, x, y, w, h) in enumerate(label):
        if text != "MRP":
            continue
        cx, cy, found = x + w / 2, y + h / 2, []
        for i, (_, bx, by, bw, bh) in enumerate(label):
            dx, dy = bx + bw / 2 - cx, by + bh / 2 - cy
            far = (dx * dx + dy * dy) ** 0.5
            right, below = dx > 0 and abs(dy) <= max(1.3 * h, 30), dy > 0.4 * h and abs(dx) <= max(2.2 * w, 260)
            if i != a and far <= 350 and (right or below):
                found.append((round(far * (1.0 if right else 1.25), 6), i))
        assert [i for _, i in sorted(got.get(a, []))] == [i for _, i in sorted(found)[:5]]


def test_wide_gaps_split_lines(spark):
    words = [
        (1, 1, 1, 0, "Net", 0, 10, 30, 10, 0.9), (1, 1, 1, 1, "Wt", 40, 10, 30, 10, 0.8), (1, 1, 1, 2, "MRP", 200, 11, 30, 10, 0.7),
        (1, 1, 1, 3, "low", 240, 11, 30, 10, 0.05), (1, 1, 1, 4, " ", 280, 11, 30, 10, 0.9), (1, 1, 2, 0, "x", 0, 40, 5, 10, 0.9),
    ]
    df = spark.createDataFrame(words, "scan_id long, block int, line int, word_no int, text string, x int, y int, w int, h int, confidence double")
    lines = sorted((r.line, r.segment, r.text, r.x, r.w, r.confidence) for r in T.assemble_lines(df).collect())
    assert lines == [(1, 0, "Net Wt", 0, 70, 0.85), (1, 1, "MRP", 200, 30, 0.7), (2, 0, "x", 0, 5, 0.9)]
