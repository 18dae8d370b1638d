"""Stores, rule packs, pages and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import DATA, rows
from tallymark.operators import citizens, pages
from tallymark.operators.conflicts import rolling_state, with_conflict
from tallymark.operators.consensus import consensus_by, consensus, with_evidence
from tallymark.operators.search import precedence_union
from tallymark.operators.skew import SkewPolicy
from tallymark.operators.tickets import spawn_tickets
from tallymark.rules.packs import BUILTIN_RULES, QUANTITY_BANDS
from tallymark.schemas import TABLES
from tallymark.sources import stores
from tallymark.sources.rule_packs import load_bands, load_rules
from tallymark.streaming import feeds
from tallymark.streaming.ledger import apply_batch, ledger_of, start_ledger_stream, tickets_of


def test_upsert_is_idempotent(spark):
    schema = "k string, v int, at int, id int"
    old = spark.createDataFrame([("a", 1, 1, 1), ("b", 2, 5, 2)], schema)
    new = spark.createDataFrame([("a", 3, 2, 3), ("b", 4, 4, 4), ("c", 5, 1, 5)], schema)
    once = stores.upsert(old, new, "k", "at", "id")
    assert rows(once.select("k", "v")) == [("a", 3), ("b", 2), ("c", 5)]
    assert rows(stores.upsert(once, new, "k", "at", "id")) == rows(once)


def test_insert_absent(spark):
    old = spark.createDataFrame([("a",)], "k string")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("b", 1)], "k string, n int")
    assert rows(stores.insert_absent(old, new, "k", "n")) == [("b", 1)]


def test_precedence_union_is_idempotent(spark):
    a = spark.createDataFrame([(1, "a"), (None, "a")], "scan_id long, s string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "scan_id long, s string")
    merged = precedence_union([a, b]).drop("source_rank")
    assert rows(merged) == [("a", 1), ("b", 2)] or {tuple(r) for r in merged.collect()} == {(1, "a"), (2, "b")}
    assert rows(precedence_union([merged, a, b]).drop("source_rank")) == rows(merged)


def test_save_and_read_scans(spark, tables, tmp_path):
    stores.save_scans(tables.submissions, str(tmp_path))
    saved = spark.read.parquet(f"{tmp_path}/scans")
    assert saved.count() == tables.submissions.count()
    assert "day" in saved.columns
    assert spark.read.parquet(f"{tmp_path}/audit_log").where("action = 'SCAN_CREATED'").count() == saved.count()
    back = stores.read_table(spark, str(tmp_path), "audit_log")
    assert [f.name for f in back.schema][:7] == [f.name for f in TABLES["audit_log"]]
    assert stores.conform(saved, "scans").columns == [f.name for f in TABLES["scans"]]


def test_rule_pack_file_and_fallback(spark, tmp_path):
    pack = tmp_path / "pack.json"
    pack.write_text(
        json.dumps(
            {
                "mandatory_declarations": [{"field_name": "mrp", "severity_if_missing": "low", "format_pattern": "x"}],
                "net_quantity_rules": [{"min_net_quantity_g": 0, "max_net_quantity_g": None, "min_font_height_mm": 9.0}],
            },
            indent=1,
        )
    )
    assert [(r.field_name, r.severity_if_missing, r.mandatory) for r in load_rules(spark, str(pack))] == [("mrp", "low", True)]
    assert load_bands(spark, str(pack))[0][0].min_height_mm == 9.0
    assert load_rules(spark, str(tmp_path / "none.json")) == BUILTIN_RULES
    broken = tmp_path / "broken.json"
    broken.write_text("{not json")
    assert load_rules(spark, str(broken)) == BUILTIN_RULES
    assert load_bands(spark, str(broken))[0] == QUANTITY_BANDS


@pytest.mark.parametrize(
    "claim, verified, status, tampered, change",
    [
        ("missing_mrp", True, "non_compliant", False, 50), ("missing_mrp", False, "compliant", False, -25),
        ("", False, "non_compliant", False, 20), (None, False, "compliant", False, 0), ("x", True, "compliant", True, -100),
    ],
)
def test_experience_points(spark, claim, verified, status, tampered, change):
    from tallymark.functions.trust import xp_change

    got = spark.range(1).select(xp_change(F.lit(bool(claim)), F.lit(verified), F.lit(status), F.lit(tampered))).first()[0]
    assert got == change


def test_claims_need_a_supporting_violation(spark):
    scans = spark.createDataFrame(
        [(1, "citizen", "Missing-MRP"), (2, "citizen", "undersized font"), (3, "citizen", "missing origin"), (4, "viewer", "mrp"), (5, "citizen", " ")],
        "scan_id long, user_role string, claimed_violation_type string",
    )
    violations = spark.createDataFrame(
        [(1, "mrp", "missing"), (1, "mrp", "missing"), (2, "mrp", "missing"), (3, "country_of_origin", "missing")],
        "scan_id long, field_name string, violation_type string",
    )
    got = {r.scan_id: (r.has_claim, r.claim_verified) for r in citizens.verify_claims(scans, violations).collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (True, True), 5: (False, False)}


def test_page_layers(spark):
    html = (
        "<title>T | Amazon.in</title><script type='application/ld+json'>{bad</script>"
        "<table><tr><th>Net Quantity</th><td>75&nbsp;g</td></tr><tr><td>net quantity</td><td>80 g</td></tr><tr><td>" + "k" * 70 + "</td><td>v</td></tr></table>"
        "<p>MRP: ₹ 1,299.00 Country of Origin: India. mail: help@maker.org</p><script>MRP 5</script>"
    )
    one = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    row = pages.listings_of(one).first()
    assert (row.product_name, row.net_quantity, row.mrp, row.country_of_origin) == ("T", "75 g", "₹1299.00", "India")
    assert row.consumer_care == "help@maker.org"
    assert not row.structured_data and row.product_specifications
    assert {(r.key, r.value) for r in pages.specs_of(one).collect()} == {("net quantity", "80 g"), ("k" * 70, "v")}


def page(spark, html, url="https://shop.example.com/p"):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def test_price_nodes_and_nested_specifications(spark):
    bullets = "".join(f"<li><span>{k}: {v}</span></li>" for k, v in [("Country of Origin", "India"), ("Net Quantity", "120.0 gram"), ("Packer", "Alpha Foods")])
    html = (
        f'<div id="detailBullets_feature_div"><div class="top"><div>x</div></div><ul>{bullets}</ul></div><ul><li>Brand: not inside</li></ul>'
        '<span class="a-price x"><span class="a-offscreen">₹35.00</span></span>'
    )
    row = pages.listings_of(page(spark, html)).first()
    assert (row.mrp, row.country_of_origin, row.net_quantity, row.packer, row.brand) == ("₹35.00", "India", "120.0 gram", "Alpha Foods", None)
    html = "<table><tr><td>Net Quantity</td><td>250 g</td></tr></table><div class='_30jeq3'>₹120</div>"
    assert pages.listings_of(page(spark, html)).first().mrp == "₹120.00"
    long = "<meta property='og:description' content='" + "d" * 900 + "'>"
    assert len(pages.listings_of(page(spark, long)).first().description) == 900


@pytest.mark.parametrize(
    "url, html, expected",
    [
        (
            "https://www.amazon.in/s?k=b",
            "<div data-component-type='s-search-result'><h2><a href='/dp/B08/ref=sr_1'><span>One 120g</span></a></h2><img class='s-image' src='https://m/71h._AC_UL320_.jpg'/></div>"
            "<div data-component-type='s-search-result'><h2><a href='/dp/B09'>Two</a></h2></div>",
            [("One 120g", "https://www.amazon.in/dp/B08", "https://m/71h._SL1500_.jpg"), ("Two", "https://www.amazon.in/dp/B09", "")],
        ),
        (
            "https://www.flipkart.com/search",
            "<div class='x _1AtVbE'><a class='_1fQZEK' href='/p/i?pid=1'><div class='_4rR01T'>Tea</div><img class='_396cs4' src='https://r/image/312/312/a.jpeg'></a></div>",
            [("Tea", "https://www.flipkart.com/p/i?pid=1", "https://r/image/832/832/a.jpeg")],
        ),
        ("https://www.bigbasket.com/x", "<li class='paginated-item'><a href='/pd/1'><h3>Rice</h3></a><img src='u'></li>", [("Rice", "https://www.bigbasket.com/pd/1", "u")]),
        ("https://other.example.com/x", "<article><h3>Soap</h3><a href='/s/1'>more</a><img data-src='d' src='i'></article><p>no card</p>", [("Soap", "https://other.example.com/s/1", "i")]),
        ("https://other.example.com/x", "<p>nothing</p>", []),
    ],
)
def test_result_cards_of_every_shop(spark, url, html, expected):
    found = pages.card_links(page(spark, html, url)).orderBy("position").collect()
    assert [(r.title, r.product_url, r.image_url) for r in found] == expected


def day_batches(tables):
    scans = tables.scans.select(
        "gtin", "scan_id", "created_at", "batch_code", "compliance_status", "calibration_tier", "user_role", F.col("confidence").cast("double").alias("confidence")
    )
    return scans, scans.withColumn("part", F.floor(F.dayofmonth("created_at") / 6))


def test_stream_equals_batch_over_many_batches(spark, tables, tmp_path):
    scans, parts = day_batches(tables)
    source = str(tmp_path / "in")
    # One file per period, written oldest first, read one file per batch.
    for i in range(6):
        parts.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(scans.schema).option("maxFilesPerTrigger", 1).parquet(source)
    folder = str(tmp_path / "out")
    start_ledger_stream(stream, folder, SkewPolicy(hot_rows=30, block_rows=120)).awaitTermination()
    expected = spawn_tickets(with_conflict(rolling_state(scans)))
    assert rows(tickets_of(spark, folder)) == rows(expected)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "evidence").iterdir() if p.name.startswith("batch="))
    state = consensus_by(with_evidence(ledger_of(spark, folder, last)), "gtin")
    assert rows(state) == rows(consensus(scans))


def test_retried_batch_changes_nothing(spark, tables, tmp_path):
    scans, parts = day_batches(tables)
    folder = str(tmp_path)
    for i in range(2):
        apply_batch(parts.where(F.col("part") == i).drop("part"), i, folder)
    first = rows(tickets_of(spark, folder)), rows(ledger_of(spark, folder, 1))
    apply_batch(parts.where(F.col("part") == 1).drop("part"), 1, folder)
    assert (rows(tickets_of(spark, folder)), rows(ledger_of(spark, folder, 1))) == first


def test_store_and_forward_reads_each_file_once(spark, tmp_path):
    queue, out = tmp_path / "queue", str(tmp_path / "out")
    queue.mkdir()
    schema = spark.createDataFrame([], "scan_id long, product_name string").schema

    def sync():
        feeds.store_append(feeds.pending_submissions(spark, str(queue), schema), out).awaitTermination()
        return spark.read.parquet(f"{out}/rows").count()

    (queue / "a.json").write_text('{"scan_id": 1, "product_name": "x"}\n')
    assert sync() == 1
    assert sync() == 1
    (queue / "b.json").write_text('{"scan_id": 2, "product_name": "y"}\n{"scan_id": 3}\n')
    assert sync() == 3


def test_progress_counts_rows_and_failures(spark, tables, tmp_path):
    schema = tables.read("events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(DATA)
    counted = feeds.with_progress(events, "run", F.col("event_type") == "error")
    running = feeds.store_append(counted, str(tmp_path))
    running.awaitTermination()
    seen = [p.observedMetrics["run"] for p in running.recentProgress if "run" in (p.observedMetrics or {})]
    total = tables.read("events").count()
    assert sum(m["rows"] for m in seen) == total
    assert 0 < sum(m["failed"] for m in seen) < total


def test_totals_go_beyond_the_reports_that_a_query_keeps(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    # The second to fifth file are a month late.
    for i in range(6):
        day = "2024-03-01" if i == 0 else "2024-02-01" if i < 5 else "2024-03-02"
        (source / f"{i}.json").write_text(f'{{"scan_id": {i}, "created_at": "{day} 00:00:00"}}\n')
        os.utime(source / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        stream = spark.readStream.schema("scan_id long, created_at timestamp").option("maxFilesPerTrigger", 1).json(str(source))
        watched = feeds.with_progress(stream, "run", F.col("scan_id") > 2)
        running = feeds.store_append(feeds.deduplicate(watched), str(tmp_path / "out"))
        running.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
    assert len(running.recentProgress) <= 2
    # Ids are distinct, so rows that are not written were late (a row of the batch after the first one is not yet).
    written = spark.read.parquet(str(tmp_path / "out" / "rows")).count()
    assert written == 3 and feeds.late_rows(running) == 6 - written
    assert feeds.observed(running, "run") == {"rows": 6, "failed": 3}
