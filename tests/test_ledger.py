"""Consensus, rolling state, conflicts and tickets."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallymark.operators.conflicts import ConflictConfig, rolling_state, with_conflict
from tallymark.operators.consensus import consensus_by, with_evidence
from tallymark.operators.ledger import batch_breakdown, build_ledger
from tallymark.operators.skew import SkewPolicy, minute_of, running_sum, sequence_ids

EVIDENCE = "k string, compliance_status string, calibration_tier string, user_role string, confidence double"


def verdicts(spark, evidence):
    df = spark.createDataFrame(evidence, EVIDENCE)
    return {r.k: (r.current_verdict, r.rolling_confidence) for r in consensus_by(with_evidence(df), "k").collect()}


def test_weighted_evidence_outvotes_many_weak_scans(spark):
    got = verdicts(
        spark,
        [("a", "compliant", "dpi_estimated", "anonymous", 0.9)] * 2
        + [("a", "non_compliant", "ar_verified", "inspector", 0.98)]
        + [("b", "compliant", "ar_verified", "inspector", 1.0)] * 4
        + [("c", "compliant", "dpi_estimated", "viewer", 0.9), ("c", "non_compliant", "dpi_estimated", "viewer", 0.9)]
        + [("d", None, None, None, None)]
        + [("e", "compliant", "ar_verified", "admin", 0.0)]
        + [("f", "partial_review_needed", "unknown", "citizen", 0.9)],
    )
    assert got["a"][0] == "non_compliant"
    assert got["b"] == ("compliant", 1.0)
    assert got["c"][0] == "disputed"
    assert got["d"][0] == "non_compliant"
    assert got["e"] == ("compliant", 0.5)
    # One weak scan: sharp 1, quality .56/3.2, volume .55.
    assert got["f"] == ("non_compliant", pytest.approx(0.4 + 0.35 * 0.175 + 0.25 * 0.55, abs=1e-4))


def test_consensus_ignores_row_order(spark):
    rng = random.Random(7)
    base = [
        (
            "k",
            rng.choice(["compliant", "non_compliant"]),
            rng.choice(["ar_verified", "dpi_estimated", "package_dimension"]),
            rng.choice(["inspector", "viewer", "anonymous"]),
            rng.randint(50, 100) / 100,
        )
        for _ in range(60)
    ]
    first = verdicts(spark, base)
    for _ in range(3):
        rng.shuffle(base)
        assert verdicts(spark, base) == first


STATE = (
    "prior_verdict string, prior_confidence double, new_verdict string, new_confidence double, prior_ar_verified long, "
    "prior_reference_object long, prior_package_dimension long, prior_dpi_estimated long, compliance_status string, "
    "calibration_tier string, user_role string"
)


@pytest.mark.parametrize(
    "state, expected",
    [
        (("compliant", 0.88, "disputed", 0.6, 0, 0, 0, 3, "non_compliant", "ar_verified", "anonymous"), ("sensor_tier_escalation", "critical", "dpi_estimated")),
        (("non_compliant", 0.8, "disputed", 0.6, 0, 0, 0, 2, "compliant", "reference_object", "anonymous"), ("sensor_tier_escalation", "high", "dpi_estimated")),
        (("compliant", 0.88, "compliant", 0.8, 1, 0, 0, 3, "non_compliant", "dpi_estimated", "inspector"), ("verdict_inversion", "critical", "dpi_estimated")),
        (("compliant", 0.88, "compliant", 0.8, 1, 0, 0, 1, "non_compliant", "dpi_estimated", "anonymous"), ("verdict_inversion", "high", "ar_verified")),
        (("non_compliant", 0.88, "disputed", 0.8, 0, 2, 2, 1, "compliant", "dpi_estimated", "viewer"), ("verdict_inversion", "high", "reference_object")),
        (("compliant", 0.88, "disputed", 0.8, 0, 0, 0, 1, "compliant", "dpi_estimated", "viewer"), ("consensus_disputed", "medium", "dpi_estimated")),
        (("disputed", 0.90, "compliant", 0.70, 0, 0, 0, 1, "compliant", "dpi_estimated", "viewer"), ("confidence_drop", "medium", "dpi_estimated")),
        (("disputed", 0.90, "compliant", 0.65, 0, 0, 0, 1, "compliant", "dpi_estimated", "viewer"), ("confidence_drop", "high", "dpi_estimated")),
        (("compliant", 0.88, "compliant", 0.90, 0, 0, 0, 1, "compliant", "ar_verified", "inspector"), (None, None, None)),
        ((None, None, "compliant", 0.90, 0, 0, 0, 0, "compliant", "ar_verified", "inspector"), (None, None, None)),
    ],
)
def test_conflict_rules(spark, state, expected):
    row = with_conflict(spark.createDataFrame([state], STATE)).first()
    assert (row.conflict_type, row.priority, row.prior_tier) == expected


def test_conflict_rules_can_be_switched_off(spark):
    state = ("compliant", 0.88, "disputed", 0.6, 0, 0, 0, 3, "non_compliant", "ar_verified", "anonymous")
    config = ConflictConfig(tier_escalation=False, verdict_flip=False)
    assert with_conflict(spark.createDataFrame([state], STATE), config).first().conflict_type == "consensus_disputed"


def scan_rows(spark, counts, seed=3):
    rng = random.Random(seed)
    start = dt.datetime(2025, 1, 1)
    out = []
    for gtin, n in counts.items():
        for _ in range(n):
            out.append(
                (
                    len(out),
                    gtin,
                    start + dt.timedelta(seconds=rng.randint(0, 40_000)),
                    rng.choice(["compliant", "compliant", "non_compliant"]),
                    rng.choice(["ar_verified", "reference_object", "dpi_estimated", "package_dimension"]),
                    rng.choice(["inspector", "viewer", "anonymous"]),
                    rng.randint(60, 99) / 100,
                    "L1",
                )
            )
    schema = "scan_id long, gtin string, created_at timestamp_ntz, compliance_status string, calibration_tier string, user_role string, confidence double, batch_code string"
    return spark.createDataFrame(out, schema)


def test_blocks_of_a_hot_product_change_nothing(spark):
    scans = scan_rows(spark, {"hot": 1500, "warm": 260, "cold": 15}).cache()
    plain = rolling_state(scans)
    cut = rolling_state(scans, SkewPolicy(hot_rows=200, block_rows=130))
    assert rows(cut) == rows(plain)
    assert plain.count() == 1775


def test_block_must_exceed_halo(spark):
    with pytest.raises(ValueError):
        rolling_state(scan_rows(spark, {"a": 3}), SkewPolicy(hot_rows=1, block_rows=100))


def test_running_sum_in_blocks_equals_plain_sum(spark):
    scans = scan_rows(spark, {"u1": 500, "u2": 40}).withColumn("v", F.col("scan_id") % 7 - 3).cache()
    args = ("gtin", ["created_at", "scan_id"], minute_of("created_at"), F.col("v"), "total")
    assert rows(running_sum(scans, *args, SkewPolicy(50, 30))) == rows(running_sum(scans, *args))


def test_sequence_ids_are_gap_free_and_ordered(spark):
    scans = scan_rows(spark, {"a": 300, "b": 200})
    ids = sequence_ids(scans, ["created_at", "scan_id"], minute_of("created_at"), "seq", 10)
    got = [r.scan_id for r in ids.orderBy("seq").collect()]
    assert got == [r.scan_id for r in scans.orderBy("created_at", "scan_id").collect()]
    assert [r.seq for r in ids.orderBy("seq").collect()] == list(range(10, 510))


def test_ledger_names_skip_placeholders(spark):
    schema = "scan_id long, gtin string, created_at timestamp_ntz, compliance_status string, calibration_tier string, user_role string, confidence double, product_name string, category string, batch_code string"
    at = dt.datetime(2025, 1, 1)
    data = [
        (1, "g", at, "compliant", "ar_verified", "inspector", 0.9, None, "", None),
        (2, "g", at + dt.timedelta(1), "compliant", None, "inspector", 0.9, "GTIN-1 (x)", "Tea", " "),
        (3, "g", at + dt.timedelta(2), "non_compliant", "odd", "inspector", 0.9, "Real", "Milk", "B1"),
        (4, "h", at, "compliant", "dpi_estimated", "viewer", None, "GTIN-2", None, None),
        (5, None, at, "compliant", "dpi_estimated", "viewer", 0.9, "x", "y", None),
    ]
    scans = spark.createDataFrame(data, schema)
    ledger = {r.gtin: r for r in build_ledger(scans).collect()}
    assert set(ledger) == {"g", "h"}
    assert (ledger["g"].product_name, ledger["g"].category, ledger["g"].last_scan_id) == ("Real", "Tea", 3)
    assert (ledger["g"].dpi_estimated_count, ledger["g"].ar_verified_count) == (2, 1)
    assert ledger["h"].product_name == "GTIN-2"
    batches = {(r.gtin, r.batch_code): r.current_verdict for r in batch_breakdown(scans).collect()}
    assert batches == {("g", "unspecified"): "compliant", ("g", "B1"): "non_compliant", ("h", "unspecified"): "compliant"}


@pytest.mark.parametrize("times", ["null", "one", "mixed"])
def test_rows_without_a_time_and_bulk_loads_are_the_same_hot_and_cold(spark, times):
    at = {"null": lambda i: None, "one": lambda i: dt.datetime(2024, 5, 1, 8, 0), "mixed": lambda i: None if i % 10 == 0 else dt.datetime(2024, 5, 1, 8, i % 3, i % 7)}[times]
    made = [(f"g{i % 3 // 2}", i * 70_000, at(i), 1 + i % 4) for i in range(120)]
    df = spark.createDataFrame(made, "gtin string, scan_id long, created_at timestamp_ntz, v int")
    small = SkewPolicy(hot_rows=10, block_rows=25)
    order = ["created_at", "scan_id"]
    cold, hot = (rows(running_sum(df, "gtin", order, minute_of("created_at"), F.col("v"), "total", p)) for p in (SkewPolicy(), small))
    assert cold == hot and len(hot) == len(made)
    ids = sequence_ids(df, order, minute_of("created_at"), "n").orderBy("n").collect()
    assert [r.n for r in ids] == list(range(1, 121))
    assert [r.scan_id for r in ids] == [r.scan_id for r in df.orderBy(*order).collect()]


def test_two_updates_of_a_ticket_leave_one_ticket(spark):
    from tallymark.operators.tickets import update_tickets

    tickets = spark.sql("SELECT 1L AS trigger_scan_id, 'open' AS status, timestamp_ntz'2024-01-01 00:00:00' AS updated_at")
    updates = spark.sql("""SELECT * FROM VALUES (1L, 'Resolved', null, 'done', timestamp_ntz'2024-01-02 00:00:00'), (1L, '', 'Ann', null, timestamp_ntz'2024-01-03 00:00:00')
        AS t(trigger_scan_id, status, assigned_to, resolution_notes, updated_at)""")
    (row,) = update_tickets(tickets, updates).collect()
    assert (row.status, row.assigned_to, row.resolution_notes, row.resolved_at.day, row.updated_at.day) == ("resolved", "Ann", "done", 2, 3)
