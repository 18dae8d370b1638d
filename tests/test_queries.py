"""Registered queries against their SQL on the smallest tables.

All queries of the engine run by default, TALLYMARK_SAMPLE=1 runs a sample of every plan. The optional
training-data queries are tested beside their operators. tools/check_queries.py does the same at any scale.
"""

import os

import pytest

import __spark_entry__ as entry_module
from conftest import DATA
from tallymark.plans import load_all
from tools.check_queries import compare, duck

SAMPLE = [
    "ledger_consensus", "ledger_batches", "conflict_tickets", "ticket_queue", "kpi_counts", "top_recurring_violations", "docket_register",
    "scan_search_page", "merged_scan_feed", "claim_verification", "xp_running_balance", "submission_gate", "reviewed_scans",
    "assigned_scan_uids", "document_scans", "origin_inference", "label_verdicts", "label_gaps", "cross_validation", "listing_verdicts",
    "shelf_life", "consumption_forecast", "nutrient_table", "merged_sides", "heading_neighbours", "classified_fields", "listing_pages",
    "page_images", "stream_daily_counts", "stream_balances", "stream_progress", "stream_store_and_forward", "label_scan_verdicts", "result_cards",
]


@pytest.fixture(scope="session")
def con():
    return duck(DATA)


def test_every_query_has_a_check():
    sqls = entry_module.oracle_sql()
    assert set(sqls) <= set(entry_module.queries())
    # What SQL cannot express is held against brute-force versions, for which see tests/llm.
    assert set(load_all()) <= set(sqls)


def test_entry_runs(spark):
    frame = entry_module.entry(spark)
    assert frame.count() > 0
    assert "current_verdict" in frame.columns


@pytest.mark.parametrize("name", SAMPLE if os.environ.get("TALLYMARK_SAMPLE") else list(load_all()))
def test_query_matches_sql(spark, con, name):
    ok, message = compare(spark, con, DATA, name, entry_module.queries()[name], entry_module.oracle_sql()[name])
    assert ok, message
