"""Every query of this subpackage has SQL, or a test against a brute-force version, named here."""

import importlib

import pytest

import __spark_entry__

BRUTE_FORCE = {
    "op1_repetition_rules": ("test_operators", "test_repetition"),
    "op6_weakly_supervised_pii": ("test_operators", "test_pii"),
    "op7_token_counts": ("test_operators", "test_token_counts"),
    "op8_token_files": ("test_operators", "test_token_files"),
    "op9_license_scan": ("test_operators", "test_licenses"),
    "op10_byte_bpe_round_trip": ("test_operators", "test_byte_bpe"),
    "op13_chunk_bpe_round_trip": ("test_chunk_bpe", "test_round_trip"),
    "pipeline": ("test_pipeline", "test_stages"),
}


def own_queries():
    from tallymark.plans import load_all

    return sorted(set(__spark_entry__.queries()) - set(load_all()))


@pytest.mark.parametrize("name", own_queries())
def test_is_checked(name):
    if name in __spark_entry__.oracle_sql():
        assert name not in BRUTE_FORCE
    else:
        module, test = BRUTE_FORCE[name]
        assert callable(getattr(importlib.import_module(module), test))
