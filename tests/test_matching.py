"""Choices in turn against the loop that makes them one by one."""

import random

import pytest

from tallymark.operators import tokens as T
from tallymark.operators.matching import choose_in_turn

RAW = "scan_id long, token_id long, text string, x double, y double, w double, h double, confidence double, engine string"


def one_by_one(rows):
    out, served = set(), set()
    for group, taker, cost, item in sorted((g, e, c, t) for g, e, t, c in rows):
        if (group, "e", taker) not in served and (group, "t", item) not in served:
            served |= {(group, "e", taker), (group, "t", item)}
            out.add((group, taker, item))
    return out


def made(rng, kind):
    if kind == "chain":  # each taker's second wish is the next one's first: all wait for the one before
        return [(1, e, e + k, -1.0 + k / 10 if e else -0.5) for e in range(30) for k in (0, 1)] + [(1, 0, 1, -2.0)]
    if kind == "one hot item":
        return [(1, e, 0, -1.0) for e in range(500)] + [(1, e, e, -0.5) for e in range(1, 500)]
    sizes = {"many groups": (200, 12), "one large group": (1, 2500)}[kind]
    rows = {(g, rng.randrange(sizes[1]), rng.randrange(sizes[1])): -rng.randrange(6) / 8 for g in range(sizes[0]) for _ in range(sizes[1] * 3)}
    return [(*k, c) for k, c in rows.items()]


@pytest.mark.parametrize("kind", ["many groups", "one large group", "chain", "one hot item"])
def test_equals_the_loop(spark, kind):
    rows = made(random.Random(3), kind)
    pairs = spark.createDataFrame(rows, "g long, e long, t long, cost double")
    chosen = choose_in_turn(pairs, "g", "e", "t", "cost")
    assert chosen.columns == pairs.columns
    assert {(r.g, r.e, r.t) for r in chosen.collect()} == one_by_one(rows)


def test_no_pairs(spark):
    assert choose_in_turn(spark.createDataFrame([], "g long, e long, t long, cost double"), "g", "e", "t", "cost").collect() == []


def test_huge_boxes_cover_few_cells(spark):
    rows = [(1, i, "t", 10.0 * i, 5.0, 9.0, 9.0, 0.9, "tesseract") for i in range(50)]
    rows += [(1, 100, "a", 0.0, 0.0, 3e7, 2e7, 0.5, "tesseract"), (1, 101, "b", 0.0, 0.0, 2.9e7, 2e7, 0.6, "easyocr"), (1, 102, "c", 20.0, 5.0, 9.0, 9.0, 0.1, "easyocr")]
    rows += [(2, 1, "none", 0.0, 0.0, 0.0, 0.0, 0.9, "tesseract"), (2, 2, "none", 0.0, 0.0, 0.0, 0.0, 0.9, "easyocr")]
    kept = {(r.scan_id, r.token_id): r.engine_used for r in T.merge_engines(spark.createDataFrame(rows, RAW)).collect()}
    assert (1, 100) not in kept and (1, 102) not in kept
    assert kept[1, 101] == "easyocr|merged" and kept[1, 2] == "tesseract|merged"
    assert len(kept) == 53
