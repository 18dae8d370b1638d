"""Hard negatives against brute force over all pairs."""

import math

import pytest
from pyspark.sql import functions as F

from tallymark.llm import hard_negatives


def shifted():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def brute(rows, shift=True, every=100, task=hard_negatives.Task()):
    held = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        one = ((label + 1) % 10 if shift and key % 7 == 0 else label, [math.floor(256 * x) for x in vector])
        held[key] = min(held.get(key, one), one)

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for a, (label, vector) in held.items():
        if a % every:
            continue
        scored = sorted((-dot(vector, v), k, own == label) for k, (own, v) in held.items() if k != a)
        for p, positive, _ in [s for s in scored if s[2]][: task.positives]:
            good = [s for s in scored if not s[2] and task.least_percent * -p <= 100 * -s[0] <= task.most_percent * -p]
            out += [(a, positive, nth, s[1], -p, -s[0]) for nth, s in enumerate(good[: task.negatives], 1)]
    return sorted(out)


def check(df, rows, **options):
    found = hard_negatives.hard_negatives(df, F.col("id") % options.get("every", 100) == 0, label=shifted())
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, **options)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    check(df, [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])


@pytest.mark.parametrize("shard_values", [8_000_000, 64])
def test_awkward_rows(spark, monkeypatch, shard_values):
    monkeypatch.setattr(hard_negatives, "SHARD_VALUES", shard_values)
    monkeypatch.setattr(hard_negatives, "STRIDE", 3)
    monkeypatch.setattr(hard_negatives, "HEAD_VALUES", 40)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [((i * 37 + k * 11) % 19 - 6) / 16 for k in range(4)], i % 3) for i in range(-30, 60)]
    rows += [(100 + i, [0.5, 0.25, 0.0, 0.125], i % 2) for i in range(40)]  # ties
    rows += [(200, [0.0, 0.0], 1), (210, [1.0], 1), (220, [], 0), (230, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], 2)]
    rows += [(None, [1.0], 1), (300, None, 1), (310, [1.0, None], 1), (320, [nan, 1.0], 1), (330, [inf], 1), (340, [1.0], None)]
    rows += [rows[3], rows[3], (0, [9.0, 9.0, 9.0, 9.0], 9), (400, [1e5, -1e5, 3e5, 0.0], 1), (410, [2e5, 1e5, 2e5, 0.0], 2), (420, [2e5, 1e5, 2.5e5, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label long, cluster string, bound int")
    check(df, rows, every=10)


def test_bounds_hold(spark):
    """No member of a cluster can pass its list's key."""
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(20):
        rows = rng.integers(-50, 50, (60, 5))
        centre = rows[:1] / np.linalg.norm(rows[0])
        vectors = hard_negatives.Vectors(rows)
        angles = np.arccos(hard_negatives.cosines(rows, centre)[:, 0])
        members = angles < 1.0
        bound = hard_negatives.bounds(vectors, np.cos(angles), angles[members].max())
        scores = rows[members] @ rows.T
        assert (scores <= vectors.length[members][:, None] * bound[None, :] * (1 + 1e-6) + 1e-3).all()


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(df, F.col("id") % 100 == 0).collect() == []
