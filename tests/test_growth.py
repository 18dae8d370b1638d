"""What must not grow: nothing as long as the input goes through the driver, and rows of a label are dealt once."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymark.llm import byte_bpe
from tallymark.operators import classify as C
from tallymark.operators import evaluation
from tallymark.operators import tokens as T
from tallymark.plans import load_all

RAW = "scan_id long, token_id long, text string, x int, y int, w int, h int, confidence double, engine string"


@pytest.fixture
def no_broadcast(spark):
    """No table may be sent through the driver, even where Spark takes it for small."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_scores_send_no_table_through_the_driver(spark, no_broadcast):
    truth = spark.createDataFrame([(i, f, "v") for i in range(50) for f in ("mrp", "net_quantity")], "scan_id long, field_name string, expected string")
    guess = truth.where("scan_id < 40").select("scan_id", "field_name", F.when(F.col("scan_id") < 30, "V ").otherwise("w").alias("extracted_value"))
    got = evaluation.extraction_scores(truth, guess)
    assert {tuple(r)[:4] for r in got.collect()} == {(f, 50, 40, 30) for f in ("mrp", "net_quantity")}


def test_engine_merge_sends_no_table_through_the_driver(spark, no_broadcast):
    rows = [(s, i, "t", 100 * i, 5, 60, 20, 0.5, "tesseract") for s in range(30) for i in range(6)]
    rows += [(s, 100 + i, "t", 100 * i + 2, 6, 60, 20, 0.4 if i % 2 else 0.6, "easyocr") for s in range(30) for i in range(6)]
    got = {(r.scan_id, r.token_id): r.engine_used for r in T.merge_engines(spark.createDataFrame(rows, RAW)).collect()}
    assert got == {(s, i if i % 2 else 100 + i): "tesseract|merged" if i % 2 else "easyocr|merged" for s in range(30) for i in range(6)}


def label_blocks(labels=6, blocks=60, seed=4):
    rng = random.Random(seed)
    texts = ["MRP", "Rs. 45.00", "NET WT", "500 g", "MFG DATE", "12/03/2025", "USE BY", "01/02/2026", "MKTD BY", "Sun Foods Pvt Ltd, Plot 4, Pune 411001", "hello", "x"]
    rows = [(s, i, rng.choice(texts), rng.randint(-900, 900), rng.randint(-900, 900), rng.randint(5, 300), rng.randint(5, 200), 0.9, "easyocr") for s in range(labels) for i in range(blocks)]
    return rows + rows[: blocks // 3]  # some of the first label's blocks come twice


@pytest.mark.parametrize("settle", [C.classify, C.classify_labels, C.failed_fields, C.merge_fields, C.all_blocks])
def test_blocks_of_a_label_are_dealt_once(spark, settle):
    plan = settle(T.clean_tokens(spark.createDataFrame(label_blocks(1, 5), RAW)))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange \w+partitioning", plan)) == 1
    assert "Join" not in plan and "Window" not in plan


def test_neighbours_within_a_label_are_those_of_the_grid(spark):
    tokens = T.clean_tokens(spark.createDataFrame(label_blocks(), RAW))
    grid = {}
    for r in T.near_tokens(T.find_anchors(tokens).where("anchor_order = 1").dropDuplicates(["scan_id", "token_id"]), tokens).collect():
        grid.setdefault((r.scan_id, r.token_id), []).append((r.eff_dist, r.near_id, r.near_text))
    rows = C.read_labels(tokens).withColumn("_s", T.strips(F.col("blocks")))
    found = rows.select("scan_id", F.explode(F.transform(F.filter("blocks", lambda b: F.size(b.headings) > 0), lambda b: F.struct(b.token_id, T.nearest_blocks(b, F.col("_s"))))).alias("r"))
    got = {(r.scan_id, r.r[0]): [(n.eff_dist, n.token_id, n.text) for n in r.r[1]] for r in found.collect()}
    assert {k: v for k, v in got.items() if v} == {k: sorted(v) for k, v in grid.items()}
    assert len(grid) > 100


def test_blocks_without_a_label_count_for_none(spark):
    rows = [(None, 0, "MRP Rs. 45.00", 1, 1, 50, 9, 0.9, "easyocr"), (1, 0, "MRP Rs. 46.00", 1, 1, 50, 9, 0.9, "easyocr")]
    tokens = T.clean_tokens(spark.createDataFrame(rows, RAW))
    assert [(r.scan_id, r.field_name, r.extracted_value) for r in C.classify(tokens).collect()] == [(1, "mrp", "MRP Rs. 46.00")]
    assert {r.scan_id for r in C.merge_fields(tokens).collect()} == {1}
    assert sorted((r.scan_id or 0, r.block_text) for r in C.all_blocks(tokens).collect()) == [(0, "MRP Rs. 45.00"), (1, "MRP Rs. 46.00")]


def test_repeated_evidence_reads_each_file_once(spark, tmp_path):
    pages = [(i, "same" if i % 9 == 2 else f"page {i}") for i in range(30)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    found = load_all()["repeated_evidence"](spark, f"file://{tmp_path}")
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan binaryFile") == 1
    kept = [i for i, _ in pages if i % 13 != 5]
    expected = {}
    for i in kept:
        body = dict(pages)[i] + ("<!-- changed -->" if i % 11 == 4 else "")
        expected.setdefault(body, []).extend([i, i + 1_000_000] if i % 9 == 2 else [i])
    assert sorted((r.n_files, r.first_file_id) for r in found.collect()) == sorted((len(v), min(v)) for v in expected.values() if len(v) > 1)


def test_few_texts_are_encoded_at_once(spark, monkeypatch):
    caught, sizes = {}, []
    monkeypatch.setattr(byte_bpe, "with_codec", lambda df, path, rows, schema: caught.update(rows=rows))
    byte_bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"))
    codec = byte_bpe.Codec(byte_bpe.default_path())
    encode = codec.encode
    codec.encode = lambda texts: (sizes.append(texts.nbytes), encode(texts))[1]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array([f"word{i} " * 15_000 for i in range(30)])], ["doc_id", "text"])
    assert [i for out in caught["rows"](codec, batch) for i in out.column(0).to_pylist()] == list(range(30))
    assert len(sizes) > 2 and max(sizes) <= 1.01 * 2**20
