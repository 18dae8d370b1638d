"""The pipeline stage by stage against brute-force versions of what each must keep."""

import re

import corpus_pipeline
from test_operators import LOWER, alnum_words, brute_classes

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    bench = [alnum_words(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in bench for i in range(max(1, len(w) - 9))}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{number}")
        after = spark.read.parquet(f"{tmp_path}/{number}")
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        kept = {r["doc_id"] for r in after.select("doc_id").collect()}
        if number == 1:
            assert kept == {d for d, n, c in brute_classes(rows) if not n or d == c}
        elif number == 2:
            texts = {d: alnum_words(t) for d, t in rows}
            assert kept == {d for d, w in texts.items() if not any(tuple(w[i : i + 10]) in windows for i in range(len(w)))}
        elif number > 2:
            assert kept == {d for d, _ in rows}
        if number < 4:
            assert after.columns == columns
        docs = after
    assert docs.count() > 0 and "ids" in docs.columns


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [k for k, _ in corpus_pipeline.STAGES][0] == "quality rules" and re.match("n-gram", corpus_pipeline.STAGES[1][0]) and LOWER
