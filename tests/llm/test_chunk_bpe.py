"""Chunked BPE against the library on whole texts."""

import hashlib
import random

import public_tokenizers as P
import pytest
from test_operators import PASSAGE, docs, frame, pairs, sorted_rows  # noqa: F401  docs is a fixture
from tokenizers import Tokenizer

from tallymark.llm import chunk_bpe


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def expected(library, rows):
    out = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted_rows(out)


def test_round_trip(docs, library):  # noqa: F811
    assert sorted_rows(chunk_bpe.round_trip(docs).collect()) == expected(library, pairs(docs))


@pytest.mark.parametrize("least, most, mask", [(1, 7, 3), (3, 40, 15), (17, 400, 63)])
def test_shared_passages_with_small_chunks(spark, library, monkeypatch, least, most, mask):
    """Every kind of cut: within words, characters, contractions, special strings and runs without a blank."""
    for name, value in (("LEAST", least), ("MOST", most), ("MASK", mask)):
        monkeypatch.setattr(chunk_bpe, name, value)
    rng = random.Random(7)
    parts = ["don't ", "we'll", "x" * 90, "é́é ", "日本語", "<|endoftext|>", "<|endof", "text|>", " \n\t", "İı", "ﬁ", "123 45", "...!?", "'s's", " ", " ", "😀", "ΣΑΣ ", "word ", "<", "≮ ≮ "]
    shared = ["".join(rng.choice(parts) for _ in range(60)) for _ in range(6)]
    texts = ["".join(rng.choice([*parts, *shared]) for _ in range(12)) for _ in range(60)] + shared + [PASSAGE, PASSAGE * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted_rows(chunk_bpe.round_trip(df).collect()) == expected(library, list(enumerate(texts)))


def test_ids_and_decode(spark, library):
    df = frame(spark)
    coded = chunk_bpe.encode(df)
    whole = sorted_rows((d, str(ids)) for d, ids in coded.collect())
    assert whole == sorted_rows((d, str(library.encode(t or "", add_special_tokens=False).ids)) for d, t in pairs(df))
    decoded = {(d, t) for d, t in chunk_bpe.decode(coded).collect()}
    assert decoded == {(d, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for d, t in pairs(df)}


def test_chunks_are_content_defined():
    import numpy as np

    data = " ".join(f"word{i * i}" for i in range(2000)).encode()
    other = b"something else before it, of another length. " + data
    split = [{bytes(t[a:b]) for a, b in zip([0, *e[:-1]], e)} for t in (data, other) for e in chunk_bpe.cuts(np.frombuffer(t, np.uint8), np.array([0, len(t)]))]
    assert len(split[0] & split[1]) > 0.9 * len(split[0]) > 10


def test_other_tokenizers_are_refused(spark):
    assert chunk_bpe.agrees_at_blanks(P.path("word_bpe_49k.json"))
    with pytest.raises(ValueError, match="blank"):
        chunk_bpe.round_trip(frame(spark), path=P.path("byte_bpe_50k.json"))
