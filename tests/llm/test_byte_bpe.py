"""Byte-level BPE: what is contracted before the rounds changes no result, and words in use are contracted once."""

import base64
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tallymark.llm import byte_bpe


def plain(ranks, word):
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while found := [(ranks[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in ranks]:
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@pytest.mark.parametrize("seed", range(6))
def test_any_rank_file(tmp_path, seed):
    """Ranks in any order: a token may rank before its parts, and a pair of bytes may be part of one that does."""
    draw = random.Random(seed)
    letters = [b"ab", b"abc", b"abcdefgh"][seed % 3]
    tokens = {bytes(draw.choices(letters, k=draw.choice((2, 2, 2, 3, 3, 4, 6)))) for _ in range((8, 30, 150)[seed % 3])}
    every = [bytes([b]) for b in range(256)] + sorted(tokens)
    if seed < 3:
        draw.shuffle(every)
    else:
        every[256:] = sorted(every[256:], key=len)
    ranks = {t: i for i, t in enumerate(every)}
    path = tmp_path / f"{seed}.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in ranks.items()))
    codec = byte_bpe.Codec(str(path))
    words = list({bytes(draw.choices(letters, k=draw.randint(1, 24))) for _ in range(800)} | {b"a" * n for n in range(1, 257)})
    codec.encode_words(words)
    assert [np.frombuffer(codec.own.known[w], np.int32).tolist() for w in words] == [plain(ranks, w) for w in words]
    codec.close()


def test_most_tokens_stand_before_the_first_round():
    codec = byte_bpe.Codec(byte_bpe.default_path())
    words = [b" retionheating", b" schlichbeuaux", b" thatnesslesst", b" enenenschestishing"]
    start = codec.start(words)
    left = start.num_rows - sum(start.column("gone").to_pylist())
    codec.encode_words(words)
    assert [np.frombuffer(codec.own.known[w], np.int32).tolist() for w in words] == [plain(codec.ranks, w) for w in words]
    assert left < 0.75 * sum(map(len, words))
    codec.close()


def test_words_in_use_are_contracted_once(monkeypatch):
    """More words pass than are remembered, but those that stand in every text stay, though once in each."""
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 100)
    codec, contracted = byte_bpe.Codec(byte_bpe.default_path()), []
    codec.own.known, codec.own.older = {}, {}
    start = codec.start
    codec.start = lambda words: (contracted.extend(words), start(words))[1]
    often = [f"xqzvk{chr(97 + i)}w" for i in range(20)]
    for n in range(30):
        codec.encode(pa.array([" ".join([*often, *(f"pqjx{chr(97 + n % 26)}{chr(97 + n // 26)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)), "z" * 70])], pa.large_string()))
        assert len(codec.own.known) <= 100 + 61 and len(codec.own.older) <= 100 + 61
        assert not any(len(w) > byte_bpe.LONGEST_REMEMBERED for w in codec.own.known)
    assert all(contracted.count(f" {w}".encode()) == 1 for w in often[1:])
    codec.close()
