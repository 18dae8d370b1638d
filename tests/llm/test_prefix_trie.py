"""The trie of conversation prefixes against brute force over all prefixes."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallymark.llm import catalogue, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, t string, bucket int"


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    lists = {c: [t[1:] for t in sorted(own[c], key=lambda t: (t[0], prefix_trie_digest(*t[1:])))] for c in own}
    whole = {}
    for c, turns in lists.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        base = c - int(c - 100 * int(c / 100)) if rebuild else c
        whole[c] = lists.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        own_saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        parts = [below[k] for k in children[node]]
        below[node] = (sum(p[0] for p in parts) or (not parts), own_saved + sum(p[1] for p in parts))
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), int(below[node][0]), below[node][1], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def prefix_trie_digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def found(df, rebuild=True):
    base, kept = F.col("conv") - F.col("conv") % 100, F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    result = prefix_trie.conversation_trie(df, base, kept, 5) if rebuild else prefix_trie.conversation_trie(df)
    assert result.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, result.collect()), key=str)


def awkward():
    rows = []
    for c in [*range(100, 140), 0, 7, -3, -100, -105, 250, 251]:
        n = (c * 7) % 12
        rows += [(c, i, "user" if i % 2 == 0 else "assistant", f"text {i if c % 3 else i * (c % 5)} é😀") for i in range(n)]
    rows += [(500, i, "u", "long " + str(i)) for i in range(90)] + [(501, i, "u", "long " + str(i if i < 61 else -i)) for i in range(90)]
    rows += [(502, 0, None, None), (502, None, "u", None), (502, None, None, "x"), (503, 1, "a", "same"), (503, 1, "b", "same"), (503, 1, "a", "same")]
    rows += [(504, 0, "user", ""), (505, 0, "use", "r"), (None, 0, "u", "no conversation"), (506, -5, "u", "early"), (506, 3, "u", "late")]
    rows += [(c, i, "u", "copy %d" % i) for c in range(600, 640) for i in range(10)]
    return rows


@pytest.mark.parametrize("block, bucket, ids", [(8, 1024, 12), (2, 4, 1), (4, 16, 3)])
@pytest.mark.parametrize("rebuild", [True, False])
def test_awkward_rows(spark, monkeypatch, block, bucket, ids, rebuild):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "BUCKET", bucket)
    monkeypatch.setattr(prefix_trie, "IDS", ids)
    rows = awkward()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert found(df, rebuild) == brute(rows, rebuild)


def test_given_and_empty_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    result = sorted(map(tuple, catalogue.QUERIES["op11_conversation_trie"](spark, "/root/testdata/sf0.001").collect()), key=str)
    assert result == brute(rows)
    assert found(spark.createDataFrame([], SCHEMA)) == []
