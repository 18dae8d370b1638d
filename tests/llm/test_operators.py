"""Each operator against a brute-force version, on hand-made rows with every awkward case and on the smallest tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tallymark.llm import byte_bpe, catalogue, combination_join, decontamination, licenses, pii, repetition, superkmers, token_counts, token_files, url_filters, vocabulary

DATA = "/root/testdata/sf0.001"
WHITE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = {i: i + 32 for i in range(65, 91)}

PASSAGE = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "one two three four",
    PASSAGE,
    PASSAGE,
    "Before it " + PASSAGE + " after it",
    PASSAGE.upper(),
    "again and again " * 300,
    "the same line here\n" * 40 + "and an end",
    "x" * 30_000,
    " ".join(f"long{i % 997}x{i}" for i in range(20_000)),
    "ça été Éé İı ﬁ é 日本語のテキスト 😀😀 don't we'll 'tis I'M\r\n\r\n  two  blanks ",
    "<|startoftext|> Special <|endoftext|> strings",
    "Licensed under the Apache License, Version 2.0. Released under the MIT License. mit license",
    "licensed under the GNU General Public License, version 3",
    "mail a.b+c@d-e.co.uk, x@y.z+a@b.c 10.0.0.1 300.1.1.1 1.2.3.4.5.6.7.8 4111 1111 1111 1111 4111-1111-1111-1112 +1 (234) 555-1234 +1 2",
    'Dr. Jones, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 123-45-6789',
    "1" * 5000 + " " * 5000 + "a@b.c",
]


def frame(spark, texts=TEXTS):
    """Ids from 1, one null id, one row twice, and columns whose names operators might use themselves."""
    rows = [(i + 1, t, "en", "kept", i, b"n") for i, t in enumerate(texts)]
    rows += [(None, "no id but " + PASSAGE, None, None, None, None), rows[7]] if texts else []
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string, _row int, node binary")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is not None, v) for v in r))


def check(df, expected):
    assert sorted_rows(df.collect()) == sorted_rows(expected)


@pytest.fixture(scope="module", params=["awkward", "given", "empty"])
def docs(request, spark):
    made = {"awkward": lambda: frame(spark), "given": lambda: spark.read.parquet(f"{DATA}/documents.parquet"), "empty": lambda: frame(spark, [])}
    return made[request.param]()


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_repetition(docs):
    def brute(text):
        text = text or ""
        words = re.findall(WHITE, text)
        seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(WHITE, x)]
        counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        return *counts, len(words) < 20 or 100 * len(covered) > 30 * len(words)

    found = repetition.repetition_report(docs)
    check(found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), [(d, *brute(t)) for d, t in pairs(docs)])
    assert found.filter("base_failed and kept").count() == 0
    kept = repetition.filter_rows(docs)
    assert kept.columns == docs.columns
    assert kept.count() == found.filter("kept").count()


def test_longest_and_maximal_repeats():
    import pyarrow as pa

    from tallymark.llm.words import WHITE as SPACES
    from tallymark.llm.words import split

    rng = np.random.default_rng(5)
    for _ in range(60):
        words = [str(x) for x in rng.integers(0, 3, rng.integers(0, 80))]
        words += words[: int(rng.integers(0, 40))]
        got = split(pa.array([" ".join(words), "a b a b"], pa.large_string()), SPACES)
        found = repetition.suffixes(got)
        # Brute force: substrings of 8 words or more that occur twice and cannot be extended to either side in all places.
        places = {}
        for size in range(8, len(words) + 1):
            for i in range(len(words) - size + 1):
                places.setdefault(tuple(words[i : i + size]), []).append(i)
        expected = set()
        for sub, at in places.items():
            if len(at) < 2:
                continue
            left = {words[i - 1] if i else None for i in at}
            right = {words[i + len(sub)] if i + len(sub) < len(words) else -i for i in at}
            if (len(left) > 1 or None in left) and len(right) > 1:
                expected.add((len(sub), tuple(at)))
        every = repetition.maximal_repeats(got, found, 8)
        assert {(n, tuple(sorted(found.order[a : b + 1].tolist()))) for n, a, b in zip(every.length.tolist(), every.first, every.last)} == expected
        # The verdict, from all substrings of the least length or more that occur twice.
        twice = [(sub, at) for sub, at in places.items() if len(at) > 1 and len(sub) >= 16]
        spans = {j for sub, at in twice for i in at for j in range(i, i + len(sub))}
        longest = max((len(sub) for sub, _ in twice), default=0)
        own = repetition.judge(got, repetition.Limits())
        assert (own.spans[0], own.longest[0]) == (len(spans), longest)
        assert own.kept[0] == (not own.failed[0] and len(spans) <= 0.2 * len(words) and longest <= 200)


@pytest.mark.parametrize("text", ["a " * 200_000, "the same line here and more\n" * 20_000], ids=["one word", "one line"])
def test_repetition_of_one_long_text(text):
    import tracemalloc

    import pyarrow as pa

    tracemalloc.start()
    found = repetition.report(pa.array([text], pa.large_string()), repetition.Limits())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = found["n_words"][0]
    assert found["n_covered_words"][0] == n and found["longest_repeat"][0] > n * 0.99 and not found["kept"][0]
    assert peak < 500 << 20


def alnum_words(text):
    return re.findall(ALNUM, (text or "").translate(LOWER))


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, PASSAGE[:200]), (2, "one"), (10, "again and again again"), (3, None), (None, "line here and"), (5, "..."), (1, PASSAGE[:200])], "item_id long, text string")
    bench = bench.union(spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text"))
    windows = {}
    for item, text in bench.collect():
        words = alnum_words(text)
        size = min(10, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add("" if item is None else str(item))
    expected = []
    for d, t in pairs(docs):
        words, hit, items = alnum_words(t), set(), set()
        for size in range(1, 11):
            for i in range(len(words) - size + 1):
                if (w := tuple(words[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    items |= windows[w]
        expected.append((d, len(words), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    found = decontamination.contamination_report(docs, bench)
    check(found, expected)
    clean = decontamination.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not e[-1] for e in expected)
    cut = decontamination.remove_spans(docs, bench)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    left = sum(len(alnum_words(t)) for _, t in pairs(cut))
    assert left == sum(e[1] - e[2] for e in expected)


def test_decontamination_without_broadcast(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    expected = decontamination.contamination_report(docs, bench).collect()
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    check(decontamination.contamination_report(docs, bench), expected)
    assert decontamination.contamination_report(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_decontamination_shuffles_no_words_per_window(spark, monkeypatch):
    bench = spark.createDataFrame([(1, PASSAGE), (2, "one two"), (3, "word7")], "item_id long, text string")
    texts = [PASSAGE + " one two " + PASSAGE, " ".join(f"x{i}" for i in range(3000)) + " one two", "one", "two", None, "", "a b", PASSAGE]
    docs = frame(spark, texts)
    expected = decontamination.span_report(docs, bench).collect()
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    report = decontamination.span_report(docs, bench)
    check(report, expected)
    shown = report._jdf.queryExecution().explainString(report._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    exchanged = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", shown)
    assert exchanged and not any("_words" in columns for columns in exchanged)


@pytest.mark.parametrize("hot", [2000, 1])
def test_substring_dedup(docs, hot):
    rows = [(d, re.findall(WHITE, t or "")) for d, t in pairs(docs)]
    seen = Counter(tuple(w[i : i + 35]) for _, w in rows for i in range(len(w) - 34))
    expected = []
    for d, w in rows:
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        expected.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    check(superkmers.substring_dedup(docs, hot=hot), expected)


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = re.findall(WHITE, (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]


def near_copies(spark):
    """Chains of near copies, copies, sets that share a frequent passage, and edits just below and above the threshold."""
    rng = np.random.default_rng(3)
    texts = []
    for base in range(6):
        words = [f"b{base}w{i}" for i in range(80)]
        for copy in range(12):
            for _ in range(copy % 4):
                words[int(rng.integers(0, len(words)))] = f"e{base}x{copy}y{int(rng.integers(0, 9))}"
            texts.append(" ".join(words))
    texts += [f"own{i} start{i} " + PASSAGE + f" own{i} end{i}" for i in range(25)]
    texts += [f"{PASSAGE} " + " ".join(f"u{i}v{j}" for j in range(14)) for i in range(25)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("frequent, most, side", [(16, 24, 2000), (2, 24, 3), (2, 0, 2), (3, 400, 5)])
def test_jaccard_join(spark, frequent, most, side, monkeypatch):
    monkeypatch.setattr(combination_join, "FREQUENT", frequent)
    monkeypatch.setattr(combination_join, "SIDE", side)
    monkeypatch.setattr(combination_join, "MOST_FREQUENT", most)
    docs = near_copies(spark)
    check(combination_join.near_duplicate_classes(docs).select("doc_id", "n_shingles", "component_id"), brute_classes(pairs(docs)))


def test_jaccard_join_cases(docs):
    rows = pairs(docs)
    expected = brute_classes(rows)
    check(combination_join.near_duplicate_classes(docs).select("doc_id", "n_shingles", "component_id"), expected)
    kept = combination_join.keep_one_each(docs)
    assert kept.columns == docs.columns
    classes = {c for _, n, c in expected if n}
    assert kept.count() == len(classes) + sum(n == 0 for _, n, _ in expected)


@pytest.mark.parametrize("n", [1_000, 13_000_000, 30_000_000])
def test_jaccard_bounds_of_large_sets(spark, n):
    join = combination_join.Join(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", 5, 75)
    rows = [(0, 1, b"a", n, 0, b"a"), (0, 1, b"b", n - n // 10, 5, b"b"), (0, 1, b"c", n // 2, 0, b"c"), (0, 1, b"d", n, n // 2, b"d")]
    labelled = spark.createDataFrame([(*r, False) for r in rows], "kind int, token long, node binary, n int, pos int, label binary, big boolean")
    bitmaps = spark.createDataFrame([(r[2], r[3], bytes(64)) for r in rows], "node binary, n int, bitmap binary")
    assert join.open_pairs(labelled, bitmaps).count() == 1
    sizes = spark.createDataFrame([(n, n - n // 10, 0, 5), (n, n // 2, 0, 0), (n, n, 0, n // 2)], "n int, m int, pos int, other int")
    assert [r[0] for r in sizes.select(join.may_link("n", "m", "pos", "other")).collect()] == [True, False, False]


def test_url_lists(spark):
    entries = spark.sql("""SELECT * FROM VALUES ('bad', 'example.com', true, timestamp'2024-01-02 00:00:00'), ('bad', 'example.com', false, timestamp'2024-01-09 00:00:00'),
        ('bad', 'example.com', true, timestamp'2024-01-09 00:00:00'), ('bad', 'a.example.com', true, timestamp'2024-02-01 00:00:00'), ('ads', 'x.org/p/', true, timestamp'2024-01-01 00:00:00'),
        ('ads', 'x.org/p/', true, timestamp'2024-01-05 00:00:00'), ('ads', null, true, timestamp'2024-01-05 00:00:00') AS t(list, pattern, added, at)""")
    cases = [
        (1, "http://a.example.com/q", "2024-01-01 23:59:59", 0, ""),
        (2, "http://a.example.com/q", "2024-01-02 00:00:00", 1, "bad"),
        (3, "http://a.example.com/q", "2024-01-09 00:00:00", 0, ""),
        (4, "https://user@A.Example.com:80/q", "2024-03-01 00:00:00", 1, "bad"),
        (5, "http://x.org/p/deep/page?x=1", "2030-01-01 00:00:00", 1, "ads"),
        (6, "http://x.org/pp/", "2024-01-06 00:00:00", 0, ""),
        (7, None, "2024-01-06 00:00:00", 0, ""),
        (8, "not a url", "2024-01-06 00:00:00", 0, ""),
        (9, "http://x.org/p/", None, 0, ""),
        (None, "http://x.org/p/", "2024-01-06 00:00:00", 1, "ads"),
        (5, "http://x.org/p/deep/page?x=1", "2030-01-01 00:00:00", 1, "ads"),
    ]
    captures = spark.createDataFrame([c[:3] for c in cases], "page_id long, url string, fetched_at string").selectExpr("page_id", "url", "cast(fetched_at AS timestamp) fetched_at", "1 AS list", "2 AS pattern")
    found = url_filters.judge(captures, entries)
    check(found.select("page_id", "n_entries", "lists", "blocked"), [(c[0], c[3], c[4], c[3] > 0) for c in cases])
    assert url_filters.judge(captures, entries.limit(0)).filter("blocked").count() == 0
    assert url_filters.judge(captures.limit(0), entries).count() == 0


def luhn(number):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
]


def test_pii(docs):
    expected, base = [], {}
    for d, t in pairs(docs):
        found = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if ok(m.group())] for k, p, ok in BASE]
        flat = [x for f in found for x in f]
        expected.append((d, *map(len, found), sha(",".join(flat))))
        base[d, t] = flat
    report = pii.span_report(docs)
    check(report.drop("spans"), expected)
    for row in report.collect():
        spans = row["spans"].split(",") if row["spans"] else []
        assert any(spans[: len(b)] == b for (d, _), b in base.items() if d == row["doc_id"])
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    for _, t in pairs(clean):
        assert not re.search(BASE[0][1], t or "")


def test_pii_of_one_long_text(spark):
    """Thousands of matches in one text, some of the wide pattern within, before and after base spans."""
    parts = [f"u{i}@h{i % 7}.org" if i % 3 else f"+1 (234) 555-{i:04d} 123-45-6789 4111 1111 1111 1111 Dr. Jones{i}@x.io é😀" for i in range(6000)]
    text = " ".join(parts)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    emails = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    row = pii.with_candidates(docs).first()
    assert [(s["start"], s["end"]) for s in row["_email"]] == emails
    base = [(s["start"], s["end"]) for s in row["_base"]]
    touched = {i for a, b in base for i in range(a, b)}
    clear = [(a, b, v) for a, b, v in wide_spans(text) if touched.isdisjoint(range(a, b))]
    assert [(s["start"], s["end"], s["value"]) for s in row["_wide"]] == clear
    out, at = [], 0
    spans = sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in pii.span_report(docs).first()["spans"].split(",")))
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    assert pii.redact(docs).first()["text"] == "".join(out) + text[at:]


def test_pii_labelers_find_secrets(spark):
    text = " ".join(f'token = "{sha(str(i))[:40]}" and more words here, mail m{i}@example.com' for i in range(4))
    docs = spark.createDataFrame([(i, f"{i} {text}") for i in range(20)], "doc_id long, text string")
    assert all(r["spans"].count("secret:") == 4 for r in pii.span_report(docs).collect())


def wide_spans(text):
    return [(m.start(), m.end(), m.group()) for m in re.finditer(pii.WIDE.replace(r"\p{L}", r"[^\W\d_]"), text)]


def test_pii_places_of_repeated_values(spark):
    texts = [
        "part A123-45-6789 ssn 123-45-6789",
        "x1234567890123 acct 1234567890123",
        "case 123-45-67890, ssn 123-45-6789",
        "😀 A123-45-6789, B123-45-6789 ssn 123-45-6789 and 123-45-6789x then 123-45-6789",
        "xDr. Jones and Dr. Jones",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["_text"]: [(s["start"], s["end"], s["value"]) for s in r["_wide"]] for r in pii.with_candidates(docs).collect()}
    assert found == {t: wide_spans(t) for t in texts}
    many = spark.createDataFrame([(i, t) for i in range(20) for t in texts[:1]], "doc_id long, text string")
    assert {r["spans"] for r in pii.span_report(many).collect()} == {"id:22:33"}
    assert {r["text"] for r in pii.redact(many).collect()} == {"part A123-45-6789 ssn <id>"}


def test_pii_candidates_without_three_digits_in_a_row(spark):
    texts = [
        "token = a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6",
        "key " + "abcdefAB" * 5,
        "12 34 56 78 90 12 34",
        "number 1-2-3-4-5-6-7-8-9-0-1-2-3 here",
        "call Dr Jones",
        "12 34 and no more",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["_text"]: [(s["start"], s["end"], s["value"]) for s in r["_wide"]] for r in pii.with_candidates(docs).collect()}
    assert found == {t: wide_spans(t) for t in texts}
    assert [len(found[t]) for t in texts] == [1, 1, 1, 1, 1, 0]


@pytest.fixture(scope="module")
def word_ids():
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("head", [vocabulary.HEAD, 5, 0])
def test_token_counts(docs, word_ids, head):
    expected = [(d, len((t or "").encode()), n := len(word_ids(t)), n > 2048) for d, t in pairs(docs)]
    check(token_counts.token_counts(docs, head=head), expected)


def test_token_files(spark, docs, word_ids, tmp_path):
    rows = []
    for d, t in pairs(docs):
        ids = np.array([*word_ids(t), 1], "<u4")
        rows.append((d is not None, d or 0, len(ids), zlib.crc32(ids.tobytes()), d, ids.tolist()))
    expected, start = [], 0
    for *_, n, crc, d, ids in sorted(rows):
        expected.append((d, start, n, crc, ids))
        start += n
    token_files.write_token_files(docs, str(tmp_path))
    check(token_files.token_digests(spark, str(tmp_path)), [e[:4] for e in expected])
    check(token_files.read_token_files(spark, str(tmp_path)), [(d, s, ids) for d, s, _, _, ids in expected])


def test_packed_values_round_trip():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2 ** rng.integers(1, 32, 5000), dtype=np.int64).astype(np.uint32)
    counts = np.array([0, 1, 2, 3, 4, 5, 0, 4985])
    control, data, _, _ = token_files.pack(values, counts)
    assert (token_files.unpack(control, data, counts) == values).all()
    assert len(token_files.unpack(np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.int64))) == 0


def test_licenses(docs):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    expected = []
    for d, t in pairs(docs):
        w = alnum_words(t)
        at = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p)
        expected.append((d, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({label for _, label in at}))))
    found = licenses.license_report(docs)
    check(found.drop("labels", "score"), expected)
    for row in found.collect():
        assert 0 <= row["score"] <= 1
        assert set(filter(None, row["base_labels"].split(","))) <= set(filter(None, row["labels"].split(",")))


def test_license_templates(spark):
    texts = [text for _, text, _ in licenses.TEMPLATES] + ["the general terms of this software are as is", "a license"]
    found = licenses.license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for row, (label, _, _) in zip(found, licenses.TEMPLATES):
        assert label in row["labels"].split(",") and row["score"] > 0.99
    assert [r["labels"] for r in found[-2:]] == ["", ""]


def test_licenses_of_several_notices(spark):
    notices = [text for _, text, _ in licenses.TEMPLATES]
    every = ",".join(sorted({label for label, _, _ in licenses.TEMPLATES}))
    others = " ".join(w.decode() for w in licenses.TERMS)
    cases = {1: (" ".join(notices), every), 2: ("\nsome words between notices\n".join(notices[::-1]), every)}
    for i, (label, text, _) in enumerate(licenses.TEMPLATES):
        cases[10 + i] = (f"{others} plain words " * 20 + text + f" plain words {others}" * 20, label)
    docs = [(d, text) for d, (text, _) in cases.items()] + [(100 + i, "of the terms and this is a plain text") for i in range(200)]
    found = {r["doc_id"]: r for r in licenses.license_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [found[d]["labels"] for d in cases] == [labels for _, labels in cases.values()]
    assert all(found[d]["score"] > 0.99 for d in cases)


@pytest.fixture(scope="module")
def bytes_encoding():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, bytes_encoding):
    rows = pairs(docs)
    expected = [(d, bytes_encoding.encode_ordinary(t or "")) for d, t in rows]
    coded = byte_bpe.encode(docs)
    check(coded, expected)
    check(byte_bpe.decode(coded), [(d, (t or "").encode()) for d, t in rows])
    check(byte_bpe.round_trip(docs), [(d, len(ids), sha(" ".join(map(str, ids))), sha(t or "")) for (d, ids), (_, t) in zip(expected, rows)])


def test_queries_cover_every_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in catalogue.QUERIES) == list(range(1, 14))
