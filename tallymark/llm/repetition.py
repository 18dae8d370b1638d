"""Quality rules from a suffix array of each document: how much of it repeats, and how long the longest repeat is.

The words of a document are its letters. A suffix array with longest common prefixes (LCP) gives LCP
intervals; an interval that cannot be extended to the left without splitting is a maximal repeated substring.
The union of the spans of all repeats of at least ``min_repeat`` words, and the longest of them, are limited.

Cases: a null or empty text has no words and fails the base rule; a text of one word over and over repeats in
all but nothing; copies of a row are judged alike, each by itself; extra columns are passed on by ``filter_rows``
whatever they are called; an empty table gives an empty result. A document is worked on in one task: memory is in proportion to the chunk or
the longest single document (about 400 bytes a word), however much of it repeats.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallymark.llm.words import WHITE, Words, chunks, column, map_arrow, split

WINDOW = 8  #: words of a window of the base rule
SYMBOLS = b"#*$%&|<>"
CHUNK = 2 << 20  #: bytes of texts at a time, about


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    max_window_percent: int = 30  #: of words in repeated 8-word windows
    min_repeat: int = 16  #: words of a repeat that the method counts
    max_covered: float = 0.2  #: of the words may lie in such repeats
    max_longest: int = 200  #: words of the longest repeat


@dataclass
class Repeats:
    """Repeats within documents: suffixes in sorted order, each with the LCP to the next one."""

    order: np.ndarray
    lcp: np.ndarray  #: 0 where the next suffix shares fewer than ``WINDOW`` words or is of another document


def suffixes(words: Words) -> Repeats:
    """Suffix arrays of all documents at once by prefix doubling; suffixes that are alone in sharing ``WINDOW`` words are left out."""
    n = len(words.ids)
    document = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    end = words.first[1:][document] if n else np.zeros(0, np.int64)
    levels: list[np.ndarray] = []
    rank = np.zeros(n, np.int64)
    active = np.arange(n)
    key = document * (len(words.names) + 1) + words.ids
    width, long = 1, None
    while len(active):
        if levels:
            after = active + width
            inside = after < end[active]
            second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
            key = rank[active] * (n + 2) + second
            width *= 2
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        place = np.arange(len(active))
        new = np.ones(len(active), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.maximum.accumulate(np.where(new, place, 0))
        if levels:
            old = rank[active]
            changed = np.ones(len(active), bool)
            changed[1:] = old[1:] != old[:-1]
            group = old + group - np.maximum.accumulate(np.where(changed, place, 0))
        rank[active] = group
        levels.append(rank.astype(np.int32))
        last = np.ones(len(active), bool)
        last[:-1] = new[1:]
        active = active[~(new & last)]
        if width == WINDOW:
            long = active
    if long is None or not len(long):
        return Repeats(np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = long[np.argsort(rank[long])]
    left, right = order[:-1], order[1:]
    length = np.zeros(len(left), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        a, b = left + length, right + length
        ok = (a < end[left]) & (b < end[right])
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        length += np.where(ok & (levels[t][a] == levels[t][b]), 1 << t, 0)
    length[(length < WINDOW) | (document[left] != document[right])] = 0
    return Repeats(order, np.append(length, 0))


@dataclass
class Intervals:
    """LCP intervals that also differ to their left: maximal repeated substrings."""

    length: np.ndarray  #: words
    first: np.ndarray  #: the interval's first place in the suffix order
    last: np.ndarray
    at: np.ndarray  #: of each suffix, the longest of these repeats that starts there, or 0


def maximal_repeats(words: Words, found: Repeats, least: int) -> Intervals:
    """Maximal repeats of at least ``least`` words, by one pass with a stack of open intervals; none of them lists its places.

    Intervals are nested, so a suffix takes its longest repeat from the first of them that closes over it.
    """
    first = np.zeros(len(words.ids) + 1, bool)
    first[words.first] = True
    before = np.where(first[found.order], -1 - found.order, words.ids[found.order - 1] if len(found.order) else 0)
    turns = np.concatenate([[0], np.cumsum(np.diff(before) != 0)]).tolist() if len(before) else []
    at = np.zeros(len(found.order), np.int64)
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    waiting: list[int] = []  # suffixes of open intervals that no closed one holds, in order
    for i, lcp in enumerate(found.lcp.tolist()):
        start = i
        if stack:
            waiting.append(i)
        while stack and stack[-1][0] > lcp:
            value, start = stack.pop()
            if turns[i] > turns[start]:
                out.append((value, start, i))
                while waiting and waiting[-1] >= start:
                    at[waiting.pop()] = value
        if lcp < least:
            waiting.clear()
        elif not stack or stack[-1][0] < lcp:
            if start == i and not stack:
                waiting = [i]
            stack.append((lcp, start))
    length, begin, end = np.array(out, np.int64).reshape(-1, 3).T
    return Intervals(length, begin, end, at)


def covered(words: Words, found: Repeats, longest: np.ndarray, least: int) -> np.ndarray:
    """Words of each document in the union of the spans of repeats of at least ``least`` words; ``longest`` starts at each suffix."""
    n = len(words.ids)
    take = longest >= least
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found.order[take], 1)
    np.add.at(edge, found.order[take] + longest[take], -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edge[:n]) > 0)])
    return inside[words.first[1:]] - inside[words.first[:-1]]


@dataclass
class Verdict:
    count: np.ndarray
    windows: np.ndarray
    spans: np.ndarray
    longest: np.ndarray
    repeats: np.ndarray
    failed: np.ndarray
    kept: np.ndarray


def judge(words: Words, limits: Limits) -> Verdict:
    """The base rule and the method's, from one suffix array."""
    found = suffixes(words)
    count = np.diff(words.first)
    every = maximal_repeats(words, found, min(WINDOW, limits.min_repeat))
    windows = covered(words, found, every.at, WINDOW)
    spans = covered(words, found, every.at, limits.min_repeat)
    long = every.length >= limits.min_repeat
    document = np.searchsorted(words.first, found.order[every.first[long]], "right") - 1
    longest = np.zeros(len(count), np.int64)
    np.maximum.at(longest, document, every.length[long])
    failed = (count < limits.min_words) | (100 * windows > limits.max_window_percent * count)
    good = (spans <= limits.max_covered * count) & (longest <= limits.max_longest)
    return Verdict(count, windows, spans, longest, np.bincount(document, minlength=len(count)), failed, ~failed & good)


def report(texts: pa.Array, limits: Limits) -> dict[str, np.ndarray]:
    words = split(texts, WHITE)
    found = judge(words, limits)
    data, at = words.data, words.text
    # A code point is its first byte.
    points = np.concatenate([[0], np.cumsum(~WHITE[data] & ((data & 0xC0) != 0x80))])
    symbols = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))])
    lines = []
    for text in texts.to_pylist():
        kept = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
        lines.append(len(kept) - len(set(kept)))
    return {
        "n_words": found.count,
        "word_chars": points[at[1:]] - points[at[:-1]],
        "n_symbols": symbols[at[1:]] - symbols[at[:-1]],
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": found.windows,
        "base_failed": found.failed,
        "kept": found.kept,
        "n_covered_words": found.spans,
        "longest_repeat": found.longest,
        "n_maximal_repeats": found.repeats,
    }


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_covered_words long, longest_repeat long, n_maximal_repeats long"
)


def repetition_report(docs: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its counts and the verdict. No shuffle."""

    def rows(batch):
        keys = batch.column(batch.schema.get_field_index(key))
        for at, texts in chunks(column(batch, text), CHUNK):
            found = report(texts, limits)
            yield pa.RecordBatch.from_arrays([keys.slice(at, len(texts)), *map(pa.array, found.values())], [key, *found])

    picked = docs.select(key, text)
    return map_arrow(picked, rows, f"{key} {picked.schema[key].dataType.simpleString()}, {SCHEMA}")


def filter_rows(docs: DataFrame, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""

    def rows(batch):
        for at, texts in chunks(column(batch, text), CHUNK):
            yield batch.slice(at, len(texts)).filter(pa.array(judge(split(texts, WHITE), limits).kept))

    return map_arrow(docs, rows, docs.schema)
