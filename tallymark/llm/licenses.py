"""Licence scan by a positional index of rare template words.

The templates' words are posted with their positions, and weighted by their inverse document frequency over the
whole corpus. All licence words of a document are looked up; every posting votes with its word's weight for a
template and a relative position (place in the text less place in the template), so an alignment's votes are the
weight of all template words that stand where they should, and their share is its score. A label needs
``MIN_SCORE`` and the template's mandatory key phrases. Places of three fixed phrases are always reported as base labels.

Cases: a null or empty text has no words, no labels and score 0; rows with the same id are scanned each by
itself; equal scores of two alignments take the earlier one; an empty table gives an empty result; only key and
text are read. A document is scanned in the task that reads it; what is collected is one number per template
word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.words import LOWER, NOT_ALNUM, Words, chunks, column, map_arrow, split

# Phrases of the base labels, and notices with the phrases that must stand in a text.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("apache", "Licensed under the Apache License, Version 2.0", ["apache license", "version 2"]),
    ("gpl", "licensed under the GNU General Public License, version 3", ["gnu general public license"]),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation", ["gnu general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ["source and binary forms"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", ["mozilla public license"]),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee"]),
]
MIN_SCORE = 0.6


def normal(text: str) -> list[bytes]:
    return [bytes(w) for w in bytes(b if not NOT_ALNUM[b] else 32 for b in LOWER[np.frombuffer(text.encode(), np.uint8)].tolist()).split()]


PATTERNS = [(label, normal(text), [normal(p) for p in phrases]) for label, text, phrases in TEMPLATES]
TERMS = sorted({w for _, words, _ in PATTERNS for w in words})


def term_ids(words: Words) -> np.ndarray:
    """Of each word, its place in ``TERMS``, or -1."""
    known = {t: i for i, t in enumerate(TERMS)}
    return np.array([known.get(w, -1) for w in words.names.to_pylist()], np.int64)[words.ids] if len(words.names) else np.zeros(0, np.int64)


def term_weights(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Inverse document frequency of every template word over all documents; the last entry counts documents."""

    def count(batch):
        for _, texts in chunks(column(batch, text)):
            words = split(texts, NOT_ALNUM, lower=True)
            terms = term_ids(words)
            document = np.repeat(np.arange(len(texts)), np.diff(words.first))
            some = terms >= 0
            held = np.bincount(np.unique(document[some] * len(TERMS) + terms[some]) % len(TERMS), minlength=len(TERMS) + 1)
            held[-1] = len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held), dtype=np.int32)), pa.array(held)], ["term", "n"])

    counted = map_arrow(docs.select(text), count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    frequency = np.zeros(len(TERMS) + 1)
    for term, n in counted.collect():  # one row per template word
        frequency[term] = n
    return np.log((frequency[-1] + 1) / (frequency[:-1] + 1)) + 1e-9


def has_phrase(words: list[bytes], phrase: list[bytes]) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


def scan(terms: np.ndarray, weights: np.ndarray, words) -> tuple[set[str], float]:
    """Labels and best score of one document, from the term of each word (-1: none); ``words(a, b)`` gives the words of a span."""
    at = np.flatnonzero(terms >= 0)
    places = {t: at[terms[at] == t] for t in set(terms[at].tolist())}
    known = {t: i for i, t in enumerate(TERMS)}
    labels, best = set(), 0.0
    for label, template, phrases in PATTERNS:
        total = sum(weights[known[w]] for w in template)
        # By relative position, which starts at 1 - len(template).
        votes = np.zeros(len(terms) + len(template))
        for q, w in enumerate(template):
            if known[w] in places:
                votes[places[known[w]] - q + len(template) - 1] += weights[known[w]]
        scores = np.minimum(1.0, votes / total)
        found = np.flatnonzero(scores >= MIN_SCORE)
        for i in found[np.argsort(-scores[found], kind="stable")].tolist():
            if label in labels and scores[i] <= best:
                break
            shift = i - len(template) + 1
            if all(has_phrase(words(max(0, shift - 5), shift + len(template) + 5), p) for p in phrases):
                labels.add(label)
                best = max(best, float(scores[i]))
    return labels, best


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: word count, base places and labels, all labels, score."""
    weights = term_weights(docs, text)
    place_of = {t: i for i, t in enumerate(TERMS)}
    # No label without its key phrases, so only documents with the rarest word of some template's phrases are aligned.
    rarest = np.zeros(len(TERMS) + 1, bool)
    for _, _, needed in PATTERNS:
        rarest[max({place_of[w] for p in needed for w in p}, key=lambda t: (weights[t], t))] = True
    phrases = [(normal(p), label) for p, label in BASE.items()]

    def rows(batch):
        keys = batch.column(batch.schema.get_field_index(key))
        for at, texts in chunks(column(batch, text)):
            words = split(texts, NOT_ALNUM, lower=True)
            n, count = len(texts), np.diff(words.first)
            document = np.repeat(np.arange(n), count)
            names = words.names.to_pylist()
            place = {w: i for i, w in enumerate(names)}
            base: list[dict[str, list[int]]] = [{} for _ in range(n)]
            for phrase, label in phrases:
                if not all(w in place for w in phrase):
                    continue
                hit = np.ones(max(0, len(words.ids) - len(phrase) + 1), bool)
                for k, w in enumerate(phrase):
                    hit &= words.ids[k : len(hit) + k] == place[w]
                for p in np.flatnonzero(hit).tolist():
                    if document[p] == document[p + len(phrase) - 1]:
                        base[document[p]].setdefault(label, []).append(p - int(words.first[document[p]]))
            labels = [set(b) for b in base]
            score = np.zeros(n)
            terms = term_ids(words)
            strong = rarest[terms]
            for d in np.unique(document[strong]).tolist():
                a, b = int(words.first[d]), int(words.first[d + 1])
                more, score[d] = scan(terms[a:b], weights, lambda x, y, a=a, b=b: [names[i] for i in words.ids[a + x : min(a + y, b)]])
                labels[d] |= more
            spots = [sorted(p for ps in b.values() for p in ps) for b in base]
            out = [
                keys.slice(at, n),
                pa.array(count),
                pa.array([len(s) for s in spots], pa.int64()),
                pa.array([s[0] if s else None for s in spots], pa.int64()),
                pa.array([s[-1] if s else None for s in spots], pa.int64()),
                pa.array([",".join(sorted(b)) for b in base]),
                pa.array([",".join(sorted(x)) for x in labels]),
                pa.array(score),
            ]
            yield pa.RecordBatch.from_arrays(out, [key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    picked = docs.select(key, text)
    return map_arrow(picked, rows, f"{key} {picked.schema[key].dataType.simpleString()}, {SCHEMA}")
