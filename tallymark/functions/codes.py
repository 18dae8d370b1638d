"""Product codes and batch codes in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.rules.lexicon import BATCH_PATTERNS, BATCH_STOPWORDS, CODE_LENGTHS, GS1_CODE


def gtin(text: Column, code_format: Column) -> Column:
    """Code by the length its format demands, else a GS1 element or link, else a plain number."""
    clean = F.trim(text)
    kind = F.regexp_replace(F.upper(code_format), "[^A-Z0-9]", "")
    fixed = F.lit(None)
    for name, length in CODE_LENGTHS.items():
        fixed = F.when((kind == name) & F.rlike(clean, F.lit(rf"^\d{{{length}}}$")), clean).otherwise(fixed)
    element = F.nullif(F.regexp_extract(clean, GS1_CODE, 1), F.lit(""))
    plain = F.when(F.rlike(clean, F.lit(r"^(?:\d{8}|\d{12,14})$")), clean)
    return F.coalesce(fixed, element, plain)


def batch_code(text: Column) -> Column:
    """First batch pattern whose match is a real code: long enough and no stop word."""

    def valid(pattern: str) -> Column:
        code = F.regexp_replace(F.regexp_extract(text, pattern, 1), r"^[.,:\-/]+|[.,:\-/]+$", "")
        return F.when((F.length(code) >= 2) & ~F.lower(code).isin(BATCH_STOPWORDS), code)

    return F.coalesce(*[valid(p) for p in BATCH_PATTERNS])
