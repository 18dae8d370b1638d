"""Dates printed on labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as printed.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5,
    "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9,
    "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}

# The date shapes looked for.
DAY_FIRST = r"\b(\d{1,2})[/\.-](\d{1,2})[/\.-](\d{4})\b"
YEAR_FIRST = r"\b(\d{4})[/\.-](\d{1,2})[/\.-](\d{1,2})\b"
MONTH_YEAR = r"\b(0[1-9]|1[0-2])[/\.-](\d{4})\b"
NAMED_MONTH = r"(?:(\d{1,2})\s+)?([a-z]{3,9})\s+(\d{4})"
MONTH_NAME = (
    r"(?:JAN(?:UARY)?|FEB(?:RUARY)?|MAR(?:CH)?|APR(?:IL)?|MAY|JUN(?:E)?|JUL(?:Y)?|AUG(?:UST)?"
    r"|SEP(?:TEMBER)?|OCT(?:OBER)?|NOV(?:EMBER)?|DEC(?:EMBER)?)"
)
FULL = r"\b(\d{1,2})[/\-\.](\d{1,2})[/\-\.](\d{2,4})\b"
NAMED = rf"\b(?:(\d{{1,2}})\s+)?({MONTH_NAME})\.?(?:\s+|/|\-|\.\s*)(\d{{2,4}})\b"
SHORT = r"\b(\d{1,2})[/\-\.]((?:20)?\d{2})\b"
ANY_DATE = f"{FULL}|{NAMED}|{SHORT}"


def date_of(year: Column, month: Column, day: Column) -> Column:
    """A date from text parts; null for anything that is not a calendar day."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def month_number(name: Column) -> Column:
    expr = F.lit(None)
    for text, number in MONTHS.items():
        expr = F.when(name == text, F.lit(str(number))).otherwise(expr)
    return expr


def label_date(text: Column) -> Column:
    """One date from free text. The first shape that gives a real day wins.

    Month and year alone mean the 28th; a named month caps the day at 28.
    """
    low = F.lower(F.trim(text))

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(low, pattern, group)

    day = F.coalesce(F.nullif(part(NAMED_MONTH, 1), F.lit("")), F.lit("28"))
    capped = F.when(day.cast("int") > 28, F.lit("28")).otherwise(day)
    return F.coalesce(
        date_of(part(DAY_FIRST, 3), part(DAY_FIRST, 2), part(DAY_FIRST, 1)),
        date_of(part(YEAR_FIRST, 1), part(YEAR_FIRST, 2), part(YEAR_FIRST, 3)),
        F.when(part(MONTH_YEAR, 1) != "", date_of(part(MONTH_YEAR, 2), part(MONTH_YEAR, 1), F.lit("28"))),
        date_of(part(NAMED_MONTH, 3), month_number(part(NAMED_MONTH, 2)), capped),
    )


def full_year(year: Column) -> Column:
    """Years below 100 belong to this century."""
    number = year.cast("int")
    return F.when(number < 100, number + 2000).otherwise(number).cast("string")


def all_dates(text: Column) -> Column:
    """Every date found in the text, in reading order."""
    pieces = F.regexp_extract_all(F.upper(text), F.lit(ANY_DATE), F.lit(0))

    def parse(piece: Column) -> Column:
        def part(pattern: str, group: int) -> Column:
            return F.nullif(F.regexp_extract(piece, pattern, group), F.lit(""))

        month = month_number(F.lower(F.left(part(NAMED, 2), F.lit(3))))
        return (
            F.when(part(FULL, 1).isNotNull(), date_of(full_year(part(FULL, 3)), part(FULL, 2), part(FULL, 1)))
            .when(
                part(NAMED, 2).isNotNull(),
                date_of(full_year(part(NAMED, 3)), month, F.coalesce(part(NAMED, 1), F.lit("1"))),
            )
            .otherwise(date_of(full_year(part(SHORT, 2)), part(SHORT, 1), F.lit("1")))
        )

    return F.filter(F.transform(pieces, parse), lambda d: d.isNotNull())


def date_declaration(text: Column, as_of: Column) -> Column:
    """Struct of mfg_date, use_by_date, is_expired and status for a date declaration.

    Two or more dates: earliest is manufacture, latest is use-by. A single one is decided by the
    words around it.
    """
    found = all_dates(text)
    many, one = F.size(found) >= 2, F.size(found) == 1
    upper = F.upper(text)
    expiry_words = upper.contains("USE BY") | upper.contains("EXP") | upper.contains("BEST BEFORE")
    made = F.when(many | (one & ~expiry_words), F.array_min(found))
    until = F.when(many | (one & expiry_words), F.array_max(found))
    expired = F.coalesce(until < as_of, F.lit(False))
    blank = F.coalesce(text, F.lit("")) == ""
    return F.struct(
        F.when(~blank, made).alias("mfg_date"),
        F.when(~blank, until).alias("use_by_date"),
        (~blank & expired).alias("is_expired"),
        F.when(blank, "VALID")
        .when(expired, "EXPIRED")
        .when(F.size(found) == 0, "NO_VALID_DATE")
        .otherwise("VALID")
        .alias("status"),
    )
