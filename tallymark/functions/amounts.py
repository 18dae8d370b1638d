"""Quantities and prices in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quantity and price shapes.
QUANTITY = r"(?i)(\d+(?:\.\d+)?)\s*(grams?|gms?|g|kg|kilograms?|ml|millilitres?|ltr?|litres?|l|pcs|pieces?|units?|count)\b"
NUMBER = r"\b(\d+(?:\.\d+)?)\b"
LARGE_UNIT = r"(?i)(\d+(?:\.\d+)?)\s*(kg|l|litre|liter)"
SMALL_UNIT = r"(?i)(\d+(?:\.\d+)?)\s*(g|gm|gram|ml)"
ANY_NUMBER = r"(\d+(?:\.\d+)?)"
PRICE = r"(?:₹|Rs\.?|INR)?\s*(\d+(?:\.\d{1,2})?)"
MARKED_PRICE = r"(?i)(?:MRP|₹|Rs\.?|INR)[\s:\.]*(\d+(?:[\.,]\d{1,2})?)"
DECIMAL_PRICE = r"\b(\d+\.\d{2})\b"
GRAM_UNITS = ["g", "gm", "gms", "gram", "grams"]
KILO_UNITS = ["kg", "kilogram", "kilograms"]
ML_UNITS = ["ml", "millilitre", "millilitres"]
LITRE_UNITS = ["l", "lt", "ltr", "litre", "litres"]
DEFAULT_GRAMS = 100.0


def number_in(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("double")


def quantity_value(text: Column) -> Column:
    """Amount in g, ml or pieces; a bare number stands for itself."""
    unit = F.lower(F.regexp_extract(text, QUANTITY, 2))
    scale = F.when(unit.isin(KILO_UNITS + LITRE_UNITS), F.lit(1000.0)).otherwise(F.lit(1.0))
    return F.coalesce(number_in(text, QUANTITY) * scale, number_in(text, NUMBER))


def quantity_unit(text: Column) -> Column:
    unit = F.lower(F.regexp_extract(text, QUANTITY, 2))
    return (
        F.when(unit.isin(GRAM_UNITS + KILO_UNITS), "g")
        .when(unit.isin(ML_UNITS + LITRE_UNITS), "ml")
        .otherwise(F.nullif(unit, F.lit("")))
    )


def grams(text: Column) -> Column:
    """Amount in grams or millilitres with a default, for consumption estimates."""
    return F.coalesce(
        number_in(text, LARGE_UNIT) * 1000.0,
        number_in(text, SMALL_UNIT),
        number_in(text, ANY_NUMBER),
        F.lit(DEFAULT_GRAMS),
    )


def price(text: Column) -> Column:
    """First price in the text, thousands separators ignored."""
    return number_in(F.replace(text, F.lit(","), F.lit("")), PRICE)


def positive_price(text: Column) -> Column:
    """First price in the text when it is above zero."""
    found = price(text)
    return F.when(found > 0, found)


def listing_price(text: Column) -> Column:
    """Price of a listing text: after a currency mark, then any two-decimal number, then a short text's number."""
    clean = F.trim(text)
    marked = F.nullif(F.replace(F.regexp_extract(clean, MARKED_PRICE, 1), F.lit(","), F.lit("")), F.lit(""))
    short = F.when(F.length(clean) <= 15, number_in(F.replace(clean, F.lit(","), F.lit("")), r"(\d+(?:\.\d{1,2})?)"))
    return F.when(
        clean != "", F.coalesce(marked.try_cast("double"), number_in(clean, DECIMAL_PRICE), short)
    )
