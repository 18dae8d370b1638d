"""Shelf life, household consumption and the waste they imply together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.amounts import grams
from tallymark.functions.dates import label_date
from tallymark.functions.rounding import round_even

# Shelf-life fallbacks in days, status limits, and best-before wordings.
DAYS_PER_MONTH = 30.5
DEFAULT_SHELF_DAYS = 270
UNKNOWN_SHELF_DAYS = 180
VERY_SOON_DAYS, SOON_DAYS = 15, 45
BEST_BEFORE = r"(?i)best\s+before\s+(\d{1,2})\s+months?"
MONTHS_FROM = r"(?i)(\d{1,2})\s+months?\s+(?:from|of)\s+(?:mfg|pkd|packing|manufacture)"
YEAR = r"\b(2[0-9]{3})\b"

# Grams or millilitres one person uses per day; the first category contained wins.
DAILY_RATES = {
    "packaged foods": 25.0,
    "biscuits": 25.0,
    "cookies": 25.0,
    "beverages": 200.0,
    "dairy": 150.0,
    "staples": 100.0,
    "edible oil": 20.0,
    "tea": 5.0,
    "coffee": 4.0,
    "general": 30.0,
}
OTHER_RATE = 25.0

ADVICE = {
    "EXPIRED": "dispose safely, do not consume",
    "EXPIRING VERY SOON": "use at once, do not restock",
    "EXPIRING SOON": "plan use within weeks or donate",
    "SAFE": "store cool and dry",
}


def best_before_months(text: Column) -> Column:
    def months(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")

    return F.coalesce(months(BEST_BEFORE), months(MONTHS_FROM))


def analyze_expiry(products: DataFrame, as_of: Column) -> DataFrame:
    """Adds dates, days remaining, shelf-life share, status and advice.

    ``products`` has mfg_text, exp_text and description. Missing dates fall back, in order, to the
    stated months, nine months, the end of a printed year, and half a year from ``as_of``.
    """
    blank = F.lit("")
    made_text, until_text = F.coalesce("mfg_text", blank), F.coalesce("exp_text", blank)
    about = F.coalesce("description", blank)
    staged = products.withColumns(
        {
            "_made": label_date(made_text),
            "_until": label_date(until_text),
            "_months": F.coalesce(
                F.nullif(best_before_months(until_text), F.lit(0)),
                F.nullif(best_before_months(about), F.lit(0)),
                F.nullif(best_before_months(made_text), F.lit(0)),
            ),
            "_year": F.nullif(F.regexp_extract(F.concat_ws(" ", until_text, made_text), YEAR, 1), blank),
        }
    )
    stated = F.date_add("_made", F.floor(F.col("_months") * DAYS_PER_MONTH).cast("int"))
    until = F.coalesce(
        "_until",
        stated,
        F.date_add("_made", DEFAULT_SHELF_DAYS),
        F.to_date(F.concat("_year", F.lit("-12-31")), "yyyy-MM-dd"),
        F.date_add(as_of, UNKNOWN_SHELF_DAYS),
    )
    dated = staged.withColumn("expiry_date", until).withColumn(
        "manufacture_date", F.coalesce("_made", F.date_sub("expiry_date", UNKNOWN_SHELF_DAYS))
    )
    days = F.datediff("expiry_date", as_of)
    total = F.greatest(F.lit(1), F.datediff("expiry_date", "manufacture_date"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(100.0), round_even(days * 100.0 / total, 1)))
    status = (
        F.when(days < 0, "EXPIRED")
        .when(days <= VERY_SOON_DAYS, "EXPIRING VERY SOON")
        .when(days <= SOON_DAYS, "EXPIRING SOON")
        .otherwise("SAFE")
    )
    advice = F.lit(None)
    for name, text in ADVICE.items():
        advice = F.when(F.col("status") == name, text).otherwise(advice)
    return (
        dated.withColumns({"days_remaining": days, "shelf_life_percent": share, "status": status})
        .withColumns({"is_expired": F.col("days_remaining") < 0, "recommendation": advice})
        .drop("_made", "_until", "_months", "_year")
    )


def expiry_mix(analyzed: DataFrame) -> DataFrame:
    """Expiry status by category."""
    return analyzed.groupBy("category", "status").agg(F.count(F.lit(1)).alias("product_count"))


def expiring_first(analyzed: DataFrame, n: int = 50) -> DataFrame:
    return analyzed.orderBy("days_remaining", "product_id").limit(n)


def daily_rate(category: Column) -> Column:
    key = F.lower(F.trim(F.coalesce(F.nullif(category, F.lit("")), F.lit("general"))))
    expr = F.lit(OTHER_RATE)
    for name, rate in reversed(list(DAILY_RATES.items())):
        expr = F.when(F.contains(key, F.lit(name)), F.lit(rate)).otherwise(expr)
    return expr


def predict_consumption(products: DataFrame, as_of: Column) -> DataFrame:
    """Adds quantity, household rate, days it lasts, depletion date and the waste flag.

    ``products`` has category, quantity_text, household_size and expiry_date.
    """
    household = F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce("household_size", F.lit(2)).cast("int")))
    staged = products.withColumns(
        {
            "household": household,
            "net_quantity_g": grams(F.coalesce("quantity_text", F.lit(""))),
            "_rate": daily_rate(F.col("category")) * household,
        }
    )
    days = F.greatest(F.lit(1), round_even(F.col("net_quantity_g") / F.col("_rate"), 0).cast("int"))
    return (
        staged.withColumn("daily_rate_g", round_even(F.col("_rate"), 1))
        .withColumn("lasts_days", days)
        .withColumn("depletion_date", F.date_add(as_of, F.col("lasts_days")))
        .withColumn("waste_risk", F.coalesce(F.col("depletion_date") > F.col("expiry_date"), F.lit(False)))
        .withColumn("days_over", F.when(F.col("waste_risk"), F.datediff("depletion_date", "expiry_date")))
        .drop("_rate")
    )


def waste_share(predicted: DataFrame) -> DataFrame:
    """Share of products at risk of being wasted, by category."""
    risky, total = F.count_if("waste_risk"), F.count(F.lit(1))
    return predicted.groupBy("category").agg(
        total.alias("products"), risky.alias("at_risk"), round_even(risky * 100.0 / total, 1).alias("risk_percent")
    )
