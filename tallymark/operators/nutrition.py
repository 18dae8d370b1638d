"""Nutrition facts in label text, and what they mean for different audiences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.rounding import round_even

# Patterns per nutrient in order, units, and the range a value may have.
NUTRIENTS = {
    "energy": ("kcal", [r"(?:energy|calories)\s*[:\-]?\s*(\d{2,4}(?:\.\d{1,2})?)\s*(?:kcal|cal|kj)?", r"(\d{2,4})\s*(?:kcal)\b"]),
    "protein": ("g", [r"protein\s*[:\-]?\s*(\d{1,3}(?:\.\d{1,2})?)\s*g?", r"(\d{1,2}(?:\.\d{1,2})?)\s*g?\s*protein"]),
    "carbohydrate": ("g", [r"(?:carbohydrate|carbs|total\s+carbohydrate)\s*[:\-]?\s*(\d{1,3}(?:\.\d{1,2})?)\s*g?"]),
    "sugars": ("g", [r"(?:total\s+sugars?|sugars?)\s*[:\-]?\s*(\d{1,3}(?:\.\d{1,2})?)\s*g?"]),
    "added_sugars": ("g", [r"added\s+sugars?\s*[:\-]?\s*(\d{1,3}(?:\.\d{1,2})?)\s*g?"]),
    "fat": ("g", [r"(?:total\s+fat|fat)\s*[:\-]?\s*(\d{1,3}(?:\.\d{1,2})?)\s*g?"]),
    "saturated_fat": ("g", [r"(?:saturated\s+fat(?:ty\s+acids)?|sat\s+fat)\s*[:\-]?\s*(\d{1,3}(?:\.\d{1,2})?)\s*g?"]),
    "trans_fat": ("g", [r"(?:trans\s+fat(?:ty\s+acids)?)\s*[:\-]?\s*(\d{1,2}(?:\.\d{1,2})?)\s*g?"]),
    "sodium": ("mg", [r"sodium\s*[:\-]?\s*(\d{1,4}(?:\.\d{1,2})?)\s*mg?", r"salt\s*[:\-]?\s*(\d{1,3}(?:\.\d{1,2})?)\s*g?"]),
    "fiber": ("g", [r"(?:dietary\s+fiber|fiber|fibre)\s*[:\-]?\s*(\d{1,2}(?:\.\d{1,2})?)\s*g?"]),
}
HIGHEST_VALUE = 2000.0
SERVING_SHARE = 0.25
KEY_NUTRIENTS = ["energy", "protein", "carbohydrate", "sugars", "fat"]
INGREDIENTS = r"(?i)(?:ingredients|contains)\s*[:\-]?\s*([^\.\n]{15,})"
SERVING = r"(?i)serving\s+size\s*[:\-]?\s*(\d{1,3}(?:\.\d{1,2})?\s*(?:g|ml|pcs|pieces?|biscuits?))"
DEFAULT_SERVING = "25 g (approx.)"

# Thresholds per 100 g.
SUGAR_HIGH, SUGAR_TREAT, SODIUM_HIGH, PROTEIN_RICH = 20.0, 25.0, 600.0, 10.0


def nutrient_value(text: Column, patterns: list[str]) -> Column:
    def value(pattern: str) -> Column:
        number = F.nullif(F.regexp_extract(text, "(?i)" + pattern, 1), F.lit("")).cast("double")
        return F.when(number.between(0.0, HIGHEST_VALUE), number)

    return F.coalesce(*[value(p) for p in patterns])


def with_nutrients(labels: DataFrame, text: str) -> DataFrame:
    """Adds one ``n_<nutrient>`` per nutrient, ingredients and serving size."""
    source = F.coalesce(F.col(text), F.lit(""))
    return labels.withColumns(
        {
            **{f"n_{name}": nutrient_value(source, patterns) for name, (_, patterns) in NUTRIENTS.items()},
            "ingredients": F.trim(F.nullif(F.regexp_extract(source, INGREDIENTS, 1), F.lit(""))),
            "serving_size": F.coalesce(F.nullif(F.regexp_extract(source, SERVING, 1), F.lit("")), F.lit(DEFAULT_SERVING)),
        }
    ).withColumn("available", F.coalesce(*[F.col(f"n_{n}") for n in KEY_NUTRIENTS]).isNotNull())


def nutrient_rows(found: DataFrame, key: str = "product_id") -> DataFrame:
    """Long form with per-serving amounts; nutrients without a value are left out."""
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("nutrient"), F.lit(unit).alias("unit"), F.col(f"n_{name}").alias("per_100g"))
            for name, (unit, _) in NUTRIENTS.items()
        ]
    )
    return (
        found.select(key, F.inline_outer(rows))
        .where(F.col("per_100g").isNotNull())
        .withColumn("per_serving", round_even(F.col("per_100g") * SERVING_SHARE, 1))
    )


def coverage(found: DataFrame) -> DataFrame:
    """How many labels state each nutrient."""
    return nutrient_rows(found).groupBy("nutrient").agg(
        F.count(F.lit(1)).alias("labels"), F.round(F.avg("per_100g"), 4).alias("mean_per_100g")
    )


def audience_profiles(found: DataFrame, key: str = "product_id") -> DataFrame:
    """Suitability per audience. Audiences judged by a nutrient the label omits may be absent."""
    sugar, sodium, protein = F.col("n_sugars"), F.col("n_sodium"), F.col("n_protein")

    def profile(audience: str, suitability: Column) -> Column:
        return F.struct(F.lit(audience).alias("audience"), suitability.alias("suitability"))

    rows = F.array(
        profile("General Consumers", F.lit("SUITABLE")),
        profile(
            "Sugar-Conscious Consumers",
            F.when(sugar.isNull(), "INFORMATIONAL").when(sugar > SUGAR_HIGH, "MODERATION ADVISED").otherwise("SUITABLE"),
        ),
        F.when(
            sodium.isNotNull(),
            profile("Sodium-Conscious Consumers", F.when(sodium > SODIUM_HIGH, "MODERATION ADVISED").otherwise("SUITABLE")),
        ),
        F.when(
            protein.isNotNull(),
            profile(
                "Athletes & Active Individuals",
                F.when(protein >= PROTEIN_RICH, "SUITABLE (HIGH PROTEIN)").otherwise("INFORMATIONAL"),
            ),
        ),
        profile(
            "Children & Youth", F.when(F.coalesce(sugar > SUGAR_TREAT, F.lit(False)), "OCCASIONAL TREAT").otherwise("SUITABLE")
        ),
        profile("Elderly Consumers", F.lit("SUITABLE")),
    )
    return found.select(key, F.inline_outer(F.array_compact(rows)))
