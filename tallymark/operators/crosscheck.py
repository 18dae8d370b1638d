"""Web listing against pack: four declarations compared, and pack gaps filled from the listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.amounts import price, quantity_unit, quantity_value

# Tolerances, and words that say nothing about a maker's identity.
QUANTITY_SLACK, QUANTITY_SHARE, PRICE_SLACK = 1.0, 0.01, 0.5
MAKER_STOPWORDS = ["pvt", "ltd", "private", "limited", "the", "and", "foods", "industries"]
NOT_PRINTED = ["webpage_extracted", "not_found", ""]
FIELDS = ["net_quantity", "mrp", "country_of_origin", "manufacturer_name_address"]
ABSENT = ["not_found", "genai_fallback"]


def given(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def side_status(web: Column, pack: Column, both: Column) -> Column:
    return (
        F.when(web.isNotNull() & pack.isNotNull(), both)
        .when(pack.isNotNull(), "PACKAGING_ONLY")
        .when(web.isNotNull(), "ONLINE_ONLY")
    )


def compare_quantity(web: Column, pack: Column) -> Column:
    """Amounts within 1 g/ml or 1 % match; amounts in different known units never do."""
    a, b = quantity_value(web), quantity_value(pack)
    units = F.coalesce(quantity_unit(web) == quantity_unit(pack), F.lit(True))
    close = F.abs(a - b) <= F.greatest(F.lit(QUANTITY_SLACK), a * QUANTITY_SHARE)
    return F.when(a.isNull() | b.isNull(), "MATCH").when(units & close, "MATCH").otherwise("MISMATCH")


def compare_price(web: Column, pack: Column) -> Column:
    """A web price above the printed one is a warning; a discount is fine."""
    a, b = price(web), price(pack)
    over = (F.abs(a - b) >= PRICE_SLACK) & (a > b)
    return F.when(over, "WARNING").otherwise("MATCH")


def compare_origin(web: Column, pack: Column) -> Column:
    a, b = F.lower(F.trim(web)), F.lower(F.trim(pack))
    same = (a.contains("india") & b.contains("india")) | F.contains(b, a) | F.contains(a, b)
    return F.when(same, "MATCH").otherwise("MISMATCH")


def maker_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\w+)"), F.lit(1))
    return F.array_except(words, F.array(*[F.lit(w) for w in MAKER_STOPWORDS]))


def compare_maker(web: Column, pack: Column) -> Column:
    shared = F.size(F.array_intersect(maker_words(web), maker_words(pack))) > 0
    return F.when(shared, "MATCH").otherwise("WARNING")


def pack_side(fields: DataFrame) -> DataFrame:
    """One row per product with the printed value of each compared field; a web-sourced price is not printed."""
    method = F.coalesce("extraction_method", F.lit(""))
    printed = F.when((F.col("field_name") != "mrp") | ~method.isin(NOT_PRINTED), given(F.col("extracted_value")))
    rows = fields.where(F.col("field_name").isin(FIELDS)).select("product_id", "field_name", printed.alias("value"))
    return rows.groupBy("product_id").agg(
        *[F.max(F.when(F.col("field_name") == name, F.col("value"))).alias(f"pack_{name}") for name in FIELDS]
    )


def web_side(listings: DataFrame) -> DataFrame:
    return listings.select(
        "product_id",
        given(F.col("net_quantity")).alias("web_net_quantity"),
        F.coalesce(given(F.col("mrp")), given(F.col("selling_price"))).alias("web_mrp"),
        given(F.col("country_of_origin")).alias("web_country_of_origin"),
        given(F.col("manufacturer")).alias("web_manufacturer_name_address"),
    )


COMPARE = {
    "net_quantity": compare_quantity,
    "mrp": compare_price,
    "country_of_origin": compare_origin,
    "manufacturer_name_address": compare_maker,
}


def with_comparison(joined: DataFrame) -> DataFrame:
    """Adds ``cv_<field>`` to rows that carry ``web_<field>`` and ``pack_<field>``."""
    return joined.withColumns(
        {
            f"cv_{name}": side_status(F.col(f"web_{name}"), F.col(f"pack_{name}"), compare(F.col(f"web_{name}"), F.col(f"pack_{name}")))
            for name, compare in COMPARE.items()
        }
    )


def cross_validate(listings: DataFrame, fields: DataFrame) -> DataFrame:
    """Long result per product and field. Both sides are one row per product before the full join."""
    wide = with_comparison(web_side(listings).join(pack_side(fields), "product_id", "full"))
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("field_name"),
                F.col(f"web_{name}").alias("ecommerce_value"),
                F.col(f"pack_{name}").alias("packaging_value"),
                F.col(f"cv_{name}").alias("status"),
            )
            for name in FIELDS
        ]
    )
    return (
        wide.select("product_id", F.inline_outer(rows))
        .where(F.col("status").isNotNull())
        .withColumn("matches", F.col("status") == "MATCH")
    )


def fill_from_listing(fields: DataFrame, specs: DataFrame) -> DataFrame:
    """Pack fields that are missing or only guessed take the listing's value; new fields are added."""
    offered = specs.where(F.trim("spec_value") != "").select("scan_id", "field_name", F.trim("spec_value").alias("_spec"))
    joined = fields.join(offered, ["scan_id", "field_name"], "full")
    weak = (F.trim(F.coalesce("extracted_value", F.lit(""))) == "") | F.coalesce("extraction_method", F.lit("not_found")).isin(ABSENT)
    take = weak & F.col("_spec").isNotNull()
    return joined.select(
        "scan_id",
        "field_name",
        F.when(take, F.col("_spec")).otherwise(F.col("extracted_value")).alias("extracted_value"),
        F.when(take, "ecommerce_html_spec").otherwise(F.col("extraction_method")).alias("extraction_method"),
        F.when(take, F.lit(0.98)).otherwise(F.col("confidence")).alias("confidence"),
    )
