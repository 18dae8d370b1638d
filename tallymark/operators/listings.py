"""Listing rules: ten declarations judged per web listing, with a verdict and confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.amounts import listing_price, number_in, positive_price
from tallymark.functions.dates import date_declaration
from tallymark.functions.rounding import round_even
from tallymark.operators.crosscheck import given

# Shapes that count as a unit, a date, a shelf life or a contact; address words.
METRIC_UNIT = r"(?i)\b(?:g|gm|gms|grams?|kg|kilograms?|ml|millilitres?|l|ltr|litres?|pcs|pieces?|units?|count)\b"
MONTH = (
    r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?"
    r"|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
DATE_SHAPE = (
    r"(?i)\b(?:\d{1,2}[/-]\d{1,2}[/-](?:20\d{2}|\d{2})|\d{1,2}[/-](?:20\d{2}|\d{2})"
    rf"|(?:(?:\d{{1,2}}\s+)?{MONTH}\.?(?:[\s\-/]+|\.\s*)(?:20\d{{2}}|\d{{2}}))|(?:(?:20\d{{2}}|\d{{2}})[\s\-/]+{MONTH}))\b"
)
SHELF_LIFE = r"(?i)[\s:\-]*\d+\s*(?:months?|days?|years?)\b"
CONTACT = (
    r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}|\b(?:\+?91[\-\s]?)?[6-9]\d{9}\b|1800[\-\s]?\d{3}[\-\s]?\d{3,4})"
)
ADDRESS_TERMS = ["plot", "road", "street", "lane", "marg", "industrial", "area", "dist", "nagar", "pin"]
STAMPED = "stamped on physical"
PLACEHOLDER_NAME = "Packaged Commodity Product"
LONG_ADDRESS = 25
PACK_FIELDS = ["net_quantity", "mrp", "manufacturer_name_address", "country_of_origin", "manufacture_date", "consumer_care_details"]

# Share of each part in the compliance confidence.
OCR_SHARE, EXTRACTION_SHARE, UNSEEN_FACTOR = 0.35, 0.65, 0.88

# Unit prices, the range a derived price may have, the usual discount, the absurd price.
UNIT_PRICE = r"(?i)(?:₹|Rs\.?)\s*(\d+(?:\.\d{1,2})?)\s*/\s*100\s*g"
GRAMS_ONLY = r"(?i)(\d+(?:\.\d+)?)\s*(?:g|grams?)\b"
UNIT_PRICE_RANGE = (5.0, 500.0)
UNDISCOUNTED = 0.93
ABSURD_PRICE = 150.0


def printed_fields(fields: DataFrame) -> DataFrame:
    """One row per product with ``p_<field>``, the printed value unless it was not found."""
    value = F.when(F.coalesce("extraction_method", F.lit("")) != "not_found", given(F.col("extracted_value")))
    rows = fields.where(F.col("field_name").isin(PACK_FIELDS)).select("product_id", "field_name", value.alias("v"))
    return rows.groupBy("product_id").agg(
        *[F.max(F.when(F.col("field_name") == n, F.col("v"))).alias(f"p_{n}") for n in PACK_FIELDS]
    )


def _check(rule: str, field: str, status: Column, source: Column, severity: Column, violation: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule_id"),
        F.lit(field).alias("field_name"),
        status.alias("status"),
        source.alias("source"),
        severity.alias("severity"),
        violation.alias("violation_type"),
    )


def origin_side(web: Column, pack: Column) -> Column:
    """Which side a value came from."""
    return (
        F.when(web.isNotNull() & pack.isNotNull(), "Both")
        .when(pack.isNotNull(), "Packaging OCR")
        .when(web.isNotNull(), "Webpage")
        .otherwise("None")
    )


def evaluate_listings(joined: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``checks``. Rows carry listing columns, ``p_<field>``, cv_net_quantity and geo_country.

    Every rule is an expression over one row: no join and no shuffle beyond bringing the sides together.
    """
    none, fail, ok, warn = F.lit(None).cast("string"), F.lit("FAIL"), F.lit("PASS"), F.lit("WARNING")

    def web(name: str) -> Column:
        return given(F.col(name)) if name in joined.columns else none

    def pack(name: str) -> Column:
        return F.col(f"p_{name}")

    def simple(rule: str, field: str, passed: Column, source: Column) -> Column:
        """Present passes; absent fails as a missing declaration of high severity."""
        return _check(
            rule,
            field,
            F.when(passed, ok).otherwise(fail),
            source,
            F.when(passed, "none").otherwise("high"),
            F.when(~passed, "missing"),
        )

    name = web("product_name")
    named = F.coalesce(name != PLACEHOLDER_NAME, F.lit(False))
    rules = [simple("rule_product_name", "product_name", named, F.when(named, "Webpage").otherwise("None"))]

    web_qty, pack_qty = web("net_quantity"), pack("net_quantity")
    qty = F.coalesce(pack_qty, web_qty)
    clash = F.coalesce(F.col("cv_net_quantity") == "MISMATCH", F.lit(False))
    metric = F.rlike(qty, F.lit(METRIC_UNIT))
    rules.append(
        _check(
            "rule_net_quantity",
            "net_quantity",
            F.when(clash | qty.isNull(), fail).when(metric, ok).otherwise(warn),
            F.when(clash, "Both").otherwise(origin_side(web_qty, pack_qty)),
            F.when(clash, "critical").when(qty.isNull(), "high").when(metric, "none").otherwise("medium"),
            F.when(clash, "quantity_mismatch").when(qty.isNull(), "missing"),
        )
    )

    web_mrp, selling, pack_mrp = web("mrp"), web("selling_price"), pack("mrp")
    sold, printed = F.nullif(listing_price(selling), F.lit(0.0)), F.nullif(listing_price(pack_mrp), F.lit(0.0))
    over = F.coalesce(sold > printed, F.lit(False))
    declared = web_mrp.isNotNull() | pack_mrp.isNotNull()
    rules.append(
        _check(
            "rule_mrp",
            "mrp",
            F.when(over, fail).when(declared, ok).when(selling.isNotNull(), warn).otherwise(fail),
            F.when(over, "Both").when(declared, origin_side(web_mrp, pack_mrp)).otherwise(origin_side(selling, none)),
            F.when(over, "critical").when(declared, "none").when(selling.isNotNull(), "medium").otherwise("high"),
            F.when(over, "overpricing").when(~declared & selling.isNull(), "missing"),
        )
    )

    web_maker, pack_maker, web_address = web("manufacturer"), pack("manufacturer_name_address"), web("manufacturer_address")
    maker = F.coalesce(pack_maker, web_maker)
    rules.append(
        simple("rule_manufacturer", "manufacturer_name_address", maker.isNotNull(), origin_side(web_maker, pack_maker))
    )
    wordy = (F.length(web_maker) > LONG_ADDRESS) & F.rlike(F.lower(web_maker), F.lit("|".join(ADDRESS_TERMS)))
    address = F.coalesce(
        web_address, F.when(F.length(pack_maker) > LONG_ADDRESS, pack_maker), F.when(wordy, web_maker)
    )
    rules.append(
        simple(
            "rule_manufacturer_address",
            "manufacturer_address",
            address.isNotNull() | maker.isNotNull(),
            F.when(web_address.isNotNull(), "Webpage")
            .when(address.isNotNull() | pack_maker.isNotNull(), "Packaging OCR")
            .when(maker.isNotNull(), "Webpage")
            .otherwise("None"),
        )
    )

    packed = web("packer").isNotNull()
    rules.append(
        _check(
            "rule_packer", "packer", F.when(packed, ok).otherwise("NOT_APPLICABLE"), F.lit("Webpage"), F.lit("none"), none
        )
    )

    origin_word = F.lower(F.coalesce(web("country_of_origin"), web("geo_country"), F.lit("")))
    imported = (origin_word != "") & ~origin_word.contains("india")
    importer = web("importer").isNotNull()
    rules.append(
        _check(
            "rule_importer",
            "importer",
            F.when(~imported, "NOT_APPLICABLE").when(importer, ok).otherwise(fail),
            F.when(imported & ~importer, "None").otherwise("Webpage"),
            F.when(imported & ~importer, "high").otherwise("none"),
            F.when(imported & ~importer, "missing_importer"),
        )
    )

    web_origin, pack_origin = web("country_of_origin"), pack("country_of_origin")
    rules.append(
        simple(
            "rule_country_of_origin",
            "country_of_origin",
            F.coalesce(web_origin, pack_origin, web("geo_country")).isNotNull(),
            F.when(web_origin.isNotNull(), "Webpage")
            .when(pack_origin.isNotNull(), "Packaging OCR")
            .when(web("geo_country").isNotNull(), "Geo-Intelligence")
            .otherwise("None"),
        )
    )

    pack_date = pack("manufacture_date")
    stated = F.coalesce(pack_date, web("manufacture_date"), web("packing_date"), web("best_before"))
    date_text = F.when(~F.lower(stated).contains(STAMPED), stated)
    parsed = F.col("_date")
    shaped = (
        parsed.mfg_date.isNotNull()
        | parsed.use_by_date.isNotNull()
        | F.rlike(date_text, F.lit(DATE_SHAPE))
        | F.rlike(date_text, F.lit(SHELF_LIFE))
    )
    expired = date_text.isNotNull() & parsed.is_expired
    irregular = date_text.isNotNull() & ~shaped
    rules.append(
        _check(
            "rule_date_declaration",
            "manufacture_date",
            F.when(expired, fail).when(irregular, warn).otherwise(ok),
            F.when(date_text.isNull(), "E-Commerce Dispatch Proviso")
            .when(pack_date.isNotNull(), "Packaging OCR")
            .otherwise("Webpage"),
            F.when(expired, "critical").when(irregular, "medium").otherwise("none"),
            F.when(expired, "expired_product"),
        )
    )

    contact_in = F.coalesce(web_address, web_maker, F.lit(""))
    web_care = F.coalesce(web("consumer_care"), web("spec_care"), F.nullif(F.regexp_extract(contact_in, CONTACT, 1), F.lit("")))
    pack_care = pack("consumer_care_details")
    rules.append(
        simple(
            "rule_consumer_care",
            "consumer_care_details",
            F.coalesce(pack_care, web_care).isNotNull(),
            origin_side(web_care, pack_care),
        )
    )
    dated = joined.withColumn("_date", date_declaration(date_text, as_of))
    return dated.withColumn("checks", F.array(*rules)).drop("_date")


def listing_checks(evaluated: DataFrame) -> DataFrame:
    return evaluated.select("product_id", F.inline_outer("checks"))


def listing_metrics(evaluated: DataFrame) -> DataFrame:
    """Verdict and confidences per listing, from the check array of the same row."""
    checks = F.col("checks")
    used = F.size(F.filter(checks, lambda c: c.status != "NOT_APPLICABLE"))
    fine = F.size(F.filter(checks, lambda c: c.status.isin("PASS", "WARNING")))
    failed = F.exists(checks, lambda c: c.status == "FAIL")
    quality = F.when(F.col("ocr_avg_conf") > 0, round_even(F.col("ocr_avg_conf") * 100, 1))
    base = evaluated.select(
        "product_id",
        F.when(failed, "NON-COMPLIANT").otherwise("COMPLIANT").alias("compliance_status"),
        quality.alias("ocr_quality"),
        round_even(fine * 100.0 / F.greatest(F.lit(1), used), 1).alias("field_extraction_confidence"),
        F.size(F.filter(checks, lambda c: c.violation_type.isNotNull())).alias("violations_count"),
    )
    seen = OCR_SHARE * F.col("ocr_quality") + EXTRACTION_SHARE * F.col("field_extraction_confidence")
    unseen = F.col("field_extraction_confidence") * UNSEEN_FACTOR
    return base.withColumn(
        "compliance_confidence", F.when(F.col("ocr_quality") > 0, round_even(seen, 1)).otherwise(round_even(unseen, 1))
    )


def reconcile_prices(listings: DataFrame) -> DataFrame:
    """Price and MRP of a listing.

    A missing price is derived from a plausible unit price per 100 g; a missing one of the two is
    copied from the other, and an MRP below the price is raised to it.
    """
    mrp, sold = positive_price(F.col("mrp")), positive_price(F.col("selling_price"))
    unit = number_in(F.coalesce("unit_text", F.lit("")), UNIT_PRICE)
    derived = round_even(unit * number_in(F.coalesce("net_quantity", F.lit("")), GRAMS_ONLY) / 100.0, 2)
    derived = F.when(sold.isNull() & derived.between(*UNIT_PRICE_RANGE), derived)
    marked = F.when(mrp >= derived, mrp).otherwise(round_even(derived / UNDISCOUNTED, 0))
    prepared = listings.select(
        "product_id",
        F.coalesce(sold, derived).alias("_sold"),
        F.when(derived.isNotNull(), marked).otherwise(mrp).alias("_mrp"),
        derived.isNotNull().alias("from_unit_price"),
    )
    low = F.col("_mrp") < F.col("_sold")
    return prepared.select(
        "product_id",
        F.when(low, F.col("_sold")).otherwise(F.coalesce("_mrp", "_sold")).alias("mrp_value"),
        F.coalesce("_sold", "_mrp").alias("selling_value"),
        "from_unit_price",
    )


def enrich_prices(listings: DataFrame, catalog: DataFrame, ceiling: float = ABSURD_PRICE) -> DataFrame:
    """Catalog prices for listings whose own price is missing or absurd.

    The catalog entry is found by item code, else EAN, else title. Each key is first reduced to its
    lowest entry, so a repeated catalog key cannot multiply listings.
    """
    out = listings
    for key in ("item_code", "ean", "title"):
        entry = F.struct("catalog_selling", "catalog_mrp")
        entries = catalog.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(entry).alias(f"_{key}"))
        out = out.join(entries, key, "left")
    item = F.coalesce("_item_code", "_ean", "_title")

    def repaired(own: str, ref: Column) -> Column:
        return F.when(F.coalesce(F.col(own) <= ceiling, F.lit(False)), F.col(own)).otherwise(F.coalesce(ref, F.col(own)))

    return out.withColumns(
        {
            "selling_value": repaired("selling_value", item.catalog_selling),
            "mrp_value": repaired("mrp_value", item.catalog_mrp),
            "from_catalog": item.isNotNull(),
        }
    ).drop("_item_code", "_ean", "_title")
