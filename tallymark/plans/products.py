"""Listing, cross-check, panel, shelf-life, consumption and nutrition queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions import amounts, dates
from tallymark.operators import crosscheck, geo, listings, nutrition, panels, shelf
from tallymark.operators.rules import evaluate, summaries
from tallymark.plans.check_sql import half_even
from tallymark.plans.labels import LABEL_VIEWS, LISTING_ORIGIN_VIEWS, origin_sql, quoted
from tallymark.plans.registry import query
from tallymark.sources import stores
from tallymark.sources.fixtures import Tables
from tallymark.sources.stores import expiry_register

# The inspection date is an argument, never the clock. Dates on the labels run from 2025 to 2027.
AS_OF = "2026-03-15"


def as_of() -> F.Column:
    return F.lit(AS_OF).cast("date")


def rx(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({text}, {quoted(pattern)}, {group})"


def num(text: str, pattern: str, group: int = 1) -> str:
    return f"TRY_CAST(nullif({rx(text, pattern, group)}, '') AS DOUBLE)"


# --- dates -----------------------------------------------------------------------------------------
MONTH_CASE = "CASE {m} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dates.MONTHS.items()) + " END"


def day_sql(y: str, m: str, d: str) -> str:
    return f"TRY_CAST(lpad({y}, 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"


def label_date_sql(text: str) -> str:
    low = f"lower(trim({text}))"
    named = dates.NAMED_MONTH
    day = f"CAST(least(28, coalesce(TRY_CAST(nullif({rx(low, named, 1)}, '') AS INT), 28)) AS VARCHAR)"
    return (
        "coalesce("
        + day_sql(rx(low, dates.DAY_FIRST, 3), rx(low, dates.DAY_FIRST, 2), rx(low, dates.DAY_FIRST, 1))
        + ", "
        + day_sql(rx(low, dates.YEAR_FIRST, 1), rx(low, dates.YEAR_FIRST, 2), rx(low, dates.YEAR_FIRST, 3))
        + ", "
        + day_sql(rx(low, dates.MONTH_YEAR, 2), rx(low, dates.MONTH_YEAR, 1), "'28'")
        + ", "
        + day_sql(rx(low, named, 3), MONTH_CASE.format(m=rx(low, named, 2)), day)
        + ")"
    )


@query(
    "label_dates",
    f"SELECT product_id, {label_date_sql('mfg_text')} AS mfg_date, {label_date_sql('exp_text')} AS exp_date FROM v_labels",
)
def label_dates(t: Tables) -> DataFrame:
    return t.labels.select(
        "product_id", dates.label_date(F.col("mfg_text")).alias("mfg_date"), dates.label_date(F.col("exp_text")).alias("exp_date")
    )


def full_year_sql(y: str) -> str:
    return f"CAST(CASE WHEN CAST({y} AS INT) < 100 THEN CAST({y} AS INT) + 2000 ELSE CAST({y} AS INT) END AS VARCHAR)"


def piece_date_sql(p: str) -> str:
    full, named, short = dates.FULL, dates.NAMED, dates.SHORT
    month = MONTH_CASE.format(m=f"lower(left({rx(p, named, 2)}, 3))")
    return (
        f"CASE WHEN {rx(p, full)} <> '' THEN {day_sql(full_year_sql(rx(p, full, 3)), rx(p, full, 2), rx(p, full, 1))} "
        f"WHEN {rx(p, named, 2)} <> '' THEN {day_sql(full_year_sql(rx(p, named, 3)), month, f'coalesce(nullif({rx(p, named, 1)}, {quoted(str())}), {quoted(str(1))})')} "
        f"ELSE {day_sql(full_year_sql(rx(p, short, 2)), rx(p, short, 1), quoted(str(1)))} END"
    )


DATE_VIEWS = {
    "e_date_text": "SELECT product_id, category, CASE WHEN product_id % 2 = 0 THEN mfg_text || ' ' || exp_text WHEN product_id % 3 = 0 THEN exp_text ELSE mfg_text END AS date_text FROM v_labels",
    "e_pieces": f"SELECT product_id, category, date_text, unnest(regexp_extract_all(upper(date_text), {quoted(dates.ANY_DATE)}, 0)) AS piece FROM e_date_text",
    "e_dates": f"SELECT product_id, {piece_date_sql('piece')} AS d FROM e_pieces",
    "e_declared": f"""SELECT t.product_id, t.category, t.date_text, coalesce(n, 0) AS n,
        CASE WHEN n >= 2 OR (n = 1 AND NOT words) THEN lo END AS mfg_date, CASE WHEN n >= 2 OR (n = 1 AND words) THEN hi END AS use_by_date
      FROM (SELECT *, contains(upper(date_text), 'USE BY') OR contains(upper(date_text), 'EXP') OR contains(upper(date_text), 'BEST BEFORE') AS words FROM e_date_text) t
      LEFT JOIN (SELECT product_id, count(d) AS n, min(d) AS lo, max(d) AS hi FROM e_dates GROUP BY 1) p USING (product_id)""",
    "e_date_status": f"""SELECT *, coalesce(use_by_date < DATE '{AS_OF}', false) AS is_expired, CASE WHEN date_text = '' THEN 'VALID' WHEN use_by_date < DATE '{AS_OF}' THEN 'EXPIRED'
        WHEN n = 0 THEN 'NO_VALID_DATE' ELSE 'VALID' END AS status FROM e_declared""",
}


def date_texts(t: Tables) -> DataFrame:
    number = F.col("product_id")
    text = (
        F.when(number % 2 == 0, F.concat("mfg_text", F.lit(" "), "exp_text"))
        .when(number % 3 == 0, F.col("exp_text"))
        .otherwise(F.col("mfg_text"))
    )
    return t.labels.select("product_id", "category", text.alias("date_text"))


@query("date_declarations", "SELECT product_id, mfg_date, use_by_date, is_expired, status FROM e_date_status", DATE_VIEWS)
def date_declarations(t: Tables) -> DataFrame:
    read = date_texts(t).withColumn("d", dates.date_declaration(F.col("date_text"), as_of()))
    return read.select("product_id", "d.*")


@query("date_status_mix", "SELECT category, status, count(*) AS label_count FROM e_date_status GROUP BY 1, 2", DATE_VIEWS)
def date_status_mix(t: Tables) -> DataFrame:
    read = date_texts(t).withColumn("status", dates.date_declaration(F.col("date_text"), as_of()).status)
    return read.groupBy("category", "status").agg(F.count(F.lit(1)).alias("label_count"))


# --- shelf life and consumption --------------------------------------------------------------------
def months_sql(text: str) -> str:
    return f"nullif(coalesce(TRY_CAST(nullif({rx(text, shelf.BEST_BEFORE)}, '') AS INT), TRY_CAST(nullif({rx(text, shelf.MONTHS_FROM)}, '') AS INT)), 0)"


SHELF_VIEWS = {
    "e_shelf0": f"""SELECT b.product_id, b.category, l.category AS listing_category, l.household_size, b.quantity_text, {label_date_sql('b.mfg_text')} AS made, {label_date_sql('b.exp_text')} AS until,
        coalesce({months_sql('b.exp_text')}, {months_sql('l.description')}, {months_sql('b.mfg_text')}) AS months,
        nullif({rx("(b.exp_text || ' ' || b.mfg_text)", shelf.YEAR)}, '') AS yr FROM v_labels b JOIN v_listings l USING (product_id)""",
    "e_shelf1": f"""SELECT *, coalesce(until, CAST(made + CAST(floor(months * 30.5) AS INT) AS DATE), CAST(made + 270 AS DATE), CAST(yr || '-12-31' AS DATE), DATE '{AS_OF}' + 180) AS expiry_date FROM e_shelf0""",
    "e_shelf": f"""SELECT *, coalesce(made, CAST(expiry_date - 180 AS DATE)) AS manufacture_date, CAST(expiry_date - DATE '{AS_OF}' AS INT) AS days_remaining,
        CASE WHEN expiry_date < DATE '{AS_OF}' THEN 'EXPIRED' WHEN expiry_date - DATE '{AS_OF}' <= 15 THEN 'EXPIRING VERY SOON' WHEN expiry_date - DATE '{AS_OF}' <= 45 THEN 'EXPIRING SOON' ELSE 'SAFE' END AS status
      FROM e_shelf1""",
    "e_use": f"""SELECT *, rate * hh AS day_rate, coalesce({num('quantity_text', amounts.LARGE_UNIT)} * 1000, {num('quantity_text', amounts.SMALL_UNIT)}, {num('quantity_text', amounts.ANY_NUMBER)}, 100.0) AS net_quantity_g
      FROM (SELECT *, greatest(1, least(10, coalesce(household_size, 2))) AS hh,
        CASE {' '.join(f"WHEN contains(k, '{n}') THEN {r}" for n, r in shelf.DAILY_RATES.items())} ELSE 25.0 END AS rate
        FROM (SELECT *, lower(trim(coalesce(nullif(listing_category, ''), 'general'))) AS k FROM e_shelf))""",
    "e_last": f"""SELECT *, CAST(greatest(1, {half_even('net_quantity_g / day_rate', 0)}) AS INT) AS lasts_days FROM e_use""",
}


def shelf_life(t: Tables) -> DataFrame:
    about = t.listings.select("product_id", "description", F.col("category").alias("listing_category"), "household_size")
    return shelf.analyze_expiry(t.labels.join(about, "product_id"), as_of())


@query(
    "shelf_life",
    f"""SELECT product_id, manufacture_date, expiry_date, days_remaining, days_remaining < 0 AS is_expired, status,
      greatest(0.0, least(100.0, {half_even('days_remaining * 100.0 / greatest(1, expiry_date - manufacture_date)', 1)})) AS shelf_life_percent FROM e_shelf""",
    SHELF_VIEWS,
)
def shelf_life_query(t: Tables) -> DataFrame:
    return shelf_life(t).select(
        "product_id", "manufacture_date", "expiry_date", "days_remaining", "is_expired", "status", "shelf_life_percent"
    )


@query("expiry_status_mix", "SELECT category, status, count(*) AS product_count FROM e_shelf GROUP BY 1, 2", SHELF_VIEWS)
def expiry_status_mix(t: Tables) -> DataFrame:
    return shelf.expiry_mix(shelf_life(t))


@query(
    "expiring_first",
    "SELECT product_id, days_remaining, status FROM e_shelf ORDER BY days_remaining, product_id LIMIT 50",
    SHELF_VIEWS,
)
def expiring_first(t: Tables) -> DataFrame:
    return shelf.expiring_first(shelf_life(t)).select("product_id", "days_remaining", "status")


@query(
    "expiry_register",
    "SELECT 'LM-' || CAST(product_id AS VARCHAR) AS scan_uid, strftime(expiry_date, '%d/%m/%Y') AS expiry_date, days_remaining, status FROM e_shelf",
    SHELF_VIEWS,
)
def expiry_register_query(t: Tables) -> DataFrame:
    found = shelf_life(t).withColumns(
        {"scan_uid": F.concat(F.lit("LM-"), F.col("product_id").cast("string")), "product_name": F.col("name")}
    )
    return expiry_register(found).drop("product_name")


def consumption(t: Tables) -> DataFrame:
    return shelf.predict_consumption(shelf_life(t).withColumn("category", F.col("listing_category")), as_of())


@query(
    "consumption_forecast",
    f"""SELECT product_id, hh AS household, net_quantity_g, {half_even('day_rate', 1)} AS daily_rate_g, lasts_days, DATE '{AS_OF}' + lasts_days AS depletion_date,
      DATE '{AS_OF}' + lasts_days > expiry_date AS waste_risk, CASE WHEN DATE '{AS_OF}' + lasts_days > expiry_date THEN CAST(DATE '{AS_OF}' + lasts_days - expiry_date AS INT) END AS days_over FROM e_last""",
    SHELF_VIEWS,
)
def consumption_forecast(t: Tables) -> DataFrame:
    return consumption(t).select(
        "product_id", "household", "net_quantity_g", "daily_rate_g", "lasts_days", "depletion_date", "waste_risk", "days_over"
    )


@query(
    "waste_risk_share",
    f"""SELECT listing_category AS category, count(*) AS products, count(*) FILTER (DATE '{AS_OF}' + lasts_days > expiry_date) AS at_risk,
      {half_even(f"count(*) FILTER (DATE '{AS_OF}' + lasts_days > expiry_date) * 100.0 / count(*)", 1)} AS risk_percent FROM e_last GROUP BY 1""",
    SHELF_VIEWS,
)
def waste_risk_share(t: Tables) -> DataFrame:
    return shelf.waste_share(consumption(t))


# --- nutrition -------------------------------------------------------------------------------------
def nutrient_sql(patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(
        f"CASE WHEN {num('label_text', '(?i)' + p)} BETWEEN 0 AND 2000 THEN {num('label_text', '(?i)' + p)} END" for p in patterns
    ) + ", NULL)"


NUTRITION_VIEWS = {
    "e_nut": "SELECT product_id, label_text, "
    + ", ".join(f"{nutrient_sql(p)} AS n_{n}" for n, (_, p) in nutrition.NUTRIENTS.items())
    + " FROM v_nutrition",
    "e_nut_rows": " UNION ALL ".join(
        f"SELECT product_id, '{n}' AS nutrient, '{u}' AS unit, n_{n} AS per_100g FROM e_nut WHERE n_{n} IS NOT NULL"
        for n, (u, _) in nutrition.NUTRIENTS.items()
    ),
}


def nutrients(t: Tables) -> DataFrame:
    return nutrition.with_nutrients(t.nutrition, "label_text")


@query(
    "nutrient_table",
    f"SELECT product_id, nutrient, unit, per_100g, {half_even('per_100g * 0.25', 1)} AS per_serving FROM e_nut_rows",
    NUTRITION_VIEWS,
)
def nutrient_table(t: Tables) -> DataFrame:
    return nutrition.nutrient_rows(nutrients(t))


@query(
    "nutrient_coverage",
    "SELECT nutrient, count(*) AS labels, round(avg(per_100g), 4) AS mean_per_100g FROM e_nut_rows GROUP BY 1",
    NUTRITION_VIEWS,
)
def nutrient_coverage(t: Tables) -> DataFrame:
    return nutrition.coverage(nutrients(t))


@query(
    "label_ingredients",
    f"""SELECT product_id, trim(nullif({rx('label_text', nutrition.INGREDIENTS)}, '')) AS ingredients, coalesce(nullif({rx('label_text', nutrition.SERVING)}, ''), '25 g (approx.)') AS serving_size,
      coalesce(n_energy, n_protein, n_carbohydrate, n_sugars, n_fat) IS NOT NULL AS available FROM e_nut""",
    NUTRITION_VIEWS,
)
def label_ingredients(t: Tables) -> DataFrame:
    return nutrients(t).select("product_id", "ingredients", "serving_size", "available")


AUDIENCE_VIEWS = {
    **NUTRITION_VIEWS,
    "e_aud": """SELECT product_id, 'General Consumers' AS audience, 'SUITABLE' AS suitability FROM e_nut
      UNION ALL SELECT product_id, 'Sugar-Conscious Consumers', CASE WHEN n_sugars IS NULL THEN 'INFORMATIONAL' WHEN n_sugars > 20 THEN 'MODERATION ADVISED' ELSE 'SUITABLE' END FROM e_nut
      UNION ALL SELECT product_id, 'Sodium-Conscious Consumers', CASE WHEN n_sodium > 600 THEN 'MODERATION ADVISED' ELSE 'SUITABLE' END FROM e_nut WHERE n_sodium IS NOT NULL
      UNION ALL SELECT product_id, 'Athletes & Active Individuals', CASE WHEN n_protein >= 10 THEN 'SUITABLE (HIGH PROTEIN)' ELSE 'INFORMATIONAL' END FROM e_nut WHERE n_protein IS NOT NULL
      UNION ALL SELECT product_id, 'Children & Youth', CASE WHEN n_sugars > 25 THEN 'OCCASIONAL TREAT' ELSE 'SUITABLE' END FROM e_nut
      UNION ALL SELECT product_id, 'Elderly Consumers', 'SUITABLE' FROM e_nut""",
}


@query("audience_profiles", "SELECT * FROM e_aud", AUDIENCE_VIEWS)
def audience_profiles(t: Tables) -> DataFrame:
    return nutrition.audience_profiles(nutrients(t))


@query("audience_mix", "SELECT audience, suitability, count(*) AS product_count FROM e_aud GROUP BY 1, 2", AUDIENCE_VIEWS)
def audience_mix(t: Tables) -> DataFrame:
    return nutrition.audience_profiles(nutrients(t)).groupBy("audience", "suitability").agg(F.count(F.lit(1)).alias("product_count"))


# --- listing against pack --------------------------------------------------------------------------
UNIT_SQL = (
    "CASE WHEN lower({u}) IN ('g','gm','gms','gram','grams','kg','kilogram','kilograms') THEN 'g' "
    "WHEN lower({u}) IN ('ml','millilitre','millilitres','l','lt','ltr','litre','litres') THEN 'ml' ELSE nullif(lower({u}), '') END"
)


def qty_sql(text: str) -> str:
    unit = f"lower({rx(text, amounts.QUANTITY, 2)})"
    big = f"CASE WHEN {unit} IN ('kg','kilogram','kilograms','l','lt','ltr','litre','litres') THEN 1000 ELSE 1 END"
    return f"coalesce({num(text, amounts.QUANTITY)} * {big}, {num(text, amounts.NUMBER)})"


def price_sql(text: str) -> str:
    return num(f"replace({text}, ',', '')", amounts.PRICE)


def words_sql(text: str) -> str:
    stop = ", ".join(quoted(w) for w in crosscheck.MAKER_STOPWORDS)
    return f"list_filter(regexp_extract_all(lower({text}), '\\w+'), lambda w: w NOT IN ({stop}))"


PACK = "max(CASE WHEN field_name = '{0}' THEN nullif(extracted_value, '') END) AS pack_{0}"
CROSS_VIEWS = {
    "e_pack": "SELECT scan_id AS product_id, "
    + ", ".join(PACK.format(n) for n in ("net_quantity", "country_of_origin", "manufacturer_name_address"))
    + ", max(CASE WHEN field_name = 'mrp' AND extraction_method <> 'not_found' THEN nullif(extracted_value, '') END) AS pack_mrp FROM v_fields GROUP BY 1",
    "e_web": """SELECT product_id, net_quantity AS web_net_quantity, coalesce(mrp, selling_price) AS web_mrp, country_of_origin AS web_country_of_origin,
      manufacturer AS web_manufacturer_name_address FROM v_listings""",
    "e_sides": f"""SELECT *, {qty_sql('web_net_quantity')} AS wq, {qty_sql('pack_net_quantity')} AS pq,
        {UNIT_SQL.format(u=rx('web_net_quantity', amounts.QUANTITY, 2))} AS wu, {UNIT_SQL.format(u=rx('pack_net_quantity', amounts.QUANTITY, 2))} AS pu,
        {price_sql('web_mrp')} AS wp, {price_sql('pack_mrp')} AS pp FROM e_web FULL JOIN e_pack USING (product_id)""",
    "e_cross": f"""SELECT product_id, 'net_quantity' AS field_name, web_net_quantity AS ecommerce_value, pack_net_quantity AS packaging_value,
        CASE WHEN wq IS NULL OR pq IS NULL THEN 'MATCH' WHEN wu <> pu THEN 'MISMATCH' WHEN abs(wq - pq) <= greatest(1.0, wq * 0.01) THEN 'MATCH' ELSE 'MISMATCH' END AS verdict FROM e_sides
      UNION ALL SELECT product_id, 'mrp', web_mrp, pack_mrp, CASE WHEN wp > pp AND wp - pp >= 0.5 THEN 'WARNING' ELSE 'MATCH' END FROM e_sides
      UNION ALL SELECT product_id, 'country_of_origin', web_country_of_origin, pack_country_of_origin, 'MATCH' FROM e_sides
      UNION ALL SELECT product_id, 'manufacturer_name_address', web_manufacturer_name_address, pack_manufacturer_name_address,
        CASE WHEN list_has_any({words_sql('web_manufacturer_name_address')}, {words_sql('pack_manufacturer_name_address')}) THEN 'MATCH' ELSE 'WARNING' END FROM e_sides""",
    "e_compared": """SELECT product_id, field_name, ecommerce_value, packaging_value, CASE WHEN ecommerce_value IS NOT NULL AND packaging_value IS NOT NULL THEN verdict
        WHEN packaging_value IS NOT NULL THEN 'PACKAGING_ONLY' ELSE 'ONLINE_ONLY' END AS status FROM e_cross WHERE ecommerce_value IS NOT NULL OR packaging_value IS NOT NULL""",
}


def pack_fields(t: Tables) -> DataFrame:
    return t.fields.withColumnRenamed("scan_id", "product_id")


@query("cross_validation", "SELECT *, status = 'MATCH' AS matches FROM e_compared", CROSS_VIEWS)
def cross_validation(t: Tables) -> DataFrame:
    return crosscheck.cross_validate(t.listings, pack_fields(t))


@query(
    "cross_validation_mix",
    "SELECT field_name, status, count(*) AS product_count FROM e_compared GROUP BY 1, 2",
    CROSS_VIEWS,
)
def cross_validation_mix(t: Tables) -> DataFrame:
    compared = crosscheck.cross_validate(t.listings, pack_fields(t))
    return compared.groupBy("field_name", "status").agg(F.count(F.lit(1)).alias("product_count"))


@query(
    "filled_from_listing",
    """SELECT coalesce(f.scan_id, s.scan_id) AS scan_id, coalesce(f.field_name, s.field_name) AS field_name,
      CASE WHEN s.v IS NOT NULL AND (trim(coalesce(f.extracted_value, '')) = '' OR coalesce(f.extraction_method, 'not_found') IN ('not_found', 'genai_fallback')) THEN s.v ELSE f.extracted_value END AS extracted_value,
      CASE WHEN s.v IS NOT NULL AND (trim(coalesce(f.extracted_value, '')) = '' OR coalesce(f.extraction_method, 'not_found') IN ('not_found', 'genai_fallback')) THEN 'ecommerce_html_spec' ELSE f.extraction_method END AS extraction_method,
      CAST(CASE WHEN s.v IS NOT NULL AND (trim(coalesce(f.extracted_value, '')) = '' OR coalesce(f.extraction_method, 'not_found') IN ('not_found', 'genai_fallback')) THEN 0.98 ELSE f.confidence END AS DOUBLE) AS confidence
    FROM v_fields f FULL JOIN (SELECT product_id AS scan_id, 'mrp' AS field_name, selling_price AS v FROM v_listings WHERE selling_price IS NOT NULL
      UNION ALL SELECT product_id, 'net_quantity', net_quantity FROM v_listings WHERE net_quantity IS NOT NULL
      UNION ALL SELECT product_id, 'country_of_origin', country_of_origin FROM v_listings WHERE country_of_origin IS NOT NULL) s
    ON s.scan_id = f.scan_id AND s.field_name = f.field_name""",
)
def filled_from_listing(t: Tables) -> DataFrame:
    specs = t.listings.selectExpr(
        "product_id AS scan_id",
        "stack(3, 'mrp', selling_price, 'net_quantity', net_quantity, 'country_of_origin', country_of_origin) AS (field_name, spec_value)",
    )
    return crosscheck.fill_from_listing(t.fields, specs)


# --- panels ----------------------------------------------------------------------------------------
@query(
    "merged_sides",
    """SELECT product_id, field_name, extracted_value, extraction_method, confidence, side FROM v_side_fields WHERE extracted_value <> ''
    QUALIFY row_number() OVER (PARTITION BY product_id, field_name ORDER BY confidence DESC, side DESC) = 1""",
)
def merged_sides(t: Tables) -> DataFrame:
    return panels.merge_sides(t.side_fields).select(
        "product_id", "field_name", "extracted_value", "extraction_method", "confidence", "side"
    )


BEST_VIEWS = {
    "e_best": f"""SELECT product_id, field_name, side, round((CASE WHEN confidence = 0 THEN 0.5 ELSE confidence END) * 2.0 + CASE WHEN contains(extraction_method, 'ocr') THEN 1.0 ELSE 0.5 END
        + least(length(trim(extracted_value)) / 100.0, 0.5), 9) AS score
      FROM v_side_fields WHERE extracted_value <> '' AND extraction_method <> 'not_found' AND field_name <> 'expiry_date'
        AND (field_name <> 'mrp' OR regexp_matches(trim(extracted_value), {quoted(panels.PRICE_SHAPE)}))""",
}


@query(
    "best_panel_candidates",
    "SELECT * FROM e_best QUALIFY row_number() OVER (PARTITION BY product_id, field_name ORDER BY score DESC, side) = 1",
    BEST_VIEWS,
)
def best_panel_candidates(t: Tables) -> DataFrame:
    origins = t.listings.select(
        "product_id", F.coalesce("country_of_origin", F.lit("India")).alias("origin_country"), F.lit(0.98).alias("origin_confidence")
    )
    return panels.best_candidates(t.side_fields, origins).select("product_id", "field_name", "side", "score")


@query(
    "best_panels",
    """SELECT product_id, side AS best_side, filled AS fields_filled, round(avg(conf) OVER (PARTITION BY product_id), 6) AS ocr_avg_conf FROM (
      SELECT product_id, side, count(*) FILTER (extracted_value <> '') AS filled, round(avg(confidence) FILTER (confidence > 0), 9) AS conf FROM v_side_fields GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY filled DESC, side) = 1""",
)
def best_panels(t: Tables) -> DataFrame:
    return panels.best_side(t.side_fields)


@query(
    "merged_headers",
    """SELECT product_id, CASE WHEN product_id % 3 = 0 THEN name ELSE name || ' front' END AS product_name, CASE WHEN product_id % 2 = 0 THEN 'G' || CAST(product_id AS VARCHAR) END AS gtin,
      CAST(CASE WHEN product_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS barcodes, CAST(3 AS BIGINT) AS sides_analyzed FROM v_labels""",
)
def merged_headers(t: Tables) -> DataFrame:
    odd, third = F.col("product_id") % 2 == 1, F.col("product_id") % 3 == 0
    code = F.concat(F.lit("G"), F.col("product_id").cast("string"))
    rows = F.array(
        F.struct(
            F.lit(1).alias("side"),
            F.when(third, "Product Scan").otherwise(F.concat("name", F.lit(" front"))).alias("product_name"),
            F.lit("").alias("gtin"),
            F.lit("b1").alias("barcode"),
        ),
        F.struct(
            F.lit(2).alias("side"), F.col("name").alias("product_name"), F.when(~odd, code).alias("gtin"), F.lit("b1").alias("barcode")
        ),
        F.struct(
            F.lit(3).alias("side"),
            F.lit("flap").alias("product_name"),
            F.when(~odd, F.lit("later")).alias("gtin"),
            F.when(~odd, "b2").alias("barcode"),
        ),
    )
    return panels.merge_headers(t.labels.select("product_id", F.inline(rows)))


# The label checks over merged sides: the same SQL, reading the merged declarations.
MERGED_VIEWS = {
    **{name: re.sub(r"\bv_fields\b", "e_merged", body) for name, body in LABEL_VIEWS.items()},
    "e_merged": """SELECT product_id AS scan_id, field_name, extracted_value, extraction_method, confidence, CAST(NULL AS INT) AS h FROM v_side_fields WHERE extracted_value <> ''
      QUALIFY row_number() OVER (PARTITION BY product_id, field_name ORDER BY confidence DESC, side DESC) = 1""",
    "e_origin": f"SELECT scan_id AS product_id, {origin_sql('extracted_value')} AS found FROM e_merged WHERE field_name = 'manufacturer_name_address'",
}


@query(
    "merged_side_verdicts", "SELECT scan_id, compliance_status, total_violations, ai_used FROM e_status", MERGED_VIEWS
)
def merged_side_verdicts(t: Tables) -> DataFrame:
    """Multi-side products judged on their merged declarations."""
    merged = panels.merge_sides(t.side_fields).withColumnRenamed("product_id", "scan_id").withColumn("h", F.lit(None).cast("int"))
    labels = t.camera.select(
        "scan_id",
        F.lit(None).cast("double").alias("px_per_mm"),
        F.col("net_quantity_g").cast("double").alias("net_quantity_g"),
        F.col("package_width_mm").cast("double").alias("package_width_mm"),
    )
    return summaries(evaluate(labels, merged)).select("scan_id", "compliance_status", "total_violations", "ai_used")


# --- listing rules ---------------------------------------------------------------------------------
P = "max(CASE WHEN field_name = '{0}' AND extraction_method <> 'not_found' THEN nullif(extracted_value, '') END) AS p_{0}"


def listing_price_sql(text: str) -> str:
    clean = f"trim({text})"
    return (
        f"CASE WHEN {clean} <> '' THEN coalesce(TRY_CAST(nullif(replace({rx(clean, amounts.MARKED_PRICE)}, ',', ''), '') AS DOUBLE), {num(clean, amounts.DECIMAL_PRICE)}, "
        f"CASE WHEN length({clean}) <= 15 THEN {num(f'replace({clean}, {quoted(chr(44))}, {quoted(str())})', '([0-9]+(?:[.][0-9]{1,2})?)')} END) END"
    )


LISTING_VIEWS = {
    **LISTING_ORIGIN_VIEWS,
    **CROSS_VIEWS,
    "e_printed": "SELECT scan_id AS product_id, " + ", ".join(P.format(n) for n in listings.PACK_FIELDS) + " FROM v_fields GROUP BY 1",
    "e_all": """SELECT l.*, p.* EXCLUDE (product_id), c.status AS cv, coalesce(CASE WHEN stated IS NOT NULL THEN coalesce(split_part(g1, '|', 1), trim(stated)) END,
        split_part(g2, '|', 1), split_part(g3, '|', 1), split_part(g4, '|', 1), split_part(g5, '|', 1), 'India') AS geo
      FROM v_listings l JOIN e_printed p USING (product_id) JOIN e_judged j USING (product_id) LEFT JOIN (SELECT * FROM e_compared WHERE field_name = 'net_quantity') c USING (product_id)""",
    "e_fact": f"""SELECT *, coalesce(p_net_quantity, net_quantity) AS qty, {listing_price_sql('selling_price')} AS sp, {listing_price_sql('p_mrp')} AS pm,
        lower(coalesce(country_of_origin, geo)) AS co, coalesce(p_manufacture_date, manufacture_date, best_before) AS dt,
        coalesce(p_consumer_care_details, consumer_care, nullif({rx("coalesce(manufacturer_address, manufacturer, '')", listings.CONTACT)}, '')) AS care FROM e_all""",
    "e_dpiece": f"SELECT product_id, unnest(regexp_extract_all(upper(dt), {quoted(dates.ANY_DATE)}, 0)) AS piece FROM e_fact",
    "e_ddate": f"SELECT product_id, count(d) AS n, max(d) AS hi FROM (SELECT product_id, {piece_date_sql('piece')} AS d FROM e_dpiece) GROUP BY 1",
    "e_dstat": f"""SELECT f.product_id, coalesce(n, 0) > 0 AS dated, coalesce((n >= 2 OR (n = 1 AND (contains(upper(dt), 'USE BY') OR contains(upper(dt), 'EXP') OR contains(upper(dt), 'BEST BEFORE')))) AND hi < DATE '{AS_OF}', false) AS expired,
        coalesce(regexp_matches(dt, {quoted(listings.DATE_SHAPE)}) OR regexp_matches(dt, {quoted(listings.SHELF_LIFE)}), false) AS shaped FROM e_fact f LEFT JOIN e_ddate USING (product_id)""",
    "e_lchecks": f"""SELECT product_id, 'rule_product_name' AS rule_id, CASE WHEN product_name <> '' THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN product_name <> '' THEN 'none' ELSE 'high' END AS severity FROM e_fact
      UNION ALL SELECT product_id, 'rule_net_quantity', CASE WHEN cv = 'MISMATCH' OR qty IS NULL THEN 'FAIL' WHEN regexp_matches(qty, {quoted(listings.METRIC_UNIT)}) THEN 'PASS' ELSE 'WARNING' END,
        CASE WHEN cv = 'MISMATCH' THEN 'critical' WHEN qty IS NULL THEN 'high' WHEN regexp_matches(qty, {quoted(listings.METRIC_UNIT)}) THEN 'none' ELSE 'medium' END FROM e_fact
      UNION ALL SELECT product_id, 'rule_mrp', CASE WHEN sp > pm AND pm > 0 THEN 'FAIL' WHEN coalesce(mrp, p_mrp) IS NOT NULL THEN 'PASS' WHEN selling_price IS NOT NULL THEN 'WARNING' ELSE 'FAIL' END,
        CASE WHEN sp > pm AND pm > 0 THEN 'critical' WHEN coalesce(mrp, p_mrp) IS NOT NULL THEN 'none' WHEN selling_price IS NOT NULL THEN 'medium' ELSE 'high' END FROM e_fact
      UNION ALL SELECT product_id, unnest(['rule_manufacturer', 'rule_manufacturer_address']), CASE WHEN coalesce(p_manufacturer_name_address, manufacturer) IS NOT NULL THEN 'PASS' ELSE 'FAIL' END,
        CASE WHEN coalesce(p_manufacturer_name_address, manufacturer) IS NOT NULL THEN 'none' ELSE 'high' END FROM e_fact WHERE coalesce(p_manufacturer_name_address, manufacturer) IS NOT NULL OR manufacturer_address IS NULL
      UNION ALL SELECT product_id, unnest(['rule_manufacturer', 'rule_manufacturer_address']), unnest(['FAIL', 'PASS']), unnest(['high', 'none']) FROM e_fact
        WHERE coalesce(p_manufacturer_name_address, manufacturer) IS NULL AND manufacturer_address IS NOT NULL
      UNION ALL SELECT product_id, 'rule_packer', CASE WHEN packer IS NOT NULL THEN 'PASS' ELSE 'NOT_APPLICABLE' END, 'none' FROM e_fact
      UNION ALL SELECT product_id, 'rule_importer', CASE WHEN co = '' OR contains(co, 'india') THEN 'NOT_APPLICABLE' WHEN importer IS NOT NULL THEN 'PASS' ELSE 'FAIL' END,
        CASE WHEN co = '' OR contains(co, 'india') OR importer IS NOT NULL THEN 'none' ELSE 'high' END FROM e_fact
      UNION ALL SELECT product_id, 'rule_country_of_origin', 'PASS', 'none' FROM e_fact
      UNION ALL SELECT f.product_id, 'rule_date_declaration', CASE WHEN dt IS NULL THEN 'PASS' WHEN expired THEN 'FAIL' WHEN dated OR shaped THEN 'PASS' ELSE 'WARNING' END,
        CASE WHEN dt IS NULL THEN 'none' WHEN expired THEN 'critical' WHEN dated OR shaped THEN 'none' ELSE 'medium' END FROM e_fact f JOIN e_dstat USING (product_id)
      UNION ALL SELECT product_id, 'rule_consumer_care', CASE WHEN care IS NOT NULL THEN 'PASS' ELSE 'FAIL' END, CASE WHEN care IS NOT NULL THEN 'none' ELSE 'high' END FROM e_fact""",
    "e_lscore": f"""SELECT product_id, count(*) FILTER (status = 'FAIL') AS fails, {half_even("count(*) FILTER (status IN ('PASS', 'WARNING')) * 100.0 / greatest(1, count(*) FILTER (status <> 'NOT_APPLICABLE'))", 1)} AS fe FROM e_lchecks GROUP BY 1""",
    "e_lq": f"""SELECT product_id, {half_even('q * 100', 1)} AS oq FROM (SELECT product_id, round(avg(conf), 6) AS q FROM (
        SELECT product_id, side, round(avg(confidence) FILTER (confidence > 0), 9) AS conf FROM v_side_fields GROUP BY 1, 2) GROUP BY 1)""",
}


def judged_listings(t: Tables, shown: DataFrame | None = None) -> DataFrame:
    """Listings (``shown``, or the stored ones) beside their pack: every input is one row per product before it is joined."""
    fields = pack_fields(t)
    shown = t.listings if shown is None else shown
    panel = t.labels.select("product_id", F.col("address_text").alias("panel_address"))
    origin = geo.resolve_origin(shown.join(panel, "product_id", "left")).withColumnRenamed("origin_country", "geo_country")
    compared = crosscheck.with_comparison(
        crosscheck.web_side(shown).join(crosscheck.pack_side(fields), "product_id", "left")
    ).select("product_id", "cv_net_quantity")
    quality = panels.best_side(t.side_fields).select("product_id", "ocr_avg_conf")
    joined = (
        origin.join(listings.printed_fields(fields), "product_id", "left")
        .join(compared, "product_id", "left")
        .join(quality, "product_id", "left")
    )
    return listings.evaluate_listings(joined, as_of())


@query("listing_rule_checks", "SELECT * FROM e_lchecks", LISTING_VIEWS)
def listing_rule_checks(t: Tables) -> DataFrame:
    return listings.listing_checks(judged_listings(t)).select("product_id", "rule_id", "status", "severity")


@query(
    "listing_verdicts",
    f"""SELECT product_id, CASE WHEN fails > 0 THEN 'NON-COMPLIANT' ELSE 'COMPLIANT' END AS compliance_status, oq AS ocr_quality, fe AS field_extraction_confidence,
      CAST(fails AS INT) AS violations_count, CASE WHEN oq > 0 THEN {half_even('0.35 * oq + 0.65 * fe', 1)} ELSE {half_even('fe * 0.88', 1)} END AS compliance_confidence
    FROM e_lscore JOIN e_lq USING (product_id)""",
    LISTING_VIEWS,
)
def listing_verdicts(t: Tables) -> DataFrame:
    return listings.listing_metrics(judged_listings(t))


@query(
    "listing_rule_mix",
    "SELECT rule_id, status, count(*) AS listing_count FROM e_lchecks GROUP BY 1, 2",
    LISTING_VIEWS,
)
def listing_rule_mix(t: Tables) -> DataFrame:
    rows = listings.listing_checks(judged_listings(t))
    return rows.groupBy("rule_id", "status").agg(F.count(F.lit(1)).alias("listing_count"))


# --- prices ----------------------------------------------------------------------------------------
def positive_sql(text: str) -> str:
    return f"CASE WHEN {price_sql(text)} > 0 THEN {price_sql(text)} END"


PRICE_VIEWS = {
    "e_price0": f"""SELECT product_id, item_code, ean, product_name, {positive_sql('mrp')} AS m, {positive_sql('selling_price')} AS s,
        {half_even(f"{num('unit_text', listings.UNIT_PRICE)} * {num('net_quantity', listings.GRAMS_ONLY)} / 100.0", 2)} AS u FROM v_listings""",
    "e_price1": f"""SELECT *, coalesce(s, d) AS ss, CASE WHEN d IS NULL THEN m WHEN m >= d THEN m ELSE {half_even('d / 0.93', 0)} END AS mm
      FROM (SELECT *, CASE WHEN s IS NULL AND u BETWEEN 5 AND 500 THEN u END AS d FROM e_price0)""",
    "e_price": """SELECT product_id, item_code, ean, product_name, CASE WHEN mm < ss THEN ss ELSE coalesce(mm, ss) END AS mrp_value, coalesce(ss, mm) AS selling_value, d IS NOT NULL AS from_unit_price FROM e_price1""",
    "e_catalog": """SELECT 'B0' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(8, length(CAST(p_partkey AS VARCHAR))) AS INT), '0') AS item_code, '890' || lpad(CAST(p_partkey + 3 AS VARCHAR), CAST(greatest(10, length(CAST(p_partkey + 3 AS VARCHAR))) AS INT), '0') AS ean, p_name AS title,
        CAST(p_size AS DOUBLE) AS cs, CAST(p_size + 5 AS DOUBLE) AS cm FROM part WHERE p_brand = 'Brand#2'""",
    "e_item": """SELECT p.*, coalesce(a.x, b.x, c.x) AS item FROM e_price p LEFT JOIN (SELECT item_code, min({'s': cs, 'm': cm}) AS x FROM e_catalog GROUP BY 1) a USING (item_code)
      LEFT JOIN (SELECT ean, min({'s': cs, 'm': cm}) AS x FROM e_catalog GROUP BY 1) b USING (ean) LEFT JOIN (SELECT title AS product_name, min({'s': cs, 'm': cm}) AS x FROM e_catalog GROUP BY 1) c USING (product_name)""",
}


@query("reconciled_prices", "SELECT product_id, mrp_value, selling_value, from_unit_price FROM e_price", PRICE_VIEWS)
def reconciled_prices(t: Tables) -> DataFrame:
    return listings.reconcile_prices(t.listings)


@query(
    "catalog_prices",
    """SELECT product_id, CASE WHEN selling_value <= 150 THEN selling_value ELSE coalesce(item.s, selling_value) END AS selling_value,
      CASE WHEN mrp_value <= 150 THEN mrp_value ELSE coalesce(item.m, mrp_value) END AS mrp_value, item IS NOT NULL AS from_catalog FROM e_item""",
    PRICE_VIEWS,
)
def catalog_prices(t: Tables) -> DataFrame:
    part = t.read("part").where(F.col("p_brand") == "Brand#2")
    number = F.col("p_partkey")
    catalog = part.select(
        F.concat(F.lit("B0"), stores.padded(number, 8)).alias("item_code"),
        F.concat(F.lit("890"), stores.padded(number + 3, 10)).alias("ean"),
        F.col("p_name").alias("title"),
        F.col("p_size").cast("double").alias("catalog_selling"),
        (F.col("p_size") + 5).cast("double").alias("catalog_mrp"),
    )
    keys = t.listings.select("product_id", "item_code", "ean", F.col("product_name").alias("title"))
    priced = listings.reconcile_prices(t.listings).join(keys, "product_id")
    return listings.enrich_prices(priced, catalog).select("product_id", "selling_value", "mrp_value", "from_catalog")


@query(
    "quantity_values",
    f"SELECT product_id, {qty_sql('quantity_text')} AS amount, {UNIT_SQL.format(u=rx('quantity_text', amounts.QUANTITY, 2))} AS unit, {price_sql('mrp_text')} AS price FROM v_labels",
)
def quantity_values(t: Tables) -> DataFrame:
    return t.labels.select(
        "product_id",
        amounts.quantity_value(F.col("quantity_text")).alias("amount"),
        amounts.quantity_unit(F.col("quantity_text")).alias("unit"),
        amounts.price(F.col("mrp_text")).alias("price"),
    )


DECLARED_VIEWS = {
    **LISTING_ORIGIN_VIEWS,
    **BEST_VIEWS,
    "e_bestv": """SELECT b.product_id, b.field_name, f.extracted_value, f.extraction_method, f.confidence FROM (
        SELECT * FROM e_best QUALIFY row_number() OVER (PARTITION BY product_id, field_name ORDER BY score DESC, side) = 1) b JOIN v_side_fields f USING (product_id, field_name, side)""",
    "e_webv": """SELECT l.product_id, unnest(['manufacturer_name_address', 'net_quantity', 'mrp', 'manufacture_date', 'consumer_care_details', 'country_of_origin']) AS field_name,
        unnest([coalesce(manufacturer_address, manufacturer), net_quantity, coalesce(mrp, selling_price), coalesce(manufacture_date, best_before, 'Stamped on physical package at dispatch (Rule 6(10))'), consumer_care,
          'Country of Origin: ' || coalesce(CASE WHEN stated IS NOT NULL THEN coalesce(split_part(g1, '|', 1), trim(stated)) END, split_part(g2, '|', 1), split_part(g3, '|', 1), split_part(g4, '|', 1), split_part(g5, '|', 1), 'India')]) AS web
      FROM v_listings l JOIN e_judged USING (product_id)""",
    "e_declared6": """SELECT w.product_id, w.field_name, CASE WHEN b.extracted_value IS NULL THEN web
          WHEN w.field_name = 'manufacturer_name_address' AND regexp_matches(lower(b.extracted_value), 'pvt|ltd') AND regexp_matches(lower(b.extracted_value), 'road|street|estate|industrial|nagar|\b[1-9][0-9]{5}\b') THEN b.extracted_value
          ELSE coalesce(web, b.extracted_value) END AS extracted_value, b.extracted_value AS packaging_value,
        CASE WHEN b.extracted_value IS NOT NULL THEN b.extraction_method WHEN web IS NULL THEN 'not_found' WHEN w.field_name = 'manufacture_date' THEN 'ecommerce_rule_6_10' ELSE 'webpage_extracted' END AS extraction_method,
        CASE WHEN b.extracted_value IS NULL THEN CASE WHEN web IS NULL THEN 0.0 ELSE 0.95 END WHEN web IS NOT NULL OR w.field_name = 'manufacturer_name_address' THEN greatest(0.95, coalesce(nullif(b.confidence, 0), 0.5)) ELSE b.confidence END AS confidence
      FROM e_webv w LEFT JOIN e_bestv b USING (product_id, field_name)""",
}


def completed(t: Tables) -> DataFrame:
    panel = t.labels.select("product_id", F.col("address_text").alias("panel_address"))
    resolved = geo.resolve_origin(t.listings.join(panel, "product_id", "left"))
    return panels.complete_declarations(panels.best_candidates(t.side_fields), resolved)


@query("completed_declarations", "SELECT product_id, field_name, extracted_value, packaging_value, extraction_method, CAST(confidence AS DOUBLE) AS confidence FROM e_declared6", DECLARED_VIEWS)
def completed_declarations(t: Tables) -> DataFrame:
    return completed(t)


@query(
    "maker_addresses",
    """SELECT product_id, CASE WHEN regexp_matches(lower(d.extracted_value), 'pvt|ltd') AND (l.manufacturer_address IS NULL OR length(d.extracted_value) > length(l.manufacturer_address))
      THEN d.extracted_value ELSE l.manufacturer_address END AS manufacturer_address FROM v_listings l LEFT JOIN (SELECT * FROM e_declared6 WHERE field_name = 'manufacturer_name_address') d USING (product_id)""",
    DECLARED_VIEWS,
)
def maker_addresses(t: Tables) -> DataFrame:
    return panels.maker_addresses(t.listings, completed(t))
