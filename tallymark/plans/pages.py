"""Product page, link and image queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import ENTITIES, visible_text
from tallymark.operators import listings
from tallymark.operators import pages as P
from tallymark.plans.labels import quoted
from tallymark.plans.products import LISTING_VIEWS, judged_listings
from tallymark.plans.registry import REGISTRY, query
from tallymark.sources.fixtures import Tables


def unescape_sql(text: str) -> str:
    for entity, plain in ENTITIES.items():
        text = f"replace({text}, {quoted(entity)}, {quoted(plain)})"
    return text


def clean_sql(text: str) -> str:
    visible = f"replace(regexp_replace({text}, '[\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{200e}}\\x{{200f}}\\x{{feff}}]', '', 'g'), chr(160), ' ')"
    return f"nullif(trim(regexp_replace({visible}, '[ \\t\\n\\r\\f]+', ' ', 'g')), '')"


def visible_sql(html: str) -> str:
    hidden = f"regexp_replace({html}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g')"
    tagless = f"regexp_replace({hidden}, '(?s)<[^>]*>', ' ', 'g')"
    return clean_sql(unescape_sql(tagless))


def shape(name: str) -> str:
    return clean_sql(f"nullif(regexp_extract(txt, {quoted(P.TEXT_SHAPES[name])}, 1), '')")


# What each built page says, straight from the listing it was built from.
PRICE = "'₹' || printf('%.2f', CAST(selling_price AS DOUBLE))"
PAGE_VIEWS = {
    "e_html": f"""SELECT product_id AS page_id,
        CASE product_id % 3 WHEN 0 THEN product_name || ' LD' WHEN 1 THEN product_name || ' OG' ELSE product_name || ' & more' END AS product_name, 'Fresh ' || brand AS description,
        CASE WHEN product_id % 3 = 0 THEN brand END AS brand,
        CASE WHEN product_id % 3 = 0 OR product_id % 4 IN (1, 3) THEN {PRICE} END AS mrp, CASE WHEN product_id % 3 = 0 THEN {PRICE} END AS selling_price,
        CASE WHEN product_id % 3 = 0 THEN CAST(product_id % 90 + 1 AS VARCHAR) || ' g' WHEN product_id % 4 = 0 THEN net_quantity WHEN product_id % 4 = 3 THEN CAST(product_id % 70 + 5 AS VARCHAR) || ' g' END AS net_quantity,
        CASE product_id % 4 WHEN 0 THEN country_of_origin WHEN 3 THEN 'Sri Lanka' END AS country_of_origin,
        CASE WHEN product_id % 3 = 1 THEN manufacturer END AS manufacturer, CASE WHEN product_id % 4 = 1 THEN coalesce(manufacturer_address, 'Plot 9') WHEN product_id % 3 = 1 AND manufacturer LIKE '%Plot%' THEN manufacturer END AS manufacturer_address,
        CASE WHEN product_id % 4 = 0 THEN 'Metro Packers' END AS packer, CASE WHEN product_id % 4 = 2 THEN coalesce(importer, 'none') END AS importer, CASE WHEN product_id % 4 = 2 THEN '9 months' END AS best_before,
        CASE WHEN product_id % 4 = 3 THEN 'B' || CAST(product_id AS VARCHAR) || 'X' END AS batch_number, CASE WHEN product_id % 4 = 3 THEN 'care@shop.org, 1800-123-4567' END AS consumer_care,
        product_id % 3 <> 2 AS structured_data, product_id % 4 <> 3 AS product_specifications FROM v_listings""",
}
SHOWN = [
    "page_id", "product_name", "description", "brand", "mrp", "selling_price", "net_quantity", "country_of_origin", "manufacturer",
    "manufacturer_address", "packer", "importer", "best_before", "batch_number", "consumer_care", "structured_data", "product_specifications",
]


@query("listing_pages", f"SELECT {', '.join(SHOWN)} FROM e_html", PAGE_VIEWS)
def listing_pages(t: Tables) -> DataFrame:
    return P.listings_of(t.listing_html).select(*SHOWN)


@query(
    "stored_pages",
    f"""SELECT page_id, coalesce({clean_sql("regexp_replace(" + clean_sql(unescape_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")) + ", " + quoted(P.SHOP_SUFFIX) + ", '')")}, 'Packaged Commodity Product') AS product_name,
      {shape('net_quantity')} AS net_quantity, {shape('manufacture_date')} AS manufacture_date, {shape('packing_date')} AS packing_date, false AS structured_data, false AS product_specifications
    FROM (SELECT *, coalesce({visible_sql('html')}, '') AS txt FROM pages)""",
)
def stored_pages(t: Tables) -> DataFrame:
    found = P.listings_of(t.pages)
    return found.select(
        "page_id", "product_name", "net_quantity", "manufacture_date", "packing_date", "structured_data", "product_specifications"
    )


@query("page_text", f"SELECT page_id, length(txt) AS text_length, md5(txt) AS text_md5 FROM (SELECT page_id, {visible_sql('html')} AS txt FROM pages)")
def page_text(t: Tables) -> DataFrame:
    text = t.pages.select("page_id", visible_text(F.col("html")).alias("txt"))
    return text.select("page_id", F.length("txt").alias("text_length"), F.md5("txt").alias("text_md5"))


@query(
    "page_specifications",
    """SELECT * FROM (SELECT product_id AS page_id, unnest(CASE product_id % 4 WHEN 0 THEN ['net quantity', 'country of origin', 'packer'] WHEN 1 THEN ['mrp (incl. tax)', 'manufacturer address'] WHEN 2 THEN ['shelf life', 'importer'] ELSE [] END) AS key,
      unnest(CASE product_id % 4 WHEN 0 THEN [net_quantity, coalesce(country_of_origin, 'Origin'), 'Metro Packers'] WHEN 1 THEN ['Rs. ' || coalesce(selling_price, '0'), coalesce(manufacturer_address, 'Plot 9')] WHEN 2 THEN ['9 months', coalesce(importer, 'none')] ELSE [] END) AS value FROM v_listings) WHERE value IS NOT NULL""",
)
def page_specifications(t: Tables) -> DataFrame:
    return P.specs_of(t.listing_html).select("page_id", "key", "value")


# A scan of a listing from its page to the verdict: what the page says, where the product is from, what the pack says, the rules.
PAGE_LISTING_VIEWS = {
    **{name: sql.replace("v_listings", "e_shown") for name, sql in LISTING_VIEWS.items()},
    **PAGE_VIEWS,
    "e_shown": "SELECT page_id AS product_id, * EXCLUDE (page_id), NULL::VARCHAR AS manufacture_date, NULL::VARCHAR AS spec_origin FROM e_html",
}


def page_listings(t: Tables) -> DataFrame:
    return P.listings_of(t.listing_html).withColumnRenamed("page_id", "product_id").withColumn("spec_origin", F.lit(None).cast("string"))


@query("page_listing_verdicts", REGISTRY["listing_verdicts"].check, PAGE_LISTING_VIEWS)
def page_listing_verdicts(t: Tables) -> DataFrame:
    return listings.listing_metrics(judged_listings(t, page_listings(t)))


@query("page_listing_checks", "SELECT * FROM e_lchecks", PAGE_LISTING_VIEWS)
def page_listing_checks(t: Tables) -> DataFrame:
    return listings.listing_checks(judged_listings(t, page_listings(t))).select("product_id", "rule_id", "status", "severity")


@query(
    "nested_specifications",
    """SELECT * FROM (SELECT product_id AS page_id, unnest(['shelf life', 'brand', 'packer', 'level']) AS key,
      unnest([CAST(product_id % 24 AS VARCHAR) || ' months', brand, 'Metro ' || product_name, 'Packer Metro ' || product_name]) AS value FROM v_listings) WHERE value IS NOT NULL""",
)
def nested_specifications(t: Tables) -> DataFrame:
    return P.specs_of(t.nested_html).select("page_id", "key", "value")


@query(
    "result_cards",
    """SELECT product_id AS page_id, 0 AS position, product_name || ' & co' AS title, 'https://www.amazon.in/n/dp/B0' || lpad(CAST(product_id AS VARCHAR), CAST(greatest(8, length(CAST(product_id AS VARCHAR))) AS INT), '0') AS product_url,
      'https://m.media-amazon.com/images/I/' || CAST(product_id AS VARCHAR) || '._SL1500_.jpg' AS image_url FROM v_listings
    UNION ALL SELECT product_id, 1, 'Amazon Product', 'https://other.example.com/p' || CAST(product_id AS VARCHAR), 'x.png' FROM v_listings WHERE product_id % 3 <> 0""",
)
def result_cards(t: Tables) -> DataFrame:
    return P.card_links(t.search_html)


@query(
    "page_images",
    """SELECT page_id, image_url, priority, CAST(row_number() OVER (PARTITION BY page_id ORDER BY priority, position) AS INT) AS scan_order FROM (
      SELECT product_id AS page_id, 'https://img.example.com/a' || CAST(product_id AS VARCHAR) || '.jpg' AS image_url, 2 AS priority, 0 AS position FROM v_listings WHERE product_id % 3 = 0
      UNION ALL SELECT product_id, 'https://img.example.com/b.png', 2, 1 FROM v_listings WHERE product_id % 3 = 0
      UNION ALL SELECT product_id, 'https://m.media-amazon.com/images/I/' || CAST(product_id AS VARCHAR) || 'aB._UL1500_.jpg', 2, 2 FROM v_listings
      UNION ALL SELECT product_id, 'https://m.media-amazon.com/images/I/' || CAST(product_id % 7 AS VARCHAR) || 'zz._UL1500_.jpg', 1, 3 FROM v_listings)""",
)
def page_images(t: Tables) -> DataFrame:
    return P.page_images(t.listing_html).select("page_id", "image_url", "priority", "scan_order")


@query(
    "page_url_facts",
    """SELECT page_id, 'B0' || lpad(CAST(page_id AS VARCHAR), CAST(greatest(8, length(CAST(page_id AS VARCHAR))) AS INT), '0') AS item_code, false AS is_image, NULL AS plain_image FROM v_html
    UNION ALL SELECT page_id, NULL, false, NULL FROM pages
    UNION ALL SELECT product_id, NULL, true, 'https://m.media-amazon.com/images/I/' || CAST(product_id AS VARCHAR) || 'aB.jpg' FROM v_listings
    UNION ALL SELECT product_id, NULL, product_id % 2 = 0, 'https://r/image/1664/1664/a' || CAST(product_id AS VARCHAR) || CASE WHEN product_id % 2 = 0 THEN '.WEBP?q=1' ELSE '.svg' END FROM v_listings""",
)
def page_url_facts(t: Tables) -> DataFrame:
    number = F.col("product_id").cast("string")
    photo = t.listings.select(F.col("product_id").alias("page_id"), F.concat(F.lit("https://m.media-amazon.com/images/I/"), number, F.lit("aB._SX38_.jpg")).alias("url"))
    ending = F.when(F.col("product_id") % 2 == 0, ".WEBP?q=1").otherwise(".svg")
    sized = t.listings.select(F.col("product_id").alias("page_id"), F.concat(F.lit("https://r/image/312/312/a"), number, ending).alias("url"))
    pages = t.listing_html.select("page_id", "url").unionByName(t.pages.select("page_id", "url")).withColumn("picture", F.lit(False))
    urls = pages.unionByName(photo.unionByName(sized).withColumn("picture", F.lit(True)))
    url = F.col("url")
    return urls.select("page_id", P.item_code(url).alias("item_code"), P.is_image_url(url).alias("is_image"), F.when(F.col("picture"), P.canonical_image(url)).alias("plain_image"))
