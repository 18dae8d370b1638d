"""Stored product pages to listing rows, links and images.

A page is opened with a few pattern scans of its whole text. Layers are tried in order and the first
that gives a value wins: structured data, meta tags, specification tables, visible text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.amounts import positive_price
from tallymark.functions.text import clean_text, inner_text, unescape, visible_text
from tallymark.operators import markup

# Markup shapes.
LD_JSON = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
SPEC_TAG = r"(?is)^<div\s[^>]*(?:id=[\"']detailBullets_feature_div[\"']|class=[\"'][^\"']*(?:spec|attribute)[^\"']*[\"'])"
STRUCTURED = r"(?i)<(?:table|dl|div)[\s>]"
SHOP_SUFFIX = r"(?i)\s*[:|\-]\s*(?:Amazon|Flipkart|BigBasket|Blinkit|Zepto|JioMart).*$"
DEFAULT_NAME = "Packaged Commodity Product"
HEADINGS = ["country of origin", "country/region of origin", "origin", "country"]
PLACE_HINT = r"(?i)(?:\b\d{6}\b|plot|road|street|industrial|area|estate|lane|nagar|phase|dist|state)"

# Words in a specification key that decide its column; the first listed column wins.
# A column is (any of these, none of those).
SPEC_KEYS = {
    "mrp": (["mrp", "maximum retail price"], []),
    "selling_price": (["selling price", "deal price", "our price"], []),
    "net_quantity": (
        ["net quantity", "net weight", "net qty", "net wt", "pack size", "volume", "item weight", "quantity"], []
    ),
    "country_of_origin": (["country of origin", "country as labeled", "origin", "made in", "manufactured in"], []),
    "manufacturer": (["manufacturer"], ["address", "packer", "importer"]),
    "manufacturer_address": (["manufacturer address"], []),
    "packer": (["packer"], ["address"]),
    "packer_address": (["packer address"], []),
    "importer": (["importer"], ["address"]),
    "importer_address": (["importer address"], []),
    "brand": (["brand"], []),
    "manufacture_date": (["manufacturing date", "mfg date", "date of manufacture", "manufactured on", "mfd"], []),
    "packing_date": (["packing date", "packed on", "date of packing", "date of packaging", "pkd"], []),
    "best_before": (["expiry date", "exp date", "expiry", "best before", "use by", "shelf life"], []),
    "batch_number": (["batch no", "batch number", "lot no", "lot number"], []),
    "consumer_care": (["consumer care", "customer care", "customer service", "helpline", "toll free", "contact us"], []),
    "ingredients": (["ingredient"], []),
}

# Declarations in running text.
DATE = (
    r"([0-9]{1,2}[\-/][0-9]{1,2}[\-/][0-9]{2,4}|[0-9]{1,2}[\-/][0-9]{4}"
    r"|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[\s\-/\.]*[0-9]{2,4})"
)
TEXT_SHAPES = {
    "mrp": r"(?i)(?:M\.R\.P\.?|MRP|Maximum\s+Retail\s+Price)[\s:\-]*(?:₹|Rs\.?|INR)?\s*(\d+(?:,\d+)*(?:\.\d{1,2})?)",
    "net_quantity": r"(?i)(?:Net\s*(?:Qty|Quantity|Wt\.?|Weight)|Pack\s*Size|Contents?)\s*[:\-]?\s*(\d+(?:\.\d+)?\s*"
    r"(?:grams?|gms?|g|kg|kilograms?|ml|millilitres?|ltr?|litres?|l|pcs|pieces?|units?|count)\b)",
    "country_of_origin": r"(?i)(?:Country\s+of\s+Origin|Made\s+in|Product\s+of|Manufactured\s+in)\s*[:\-]?\s*([A-Za-z\s]{3,30})(?:[,\.;\n]|$)",
    "manufacture_date": r"(?i)(?:Mfg\.?\s*(?:Date)?|Date\s+of\s+Manufacture|Manufactured\s*(?:on|date)?|MFD)\s*[:\-]?\s*" + DATE,
    "packing_date": r"(?i)(?:PKD|Packed\s*On|Date\s+of\s+Packing)\s*[:\-]?\s*" + DATE,
    "batch_number": r"(?i)\b(?:Batch\s*(?:No\.?|Number)?|Lot\s*(?:No\.?|Number)?)\b\s*[:\-]?\s*([A-Za-z0-9\-_]{3,25})",
}
EMAIL = r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b"
PHONE = r"\b(1800[\s\-]?\d{3}[\s\-]?\d{3,4}|1860[\s\-]?\d{3}[\s\-]?\d{3,4}|0\d{2,4}[\s\-]?\d{6,8}|\+?91[\s\-]?\d{10})\b"
EMAIL_NOISE = "example|schema|amazon|flipkart|w3"

# Image links, item codes and packaging hints.
IMAGE_SUFFIX = r"\.(?:jpg|jpeg|png|webp|bmp|tiff)$"
IMAGE_ID = r"/images/I/([A-Za-z0-9\+\-]+)"
CDN_IMAGE = "https://m.media-amazon.com/images/I/"
IMAGE_NOISE = "icon|sprite|play|video|transparent|pixel|badge"
ITEM_CODE = r"/(?:dp|gp/product|d)/([A-Za-z0-9]{10})"
PACKAGING_HINT = "nutrition|ingredient|facts|back|details|panel|table|label|statutory"

# Price nodes of product pages, in order; the first one with a price counts.
PRICE_NODES = [
    r"(?is)<span[^>]*class=[\"'][^\"']*\ba-price\b[^\"']*[\"'][^>]*>\s*<span[^>]*class=[\"'][^\"']*\ba-offscreen\b[^\"']*[\"'][^>]*>(.*?)</span>",
    r"(?is)<span[^>]*id=[\"']priceblock_ourprice[\"'][^>]*>(.*?)</span>",
    r"(?is)<div[^>]*class=[\"'][^\"']*\b_30jeq3\b[^\"']*[\"'][^>]*>(.*?)</div>",
    r"(?is)<span[^>]*id=[\"']priceblock_dealprice[\"'][^>]*>(.*?)</span>",
]


@dataclass(frozen=True)
class Shop:
    """How a shop's result pages show a product: where a card opens, its title, and how links and images are completed."""

    host: str
    card: str
    title: list[str]
    root: str
    default_title: str | None = None
    image: tuple[str, str] | None = None


def by_class(tags: str, names: str) -> str:
    return rf"(?is)<(?:{tags})[^>]*class=[\"'](?:[^\"']*\s)?(?:{names})(?:\s[^\"']*)?[\"'][^>]*>"


# Card shapes by shop; the last one fits any shop.
SHOPS = [
    Shop(
        "amazon",
        r"(?is)<div[^>]*data-component-type=[\"']s-search-result[\"'][^>]*>",
        [r"(?is)<h2[^>]*>(.*?)</h2>", by_class("span", "a-text-normal") + "(.*?)</span>"],
        "https://www.amazon.in",
        "Amazon Product",
        (r"\._[A-Z0-9_,]+_\.", "._SL1500_."),
    ),
    Shop(
        "flipkart",
        by_class("div", "_1AtVbE|_1xHGKw|_2kHMtA|_4ddW1b"),
        [by_class("div|a", "_4rR01T|s1Q98W|IRpwTa") + "(.*?)</(?:div|a)>"],
        "https://www.flipkart.com",
        "Flipkart Product",
        (r"/image/\d+/\d+/", "/image/832/832/"),
    ),
    Shop(
        "bigbasket",
        by_class("div|li", "product-deck|paginated-item|SKUContainer-sc"),
        [by_class("a", "ng-binding") + "(.*?)</a>", r"(?is)<h3[^>]*>(.*?)</h3>", r"(?is)<div[^>]*class=[\"'][^\"']*name[^\"']*[\"'][^>]*>(.*?)</div>"],
        "https://www.bigbasket.com",
    ),
    Shop(
        "",
        r"(?is)<article[^>]*>|<div[^>]*class=[\"'][^\"']*(?:product|item|card)[^\"']*[\"'][^>]*>",
        [r"(?is)<h[234][^>]*>(.*?)</h[234]>", r"(?is)<a[^>]*>(.*?)</a>", r"(?is)<img[^>]*alt=[\"']([^\"']*)[\"']"],
        "",
    ),
]

LD_SCHEMA = (
    "array<struct<`@type` string, `@graph` array<struct<`@type` string, name string, description string, category string, brand string, "
    "manufacturer string, countryOfOrigin string, weight string, offers string, image string>>, name string, description string, "
    "category string, brand string, manufacturer string, countryOfOrigin string, weight string, offers string, image string>>"
)
LD_PARTS = ["@type", "name", "description", "category", "brand", "manufacturer", "countryOfOrigin", "weight", "offers", "image"]


def products_in(html: Column) -> Column:
    """Product entries of all structured-data blocks, graphs opened; a broken block adds nothing."""
    blocks = F.transform(
        F.regexp_extract_all(html, F.lit(LD_JSON), F.lit(1)), lambda b: F.from_json(b, LD_SCHEMA, {"mode": "PERMISSIVE"})
    )
    items = F.flatten(F.filter(blocks, lambda b: b.isNotNull()))

    def plain(item: Column) -> Column:
        return F.struct(*[item.getField(p).alias(p) for p in LD_PARTS])

    opened = F.flatten(
        F.transform(
            items,
            lambda i: F.when(i.getField("@graph").isNotNull(), F.transform(i.getField("@graph"), plain)).otherwise(F.array(plain(i))),
        )
    )
    return F.filter(opened, lambda p: p.getField("@type").isin("Product", "IndividualProduct"))


def first_of(items: Column, value) -> Column:
    """First non-blank value over a list."""
    return F.try_element_at(F.filter(F.transform(items, value), lambda v: v.isNotNull() & (v != "")), F.lit(1))


def named(value: Column) -> Column:
    """A property given as text, or as an object with a name."""
    return clean_text(F.when(F.startswith(value, F.lit("{")), F.get_json_object(value, "$.name")).otherwise(value))


def amount(value: Column) -> Column:
    unit = F.coalesce(F.get_json_object(value, "$.unitText"), F.get_json_object(value, "$.unitCode"), F.lit(""))
    joined = F.concat_ws(" ", F.get_json_object(value, "$.value"), unit)
    return clean_text(F.when(F.startswith(value, F.lit("{")), joined).otherwise(value))


def offer_price(offers: Column, *keys: str) -> Column:
    """Price from one offer or from the first of a list that states one."""
    paths = [F.get_json_object(offers, f"$.{k}") for k in keys] + [F.get_json_object(offers, f"$[0].{k}") for k in keys]
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in paths])


def meta(html: Column, name: str) -> Column:
    """Content of a meta tag, whichever way round its attributes stand."""
    tag = rf"(?is)<meta[^>]*(?:property|name)=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']"
    turned = rf"(?is)<meta[^>]*content=[\"']([^\"']*)[\"'][^>]*(?:property|name)=[\"']{name}[\"']"
    found = [F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in (tag, turned)]
    return clean_text(unescape(F.coalesce(*found)))


def spec_entries(html: Column) -> Column:
    """Key and value of every specification on the page, in page order: tables, definitions, bullets."""

    def entry(key: Column, value: Column) -> Column:
        return F.struct(F.lower(key).alias("key"), value.alias("value"))

    def line(text: Column) -> Column:
        return entry(clean_text(F.regexp_extract(text, r"^([^:]*):(.*)$", 1)), clean_text(F.regexp_extract(text, r"^([^:]*):(.*)$", 2)))

    def found(page: markup.Markup) -> Column:
        pairs = F.transform(F.concat(markup.table_pairs(page), markup.term_pairs(page)), lambda p: entry(p["key"], p["value"]))
        lines = F.filter(markup.marked_lines(page), lambda t: F.contains(t, F.lit(":")))
        return F.filter(F.concat(pairs, F.transform(lines, line)), lambda e: (e.key != "") & (e.value != ""))

    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.when(F.rlike(html, F.lit(STRUCTURED)), markup.indexed(html, SPEC_TAG, found)).otherwise(none)


def spec_column(key: Column) -> Column:
    """Listing column a specification key speaks about."""
    plain = F.trim(F.translate(key, "-_", "  "))
    expr = F.lit(None)
    for column, (some, none) in reversed(list(SPEC_KEYS.items())):
        hit = F.lit(False)
        for word in some:
            hit = hit | F.contains(plain, F.lit(word))
        for word in none:
            hit = hit & ~F.contains(plain, F.lit(word))
        expr = F.when(hit, column).otherwise(expr)
    return expr


def as_price(value: Column) -> Column:
    """Price text in one format."""
    number = positive_price(value)
    return F.when(number.isNotNull(), F.concat(F.lit("₹"), F.format_string("%.2f", number)))


def listings_of(pages: DataFrame) -> DataFrame:
    """One listing row per page. ``pages`` has page_id, url and html."""
    html = F.col("html")
    opened = pages.select("page_id", "url", "html").withColumns(
        {
            "_ld": products_in(html),
            "_specs": spec_entries(html),
            "_text": F.coalesce(visible_text(html), F.lit("")),
        }
    )
    opened = opened.withColumn(
        "_specs", F.transform("_specs", lambda e: F.struct(spec_column(e.key).alias("column"), e.key.alias("key"), e.value.alias("value")))
    )

    def ld(part: str, read=clean_text) -> Column:
        return first_of(F.col("_ld"), lambda p: read(p.getField(part)))

    def spec(column: str, last: bool = False) -> Column:
        hits = F.filter("_specs", lambda e: e.column == column)
        if last:
            hits = F.reverse(F.filter(hits, lambda e: ~F.lower(F.trim(e.value)).isin(HEADINGS)))
        return F.try_element_at(F.transform(hits, lambda e: e.value), F.lit(1))

    def text(column: str) -> Column:
        return clean_text(F.nullif(F.regexp_extract("_text", TEXT_SHAPES[column], 1), F.lit("")))

    title = clean_text(F.regexp_replace(clean_text(unescape(F.regexp_extract(html, TITLE, 1))), SHOP_SUFFIX, ""))
    stated_origin = text("country_of_origin")
    short_origin = F.when(F.size(F.split(stated_origin, " ")) <= 4, stated_origin)
    batch = text("batch_number")
    emails = F.filter(
        F.regexp_extract_all("_text", F.lit(EMAIL), F.lit(1)), lambda e: ~F.rlike(F.lower(e), F.lit(EMAIL_NOISE))
    )
    contact = F.nullif(
        F.concat_ws(", ", F.try_element_at(emails, F.lit(1)), F.nullif(F.regexp_extract("_text", PHONE, 1), F.lit(""))), F.lit("")
    )
    offers = lambda *keys: first_of(F.col("_ld"), lambda p: offer_price(p.getField("offers"), *keys))
    rows = opened.select(
        "page_id",
        "url",
        F.coalesce(ld("name"), meta(html, "og:title"), title, F.lit(DEFAULT_NAME)).alias("product_name"),
        F.coalesce(ld("description"), meta(html, "og:description"), meta(html, "description")).alias("description"),
        F.coalesce(ld("category"), F.lit("Packaged Foods")).alias("category"),
        F.coalesce(ld("brand", named), spec("brand")).alias("brand"),
        F.coalesce(as_price(offers("highPrice")), as_price(spec("mrp")), as_price(text("mrp"))).alias("_mrp"),
        F.coalesce(
            as_price(offers("price", "lowPrice")), as_price(meta(html, "(?:product|og):price:amount")), as_price(spec("selling_price")),
            *[as_price(inner_text(F.regexp_extract(html, node, 1))) for node in PRICE_NODES],
        ).alias("_sold"),
        F.coalesce(ld("weight", amount), spec("net_quantity"), text("net_quantity")).alias("net_quantity"),
        F.coalesce(spec("country_of_origin", True), ld("countryOfOrigin", named), short_origin).alias("country_of_origin"),
        F.coalesce(ld("manufacturer", named), spec("manufacturer")).alias("manufacturer"),
        spec("manufacturer_address").alias("_address"),
        *[spec(c).alias(c) for c in ("packer", "packer_address", "importer", "importer_address")],
        F.coalesce(spec("manufacture_date"), text("manufacture_date")).alias("manufacture_date"),
        F.coalesce(spec("packing_date"), text("packing_date")).alias("packing_date"),
        spec("best_before").alias("best_before"),
        F.coalesce(spec("batch_number"), F.when(F.rlike(batch, F.lit(r"\d")), batch)).alias("batch_number"),
        F.coalesce(spec("consumer_care"), contact).alias("consumer_care"),
        spec("ingredients").alias("ingredients"),
        (F.size("_ld") > 0).alias("structured_data"),
        (F.size("_specs") > 0).alias("product_specifications"),
    )
    low = positive_price(F.col("_mrp")) < positive_price(F.col("_sold"))
    address = F.coalesce("_address", F.when(F.rlike("manufacturer", F.lit(PLACE_HINT)), F.col("manufacturer")))
    return rows.withColumns(
        {
            "mrp": F.when(low, F.col("_sold")).otherwise(F.coalesce("_mrp", "_sold")),
            "selling_price": F.col("_sold"),
            "manufacturer_address": address,
        }
    ).drop("_mrp", "_sold", "_address")


def specs_of(pages: DataFrame) -> DataFrame:
    """Long specifications per page; a repeated key keeps its last value."""
    entries = pages.select("page_id", F.posexplode_outer(spec_entries(F.col("html"))).alias("position", "e")).where(F.col("e").isNotNull())
    window = Window.partitionBy("page_id", "key").orderBy(F.col("position").desc())
    long = entries.select("page_id", "position", "e.key", "e.value")
    return long.withColumn("_n", F.row_number().over(window)).where(F.col("_n") == 1).drop("_n")


def card_links(pages: DataFrame) -> DataFrame:
    """Product cards of result pages: title, absolute link without tracking, full-size image.

    ``pages`` has page_id, html and, if known, url. The shop is told by the page's host, or else by the first card shape that the page has. A card reaches from
    its opening tag to the next card or the end of the page; cards without a link are left out.
    """
    url = F.col("url") if "url" in pages.columns else F.lit("")
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1))
    number = F.lit(len(SHOPS) - 1)
    for i, shop in reversed(list(enumerate(SHOPS[:-1]))):
        number = F.when(F.rlike("html", F.lit(shop.card)), F.lit(i)).otherwise(number)
    for i, shop in reversed(list(enumerate(SHOPS[:-1]))):
        number = F.when(F.contains(host, F.lit(shop.host)), F.lit(i)).otherwise(number)

    def of_shop(build) -> Column:
        expr = F.lit(None)
        for i, shop in reversed(list(enumerate(SHOPS))):
            expr = F.when(F.col("_shop") == i, build(shop)).otherwise(expr)
        return expr

    opened = pages.select("page_id", "html", F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1).alias("_root"), number.alias("_shop"))
    pieces = of_shop(lambda shop: F.split("html", shop.card, -1))
    cards = opened.select("page_id", "_root", "_shop", F.posexplode_outer(F.slice(pieces, F.lit(2), F.size(pieces))).alias("position", "card"))
    card = F.col("card")
    href = unescape(F.regexp_extract(card, r"(?is)<a[^>]*href=[\"']([^\"']+)[\"']", 1))
    image = F.regexp_extract(card, r"(?is)<img[^>]*\ssrc=[\"']([^\"']*)[\"']", 1)

    def title(shop: Shop) -> Column:
        named = [F.nullif(F.coalesce(inner_text(F.regexp_extract(card, t, 1)), F.lit("")), F.lit("")) for t in shop.title]
        return F.coalesce(*named, F.lit(shop.default_title))

    root = of_shop(lambda shop: F.lit(shop.root) if shop.root else F.col("_root"))
    absolute = F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(root, href))
    return cards.where(href != "").select(
        "page_id",
        "position",
        of_shop(title).alias("title"),
        F.split(absolute, "/ref=").getItem(0).alias("product_url"),
        of_shop(lambda shop: F.regexp_replace(image, *shop.image) if shop.image else image).alias("image_url"),
    )


def is_image_url(url: Column) -> Column:
    return F.rlike(F.lower(F.split(url, r"\?").getItem(0)), F.lit(IMAGE_SUFFIX))


def item_code(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, ITEM_CODE, 1), F.lit(""))


def canonical_image(url: Column, large: bool = False) -> Column:
    """Image link without size variants, so the same photograph has one link."""
    image = F.regexp_extract(url, IMAGE_ID, 1)
    cdn = F.rlike(url, F.lit("(?:media-amazon|images-amazon)[.]com/images/I/"))
    suffix = "._UL1500_.jpg" if large else ".jpg"
    other = F.regexp_replace(url, r"/image/\d+/\d+/", "/image/1664/1664/")
    return F.when(cdn & (image != ""), F.concat(F.lit(CDN_IMAGE), image, F.lit(suffix))).otherwise(other)


def page_images(pages: DataFrame) -> DataFrame:
    """Distinct images per page, packaging panels first, each with its priority.

    Sources in order: gallery script, structured data, preview tag, image tags. The first time an
    image is seen counts.
    """
    html = F.col("html")
    empty = F.lit("")

    def pair(url: Column, hint: Column) -> Column:
        return F.struct(url.alias("url"), hint.alias("hint"))

    gallery = F.transform(
        F.regexp_extract_all(html, F.lit(r'"(?:hiRes|large)"\s*:\s*"(https:[^"]+)"'), F.lit(1)),
        lambda u: pair(F.replace(u, F.lit("\\/"), F.lit("/")), empty),
    )
    structured = F.flatten(
        F.transform(
            products_in(html),
            lambda p: F.transform(
                F.regexp_extract_all(F.coalesce(p.getField("image"), empty), F.lit(r'(https?://[^"\s,\]]+)'), F.lit(1)), lambda u: pair(u, empty)
            ),
        )
    )
    preview = F.filter(F.array(pair(meta(html, "og:image"), empty)), lambda p: p.url.isNotNull())
    tags = F.transform(
        F.regexp_extract_all(html, F.lit(r"(?is)(<img[^>]*>)"), F.lit(1)),
        lambda t: pair(
            F.coalesce(
                *[F.nullif(F.regexp_extract(t, rf"(?is)\s{a}=[\"']([^\"']+)[\"']", 1), empty) for a in ("data-old-hires", "data-src", "src")]
            ),
            F.regexp_extract(t, r"(?is)\salt=[\"']([^\"']*)[\"']", 1),
        ),
    )
    found = pages.select("page_id", F.posexplode_outer(F.concat(gallery, structured, preview, tags)).alias("position", "i"))
    links = found.select(
        "page_id",
        "position",
        canonical_image(F.col("i.url"), True).alias("image_url"),
        F.when(F.rlike(F.lower("i.hint"), F.lit(PACKAGING_HINT)), 1).otherwise(2).alias("priority"),
    ).where(F.startswith("image_url", F.lit("http")) & ~F.rlike(F.lower(F.regexp_extract("image_url", IMAGE_ID, 1)), F.lit(IMAGE_NOISE)))
    first = Window.partitionBy("page_id", "image_url").orderBy("position")
    distinct = links.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")
    order = Window.partitionBy("page_id").orderBy("priority", "position")
    return distinct.withColumn("scan_order", F.row_number().over(order))
