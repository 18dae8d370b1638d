"""Label-compliance tables derived from the generic star-schema and text tables.

The given tables hold no label scans, so each business table is a projection of a given one: one
scan per event, one label and one web listing per part. The select lists below are plain SQL that
Spark and DuckDB both understand, so a query and its check read the same rows at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

SCANS = {
    "scan_id": "event_id",
    "created_at": "ts",
    "user_id": "user_id",
    "gtin": "concat('8901', lpad(regexp_extract(props, '([0-9]+)', 1), CAST(greatest(9, length(regexp_extract(props, '([0-9]+)', 1))) AS INT), '0'))",
    "batch_code": "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 4 THEN '  ' ELSE concat('L', CAST(event_id % 4 AS STRING)) END",
    "compliance_status": f"""CASE WHEN event_type = 'error' THEN 'non_compliant'
        WHEN {K} % 3 = 0 THEN 'compliant'
        WHEN {K} % 3 = 1 AND event_type <> 'click' THEN 'non_compliant'
        WHEN event_type = 'view' THEN 'partial_review_needed'
        ELSE 'compliant' END""",
    "calibration_tier": "CASE event_id % 7 WHEN 0 THEN 'ar_verified' WHEN 1 THEN 'reference_object' WHEN 2 THEN 'package_dimension' ELSE 'dpi_estimated' END",
    "user_role": "CASE user_id % 5 WHEN 0 THEN 'inspector' WHEN 1 THEN 'admin' WHEN 2 THEN 'viewer' WHEN 3 THEN 'citizen' ELSE 'anonymous' END",
    "category": "CASE user_id % 6 WHEN 0 THEN 'Beverages' WHEN 1 THEN 'Dairy' WHEN 2 THEN 'Staples' WHEN 3 THEN 'Biscuits' WHEN 4 THEN 'Tea' ELSE 'Packaged Foods' END",
    "scan_type": "CASE event_id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'batch' ELSE 'ecommerce' END",
    "confidence": "CAST((80 + event_id % 20) * 0.01 AS DECIMAL(5,2))",
    "product_name": f"""CASE event_id % 4 WHEN 0 THEN NULL
        WHEN 1 THEN concat('GTIN-', regexp_extract(props, '([0-9]+)', 1), ' item')
        ELSE concat('Pack ', CAST({K} % 17 AS STRING), ' no ', regexp_extract(props, '([0-9]+)', 1)) END""",
    "claimed_violation_type": """CASE WHEN user_id % 5 <> 3 THEN NULL
        WHEN event_id % 4 = 0 THEN 'Missing-MRP' WHEN event_id % 4 = 1 THEN 'undersized font'
        WHEN event_id % 4 = 2 THEN 'missing_origin' ELSE '' END""",
}

SCANS["tampered"] = "event_type = 'error' AND user_id % 9 = 3"
SCANS["scan_uid"] = "concat('LM-2026-', lpad(CAST(event_id AS STRING), CAST(greatest(9, length(CAST(event_id AS STRING))) AS INT), '0'))"

# Raw submissions as they reach the store: several optional sources per column, blanks and zeros.
SUBMISSIONS = {
    "scan_id": "event_id",
    "scan_id_text": "CASE WHEN event_type = 'signup' THEN concat('LM-2026-9', CAST(event_id AS STRING)) ELSE CAST(event_id AS STRING) END",
    "scan_uid": "CASE WHEN event_type = 'view' THEN concat('LM-2026-8', CAST(event_id AS STRING)) WHEN event_type = 'click' THEN '' ELSE NULL END",
    "product_name": "CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('Pack ', regexp_extract(props, '([0-9]+)', 1)) END",
    "product_title": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE concat('Title ', regexp_extract(props, '([0-9]+)', 1)) END",
    "details_name": "CASE WHEN event_id % 12 = 0 THEN '' ELSE 'Detail' END",
    "product_category": "CASE WHEN user_id % 4 = 0 THEN '' WHEN user_id % 4 = 1 THEN NULL ELSE 'Snacks' END",
    "category": "CASE WHEN user_id % 4 = 0 THEN 'Tea' ELSE '' END",
    "scan_type": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'batch' END",
    "compliance_status": "CASE event_type WHEN 'error' THEN 'Non-Compliant' WHEN 'click' THEN '' WHEN 'view' THEN NULL ELSE 'COMPLIANT' END",
    "final_result": "CASE event_type WHEN 'click' THEN 'Partial-Review-Needed' ELSE '' END",
    "overall_confidence": "CASE WHEN event_id % 4 = 0 THEN 0.0 WHEN event_id % 4 = 1 THEN NULL ELSE 0.9 END",
    "compliance_confidence": "CASE WHEN event_id % 8 = 0 THEN 0.0 ELSE 0.7 END",
    "ocr_confidence": "CASE WHEN event_id % 16 = 0 THEN 0.0 ELSE 0.6 END",
    "scanned_image_url": "CASE WHEN event_id % 2 = 0 THEN '' ELSE concat('img/', CAST(event_id AS STRING)) END",
    "gallery_url": "CASE WHEN event_id % 5 = 0 THEN concat('gallery/', CAST(event_id AS STRING)) ELSE NULL END",
    "created_at": "ts",
    "user_id": "user_id",
}

VIOLATIONS_MAIN = {
    "scan_id": "event_id",
    "field_name": "CASE event_id % 6 WHEN 0 THEN 'mrp' WHEN 1 THEN 'net_quantity' WHEN 2 THEN 'manufacture_date' WHEN 3 THEN 'manufacturer_name_address' WHEN 4 THEN 'consumer_care_details' ELSE 'country_of_origin' END",
    "violation_type": "CASE event_id % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'incorrect_format' ELSE 'undersized_font' END",
    "severity": "CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'critical' END",
}
VIOLATIONS_EXTRA = {
    "scan_id": "event_id",
    "field_name": "'net_quantity'",
    "violation_type": "'undersized_font'",
    "severity": "'medium'",
}
WHERE_MAIN = "event_type = 'error'"
WHERE_EXTRA = "event_type = 'error' AND event_id % 2 = 0"

LABELS = {
    "product_id": "p_partkey",
    "mrp_text": "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('MRP Rs. ', CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS STRING)) END",
    "quantity_text": """CASE WHEN p_partkey % 11 = 0 THEN concat('Approx ', CAST(p_size AS STRING))
        WHEN p_partkey % 3 = 0 THEN concat('Net Wt. ', CAST(p_size AS STRING), ' kg')
        ELSE concat('Net Wt. ', CAST(p_size * 10 AS STRING), ' g') END""",
    "mfg_text": "concat('Mfg: ', lpad(CAST(p_partkey % 28 + 1 AS STRING), 2, '0'), '/', lpad(CAST(p_partkey % 12 + 1 AS STRING), 2, '0'), '/2025')",
    "exp_text": """CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN concat('Best before ', CAST(p_partkey % 12 + 1 AS STRING), ' months from mfg')
        WHEN 2 THEN concat('Exp ', CAST(p_partkey % 28 + 1 AS STRING), CASE p_partkey % 3 WHEN 0 THEN ' Jan ' WHEN 1 THEN ' June ' ELSE ' Sept ' END, '2026')
        WHEN 3 THEN concat('2026-', lpad(CAST(p_partkey % 14 + 1 AS STRING), 2, '0'), '-', lpad(CAST(p_partkey % 28 + 1 AS STRING), 2, '0'))
        WHEN 4 THEN concat('Exp: ', lpad(CAST(p_partkey % 12 + 1 AS STRING), 2, '0'), '/2027')
        WHEN 5 THEN 'see crimp 2027' ELSE
        concat('Use By: ', lpad(CAST(p_partkey % 28 + 1 AS STRING), 2, '0'), '/', lpad(CAST(p_partkey % 12 + 1 AS STRING), 2, '0'), '/2026') END""",
    "address_text": """CASE p_partkey % 10 WHEN 0 THEN 'Made in India' WHEN 1 THEN 'Plot 4, Industrial Area, Pune' WHEN 2 THEN 'Unit 9, HR-123501'
        WHEN 3 THEN 'Vevey, Switzerland' WHEN 4 THEN 'Plot 12, Sector 5, 400057' WHEN 5 THEN 'unknown'
        WHEN 6 THEN 'Manufactured by: Sunrise Foods Pvt. Ltd., Sonipat, Haryana'
        WHEN 7 THEN CASE p_size % 5 WHEN 0 THEN 'Product of United Kingdom, bottled in Goa' WHEN 1 THEN 'Country of Origin: ITALY' WHEN 2 THEN 'Works at Navi Mumbai and Greater Noida'
             WHEN 3 THEN 'Dairy of New South Wales' ELSE 'Imported by Lotus LLP, ka 560001' END
        WHEN 8 THEN '' ELSE CASE p_size % 4 WHEN 0 THEN 'Packed for sale in india only' WHEN 1 THEN 'Salem Road, Texas' WHEN 2 THEN 'Made in Wonderland, New Delhi' ELSE 'U.S.A. 99 Ohio' END END""",
    "care_text": """CASE p_partkey % 4 WHEN 0 THEN 'Customer Care: 1800-123-4567 care@example.com' WHEN 1 THEN 'Helpline 98765 43210'
        WHEN 2 THEN 'Write to us' ELSE '' END""",
    "brand": "p_brand",
    "category": "p_type",
    "p_size": "p_size",
    "name": "p_name",
}

# One declared field per line of a label; how it was read and its print height vary with the part.
FIELD_SOURCES = {
    "mrp": "mrp_text",
    "net_quantity": "quantity_text",
    "manufacture_date": "mfg_text",
    "expiry_date": "exp_text",
    "manufacturer_name_address": "address_text",
    "consumer_care_details": "care_text",
}
FIELD_METHOD = "CASE WHEN {value} = '' THEN 'not_found' WHEN (product_id + {n}) % 23 = 0 THEN 'genai_fallback' WHEN (product_id + {n}) % 3 = 0 THEN 'ocr_easyocr' ELSE 'ocr_tesseract' END"
FIELD_CONFIDENCE = "CASE WHEN {value} = '' THEN 0.0 WHEN (product_id + {n}) % 13 = 0 THEN 0.62 WHEN (product_id + {n}) % 7 = 0 THEN 0.68 ELSE 0.92 END"
FIELD_HEIGHT = "CAST(12 + (product_id * {n} + p_size) % 70 AS INT)"

# What the camera knew about a label, for turning pixels into millimetres.
CAMERA = {
    "scan_id": "p_partkey",
    "ar_px_per_mm": "CASE WHEN p_partkey % 7 = 0 THEN 12.5 ELSE NULL END",
    "ar_mm_per_px": "CASE WHEN p_partkey % 7 = 1 THEN 0.08 ELSE NULL END",
    "circle_px": "CASE WHEN p_partkey % 7 = 2 THEN 290.0 + p_size ELSE NULL END",
    "circle_mm": "CASE WHEN p_partkey % 7 = 2 THEN 24.26 ELSE NULL END",
    "image_width_px": "1000",
    "package_width_mm": "CASE WHEN p_partkey % 7 IN (3, 4) THEN 60.0 + p_size ELSE NULL END",
    "net_quantity_g": "CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_size * 1000.0 ELSE p_size * 10.0 END",
}

LISTINGS = {
    "product_id": "p_partkey",
    "product_name": "p_name",
    "brand": "p_brand",
    "mrp": "CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'Price on request' ELSE concat('Rs. ', CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS STRING)) END",
    "selling_price": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(CAST(p_retailprice AS DECIMAL(10,2)) + CAST(p_partkey % 3 - 1 AS DECIMAL(10,2)) AS STRING) END",
    "net_quantity": """CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN 'family pack' WHEN p_partkey % 5 = 0 THEN concat(CAST(p_size * 12 AS STRING), ' g')
        WHEN p_partkey % 6 = 0 THEN concat(CAST(p_size AS STRING), ' kg') ELSE concat(CAST(p_size * 10 AS STRING), ' g') END""",
    "country_of_origin": "CASE p_partkey % 4 WHEN 0 THEN 'India' WHEN 1 THEN 'Switzerland' ELSE NULL END",
    "manufacturer": "CASE p_partkey % 5 WHEN 0 THEN 'Sunrise Foods Private Limited' WHEN 1 THEN 'Alpine Milk AG, Vevey' WHEN 2 THEN NULL ELSE 'Plot Makers and Sons' END",
    "manufacturer_address": "CASE p_partkey % 3 WHEN 0 THEN 'Plot 12, Sector 5, 400057' WHEN 1 THEN NULL ELSE 'Bhopal' END",
    "packer": "CASE WHEN p_partkey % 6 = 1 THEN 'Metro Packers' ELSE NULL END",
    "importer": "CASE WHEN p_partkey % 8 = 1 THEN 'Harbour Imports, Mumbai' ELSE NULL END",
    "consumer_care": "CASE p_partkey % 3 WHEN 0 THEN 'care@example.com' ELSE NULL END",
    "manufacture_date": "CASE p_partkey % 4 WHEN 1 THEN concat('Mfg: ', lpad(CAST(p_partkey % 28 + 1 AS STRING), 2, '0'), '/03/2025') ELSE NULL END",
    "best_before": "CASE p_partkey % 6 WHEN 1 THEN 'Best before 9 months from manufacture' WHEN 2 THEN 'Exp 02/2024' ELSE NULL END",
}


LISTINGS["description"] = """CASE p_partkey % 9 WHEN 0 THEN 'Crisp biscuits, made in Italy' WHEN 1 THEN 'Tea manufactured in Assam' WHEN 2 THEN 'Made in Neverland'
        WHEN 3 THEN 'Product of Sri Lanka. Ceylon tea' ELSE 'Everyday pack' END"""
LISTINGS["spec_origin"] = "CASE WHEN p_partkey % 14 = 2 THEN 'Japan' ELSE NULL END"


LISTINGS["unit_text"] = "CASE WHEN p_partkey % 13 = 0 THEN concat('(Rs. ', CAST(p_size AS STRING), '.50 / 100 g)') ELSE NULL END"
LISTINGS["item_code"] = "CASE WHEN p_partkey % 3 = 0 THEN concat('B0', lpad(CAST(p_partkey AS STRING), CAST(greatest(8, length(CAST(p_partkey AS STRING))) AS INT), '0')) ELSE NULL END"
LISTINGS["ean"] = "CASE WHEN p_partkey % 4 = 1 THEN concat('890', lpad(CAST(p_partkey AS STRING), CAST(greatest(10, length(CAST(p_partkey AS STRING))) AS INT), '0')) ELSE NULL END"
LISTINGS["category"] = "CASE p_partkey % 8 WHEN 0 THEN 'Hot Beverages' WHEN 1 THEN 'dairy ' WHEN 2 THEN 'Staples' WHEN 3 THEN '' WHEN 4 THEN 'Assam Tea' WHEN 5 THEN 'Edible Oil' WHEN 6 THEN 'Packaged Foods & Tea' ELSE p_type END"
LISTINGS["household_size"] = "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(p_partkey % 13 AS INT) END"

NUTRITION = {
    "product_id": "p_partkey",
    "label_text": """concat(CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('Energy: ', CAST(p_size * 11 + 40 AS STRING), ' kcal ') END,
        CASE p_partkey % 4 WHEN 0 THEN concat('Protein ', CAST(p_size % 30 AS STRING), '.5 g ') WHEN 1 THEN concat(CAST(p_size % 20 AS STRING), ' g protein ') ELSE '' END,
        CASE WHEN p_partkey % 3 = 0 THEN concat('Total Sugars - ', CAST(p_size AS STRING), '.25g of which added sugars ', CAST(p_size % 17 AS STRING), ' g ') ELSE '' END,
        CASE WHEN p_partkey % 7 < 3 THEN concat('Total Fat: ', CAST(p_size % 40 AS STRING), ' Saturated fat ', CAST(p_size % 12 AS STRING), '.1 Trans fat 0.', CAST(p_size % 10 AS STRING), ' ') ELSE '' END,
        CASE p_partkey % 6 WHEN 0 THEN concat('Sodium ', CAST(p_size * 25 AS STRING), ' mg ') WHEN 1 THEN concat('Salt: ', CAST(p_size AS STRING), 'g ') ELSE '' END,
        CASE WHEN p_partkey % 9 = 0 THEN concat('CARBOHYDRATE ', CAST(p_size + 30 AS STRING), ' Dietary fibre 3.75 ') ELSE '' END,
        CASE WHEN p_partkey % 8 = 2 THEN concat('Serving size: ', CAST(p_size AS STRING), ' g. Ingredients: wheat flour, sugar, ', p_name, '. Keep dry') ELSE '' END)""",
}

# Three photographed sides per product; the back repeats and the flap restates declarations.
SIDES = {
    1: ("extracted_value", "extraction_method", "confidence"),
    2: (
        "CASE WHEN scan_id % 4 = 0 THEN '' ELSE concat(extracted_value, ' back') END",
        "CASE WHEN extraction_method = 'not_found' THEN 'ocr_easyocr' ELSE extraction_method END",
        "CASE WHEN scan_id % 3 = 0 THEN confidence ELSE 0.75 END",
    ),
    3: ("lower(extracted_value)", "CASE WHEN scan_id % 5 = 0 THEN 'not_found' ELSE 'genai_primary' END", "CASE WHEN scan_id % 2 = 0 THEN 0.97 ELSE 0.0 END"),
}


# Text blocks of a label: (text, x, y, w, h). Headings and values stand beside or above each other.
TOKENS = [
    ("CASE product_id % 4 WHEN 0 THEN CASE WHEN mrp_text = '' THEN 'M.R.P' ELSE mrp_text END WHEN 1 THEN 'MRP' WHEN 2 THEN 'MRF' ELSE 'MAXIMUM RETAIL PRICE' END", "10", "40", "60", "20"),
    ("CASE WHEN product_id % 4 = 0 OR mrp_text = '' THEN '(Incl. of all taxes)' WHEN product_id % 3 = 0 THEN concat('Rs ', substr(mrp_text, 9), '/-') ELSE substr(mrp_text, 5) END", "90 + product_id % 90", "40 + product_id % 8", "80", "20"),
    ("CASE product_id % 5 WHEN 0 THEN quantity_text WHEN 1 THEN 'NET WT' WHEN 2 THEN 'Net Qty.' WHEN 3 THEN 'NFT WEIGHT' ELSE 'FOR 64 g' END", "10", "90", "70", "18"),
    ("CASE WHEN product_id % 5 = 0 THEN 'Serving 25 g' ELSE replace(replace(quantity_text, 'Net Wt. ', ''), 'Approx ', '') END", "CASE WHEN product_id % 2 = 0 THEN 100 ELSE 14 END", "CASE WHEN product_id % 2 = 0 THEN 92 ELSE 118 END", "60", "18"),
    ("CASE product_id % 3 WHEN 0 THEN mfg_text WHEN 1 THEN 'PKD.' ELSE 'MFG DATE' END", "10", "150", "60", "16"),
    ("CASE WHEN product_id % 3 = 0 THEN 'Batch No. ABC' ELSE substr(mfg_text, 6) END", "95", "151", "90", "16"),
    ("CASE product_id % 4 WHEN 0 THEN 'USE BY' WHEN 1 THEN exp_text WHEN 2 THEN 'EXPIRY' ELSE 'Keep dry' END", "10", "185", "70", "16"),
    ("CASE WHEN product_id % 8 = 4 THEN substr(mfg_text, 6) ELSE CASE WHEN length(exp_text) > 8 THEN substr(exp_text, 9) ELSE ' ' END END", "110", "186", "90", "16"),
    ("CASE product_id % 3 WHEN 0 THEN 'Manufactured by:' WHEN 1 THEN 'MKTD BY' ELSE brand END", "10", "420", "120", "18"),
    ("CASE WHEN product_id % 6 = 2 THEN 'Sunrise Foods Pvt. Ltd., Plot No. 7, Industrial Area, Pune 411001' ELSE address_text END", "12", "445", "300", "18"),
    ("CASE product_id % 3 WHEN 0 THEN 'CUSTOMER CARE' WHEN 1 THEN care_text ELSE 'Phone No.' END", "420", "40", "130", "18"),
    ("CASE WHEN product_id % 3 = 1 THEN 'USP Rs. 0.14/g' ELSE care_text END", "425", "66", "150", "18"),
    ("CASE product_id % 4 WHEN 0 THEN 'Country of Origin' WHEN 1 THEN 'B.No: L24-001' WHEN 2 THEN 'LOT 77/A' ELSE concat(name, ' biscuits') END", "420", "430", "150", "18"),
    ("CASE product_id % 4 WHEN 0 THEN 'India' WHEN 1 THEN 'Energy 480 kcal Protein 7 g' ELSE 'Lot: 09/25-A' END", "600", "432", "90", "18"),
]
TOKEN_CONFIDENCE = "CASE WHEN (product_id + {n}) % 10 = 0 THEN NULL ELSE CAST(0.5 + ((product_id + {n}) % 50) * 0.01 AS DOUBLE) END"
TOKEN_ENGINE = "CASE (product_id + {n}) % 3 WHEN 0 THEN 'easyocr' WHEN 1 THEN 'tesseract' ELSE NULL END"


def token_row(n: int) -> str:
    text, x, y, w, h = TOKENS[n - 1]
    return (
        f"CAST({n} AS BIGINT) AS token_id, {text} AS text, CAST({x} AS INT) AS x, CAST({y} AS INT) AS y, CAST({w} AS INT) AS w, CAST({h} AS INT) AS h, "
        f"{TOKEN_CONFIDENCE.format(n=n)} AS confidence, {TOKEN_ENGINE.format(n=n)} AS engine"
    )


# The same label read by two engines: the second shifts boxes a little, drops none and adds one.
BLOCKS = {
    "tesseract": ("token_id", "x", "y", "w", "h"),
    "easyocr": ("token_id + 100", "x + scan_id % 23", "y + token_id % 5", "w - scan_id % 7", "h + token_id % 3"),
}

# A scanned code per label and where it stands.
CODES = {
    "scan_id": "p_partkey",
    "code_text": """CASE p_partkey % 9 WHEN 0 THEN concat('890', lpad(CAST(p_partkey AS STRING), CAST(greatest(10, length(CAST(p_partkey AS STRING))) AS INT), '0')) WHEN 1 THEN lpad(CAST(p_partkey AS STRING), CAST(greatest(12, length(CAST(p_partkey AS STRING))) AS INT), '1')
        WHEN 2 THEN lpad(CAST(p_partkey AS STRING), CAST(greatest(8, length(CAST(p_partkey AS STRING))) AS INT), '4') WHEN 3 THEN concat('https://id.gs1.org/01/0890', lpad(CAST(p_partkey AS STRING), CAST(greatest(10, length(CAST(p_partkey AS STRING))) AS INT), '0'))
        WHEN 4 THEN concat('(01)0890', lpad(CAST(p_partkey AS STRING), CAST(greatest(10, length(CAST(p_partkey AS STRING))) AS INT), '0'), '(10)B', CAST(p_size AS STRING)) WHEN 5 THEN 'https://example.com/p'
        WHEN 6 THEN lpad(CAST(p_partkey AS STRING), CAST(greatest(14, length(CAST(p_partkey AS STRING))) AS INT), '2') WHEN 7 THEN lpad(CAST(p_partkey AS STRING), CAST(greatest(9, length(CAST(p_partkey AS STRING))) AS INT), '7') ELSE concat(' ', lpad(CAST(p_partkey AS STRING), CAST(greatest(13, length(CAST(p_partkey AS STRING))) AS INT), '9'), ' ') END""",
    "code_format": "CASE p_partkey % 9 WHEN 0 THEN 'EAN-13' WHEN 1 THEN 'UPC_A' WHEN 2 THEN 'EAN8' WHEN 6 THEN 'ITF-14' WHEN 8 THEN 'EAN8' ELSE 'QRCODE' END",
    "bx": "CASE WHEN p_partkey % 2 = 0 THEN 600 ELSE 20 END",
    "by": "CASE WHEN p_partkey % 2 = 0 THEN 470 ELSE 210 END",
    "bw": "80",
    "bh": "40",
}


# Product pages built from the listings: structured data, tables, definitions, bullets or plain text.
HTML = {
    "page_id": "product_id",
    "url": "concat('https://shop.example.com/x/dp/B0', lpad(CAST(product_id AS STRING), CAST(greatest(8, length(CAST(product_id AS STRING))) AS INT), '0'), '?ref=a')",
    "html": """concat('<html><head><title>', product_name, ' &amp; more | Flipkart offers</title><meta name="description" content="Fresh ', brand, '"/>',
      CASE product_id % 3 WHEN 0 THEN concat('<script type="application/ld+json">{"@context":"x","@type":"Product","name":"', product_name, ' LD","brand":{"name":"', brand, '"},"offers":{"price":"', coalesce(selling_price, ''),
           '","highPrice":"', coalesce(selling_price, ''), '"},"weight":{"value":', CAST(product_id % 90 + 1 AS STRING), ',"unitText":"g"},"image":["https://img.example.com/a', CAST(product_id AS STRING), '.jpg","https://img.example.com/b.png"]}</script>')
        WHEN 1 THEN concat('<meta content="', product_name, ' OG" property="og:title"/><script type="application/ld+json">{"@graph":[{"@type":"WebSite","name":"w"},{"@type":"Product","manufacturer":"', coalesce(manufacturer, ''), '"}]}</script>') ELSE '<script type="application/ld+json">{broken</script>' END,
      '</head><body>', CASE product_id % 4 WHEN 0 THEN concat('<table class="t"><tr><th>Net Quantity</th><td><b>', coalesce(net_quantity, ''), '</b></td></tr><tr><td>Country of Origin</td><td>', coalesce(country_of_origin, 'Origin'), '</td></tr><tr><td>Packer</td><td>Metro&nbsp;Packers</td></tr></table>')
        WHEN 1 THEN concat('<dl><dt>MRP (incl. tax)</dt><dd>Rs. ', coalesce(selling_price, '0'), '</dd><dt>Manufacturer Address</dt><dd>', coalesce(manufacturer_address, 'Plot 9'), '</dd></dl>')
        WHEN 2 THEN concat('<div class="product-spec list"><ul><li>Shelf Life: 9 months</li><li>Importer : ', coalesce(importer, 'none'), '</li><li>no colon</li></ul></div>')
        ELSE concat('<p>MRP: Rs. ', coalesce(selling_price, '0'), ' Net Wt: ', CAST(product_id % 70 + 5 AS STRING), ' g. Made in Sri Lanka. Batch No: B', CAST(product_id AS STRING), 'X mail us care@shop.org or 1800-123-4567</p>') END,
      '<img src="https://m.media-amazon.com/images/I/', CAST(product_id AS STRING), 'aB._SX38_.jpg" alt="front"/><img data-src="https://m.media-amazon.com/images/I/', CAST(product_id % 7 AS STRING), 'zz._SL500_.jpg" src="s.gif" alt="Nutrition facts panel"/>',
      '<img src="https://m.media-amazon.com/images/I/', CAST(product_id AS STRING), 'aB.jpg"/><!-- MRP 9 --></body></html>')""",
}
# Specifications within nested blocks and nested tables, 1 to 20 deep.
NESTED_HTML = {
    "page_id": "product_id",
    "html": """concat('<body><div class="tech-spec">', repeat('<div class="n">', CAST(product_id % 20 + 1 AS INT)), '<ul><li>Shelf Life: ', CAST(product_id % 24 AS STRING), ' months<li>none</ul>', repeat('</div><div>x</div>', CAST(product_id % 20 + 1 AS INT)), '<ul><li>Brand : ', brand, '</li></ul></div>',
      repeat('<table><tr><th>Level</th><td>', CAST(product_id % 20 + 1 AS INT)), '<table><TR><td>Packer<td>Metro ', product_name, '</table>', repeat('</td></tr></table>', CAST(product_id % 20 + 1 AS INT)), '<ul><li>not: listed</li></ul></body>')""",
}
SEARCH_HTML = {
    "page_id": "product_id",
    "html": """concat('<div class="r"><div data-component-type="s-search-result" class="c"><h2 class="t"><span>', product_name, ' &amp; co</span></h2><a class="l" href="/n/dp/B0', lpad(CAST(product_id AS STRING), CAST(greatest(8, length(CAST(product_id AS STRING))) AS INT), '0'), '/ref=sr_1_', CAST(product_id % 9 AS STRING),
      '?x=1"></a><img class="s-image" src="https://m.media-amazon.com/images/I/', CAST(product_id AS STRING), '._AC_UL320_.jpg"/></article></div>', CASE WHEN product_id % 3 = 0 THEN '' ELSE concat('<div data-component-type="s-search-result"><a href="https://other.example.com/p', CAST(product_id AS STRING), '"><img src="x.png"></a></article></div>') END,
      '<div data-component-type="s-search-result"><h2>No link</h2></article></div></div>')""",
}


def _items(columns: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in columns.items())


# The same tables as SQL text, for checking a query against another engine.
VIEW_SQL = {
    "v_scans": f"SELECT {_items(SCANS)} FROM events",
    "v_submissions": f"SELECT {_items(SUBMISSIONS)} FROM events",
    "v_violations": (
        f"SELECT {_items(VIOLATIONS_MAIN)} FROM events WHERE {WHERE_MAIN} "
        f"UNION ALL SELECT {_items(VIOLATIONS_EXTRA)} FROM events WHERE {WHERE_EXTRA}"
    ),
    "v_labels": f"SELECT {_items(LABELS)} FROM part",
    "v_listings": f"SELECT {_items(LISTINGS)} FROM part",
    "v_nutrition": f"SELECT {_items(NUTRITION)} FROM part",
    "v_side_fields": " UNION ALL ".join(
        f"SELECT scan_id AS product_id, {side} AS side, field_name, {value} AS extracted_value, {method} AS extraction_method, "
        f"CAST({confidence} AS DOUBLE) AS confidence FROM v_fields"
        for side, (value, method, confidence) in SIDES.items()
    ),
    "v_tokens": " UNION ALL ".join(f"SELECT product_id AS scan_id, {token_row(n)} FROM v_labels" for n in range(1, len(TOKENS) + 1)),
    "v_blocks": " UNION ALL ".join(
        f"SELECT scan_id, {i} AS token_id, text, {x} AS x, {y} AS y, {w} AS w, {h} AS h, coalesce(confidence, 0.9) AS confidence, '{engine}' AS engine FROM v_tokens WHERE trim(text) <> ''"
        for engine, (i, x, y, w, h) in BLOCKS.items()
    ),
    "v_html": f"SELECT {_items(HTML)} FROM v_listings",
    "v_nested": f"SELECT {_items(NESTED_HTML)} FROM v_listings",
    "v_search": f"SELECT {_items(SEARCH_HTML)} FROM v_listings",
    "v_codes": f"SELECT {_items(CODES)} FROM part",
    "v_camera": f"SELECT {_items(CAMERA)} FROM part",
    "v_fields": " UNION ALL ".join(
        f"SELECT product_id AS scan_id, '{name}' AS field_name, {value} AS extracted_value, "
        f"{FIELD_METHOD.format(value=value, n=n)} AS extraction_method, {FIELD_CONFIDENCE.format(value=value, n=n)} AS confidence, "
        f"{FIELD_HEIGHT.format(n=n)} AS h FROM v_labels"
        for n, (name, value) in enumerate(FIELD_SOURCES.items(), 1)
    ),
}


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


class Tables:
    """The given parquet tables of one folder, plus the derived business tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """A table for costly row work. A file too small to be split is spread over the cores; a large one is not moved."""
        df, cores = self.read(name), self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)

    @property
    def parts(self) -> DataFrame:
        return self.spread("part", "p_partkey")

    @property
    def pages(self) -> DataFrame:
        return self.spread("pages", "page_id")

    @property
    def scans(self) -> DataFrame:
        return project(self.read("events"), SCANS)

    @property
    def submissions(self) -> DataFrame:
        return project(self.read("events"), SUBMISSIONS)

    @property
    def violations(self) -> DataFrame:
        events = self.read("events")
        main = project(events.where(WHERE_MAIN), VIOLATIONS_MAIN)
        extra = project(events.where(WHERE_EXTRA), VIOLATIONS_EXTRA)
        return main.unionByName(extra)

    @property
    def labels(self) -> DataFrame:
        return project(self.parts, LABELS)

    @property
    def listings(self) -> DataFrame:
        return project(self.parts, LISTINGS)

    @property
    def camera(self) -> DataFrame:
        return project(self.parts, CAMERA)

    @property
    def fields(self) -> DataFrame:
        """Long form of the labels: one read of the part table, one row per declared field."""
        rows = ", ".join(
            f"struct('{name}' AS field_name, {value} AS extracted_value, {FIELD_METHOD.format(value=value, n=n)} AS extraction_method, "
            f"CAST({FIELD_CONFIDENCE.format(value=value, n=n)} AS DOUBLE) AS confidence, {FIELD_HEIGHT.format(n=n)} AS h)"
            for n, (name, value) in enumerate(FIELD_SOURCES.items(), 1)
        )
        return self.labels.selectExpr("product_id AS scan_id", f"inline(array({rows}))")

    @property
    def nutrition(self) -> DataFrame:
        return project(self.parts, NUTRITION)

    @property
    def side_fields(self) -> DataFrame:
        rows = ", ".join(
            f"struct({side} AS side, {value} AS extracted_value, {method} AS extraction_method, CAST({confidence} AS DOUBLE) AS confidence)"
            for side, (value, method, confidence) in SIDES.items()
        )
        return self.fields.selectExpr("scan_id AS product_id", "field_name", f"inline(array({rows}))")

    @property
    def tokens(self) -> DataFrame:
        rows = ", ".join(f"struct({token_row(n)})" for n in range(1, len(TOKENS) + 1))
        return self.labels.selectExpr("product_id AS scan_id", f"inline(array({rows}))")

    @property
    def blocks(self) -> DataFrame:
        rows = ", ".join(
            f"struct('{engine}' AS engine, {i} AS token_id, {x} AS x, {y} AS y, {w} AS w, {h} AS h)"
            for engine, (i, x, y, w, h) in BLOCKS.items()
        )
        read = self.tokens.where("trim(text) <> ''").selectExpr(
            "scan_id", "text", "CAST(coalesce(confidence, 0.9) AS DOUBLE) AS confidence", f"inline(array({rows}))"
        )
        return read.selectExpr("scan_id", "CAST(token_id AS BIGINT) AS token_id", "text", *[f"CAST({c} AS INT) AS {c}" for c in "xywh"], "confidence", "engine")

    @property
    def codes(self) -> DataFrame:
        return project(self.parts, CODES)

    @property
    def listing_html(self) -> DataFrame:
        return project(self.listings, HTML)

    @property
    def nested_html(self) -> DataFrame:
        return project(self.listings, NESTED_HTML)

    @property
    def search_html(self) -> DataFrame:
        return project(self.listings, SEARCH_HTML)
