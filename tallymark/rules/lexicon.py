"""Words and patterns that tell the declarations on a label apart."""

from __future__ import annotations

# Processing order of the declarations.
FIELDS = [
    "mrp", "net_quantity", "manufacture_date", "expiry_date", "manufacturer_name_address", "consumer_care_details",
    "country_of_origin",
]

# Headings that announce a declaration.
ANCHORS = {
    "mrp": [
        "MRP", "M.R.P", "M.R.P.", "MAXIMUM RETAIL PRICE", "PRICE", "RETAIL PRICE", "USP", "U.S.P", "UNIT SALE PRICE",
        "INCL OF ALL TAXES", "INCLUSIVE OF ALL TAXES", "INCL. TAXES", "MAX RETAIL PRICE", "MAX. RETAIL PRICE",
    ],
    "net_quantity": [
        "NET WT", "NET WT.", "NET WEIGHT", "NET QTY", "NET QUANTITY", "NET CONTENT", "NET CONTENTS", "NET VOL",
        "NET VOLUME", "NETT", "NETT WT", "NETT WEIGHT", "CONTENTS", "BISCUITS NET", "PACK OF", "QUANTITY", "QTY",
        "NET MASS", "BISCUITS NET WEIGHT",
    ],
    "manufacture_date": [
        "MFG", "MFG.", "MFG DATE", "MFD", "MFD.", "PKD", "PKD.", "PACKED", "PACKED ON", "DATE OF MFG", "DATE OF PKG",
        "DATE OF PACKING", "MANUFACTURE", "MANUFACTURED", "MANUFACTURING", "MFGDT", "DATE OF MANUFACTURE",
    ],
    "expiry_date": [
        "EXPIRY", "EXP", "EXP.", "EXPIRY DATE", "EXPIRY DT", "USE BY", "USE BEFORE", "BEST BEFORE", "BEST BEFORE DATE",
        "BBE", "BB", "BEST BY", "CONSUME BY", "CONSUME BEFORE", "SELL BY", "VALID TILL", "VALID UPTO", "VALID UP TO",
    ],
    "manufacturer_name_address": [
        "MANUFACTURED BY", "MFG BY", "MFGD BY", "MARKETED BY", "MKTD BY", "PACKED BY", "PKD BY", "MANUFACTURED FOR",
        "IMPORTED BY", "DISTRIBUTED BY", "BRAND OWNER", "REGD OFFICE", "REGISTERED OFFICE", "CORPORATE OFFICE",
        "FACTORY ADDRESS", "WORKS AT", "UNIT ADDRESS", "MFG. & MKTD. BY", "PACKED & MARKETED BY", "MFG & MARKETED BY",
        "MARKETED & MFG BY", "MARKETED & DISTRIBUTED BY", "SOLE DISTRIBUTOR", "SOLD BY", "BRAND", "A UNIT OF",
        "SUBSIDIARY OF",
    ],
    "consumer_care_details": [
        "CONSUMER CARE", "CUSTOMER CARE", "HELPLINE", "TOLL FREE", "TOLL-FREE", "CUSTOMER SUPPORT", "FOR QUERIES",
        "FOR COMPLAINTS", "FEEDBACK", "WRITE TO", "CARE LINE", "CONTACT US", "CARE CELL", "CONSUMER CELL",
        "REACH US AT", "PHONE NO", "PHONE NO.", "PHONE", "TEL NO", "TEL.", "TEL", "CALL US", "TOLL FREE NO",
        "CONSUMER HELPLINE", "CARE CONTACT",
    ],
    "country_of_origin": [
        "COUNTRY OF ORIGIN", "MADE IN", "PRODUCT OF", "PRODUCE OF", "MANUFACTURED IN", "ORIGIN", "COO", "ORIGIN COUNTRY",
    ],
}
PROMO_QUANTITY = r"\bFOR\s+\d+[\d\.\,]*\s*(?:G|GM|GMS|KG|ML|L|LTR)\b"

# Pieces the patterns share.
AMOUNT = r"\d+[\d,\.]*"
BASIC_UNIT = r"(?:g|gm|gms|kg|ml|l|ltr)"
RETAIL_UNIT = r"g|gm|gms|grams?|kg|ml|l|ltr|litres?"
MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
DAY_MONTH = rf"\d{{1,2}}\s+{MONTH}\s+\d{{2,4}}"
SHORT_DATE = r"\d{1,2}[\-/\.](?:20)?\d{2}"
MONTH_YEAR = rf"{MONTH}[\s\-/\.]*(?:20)?\d{{2}}"
HEADED_DATE = rf"((?:{DAY_MONTH}|\d{{1,2}}[\-/\.]\d{{1,2}}[\-/\.]\d{{2,4}}|{SHORT_DATE}|{MONTH_YEAR}))"
BARE_DATE = (
    rf"\b(?:{DAY_MONTH}|(?:0?[1-9]|[12]\d|3[01])[\-/\.](?:0?[1-9]|1[0-2])[\-/\.](?:20)?\d{{2}}"
    rf"|(?:0?[1-9]|1[0-2])[\-/](?:20)?\d{{2}}|{MONTH_YEAR})\b"
)
PHONE = r"1800[\s\-]?\d{3}[\s\-]?\d{4}|1860[\s\-]?\d{3}[\s\-]?\d{4}"
WEB = r"[\w\.\-]+@[\w\.\-]+\.[a-z]{2,}|www\.[\w\.\-]+\.[a-z]{2,}|https?://[\w\.\-]+"

# What a value of each declaration looks like, and how sure a match makes us.
VALIDATORS = {
    "mrp": [
        (rf"(?:MRP|M\.R\.P\.?|PRICE|USP)[\s:\-\.=?&%\*^/]*(?:Rs\.?|INR|₹)?[\s:\-\.]*({AMOUNT})", 0.98),
        (rf"(?:Rs\.?|INR|₹)\s*({AMOUNT})", 0.92),
        (r"\b(\d+\.\d{2})\b", 0.85),
        (rf"\b({AMOUNT})\s*/-", 0.88),
        (r"(?:incl\.?|inclusive)\s+(?:of\s+)?(?:all\s+)?taxes", 0.75),
    ],
    "net_quantity": [
        (
            rf"\b\d+[\d\.\,]*\s*{BASIC_UNIT}\s*[+*]\s*\d+[\d\.\,]*\s*(?:g|gm|gms|kg|ml|l|ltr|%)?\s*(?:extra|free)?\s*=\s*"
            rf"\d+[\d\.\,]*\s*{BASIC_UNIT}\b",
            0.99,
        ),
        (
            r"(?:(?:biscuits?|cookies?|snacks?|food)?\s*net\s*(?:wt\.?|weight|content|contents|qty|quantity|volume|vol\.?|mass)"
            r"|nett?\s*(?:wt|weight)|contents?|pack\s*of|count)[\s:\-\.]*"
            rf"({AMOUNT}\s*(?:{RETAIL_UNIT}|oz|fl\.?\s*oz|pcs|pieces?|pack|units?|capsules?|tablets?|wipes?|N))\b",
            0.98,
        ),
        (rf"\b(?:FOR|PACK)\s*[\s:\-\.]*({AMOUNT}\s*(?:{RETAIL_UNIT}|pcs|pieces?|units?))\b", 0.96),
        (rf"\b({AMOUNT}\s*(?:{RETAIL_UNIT}|fl\.?\s*oz|pcs|pieces?|units?|capsules?|tablets?|wipes?|N))\b", 0.88),
    ],
    "manufacture_date": [
        (
            r"(?:mfg\.?\s*(?:date)?|manufactured(?:\s*on)?|mfd\.?|pkd\.?|packed(?:\s*on)?"
            rf"|date\s+of\s+(?:mfg|pkd|packing|manufacture))[\s:\-\.]*{HEADED_DATE}",
            0.99,
        ),
        (BARE_DATE, 0.82),
    ],
    "expiry_date": [
        (
            r"(?:use\s*by|best\s*before|exp(?:iry)?\.?(?:\s*date)?|bbe|best\s*by|consume\s*(?:by|before)|sell\s*by"
            rf"|valid\s*(?:till|upto|up\s*to))[\s:\-\.]*{HEADED_DATE}",
            0.99,
        ),
        (
            r"(?:best\s*before|use\s*within)[\s:\-]*(\d+\s*(?:months?|days?|years?)"
            r"(?:\s*from\s+(?:mfg|pkd|packaging|manufacture|date))?)",
            0.88,
        ),
        (BARE_DATE, 0.82),
    ],
    "manufacturer_name_address": [
        (
            r"(?:manufactured|mfr\.?|marketed|packed|imported|distributed|bought)\s+(?:by|for)|brand\s+owner"
            r"|registered\s+office|regd\.?\s*off(?:ice)?|corporate\s+office|works\s+at|factory\s+address",
            0.92,
        ),
        (
            r"\b(?:pvt\.?\s*ltd\.?|private\s+limited|limited|llp|industries|foods|beverages|pharmaceuticals|laboratories"
            r"|enterprises)\b",
            0.88,
        ),
        (
            r"\b(?:address|road|street|marg|nagar|plot|industrial|area|estate|midc|gidc|riico|sipcot|pin|zip|\d{6})\b",
            0.82,
        ),
    ],
    "consumer_care_details": [
        (rf"\b(?:{PHONE}|0\d{{2,4}}[\s\-]?\d{{6,8}}|\+91[\s\-]?\d{{10}})\b", 0.95),
        (rf"(?:{WEB})", 0.92),
        (r"(?:consumer|customer)\s+(?:care|service|helpline|support)|toll\s*free|helpline|feedback|care@", 0.85),
        (r"(?:phone\s*(?:no\.?)?|tel\s*(?:no\.?)?|call\s*us)[\s:\-\.]*(\+?\d[\d\s\-]{4,14}\d)", 0.94),
    ],
    "country_of_origin": [
        (
            r"(?:country\s+of\s+origin|origin\s*[\s:\-]|made\s+in\s+[A-Za-z]+|product\s+of\s+[A-Za-z]+"
            r"|produce\s+of\s+[A-Za-z]+|manufactured\s+in\s+[A-Za-z]+)",
            0.95,
        ),
        (r"\b(?:India|Republic\s+of\s+India)\b", 0.88),
        (
            r"\b(?:MUMBAI|DELHI|BANGALORE|HYDERABAD|CHENNAI|KOLKATA|PUNE|AHMEDABAD|HARYANA|SONIPAT|BARHI|GURGAON|FARIDABAD"
            r"|NOIDA|GHAZIABAD|PUNJAB|GUJARAT|MAHARASHTRA|KARNATAKA|TAMIL\s*NADU|KERALA|RAJASTHAN|BIHAR|ODISHA|ASSAM"
            r"|UTTARAKHAND|TS|TN|MH|KA|UP|MP|GJ|WB|HR|PB|RJ|AP|KL|CH|DL)[^\w\d\n\r]*[-–]?\s*\d{6}\b",
            0.90,
        ),
        (
            r"\b(?:Haryana|Punjab|Maharashtra|Karnataka|Gujarat|Tamil\s*Nadu|Kerala|Rajasthan|Uttar\s*Pradesh"
            r"|Madhya\s*Pradesh|Andhra\s*Pradesh|Telangana|West\s*Bengal|Odisha|Bihar|Jharkhand|Assam|Himachal\s*Pradesh"
            r"|Uttarakhand|Goa|Delhi)\b",
            0.85,
        ),
    ],
}

# A text that has the first pattern and lacks the second is not a value of the field.
VETOES = {
    "net_quantity": [
        (
            r"\b(?:serve|serving|servings|per\s+(?:approx\.?|serve|serving|\d+)|approx\.?\s*\d+\s*(?:biscuits|pieces|units|cookies|slices)"
            r"|per\s+100\s*(?:g|gm|ml)|energy|kcal|trans\s*fat|cholesterol|carbohydrate|sugar|protein)\b",
            None,
        ),
        (r"(?:USP|U\.S\.P|unit\s*sale\s*price|/\s*(?:g|gm|kg|ml|l|ltr)|per\s*(?:g|gm|kg|ml|l|ltr))\b", None),
    ],
    "manufacture_date": [
        (r"\b(?:MRP|M\.R\.P|Rs\.?|₹|INR)\b", r"(?:mfg|exp|pkd|use\s*by|best\s*before)"),
        (
            r"\b(?:use\s*by|best\s*before|exp(?:iry)?|bbe|valid\s*(?:till|upto))\b",
            r"\b(?:mfg|mfd|pkd|packed)\b",
        ),
        (r"^\s*\d{2}[:\-]\d{2}\s*$", None),
    ],
    "expiry_date": [
        (r"\b(?:MRP|M\.R\.P|Rs\.?|₹|INR)\b", r"(?:mfg|exp|pkd|use\s*by|best\s*before)"),
        (
            r"\b(?:mfg|mfd|pkd|packed|date\s+of\s+(?:mfg|pkd|manufacture))\b",
            r"\b(?:use\s*by|best\s*before|exp(?:iry)?|bbe)\b",
        ),
        (r"^\s*\d{2}[:\-]\d{2}\s*$", None),
    ],
}
BARE_MAKER = r"^\s*(?:manufactured|mfr\.?|marketed|packed|imported|distributed)\s+(?:by|for)[\s:\-\.]*$"
BARE_MAKER_SCORE = 0.45

# How a value is written once cleaned: prefix, pattern, group. The first hit wins.
DATE_VALUE = rf"{DAY_MONTH}|\d{{1,2}}[/\.-]\d{{1,2}}[/\.-]\d{{2,4}}"
PLAIN_DATE = r"\b(\d{1,2}[\-/]\d{1,2}[\-/]\d{2,4})\b"
NAMED_DATE = rf"\b({DAY_MONTH})\b"
TEMPLATES = {
    "mrp": [
        ("MRP Rs. ", r"(?:M\.?R\.?P\.?|MRP|PRICE)[\s:?&%\*^/\.]*(?:Rs\.?|INR|₹)?[\s:\-\.]*(\d+[\.]\d{2}|\d+)"),
        ("MRP Rs. ", r"\b(\d+\.\d{2})\b"),
        ("MRP Rs. ", r"(?:Rs\.?|INR|₹)\s*(\d+)"),
    ],
    "net_quantity": [
        ("Net Wt. ", rf"=\s*(\d+[\d\.\,]*\s*{BASIC_UNIT})\b"),
        ("Net Wt. ", r"\bFOR\s*[\s:\-\.]*(\d+[\d\.\,]*\s*(?:" + RETAIL_UNIT + r"|pcs|pack|units?|N))\b"),
        ("Net Wt. ", r"\b(\d+[\d\.\,]*\s*(?:g|gm|gms|kg|ml|l|ltr|pcs|pack|units?|N))\b"),
    ],
    "manufacture_date": [
        ("Mfg: ", rf"(?:MFG|MFG\.?\s*DATE|PKD|PACKED)[\s:]*({DATE_VALUE})"),
        ("Mfg: ", PLAIN_DATE),
        ("Mfg: ", NAMED_DATE),
    ],
    "expiry_date": [
        ("Use By: ", rf"(?:USE\s*BY|USE\s*BEFORE)[\s:]*({DATE_VALUE}|{SHORT_DATE})"),
        ("Best Before: ", rf"(?:BEST\s*BEFORE|BBE)[\s:]*({DATE_VALUE}|{SHORT_DATE})"),
        ("Exp: ", rf"(?:EXP(?:IRY)?(?:\.?\s*DATE)?|SELL\s*BY|VALID\s*(?:TILL|UPTO|UP\s*TO))[\s:]*({DATE_VALUE}|{SHORT_DATE})"),
        ("Best Before: ", r"(?:BEST\s*BEFORE|USE\s*WITHIN|USE\s*BY)[\s:]*(\d+\s*(?:months?|days?|years?)[^\n\r]*)"),
        ("Exp: ", PLAIN_DATE),
        ("Exp: ", NAMED_DATE),
    ],
    "consumer_care_details": [
        ("", rf"({WEB})"),
        ("Phone: ", rf"(?:phone\s*(?:no\.?|number)?[\s:]*)?(\+?91[\s\-]?\d{{10}}|{PHONE}|\b\d{{3,5}}[\s\-]?\d{{6,8}}\b)"),
    ],
}
QUANTITY_TAIL = r"\b(?:per\s+(?:approx\.?|serve|serving|\d+)|approx\.?\s*\d+\s*(?:biscuits|pieces|units|cookies)).*$"
MAKER_NAMED = (
    r"(?:MANUFACTURED\s+(?:&\s+MARKETED\s+)?BY|MFG\s+BY|MARKETED\s+BY|PACKED\s+BY|IMPORTED\s+BY|MANUFACTURED\s+FOR)[\s:]*"
    r"([^\n\r]*(?:Pvt\.?\s*Ltd\.?|Limited|LLP|Inc\.?)[^\n\r]*)"
)
MAKER_SUFFIXED = (
    r"\b([A-Z][A-Za-z0-9\s\,\.\-&]+\b(?:Pvt\.?\s*Ltd\.?|Private\s+Limited|LLP|Industries|Foods|Beverages|Laboratories))\b"
)
MAKER_ADDRESS = (
    r"((?:At:?\s*)?(?:Plot\s+No\.?|\d+)[^\n\r]*(?:Industrial|Area|Estate|Road|Street|Marg|Nagar|Barhi|Sonipat|Haryana|Noida|Delhi"
    r"|Mumbai|Chennai|Pune|Hyderabad|Bangalore|UP|TS|TN|MH|HR|PB|GJ|KA|KL|RJ|MP|PIN|\d{6})[^\n\r]*)"
)
MAKER_NOISE = r"(?:Energy|kcal|Protein|Fat|Sugar|Carbohydrates|Added)[^\.\,\d]*"
ORIGIN_STATED = r"(?:country\s+of\s+origin|made\s+in|product\s+of)[\s:\-]*([A-Za-z\s]+)"

# The looser shapes used when blocks are merged into one value per field.
MERGE_PRICE = r"(?:M[\.\s\w]*R[\.\s\w]*P|MRP|PRICE|RS\.?)[\s:₹\?&%\*^/\.]*(?:Rs\.?|₹|INR)?[\s:\-\.]*(\d+[\.\,]\d{2})"
MERGE_DECIMAL = r"\b(\d+[\.\,]\d{2})\b"
MERGE_MAKER = r"\b([A-Z][A-Za-z0-9\s\,\.\-&]+\b(?:Pvt\.?\s*Ltd\.?|Private\s+Limited|LLP|Industries|Foods))\b"
MERGE_ADDRESS = r"(\d+[\w\s\,\.\-]+\b(?:Industrial|Area|Road|Street|Noida|Delhi|Mumbai|UP|PIN|\d{6})\b[^\n\r]*)"

# Code and batch shapes.
BATCH_PATTERNS = [
    r"(?i)(?:B\.?\s*No\.?|Batch\s*(?:No\.?|Number|#)?|Lot\s*(?:No\.?|Number|#)?|B/N|BN)\s*[:\-\.]*\s*([A-Za-z0-9/\-_]{3,25})",
    r"(?i)\b(?:BATCH|LOT)\s*[:\-\.]*\s*([A-Za-z0-9/\-_]{3,25})\b",
]
BATCH_STOPWORDS = ["date", "mfg", "exp", "pkd", "rs", "mrp", "net"]
GS1_CODE = r"(?:/01/|\(01\))(\d{8,14})"
CODE_LENGTHS = {"EAN13": 13, "UPCA": 12, "UPC": 12, "EAN8": 8, "ITF14": 14}
