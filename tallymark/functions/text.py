"""Text clean-up and markup removal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character entities resolved in page text.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&#x20b9;": "₹", "&amp;": "&"}
INVISIBLE = "[\u200b\u200c\u200d\u200e\u200f\ufeff]"
HIDDEN_PARTS = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
TAG = r"(?s)<[^>]*>"


def unescape(text: Column) -> Column:
    for entity, plain in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def clean_text(text: Column) -> Column:
    """Drops zero-width characters, turns any white space into single blanks; blank becomes null."""
    visible = F.replace(F.regexp_replace(text, INVISIBLE, ""), F.lit("\u00a0"), F.lit(" "))
    return F.nullif(F.trim(F.regexp_replace(visible, r"[ \t\n\r\f]+", " ")), F.lit(""))


def inner_text(html: Column) -> Column:
    """Text of a markup fragment."""
    return clean_text(unescape(F.regexp_replace(html, TAG, " ")))


def visible_text(html: Column) -> Column:
    """Text a reader sees: scripts, styles and comments are removed before the tags."""
    return inner_text(F.regexp_replace(html, HIDDEN_PARTS, " "))
