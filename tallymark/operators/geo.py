"""Country of origin from label or listing text.

The place lists are fixed and small, so each becomes one alternation pattern plus one literal
lookup map: a text is scanned once per list, inside the projection, with no join and no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.rules import gazetteer as G

EXPLICIT_PATTERN = r"(?i)(?:Country\s+of\s+Origin|Made\s+in|Product\s+of)[\s:\-]*([A-Za-z\s]+)"
PIN_PATTERN = r"\b([1-9][0-9]{2}\s?[0-9]{3})\b"
LABEL_PREFIX = "Country of Origin: "
DEFAULT_COUNTRY = "India"
PRESUMED_CONFIDENCE = 0.5

# Texts that repeat the heading instead of naming a country.
HEADINGS = ["country of origin", "country/region of origin", "origin", "country"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Names an intermediate value, so it is evaluated once where it is used several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literal_map(table: dict[str, str]) -> Column:
    """Fixed lookup table from one text literal; folded into a constant when the plan is optimised."""
    return F.str_to_map(F.lit("|".join(f"{k}={v}" for k, v in table.items())), F.lit("[|]"), F.lit("="))


def literal_list(words: list[str]) -> Column:
    return F.split(F.lit("|".join(words)), "[|]")


def alternation(words: list[str]) -> str:
    """Longest word first, so a longer name is not cut short by one it starts with."""
    return r"\b(" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + r")\b"


def winners(words: list[str]) -> dict[str, str]:
    """A matched name counts as the earliest listed name it contains, itself included."""
    return {w: next((k for k in words if re.search(rf"\b{re.escape(k)}\b", w)), w) for w in words}


def first_listed(text: Column, words: list[str]) -> Column:
    """Earliest entry of ``words`` that occurs in ``text`` as a whole word, or null."""
    rank = {w: i for i, w in enumerate(words)}
    ranks = literal_map({w: str(rank[v]) for w, v in winners(words).items()})
    hits = F.regexp_extract_all(text, F.lit(alternation(words)), F.lit(1))
    best = F.array_min(F.transform(hits, lambda w: F.try_element_at(ranks, w).cast("int")))
    return F.try_element_at(literal_list(words), best + 1)


def evidence(country: Column, kind: str, confidence: float, source: Column, place: Column) -> Column:
    return F.struct(
        country.alias("country"),
        F.lit(kind).alias("evidence_type"),
        F.lit(confidence).alias("confidence"),
        source.alias("inferred_from"),
        place.alias("place"),
    )


def infer_country(text: Column) -> Column:
    """Struct of country, evidence_type, confidence, inferred_from and place; null without evidence."""
    lowered, india, none = F.lower(text), F.lit(DEFAULT_COUNTRY), F.lit(None).cast("string")
    conf = G.CONFIDENCE

    named = F.lower(F.trim(F.split(F.trim(F.regexp_extract(text, EXPLICIT_PATTERN, 1)), r"[\n\r,;.]").getItem(0)))
    explicit = let(
        F.try_element_at(literal_map(G.EXPLICIT), named),
        lambda c: F.when(
            c.isNotNull(), evidence(c, "explicit_label", conf["explicit"], F.lit("Explicit declaration"), none)
        ),
    )
    state = let(
        F.try_element_at(literal_map(G.STATES), first_listed(lowered, list(G.STATES))),
        lambda s: F.when(s.isNotNull(), evidence(india, "state", conf["state"], F.concat(F.lit("State: "), s), s)),
    )
    code_pattern = r"(?i)\b(" + "|".join(G.STATE_CODES) + r")\s*[\-:\s]\s*([1-9][0-9]{5})\b"
    code = let(
        F.struct(
            F.upper(F.regexp_extract(text, code_pattern, 1)).alias("code"),
            F.regexp_extract(text, code_pattern, 2).alias("pin"),
        ),
        lambda m: F.when(
            m.code != "",
            let(
                F.try_element_at(literal_map(G.STATE_CODES), m.code),
                lambda s: evidence(
                    india, "state", conf["state_code"], F.concat(s, F.lit(" ("), m.code, F.lit("-"), m.pin, F.lit(")")), s
                ),
            ),
        ),
    )
    city = let(
        first_listed(lowered, list(G.CITIES)),
        lambda c: F.when(
            c.isNotNull(),
            let(
                F.concat(F.initcap(c), F.lit(", "), F.try_element_at(literal_map(G.CITIES), c)),
                lambda place: evidence(india, "city", conf["city"], F.concat(F.lit("City: "), place), place),
            ),
        ),
    )
    addressed = F.rlike(lowered, F.lit("|".join(G.ADDRESS_WORDS)))
    pin = let(
        F.replace(F.regexp_extract(text, PIN_PATTERN, 1), F.lit(" "), F.lit("")),
        lambda p: F.when(
            addressed & (p != ""),
            evidence(india, "pincode", conf["pin"], F.concat(F.lit("PIN Code: "), p), F.lit("Postal PIN Code")),
        ),
    )
    foreign = let(
        first_listed(lowered, list(G.FOREIGN)),
        lambda w: F.when(
            w.isNotNull(),
            let(
                F.try_element_at(literal_map(G.FOREIGN), w),
                lambda c: evidence(c, "state", conf["country"], F.concat(F.initcap(w), F.lit(", "), c), F.initcap(w)),
            ),
        ),
    )
    keyword = F.when(
        F.rlike(lowered, F.lit(r"\bindia\b")),
        evidence(india, "explicit_label", conf["keyword"], F.lit("India keyword"), none),
    )
    found = F.coalesce(explicit, state, code, city, pin, foreign, keyword)
    return F.when(F.trim(text) != "", found)


def declaration(found: Column) -> Column:
    """The origin as a label would state it."""
    base = F.concat(F.lit(LABEL_PREFIX), found.country)
    kind = F.when(found.evidence_type == "pincode", "from ").otherwise("from Location: ")
    return F.when(found.place.isNull(), base).otherwise(
        F.concat(base, F.lit(" (Inferred "), kind, found.place, F.lit(")"))
    )


def with_origin(df: DataFrame, text: str, name: str = "origin") -> DataFrame:
    return df.withColumn(name, infer_country(F.col(text)))


def origin_mix(df: DataFrame, text: str) -> DataFrame:
    """How many texts point to which country, by kind of evidence."""
    return (
        with_origin(df.select(text), text)
        .groupBy(
            F.coalesce("origin.country", F.lit("unknown")).alias("country"),
            F.coalesce("origin.evidence_type", F.lit("none")).alias("evidence_type"),
        )
        .agg(F.count(F.lit(1)).alias("text_count"))
    )


def resolve_origin(listings: DataFrame, panel_text: str = "panel_address") -> DataFrame:
    """Origin of a listing: stated, "made in", "manufactured in", maker address, panel, else India.

    Each candidate text is judged by the same inference and the first that succeeds wins.
    """
    stated = F.when(~F.lower(F.trim("country_of_origin")).isin(HEADINGS), F.col("country_of_origin"))
    stated = F.nullif(F.coalesce(stated, F.col("spec_origin")), F.lit(""))
    text = F.coalesce("description", F.lit(""))
    made = F.regexp_extract(text, r"(?i)\b(?:made\s+in|product\s+of)\s+([A-Za-z\s]+)", 0)
    built = F.regexp_extract(text, r"(?i)\bmanufactured\s+in\s+([A-Za-z\s]+)", 0)
    maker = F.coalesce(F.nullif("manufacturer_address", F.lit("")), F.nullif("manufacturer", F.lit("")), F.lit(""))

    def candidate(kind: str, source: Column, confidence: float | None, keeps_kind: bool) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            source.alias("text"),
            F.lit(confidence).cast("double").alias("confidence"),
            F.lit(keeps_kind).alias("keeps_kind"),
        )

    candidates = F.array(
        candidate("explicit_declaration", F.concat(F.lit(LABEL_PREFIX), stated), 0.98, True),
        candidate("made_in_statement", made, 0.92, True),
        candidate("manufactured_in_statement", built, 0.90, True),
        candidate("manufacturer_", maker, None, False),
        candidate("packaging_label_", F.coalesce(F.col(panel_text), F.lit("")), None, False),
    )
    judged = F.transform(candidates, lambda c: F.struct(c.alias("c"), infer_country(c.text).alias("found")))
    first = F.try_element_at(F.filter(judged, lambda j: j.found.isNotNull()), F.lit(1))
    unknown_stated = stated.isNotNull() & (F.coalesce(F.col("_first.c.kind"), F.lit("")) != "explicit_declaration")
    return (
        listings.withColumn("_first", first)
        .withColumns(
            {
                "origin_country": F.when(unknown_stated, F.trim(stated)).otherwise(
                    F.coalesce("_first.found.country", F.lit(DEFAULT_COUNTRY))
                ),
                "origin_evidence": F.when(unknown_stated, "explicit_declaration").otherwise(
                    F.coalesce(
                        F.when(F.col("_first.c.keeps_kind"), F.col("_first.c.kind")).otherwise(
                            F.concat("_first.c.kind", "_first.found.evidence_type")
                        ),
                        F.lit("default_presumption"),
                    )
                ),
                "origin_confidence": F.when(unknown_stated, F.lit(0.95)).otherwise(
                    F.coalesce("_first.c.confidence", "_first.found.confidence", F.lit(PRESUMED_CONFIDENCE))
                ),
            }
        )
        .drop("_first")
    )
