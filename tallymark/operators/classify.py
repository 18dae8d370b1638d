"""From text blocks to declarations: score, clean, classify, and merge into one value per field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.geometry import edges, union_of
from tallymark.operators.geo import declaration, infer_country, let
from tallymark.operators.rules import SLASHED_DATE
from tallymark.operators.tokens import CHAIN, SINGLES, heading_lists, nearest_blocks, strips
from tallymark.rules import lexicon as L

ACCEPT = 0.80
KEEP = 0.30
MERGE_FLOOR = 0.60
INFERRED_FLOOR = 0.92
BOX = "struct<x:double,y:double,x2:double,y2:double>"


def matches(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit("(?i)" + pattern))


def found(text: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    return F.nullif(F.regexp_extract(text, ("(?i)" if ignore_case else "") + pattern, group), F.lit(""))


def score(field: str, text: Column) -> Column:
    """How surely a text is a value of the field: the best matching pattern, unless a veto applies."""
    best = F.lit(0.0)
    for pattern, confidence in sorted(L.VALIDATORS[field], key=lambda v: v[1]):
        best = F.when(matches(text, pattern), F.lit(confidence)).otherwise(best)
    if field == "manufacturer_name_address":
        best = F.when(matches(text, L.BARE_MAKER), F.lit(L.BARE_MAKER_SCORE)).otherwise(best)
    for has, lacks in L.VETOES.get(field, []):
        vetoed = matches(text, has) if lacks is None else matches(text, has) & ~matches(text, lacks)
        best = F.when(vetoed, F.lit(0.0)).otherwise(best)
    return F.when(F.trim(text) == "", F.lit(0.0)).otherwise(best)


def clean(field: str, text: Column) -> Column:
    """Canonical wording of a value; a text no template fits is kept as it is."""
    text = F.trim(text)
    if field == "country_of_origin":
        stated = F.concat(F.lit("Country of Origin: "), F.trim(found(text, L.ORIGIN_STATED)))
        return F.coalesce(stated, let(infer_country(text), lambda g: F.when(g.isNotNull(), declaration(g))), text)
    if field == "manufacturer_name_address":
        noise = "(?i)" + L.MAKER_NOISE
        name = F.trim(
            F.regexp_replace(
                F.coalesce(F.trim(found(text, L.MAKER_NAMED)), F.trim(found(text, L.MAKER_SUFFIXED, 1, False)), F.lit("")), noise, ""
            )
        )
        place = F.trim(F.regexp_replace(F.coalesce(F.trim(found(text, L.MAKER_ADDRESS)), F.lit("")), noise, ""))
        both = F.when((place != "") & ~F.contains(name, place), F.concat_ws(" ", name, place)).otherwise(
            F.coalesce(F.nullif(name, F.lit("")), text)
        )
        return F.trim(F.regexp_replace(both, r"\s+", " "))
    target = text
    if field == "net_quantity":
        target = F.coalesce(F.nullif(F.trim(F.regexp_replace(text, "(?i)" + L.QUANTITY_TAIL, "")), F.lit("")), text)
    shaped = [F.concat(F.lit(prefix), F.trim(found(target, pattern))) for prefix, pattern in L.TEMPLATES[field]]
    return F.coalesce(*shaped, text)


def by_field(name: Column, build) -> Column:
    """CASE over the seven fields, each with its own patterns as literals."""
    expr = F.lit(None)
    for field in reversed(L.FIELDS):
        expr = F.when(name == field, build(field)).otherwise(expr)
    return expr


def score_tokens(tokens: DataFrame) -> DataFrame:
    """Long scores: one row per block and field it could be a value of."""
    rows = F.array(*[F.struct(F.lit(f).alias("field_name"), score(f, F.col("text")).alias("score")) for f in L.FIELDS])
    scored = tokens.withColumn("_s", F.explode_outer(F.filter(rows, lambda r: r.score > 0))).where(F.col("_s").isNotNull())
    return scored.select(
        *tokens.columns, F.col("_s.field_name").alias("field_name"), F.col("_s.score").alias("score")
    )


def clean_values(scored: DataFrame) -> DataFrame:
    return scored.withColumn("clean_value", by_field(F.col("field_name"), lambda f: clean(f, F.col("text"))))


def read_labels(tokens: DataFrame, *more: str) -> DataFrame:
    """One row per label: ``blocks`` by number, each with its box, the ``more`` columns, its ``headings`` and its ``scores``.

    The blocks are dealt by label once, as they come. All that is settled about a label is settled in this row, so no
    pairs, tries or candidates are ever sorted or moved. Blocks without a label are read, but count for none.
    """
    kept = ["token_id", "text", *"xywh", *more]
    scores = F.array(*[F.struct(F.lit(f).alias("field_name"), score(f, F.col("text")).alias("score")) for f in L.FIELDS])
    read = (
        heading_lists(tokens.select("scan_id", *kept).repartition("scan_id"))
        .withColumn("_scores", scores)
        .withColumn("scores", F.explode_outer(F.array(F.filter("_scores", lambda s: s.score > 0))))
    )
    headings = F.transform("headings", lambda h: F.struct(h.field_name.alias("field_name"), h.anchor_order.alias("anchor_order"), h.m.ratio.alias("ratio")))
    labelled = F.col("scan_id").isNotNull()
    block = F.struct(*kept, F.when(labelled, headings).alias("headings"), F.when(labelled, F.col("scores")).alias("scores"))
    return read.groupBy("scan_id").agg(F.sort_array(F.collect_list(block)).alias("blocks"))


def _box(block: Column) -> Column:
    return edges(block.x, block.y, block.w, block.h)


def _value(block: Column, near: Column, heading: Column) -> Column:
    """Best value of one heading: its own text when that is good enough, else text near it.

    Tried in order: heading with each of the five nearest blocks, each of those alone, then the
    heading with the four nearest joined. A later try must score higher to win. ``box`` is the least box around
    the blocks that the winning text is made of.
    """
    tries = F.flatten(
        F.transform(
            near,
            lambda n, i: F.array(
                F.struct((i * 2 + 1).alias("step"), F.trim(F.concat_ws(" ", block.text, n.text)).alias("text"), union_of(_box(block), n.box).alias("box")),
                F.struct((i * 2 + 2).alias("step"), n.text.alias("text"), n.box.alias("box")),
            ),
        )
    )
    chained = F.array_join(F.transform(F.slice(near, 1, CHAIN), lambda n: n.text), " ")
    around = F.aggregate(F.slice(near, 1, CHAIN), _box(block), lambda a, n: union_of(a, n.box))
    chain = F.when(
        F.size(near) > 0,
        F.array(F.struct(F.lit(2 * SINGLES + 1).alias("step"), F.trim(F.concat_ws(" ", block.text, chained)).alias("text"), around.alias("box"))),
    ).otherwise(F.array().cast(f"array<struct<step:int,text:string,box:{BOX}>>"))

    def tried(score_: Column, step: Column, text: Column, box: Column) -> Column:
        return F.struct(score_.alias("score"), (-step).alias("minus_step"), text.alias("text"), box.alias("box"))

    inline = F.coalesce(F.array_max(F.transform(F.filter(block.scores, lambda s: s.field_name == heading.field_name), lambda s: s.score)), F.lit(0.0))
    own = tried(inline, F.lit(0), block.text, _box(block))
    others = F.transform(F.concat(tries, chain), lambda o: tried(by_field(heading.field_name, lambda f: score(f, o.text)), o.step, o.text, o.box))
    best = F.when(inline >= ACCEPT, own).otherwise(F.array_max(F.concat(F.array(own), others)))
    return let(
        best,
        lambda b: F.struct(
            heading.field_name.alias("field_name"),
            F.round(F.least(F.lit(1.0), b.score * (0.85 + 0.15 * heading.ratio)), 9).alias("conf"),
            (-block.token_id).alias("minus_token"),
            (-heading.anchor_order).alias("minus_order"),
            b.text.alias("value_text"),
            b.box.alias("box"),
        ),
    )


def _anchored(blocks: Column, stripes: Column, repeated: Column) -> Column:
    """Values of all headings of a label; blocks that bear one number look for neighbours together."""

    def values(block: Column) -> Column:
        alike = F.when(repeated, F.filter(blocks, lambda b: b.token_id == block.token_id)).otherwise(F.array(block))
        near = F.slice(F.sort_array(F.flatten(F.transform(alike, lambda b: nearest_blocks(b, stripes)))), 1, SINGLES)
        return let(near, lambda n: F.transform(block.headings, lambda h: _value(block, n, h)))

    return F.flatten(F.transform(F.filter(blocks, lambda b: F.size(b.headings) > 0), values))


def _picked(labels: DataFrame) -> DataFrame:
    """One row per label with ``v_<field>`` (value, confidence, token_id, accepted), the claimed blocks, and all blocks.

    Fields are settled in their fixed order, because a block claimed by one is not offered to the
    next: the best anchored value, or else the best-scored free block. A date claimed by both manufacture and expiry is
    taken from expiry.
    """
    scored = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b.scores,
                lambda s: F.struct(s.field_name.alias("field_name"), s.score.alias("score"), (-b.token_id).alias("minus_token"), b.text.alias("text"), _box(b).alias("box")),
            ),
        )
    )
    ids = F.transform("blocks", lambda b: b.token_id)
    wide = labels.withColumns({"_strips": strips(F.col("blocks")), "_repeated": F.size(F.array_distinct(ids)) < F.size("blocks"), "_scored": scored})
    wide = wide.withColumn("_values", _anchored(F.col("blocks"), F.col("_strips"), F.col("_repeated")))

    def best_of(field: str) -> Column:
        own = F.filter("_values", lambda v: (v.field_name == field) & (v.conf > 0))
        return F.array_max(F.transform(own, lambda v: F.struct(*[v[c].alias(c) for c in ("conf", "minus_token", "minus_order", "value_text", "box")])))

    wide = wide.select("scan_id", "blocks", "_scored", *[best_of(f).alias(f"a_{f}") for f in L.FIELDS])
    wide = wide.withColumn("claimed", F.array().cast("array<bigint>"))
    for field in L.FIELDS:
        a, claimed = F.col(f"a_{field}"), F.col("claimed")
        anchored = F.when(
            a.isNotNull(),
            F.struct(a.conf.alias("conf"), a.value_text.alias("text"), (-a.minus_token).alias("token_id"), a.box.alias("box")),
        )
        offered = F.filter("_scored", lambda s: (s.field_name == field) & ~F.array_contains(claimed, -s.minus_token))
        wide = wide.withColumn(f"c_{field}", F.array_max(F.transform(offered, lambda s: F.struct(*[s[c].alias(c) for c in ("score", "minus_token", "text", "box")]))))
        free = F.col(f"c_{field}")
        fallback = F.when(
            (F.coalesce(a.conf, F.lit(0.0)) < ACCEPT) & (free.score > F.coalesce(a.conf, F.lit(0.0))),
            F.struct(free.score.alias("conf"), free.text.alias("text"), (-free.minus_token).alias("token_id"), free.box.alias("box")),
        )
        wide = wide.withColumn(f"p_{field}", F.coalesce(fallback, anchored))
        picked = F.col(f"p_{field}")
        wide = wide.withColumn(
            "claimed", F.when(picked.conf >= ACCEPT, F.array_append(claimed, picked.token_id)).otherwise(claimed)
        )

    def value(field: str) -> Column:
        picked = F.col(f"p_{field}")
        kept = F.struct(
            clean(field, picked.text).alias("extracted_value"),
            F.round(picked.conf, 4).alias("confidence"),
            picked.token_id.alias("token_id"),
            (picked.conf >= ACCEPT).alias("accepted"),
            picked.box.alias("box"),
        )
        return F.when(F.round(picked.conf, 4) >= KEEP, kept)

    wide = wide.select("scan_id", "blocks", "claimed", *[value(f).alias(f"v_{f}") for f in L.FIELDS])

    def day(field: str) -> Column:
        own = F.col(f"v_{field}")
        return F.when(own.accepted, F.nullif(F.regexp_extract(own.extracted_value, SLASHED_DATE, 1), F.lit("")))

    clash = F.coalesce(day("manufacture_date") == day("expiry_date"), F.lit(False))
    return wide.withColumn("v_expiry_date", F.when(~clash, F.col("v_expiry_date")))


def _rows(wide: DataFrame) -> DataFrame:
    parts = ("extracted_value", "confidence", "token_id", "accepted", "box")
    listed = F.array(
        *[F.struct(F.lit(f).alias("field_name"), *[F.col(f"v_{f}.{p}").alias(p) for p in parts]) for f in L.FIELDS]
    )
    return wide.select("scan_id", F.inline_outer(listed)).where(F.col("confidence").isNotNull())


def classify(tokens: DataFrame) -> DataFrame:
    """Long result: scan_id, field_name, extracted_value, confidence, token_id, accepted, box."""
    return _rows(_picked(read_labels(tokens)))


def settled_labels(tokens: DataFrame, *more: str) -> DataFrame:
    """Every label with its settled fields and its blocks; a missing origin comes from the maker or any printed text."""
    pool = F.array_join(F.transform("blocks", lambda b: b.text), "\n")
    wide = _picked(read_labels(tokens, *more)).withColumn("text_pool", pool)
    origin, maker = F.col("v_country_of_origin"), F.col("v_manufacturer_name_address")
    maker_text = F.coalesce(F.when(maker.accepted, maker.extracted_value), F.lit(""))
    evidence = F.coalesce(infer_country(maker_text), infer_country(F.col("text_pool")))
    inferred = let(
        evidence,
        lambda g: F.when(
            g.isNotNull(),
            F.struct(
                declaration(g).alias("extracted_value"),
                F.greatest(F.lit(INFERRED_FLOOR), g.confidence).alias("confidence"),
                F.lit(None).cast("long").alias("token_id"),
                F.lit(True).alias("accepted"),
                F.lit(None).cast(BOX).alias("box"),
            ),
        ),
    )
    return wide.withColumn(
        "v_country_of_origin",
        F.when(F.coalesce(origin.accepted, F.lit(False)), origin).otherwise(F.coalesce(inferred, origin)),
    )


def classify_labels(tokens: DataFrame) -> DataFrame:
    return _rows(settled_labels(tokens))


def failed_fields(tokens: DataFrame) -> DataFrame:
    """Fields of each label that found no accepted value."""
    names = F.array_compact(
        F.array(*[F.when(~F.coalesce(F.col(f"v_{f}.accepted"), F.lit(False)), F.lit(f)) for f in L.FIELDS])
    )
    return settled_labels(tokens).select("scan_id", F.explode_outer(names).alias("field_name")).where(F.col("field_name").isNotNull())


def reading_method(engine: Column) -> Column:
    low = F.lower(engine)
    return F.when(low.contains("easyocr"), "ocr_easyocr").when(low.contains("paddle"), "ocr_paddle").otherwise("ocr_tesseract")


def _price_in(text: Column) -> Column:
    decimal = found(text, L.MERGE_DECIMAL)
    big = F.replace(decimal, F.lit(","), F.lit(".")).try_cast("double") > 1.0
    return F.coalesce(found(text, L.MERGE_PRICE), F.when(big, decimal))


def _maker_in(text: Column) -> Column:
    return F.trim(found(text, L.MERGE_MAKER, 1, False))


def _place_in(text: Column) -> Column:
    stripped = F.trim(F.regexp_replace(F.trim(found(text, L.MERGE_ADDRESS)), r"^\d+[\.\,]\d+\s*", ""))
    return F.when(~F.contains(F.lower(text), F.lit("kcal")), stripped)


def merge_fields(tokens: DataFrame) -> DataFrame:
    """One value per label and field; fields without one are not_found.

    Price and maker are looked for in every block, classified ones first; other fields take the
    classified value when it is sure enough. The blocks are those of the label's own row.
    """
    wide = settled_labels(tokens, "confidence", "engine").where(F.col("scan_id").isNotNull())
    values = [f"v_{f}" for f in L.FIELDS]
    free = F.filter("blocks", lambda b: ~F.array_contains("claimed", b.token_id))

    def earliest(search) -> Column:
        rows = F.transform("_free", lambda b: F.struct(b.token_id.alias("token_id"), search(b.text).alias("value"), b.confidence.alias("conf"), b.engine.alias("engine")))
        return F.array_min(F.filter(rows, lambda r: r.value.isNotNull()))

    def engine_of(v: str) -> Column:
        return F.array_max(F.transform(F.filter("blocks", lambda b: b.token_id == F.col(f"{v}.token_id")), lambda b: b.engine))

    per_label = wide.withColumn("_free", free).select(
        "scan_id",
        *values,
        earliest(_price_in).alias("price"),
        earliest(_maker_in).alias("maker"),
        earliest(_place_in).alias("place"),
        *[engine_of(v).alias(f"{v}_engine") for v in values],
    )

    def classified_first(search, loose: str) -> Column:
        own = [
            F.when(
                search(F.col(f"{v}.extracted_value")).isNotNull(),
                F.struct(
                    search(F.col(f"{v}.extracted_value")).alias("value"),
                    F.col(f"{v}.confidence").alias("conf"),
                    F.col(f"{v}_engine").alias("engine"),
                ),
            )
            for v in values
        ]
        return F.coalesce(*own, F.struct(*[F.col(f"{loose}.{part}") for part in ("value", "conf", "engine")]))

    staged = per_label.withColumns(
        {
            "_price": classified_first(_price_in, "price"),
            "_maker": classified_first(_maker_in, "maker"),
            "_place": classified_first(_place_in, "place"),
        }
    )
    special = {
        "mrp": (F.concat(F.lit("MRP Rs. "), F.col("_price.value")), F.col("_price")),
        "manufacturer_name_address": (
            F.when(F.col("_maker.value").isNotNull(), F.concat_ws(" ", "_maker.value", F.nullif(F.col("_place.value"), F.lit("")))),
            F.col("_maker"),
        ),
    }

    def row(field: str) -> Column:
        own = F.col(f"v_{field}")
        sure = own.confidence >= MERGE_FLOOR
        value, conf, engine = F.when(sure, own.extracted_value), F.when(sure, own.confidence), F.col(f"v_{field}_engine")
        if field in special:
            strong, source = special[field]
            strong = F.nullif(strong, F.lit(""))
            conf = F.when(strong.isNotNull(), source.conf).otherwise(conf)
            engine = F.when(strong.isNotNull(), source.engine).otherwise(engine)
            value = F.coalesce(strong, value)
        return F.struct(
            F.lit(field).alias("field_name"),
            value.alias("extracted_value"),
            F.when(value.isNotNull(), reading_method(F.coalesce(engine, F.lit("")))).otherwise("not_found").alias("extraction_method"),
            F.when(value.isNotNull(), conf).otherwise(F.lit(0.0)).alias("confidence"),
        )

    return staged.select("scan_id", F.inline_outer(F.array(*[row(f) for f in L.FIELDS])))


def all_blocks(tokens: DataFrame) -> DataFrame:
    """Classified values and the blocks none of them claimed, as one bag.

    Every value belongs to a block, so each block of the label's row yields the values it gave and, if free, itself.
    """
    picked = _picked(read_labels(tokens, "confidence"))
    joined = picked.withColumn("_block", F.explode_outer("blocks")).select("scan_id", *[f"v_{f}" for f in L.FIELDS], "_block.token_id", "_block.text", "_block.confidence")

    def block(name: Column, text: Column, confidence: Column) -> Column:
        return F.struct(name.alias("field_name"), text.alias("block_text"), confidence.alias("confidence"))

    def given(field: str) -> Column:
        own = F.col(f"v_{field}")
        return F.when(own.token_id == F.col("token_id"), block(F.lit(field), own.extracted_value, own.confidence))

    kept = [F.when(F.col(f"v_{f}.accepted"), F.col(f"v_{f}.token_id")) for f in L.FIELDS]
    free = ~F.array_contains(F.array_compact(F.array(*kept)), F.col("token_id"))
    itself = F.when(free, block(F.lit(None).cast("string"), F.col("text"), F.col("confidence")))
    opened = joined.select("scan_id", F.inline_outer(F.array_compact(F.array(*[given(f) for f in L.FIELDS], itself))))
    return opened.where(F.col("block_text").isNotNull())
