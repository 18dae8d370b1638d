"""Recognised text blocks of a label: cleaning, lines, de-duplication, headings and neighbours.

Pairs are only formed between blocks in the same or adjoining grid cells of one label, so no label
ever yields all pairs of its blocks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.codes import batch_code
from tallymark.functions.geometry import box, cell, distance, edges, iou
from tallymark.operators.matching import choose_in_turn
from tallymark.rules.lexicon import ANCHORS, PROMO_QUANTITY

RADIUS = 350
MATCH_IOU = 0.35
ANCHOR_RATIO = 0.72
MIN_ANCHOR_CHARS = 2
MIN_WORD_CONFIDENCE = 0.10
SINGLES, CHAIN = 5, 4
DEFAULT_TOKEN_CONFIDENCE = 0.90


def clean_tokens(raw: DataFrame) -> DataFrame:
    """Drops blank text, fills missing geometry and confidence, and adds centres."""
    text = F.trim("text")
    side = {n: F.greatest(F.lit(1.0), F.coalesce(F.col(n), F.lit(0)).cast("double")) for n in ("w", "h")}
    at = {n: F.coalesce(F.col(n), F.lit(0)).cast("double") for n in ("x", "y")}
    return raw.where(text != "").select(
        "scan_id",
        "token_id",
        text.alias("text"),
        at["x"].alias("x"),
        at["y"].alias("y"),
        side["w"].alias("w"),
        side["h"].alias("h"),
        F.round(F.coalesce(F.nullif(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(DEFAULT_TOKEN_CONFIDENCE)), 4).alias("confidence"),
        F.coalesce(F.nullif("engine", F.lit("")), F.lit("tesseract")).alias("engine"),
        (at["x"] + side["w"] / 2).alias("cx"),
        (at["y"] + side["h"] / 2).alias("cy"),
    )


def assemble_lines(words: DataFrame) -> DataFrame:
    """Words of a printed line joined into segments; a wide gap starts a new segment.

    ``words`` has scan_id, block, line, word_no, text, x, y, w, h and confidence.
    """
    kept = words.where(
        (F.trim("text") != "") & (F.greatest("confidence", F.lit(0.0)) >= MIN_WORD_CONFIDENCE) & (F.col("w") > 0) & (F.col("h") > 0)
    )
    line = Window.partitionBy("scan_id", "block", "line").orderBy("word_no")
    reached = F.max(F.col("x") + F.col("w")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    breaks = (F.col("x") - reached > F.greatest(F.col("h") * 2.5, F.lit(45.0))).cast("int")
    segmented = kept.withColumn("_break", F.coalesce(breaks, F.lit(0))).withColumn(
        "segment", F.sum("_break").over(line.rowsBetween(Window.unboundedPreceding, 0))
    )
    ordered = F.array_sort(F.collect_list(F.struct("word_no", F.trim("text").alias("text"))))
    first = F.min(F.struct("word_no", "x", "y"))
    return segmented.groupBy("scan_id", "block", "line", "segment").agg(
        F.array_join(F.transform(ordered, lambda o: o.text), " ").alias("text"),
        first.x.alias("x"),
        first.y.alias("y"),
        (F.max(F.col("x") + F.col("w")) - first.x).alias("w"),
        (F.max(F.col("y") + F.col("h")) - first.y).alias("h"),
        F.round(F.avg("confidence"), 4).alias("confidence"),
    )


def text_pools(tokens: DataFrame) -> DataFrame:
    """All text of a label in reading order, one block per line."""
    ordered = F.array_sort(F.collect_list(F.struct("token_id", "text")))
    return tokens.groupBy("scan_id").agg(F.array_join(F.transform(ordered, lambda o: o.text), "\n").alias("text_pool"))


def covering_cells(start: Column, length: Column, size: Column) -> Column:
    return F.sequence(F.floor(start / size).cast("long"), F.floor((start + length) / size).cast("long"))


def merge_engines(blocks: DataFrame, cell_size: int = 200, most_cells: int = 64) -> DataFrame:
    """One block where two engines read the same region; the more confident reading is kept.

    Second-engine blocks choose in block order, each the best overlapping free block of the first
    engine (``engine`` is 'tesseract' or 'easyocr'). Candidate pairs come from shared grid cells, which are
    larger on a label of larger coordinates, so that a box covers at most ``most_cells`` of them either way. The choice
    is made for all labels at once in a few rounds; no list of a label is built. Boxes and choices are as many as the blocks,
    however small Spark takes them to be, so their joins are merged and nothing is sent whole through the driver.
    """
    # A box without a place or a size overlaps nothing.
    reach = F.max(F.greatest(F.abs("x"), F.abs("y"), F.abs(F.col("x") + F.col("w")), F.abs(F.col("y") + F.col("h"))))
    sized = blocks.withColumn("_size", F.greatest(F.lit(float(cell_size)), reach.over(Window.partitionBy("scan_id")) / (most_cells // 2)))
    celled = (
        sized.where((F.col("w") > 0) & (F.col("h") > 0))
        .withColumn("_box", box(*[F.col(c) for c in "xywh"]))
        .withColumn("_cx", F.explode(covering_cells(F.col("x"), F.col("w"), F.col("_size"))))
        .withColumn("_cy", F.explode(covering_cells(F.col("y"), F.col("h"), F.col("_size"))))
        .select("scan_id", "token_id", "engine", "confidence", "_box", "_cx", "_cy")
    )
    easy = celled.where(F.col("engine") == "easyocr").select(
        "scan_id", "_cx", "_cy", F.col("token_id").alias("e"), F.col("_box").alias("eb"), F.col("confidence").alias("ec")
    )
    tess = celled.where(F.col("engine") != "easyocr").select(
        "scan_id", "_cx", "_cy", F.col("token_id").alias("t"), F.col("_box").alias("tb"), F.col("confidence").alias("tc")
    )
    pairs = (
        easy.join(tess.hint("merge"), ["scan_id", "_cx", "_cy"])
        .withColumn("minus_iou", -iou(F.col("eb"), F.col("tb")))
        .where(F.col("minus_iou") <= -MATCH_IOU)
        .select("scan_id", "e", "t", "minus_iou", (F.col("ec") >= F.col("tc")).alias("easy_wins"))
        .distinct()
    )
    matched = choose_in_turn(pairs, "scan_id", "e", "t", "minus_iou")
    wins = F.col("easy_wins")
    taken = matched.select("scan_id", F.inline(F.array(F.struct(F.col("e").alias("token_id"), (~wins).alias("_lost")), F.struct(F.col("t").alias("token_id"), wins.alias("_lost")))))
    return (
        blocks.join(taken.hint("merge"), ["scan_id", "token_id"], "left")
        .where(~F.coalesce("_lost", F.lit(False)))
        .withColumn("engine_used", F.when(F.col("_lost").isNotNull(), F.concat("engine", F.lit("|merged"))).otherwise(F.col("engine")))
        .drop("_lost")
    )


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def letters_of(text: Column) -> Column:
    """One bit for each letter that a text holds."""
    bits = F.lit(0).cast("long")
    for i, letter in enumerate(LETTERS):
        bits = bits.bitwiseOR(F.when(F.contains(text, F.lit(letter)), F.lit(1 << i)).otherwise(0))
    return bits


class HeadingIndex:
    """All headings by length, each with the letters it holds, as constant arrays.

    A text within the ratio of a heading has a length in a range, which is a slice of the index, and neither holds
    more letters that the other lacks than edits are allowed. Only headings that pass both are compared by edit distance.
    """

    def __init__(self, anchors: dict[str, list[str]]):
        rows = [(len(a), f, i, a, sum(1 << k for k, c in enumerate(LETTERS) if c in a)) for f, words in enumerate(anchors.values()) for i, a in enumerate(words)]
        self.rows = sorted(rows)
        self.longest = self.rows[-1][0]
        #: Texts beyond this length resemble no heading.
        self.reach = int(self.longest / ANCHOR_RATIO)
        sizes = [r[0] for r in self.rows]
        fits = lambda n, m: abs(n - m) <= max(n, m) * (1.0 - ANCHOR_RATIO) + 1e-9
        spans = [[k for k, n in enumerate(sizes) if fits(n, m)] for m in range(self.reach + 1)]
        self.first = self.constant([s[0] if s else 0 for s in spans], "int")
        self.count = self.constant([len(s) for s in spans], "int")

    @staticmethod
    def constant(values: list, kind: str) -> Column:
        """Folded to one array when the plan is made, and built by one call."""
        return F.split(F.lit("|".join(map(str, values))), "[|]").cast(f"array<{kind}>")

    def column(self, n: int, kind: str) -> Column:
        return self.constant([r[n] for r in self.rows], kind)

    def resembling(self, upper: Column, letters: Column) -> Column:
        """Headings within the ratio of a text, as (field, ratio, minus_order, anchor)."""
        size, sizes, held = F.length(upper), self.column(0, "int"), self.column(4, "long")
        near = F.slice(self.constant(list(range(len(self.rows))), "int"), F.get(self.first, size) + 1, F.get(self.count, size))

        def possible(k: Column) -> Column:
            allowed = F.greatest(size, F.get(sizes, k)) * (1.0 - ANCHOR_RATIO) + 1e-9
            missing = F.bit_count(F.get(held, k).bitwiseAND(F.bitwise_not(letters))) <= allowed
            return missing & (F.bit_count(letters.bitwiseAND(F.bitwise_not(F.get(held, k)))) <= allowed)

        # No pair within the ratio is further apart than this; a distance given up on is -1.
        furthest = int(self.longest / ANCHOR_RATIO * (1.0 - ANCHOR_RATIO)) + 1
        field, order, anchor = self.column(1, "int"), self.column(2, "int"), self.column(3, "string")

        def compared(k: Column) -> Column:
            distance_ = F.nullif(F.levenshtein(upper, F.get(anchor, k), furthest), F.lit(-1))
            ratio = distance_ / -F.greatest(size, F.get(sizes, k)) + 1.0
            return F.struct(F.get(field, k).alias("field"), ratio.alias("ratio"), (-F.get(order, k)).alias("minus_order"), F.get(anchor, k).alias("anchor"))

        alike = F.filter(F.transform(F.filter(near, possible), compared), lambda r: r["ratio"] >= ANCHOR_RATIO)
        none = F.array().cast("array<struct<field:int,ratio:double,minus_order:int,anchor:string>>")
        # Headings hold no digits, so each digit of a text costs an edit.
        wordy = F.length(F.translate(upper, "0123456789", "")) >= size * ANCHOR_RATIO
        return F.when((size <= self.reach) & wordy, alike).otherwise(none)


def held_heading(upper: Column, anchors: list[str]) -> Column:
    """First heading that holds the text or is held by it."""
    listed = "|".join(anchors)
    exact = F.rlike(upper, F.lit("|".join(re.escape(a) for a in anchors))) | F.contains(F.lit(listed), upper)
    words = F.split(F.lit(listed), "[|]")
    held = F.transform(
        words,
        lambda a, i: F.when(
            F.contains(upper, a) | F.contains(a, upper), F.struct(F.lit(1.0).alias("ratio"), (-i).alias("minus_order"), a.alias("anchor"))
        ),
    )
    return F.when(exact, F.array_max(held))


def heading_lists(tokens: DataFrame) -> DataFrame:
    """Every block with its ``headings``: (field_name, anchor_order, m) of each field it reads like a heading of, if any.

    A heading that holds the text, or that the text holds, counts as equal; else the most alike by edit distance.
    The first one wins ties.
    """
    index = HeadingIndex(ANCHORS)
    upper = F.upper(F.trim("text"))

    def best(number: int, words: list[str]) -> Column:
        alike = F.transform(F.filter("_alike", lambda r: r["field"] == number), lambda r: F.struct(r["ratio"].alias("ratio"), r["minus_order"].alias("minus_order"), r["anchor"].alias("anchor")))
        return F.coalesce(held_heading(F.col("_upper"), words), F.array_max(alike))

    found = [
        F.struct(F.lit(field).alias("field_name"), F.lit(1).alias("anchor_order"), best(number, words).alias("m"))
        for number, (field, words) in enumerate(ANCHORS.items())
    ]
    promo = F.when(
        F.rlike(F.col("_upper"), F.lit(PROMO_QUANTITY)),
        F.struct(
            F.lit("net_quantity").alias("field_name"),
            F.lit(0).alias("anchor_order"),
            F.struct(F.lit(1.0).alias("ratio"), F.lit(0).alias("minus_order"), F.lit("FOR").alias("anchor")).alias("m"),
        ),
    )
    return (
        tokens.withColumn("_upper", upper)
        .withColumn("_letters", letters_of(F.col("_upper")))
        .withColumn("_alike", index.resembling(F.col("_upper"), F.col("_letters")))
        # On their own, so that the patterns stay compiled; the filter's lambda is not.
        .withColumn("_found", F.when(F.length("_upper") >= MIN_ANCHOR_CHARS, F.array(promo, *found)))
        .withColumn("headings", F.explode_outer(F.array(F.filter("_found", lambda c: c.m.ratio >= ANCHOR_RATIO))))
        .drop("_upper", "_letters", "_alike", "_found")
    )


def find_anchors(tokens: DataFrame) -> DataFrame:
    """Blocks that read like a heading, one row per field: scan_id, token_id, field_name, anchor, ratio, anchor_order."""
    return (
        heading_lists(tokens)
        .withColumn("_a", F.explode_outer("headings"))
        .where(F.col("_a").isNotNull())
        .withColumns(
            {
                "field_name": F.col("_a.field_name"),
                "anchor_order": F.col("_a.anchor_order"),
                "anchor": F.col("_a.m.anchor"),
                "ratio": F.col("_a.m.ratio"),
            }
        )
        .drop("headings", "_a")
    )


def approach(cx: Column, cy: Column, w: Column, h: Column, nx: Column, ny: Column) -> tuple[Column, Column, Column]:
    """Of a heading's centre and size and a block's centre: whether the block is near, whether to the right, and how far by weight."""
    dx, dy, far = nx - cx, ny - cy, distance(nx, ny, cx, cy)
    to_right = (dx > 0) & (F.abs(dy) <= F.greatest(h * 1.3, F.lit(30.0)))
    below = (dy > h * 0.4) & (F.abs(dx) <= F.greatest(w * 2.2, F.lit(260.0)))
    return (far <= RADIUS) & (to_right | below), to_right, F.round(F.when(to_right, far).otherwise(far * 1.25), 6)


def near_tokens(anchors: DataFrame, tokens: DataFrame, keep: int = SINGLES, how: str = "inner") -> DataFrame:
    """For each heading the nearest blocks to its right or below, by weighted distance.

    A heading looks into the nine cells around it; cells are as wide as the search radius. With
    ``how='left'`` headings without neighbours stay, with near_id null.
    """
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    box_of = edges(*[F.col(c) for c in "xywh"])
    left = (
        anchors.select("scan_id", "token_id", "field_name", "anchor_order", "ratio", "text", "cx", "cy", "w", "h", "confidence", box_of.alias("own_box"))
        .withColumn("_gx", F.explode(F.transform(around, lambda d: cell(F.col("cx"), RADIUS) + d)))
        .withColumn("_gy", F.explode(F.transform(around, lambda d: cell(F.col("cy"), RADIUS) + d)))
        .alias("l")
    )
    right = tokens.select(
        "scan_id",
        F.col("token_id").alias("near_id"),
        F.col("text").alias("near_text"),
        box_of.alias("near_box"),
        F.col("cx").alias("_nx"),
        F.col("cy").alias("_ny"),
        cell(F.col("cx"), RADIUS).alias("_gx"),
        cell(F.col("cy"), RADIUS).alias("_gy"),
    ).alias("r")
    near, to_right, eff_dist = approach(*[F.col(c) for c in ("cx", "cy", "w", "h", "_nx", "_ny")])
    same_cell = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("scan_id", "_gx", "_gy")]
    close = (F.col("near_id") != F.col("token_id")) & near
    pairs = (
        left.join(right, [*same_cell, close], how)
        .select(
            *[F.col(f"l.{c}").alias(c) for c in ("scan_id", "token_id", "field_name", "anchor_order", "ratio", "text", "confidence", "own_box")],
            "near_id",
            "near_text",
            "near_box",
            eff_dist.alias("eff_dist"),
            F.when(to_right, "right").when(F.col("near_id").isNotNull(), "below").alias("direction"),
        )
    )
    nearest = Window.partitionBy("scan_id", "token_id", "field_name", "anchor_order").orderBy(
        F.col("eff_dist").asc_nulls_last(), "near_id"
    )
    return pairs.withColumn("near_rank", F.row_number().over(nearest)).where(F.col("near_rank") <= keep)


def centre(block: Column) -> tuple[Column, Column]:
    return block.x + block.w / 2, block.y + block.h / 2


def strip(block: Column) -> Column:
    """The strip of a label, as high as the search radius, that holds a block's centre."""
    return cell(centre(block)[1], RADIUS)


def strips(blocks: Column) -> Column:
    """A label's blocks by strip: (at, blocks), so that a heading is held only against the strips around it."""

    def held(at: Column) -> Column:
        rows = F.transform(
            F.filter(blocks, lambda b: strip(b) == at),
            lambda b: F.struct(b.token_id.alias("token_id"), b.text.alias("text"), edges(b.x, b.y, b.w, b.h).alias("box"), centre(b)[0].alias("cx"), centre(b)[1].alias("cy")),
        )
        return F.struct(at.alias("at"), rows.alias("blocks"))

    return F.transform(F.array_distinct(F.transform(blocks, strip)), held)


def nearest_blocks(heading: Column, stripes: Column, keep: int = SINGLES) -> Column:
    """What ``near_tokens`` finds for one heading of a label, nearest first: (eff_dist, token_id, text, box)."""

    def reached(n: Column) -> Column:
        near, _, eff_dist = approach(*centre(heading), heading.w, heading.h, n.cx, n.cy)
        return F.when((n.token_id != heading.token_id) & near, F.struct(eff_dist.alias("eff_dist"), n.token_id.alias("token_id"), n.text.alias("text"), n.box.alias("box")))

    around = F.filter(stripes, lambda s: F.abs(s["at"] - strip(heading)) <= 1)
    return F.slice(F.sort_array(F.flatten(F.transform(around, lambda s: F.array_compact(F.transform(s.blocks, reached))))), 1, keep)


def nearest_batch_codes(tokens: DataFrame, barcodes: DataFrame, pools: DataFrame | None = None) -> DataFrame:
    """Batch code per label: the candidate block nearest its barcode, else the first; else the pooled text.

    ``barcodes`` has scan_id, bx, by, bw, bh. Candidates are reduced by min_by, so none are collected.
    """
    found = tokens.withColumn("code", batch_code(F.col("text"))).where(F.col("code").isNotNull())
    centred = found.join(barcodes, "scan_id", "left").withColumn(
        "dist",
        F.coalesce(
            distance(F.col("cx"), F.col("cy"), F.col("bx") + F.col("bw") / 2.0, F.col("by") + F.col("bh") / 2.0), F.lit(0.0)
        ),
    )
    best = centred.groupBy("scan_id").agg(
        F.min_by("code", F.struct("dist", "token_id")).alias("batch_code"), F.count(F.lit(1)).alias("candidates")
    )
    if pools is None:
        return best
    pooled = pools.select("scan_id", batch_code(F.col("text_pool")).alias("_pooled"))
    return (
        pooled.join(best, "scan_id", "left")
        .withColumn("batch_code", F.coalesce("batch_code", "_pooled"))
        .withColumn("candidates", F.coalesce("candidates", F.lit(0)))
        .drop("_pooled")
    )


def reading_order(tokens: DataFrame) -> DataFrame:
    """Position of each block on its label, top to bottom and left to right."""
    order = Window.partitionBy("scan_id").orderBy("y", "x", "token_id")
    return tokens.withColumn("reading_position", F.row_number().over(order))
