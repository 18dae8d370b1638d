"""Nested structure of page markup, by an index of its tags.

All tags of a page are listed once with their places; what lies between them are its pieces of text. The nesting
level of a tag is the running count of containers opened less those closed. Sorted by level and place, the tags of
one level stand together, so an element ends at its neighbour: the next tag of its level. That holds for any
depth, closes elements whose closing tag is left out where the next one of their kind opens, and takes time in
proportion to the number of tags (a sort). An element's text is a slice of the pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions.arrays import let, running_max, running_sum
from tallymark.functions.text import HIDDEN_PARTS, TAG, clean_text, unescape

# Containers and the items in them, by kind of structure.
TABLES = (["table"], ["tr", "td", "th"])
LISTS = (["ul", "ol"], ["li"])
TERMS = (["dl"], ["dt", "dd"])
BLOCKS = (["div"], [])
NAMES = sorted({n for containers, items in (TABLES, LISTS, TERMS, BLOCKS) for n in containers + items})
TAG_NAME = r"(?i)^</?(" + "|".join(NAMES) + r")(?=[\s/>])"
#: An element without an end reaches to the end of the page.
PAGE_END = 2**31 - 1


class Markup:
    """The index of one page: ``tags`` (place, name, open, mark) and ``pieces``, both a lambda's variables."""

    def __init__(self, tags: Column, pieces: Column):
        self.tags, self.pieces = tags, pieces

    def text(self, start: Column, end: Column) -> Column:
        """Clean text between two tags; each tag inside counts as a blank."""
        count = F.least(end, F.size(self.pieces) - 1) - start
        return clean_text(unescape(F.array_join(F.slice(self.pieces, start + 2, count), " ")))

    def elements(self, kind: tuple[list[str], list[str]]) -> Column:
        """Opening tags of one kind of structure as (level, at, name, mark, end), by level and place."""
        containers, items = kind
        own = F.filter(self.tags, lambda t: t["name"].isin(*containers, *items))

        def levelled(tags: Column) -> Column:
            change = F.transform(tags, lambda t: F.when(~t["name"].isin(*containers), 0).when(t["open"], 1).otherwise(-1))

            def placed(depth: Column) -> Column:
                def row(t: Column, i: Column) -> Column:
                    closes = t["name"].isin(*containers) & ~t["open"]
                    level = F.get(depth, i) + F.when(closes, 1).otherwise(0)
                    return F.struct(level.alias("level"), t["at"].alias("at"), t["name"].alias("name"), t["open"].alias("open"), t["mark"].alias("mark"))

                return F.array_sort(F.transform(tags, row))

            return let(running_sum(change), placed)

        def ended(sorted_: Column) -> Column:
            def row(t: Column, i: Column) -> Column:
                after = F.get(sorted_, i + 1)
                end = F.when(after["level"] == t["level"], after["at"]).otherwise(PAGE_END)
                return F.struct(t["level"].alias("level"), t["at"].alias("at"), t["name"].alias("name"), t["mark"].alias("mark"), t["open"].alias("open"), end.alias("end"))

            return F.filter(F.transform(sorted_, row), lambda t: t["open"])

        return let(let(own, levelled), ended)


def indexed(html: Column, mark: str, body: Callable[[Markup], Column]) -> Column:
    """``body`` of a page's index; ``mark`` is a pattern that opening tags of interest match."""
    seen = F.regexp_replace(html, HIDDEN_PARTS, " ")

    def tag(text: Column, at: Column) -> Column:
        name = F.lower(F.regexp_extract(text, TAG_NAME, 1))
        return F.struct(at.alias("at"), name.alias("name"), (~F.startswith(text, F.lit("</"))).alias("open"), F.rlike(text, F.lit(mark)).alias("mark"))

    def both(page: Column) -> Column:
        tags = F.filter(F.transform(F.regexp_extract_all(page, F.lit(TAG), F.lit(0)), tag), lambda t: t["name"] != "")
        return let(tags, lambda t: let(F.split(page, TAG, -1), lambda p: body(Markup(t, p))))

    return let(seen, both)


def pair(at: Column, key: Column, value: Column) -> Column:
    return F.struct(at.alias("at"), key.alias("key"), value.alias("value"))


def in_order(pairs: Column) -> Column:
    return F.array_sort(F.filter(pairs, lambda p: p.isNotNull()))


def table_pairs(page: Markup) -> Column:
    """First and second cell of every row that has two, also of tables inside cells; a cell's text includes what it holds."""

    def rows(tags: Column) -> Column:
        def row(t: Column, i: Column) -> Column:
            def cell(k: int) -> Column:
                return F.get(tags, i + k)

            def is_own(c: Column) -> Column:
                return c["name"].isin("td", "th") & (c["level"] == t["level"])

            found = (t["name"] == "tr") & is_own(cell(1)) & is_own(cell(2))
            return F.when(found, pair(t["at"], page.text(cell(1)["at"], cell(1)["end"]), page.text(cell(2)["at"], cell(2)["end"])))

        return F.transform(tags, row)

    return in_order(let(page.elements(TABLES), rows))


def term_pairs(page: Markup) -> Column:
    """The n-th term with the n-th meaning of every definition list."""

    def own_list(tags: Column) -> Column:
        lists = running_sum(F.transform(tags, lambda t: F.when(t["name"] == "dl", 1).otherwise(0)))

        def items(number: Column) -> Column:
            each = F.transform(tags, lambda t, i: F.struct(F.get(number, i).alias("list"), (t["name"] == "dd").alias("meaning"), t["at"].alias("at"), t["end"].alias("end"), t["name"].alias("name"), t["level"].alias("level")))
            return F.array_sort(F.filter(each, lambda t: (t["name"] != "dl") & (t["level"] > 0)))

        return let(lists, items)

    def matched(items: Column) -> Column:
        def starts(t: Column, i: Column) -> Column:
            before = F.get(items, i - 1)
            same = (before["list"] == t["list"]) & (before["meaning"] == t["meaning"])
            return F.when((i > 0) & same, -1).otherwise(i)

        def numbered(first: Column) -> Column:
            nth = F.transform(items, lambda t, i: F.struct(t["list"].alias("list"), (i - F.get(first, i)).alias("nth"), t["meaning"].alias("meaning"), t["at"].alias("at"), t["end"].alias("end")))
            return F.array_sort(nth)

        def met(sorted_: Column) -> Column:
            def row(t: Column, i: Column) -> Column:
                other = F.get(sorted_, i + 1)
                found = ~t["meaning"] & other["meaning"] & (other["list"] == t["list"]) & (other["nth"] == t["nth"])
                return F.when(found, pair(t["at"], page.text(t["at"], t["end"]), page.text(other["at"], other["end"])))

            return F.transform(sorted_, row)

        return let(let(running_max(F.transform(items, starts)), numbered), met)

    return in_order(let(let(page.elements(TERMS), own_list), matched))


def marked_lines(page: Markup) -> Column:
    """Text of every list item inside a marked block, at any depth."""

    def merged(blocks: Column, items: Column) -> Column:
        def event(order: int) -> Callable[[Column], Column]:
            return lambda t: F.struct(t["at"].alias("at"), F.lit(order).alias("item"), t["end"].alias("end"))

        return F.array_sort(F.concat(F.transform(blocks, event(0)), F.transform(items, event(1))))

    def inside(events: Column) -> Column:
        reach = running_max(F.transform(events, lambda e: F.when(e["item"] == 0, e["end"]).otherwise(-1)))
        return let(reach, lambda r: F.transform(F.filter(events, lambda e, i: (e["item"] == 1) & (F.get(r, i) > e["at"])), lambda e: page.text(e["at"], e["end"])))

    blocks = F.filter(page.elements(BLOCKS), lambda t: t["mark"])
    items = F.filter(page.elements(LISTS), lambda t: t["name"] == "li")
    return F.when(F.size(F.filter(page.tags, lambda t: t["mark"])) > 0, let(merged(blocks, items), inside)).otherwise(F.array().cast("array<string>"))
