"""Specifications from nested markup against a small parser."""

import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tallymark.operators import pages

ENDS = {"td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
HOLDERS = {"td": {"table"}, "th": {"table"}, "tr": {"table"}, "li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}}


class Node:
    def __init__(self, name, attrs=(), parent=None):
        self.name, self.attrs, self.parent, self.parts = name, dict(attrs), parent, []

    def text(self):
        return " ".join(" ".join(p if isinstance(p, str) else p.text() for p in self.parts).split())

    def all(self):
        for p in self.parts:
            if isinstance(p, Node):
                yield p
                yield from p.all()

    def above(self, names):
        node = self.parent
        while node and node.name not in names:
            node = node.parent
        return node


class Tree(HTMLParser):
    def __init__(self, html):
        super().__init__()
        self.root = self.at = Node("page")
        self.feed(html)

    def handle_starttag(self, name, attrs):
        # An open element of a kind that this one ends, within the same container.
        node = self.at
        if name in HOLDERS:
            while node and node.name not in HOLDERS[name]:
                if node.name in ENDS and name in ENDS[node.name]:
                    self.at = node.parent
                node = node.parent
        new = Node(name, attrs, self.at)
        self.at.parts.append(new)
        if name not in ("br", "img", "hr"):
            self.at = new

    def handle_endtag(self, name):
        node = self.at
        while node and node.name != name:
            if name in HOLDERS and node.name in HOLDERS[name]:
                return
            node = node.parent
        if node:
            self.at = node.parent

    def handle_data(self, text):
        if self.at.name != "script":
            self.at.parts.append(text)


def parsed(html):
    nodes = list(Tree(html).root.all())
    out = []
    for row in (n for n in nodes if n.name == "tr"):
        cells = [n for n in row.all() if n.name in ("td", "th") and n.above({"table"}) is row.above({"table"}) and n.above({"tr"}) is row]
        if len(cells) > 1:
            out.append((cells[0].text().lower(), cells[1].text()))
    terms = []
    for dl in (n for n in nodes if n.name == "dl"):
        own = [n for n in dl.all() if n.name in ("dt", "dd") and n.above({"dl"}) is dl]
        terms += list(zip([n for n in own if n.name == "dt"], [n for n in own if n.name == "dd"]))
    place = {id(n): i for i, n in enumerate(nodes)}
    out += [(a.text().lower(), b.text()) for a, b in sorted(terms, key=lambda t: place[id(t[0])])]
    for li in (n for n in nodes if n.name == "li"):
        node = li.parent
        while node and not (node.name == "div" and ("spec" in node.attrs.get("class", "").lower() or node.attrs.get("id") == "detailBullets_feature_div")):
            node = node.parent
        if node and ":" in li.text():
            key, value = li.text().split(":", 1)
            out.append((key.strip().lower(), value.strip()))
    return [(k, v) for k, v in out if k and v]


def found(spark, htmls):
    df = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")
    rows = df.select("page_id", pages.spec_entries(F.col("html")).alias("e")).collect()
    return {r.page_id: [(e.key, e.value) for e in r.e] for r in rows}


def made(rng, depth):
    """Random markup: tables in cells, lists in lists, blocks in blocks, some closing tags left out."""
    n = lambda: f"w{rng.randrange(999)}"
    inside = lambda: made(rng, depth - 1) if depth and rng.random() < 0.8 else n()
    end = lambda name: f"</{name}>" if rng.random() < 0.85 else ""
    kind = rng.randrange(5)
    if kind == 0:
        rows = "".join("<TR>" + "".join(f"<{c} class=a>{inside()} {n()}{end(c)}" for c in rng.choices(["td", "th"], k=rng.randrange(4))) + end("tr") for _ in range(3))
        return f"<table>{rows}</table>"
    if kind == 1:
        return "<ul>" + "".join(f"<li>{n()}: {n()} {inside()}{end('li')}" for _ in range(3)) + "</ul>"
    if kind == 2:
        return "<dl>" + "".join(f"<dt>{n()}{end('dt')}" + (f"<dd>{inside()}{end('dd')}" if rng.random() < 0.8 else "") for _ in range(3)) + "</dl>"
    if kind == 3:
        return f"<div class='{rng.choice(['x', 'product-spec', 'y z'])}'>{inside()}<p>{n()}<br/>{inside()}</p></div>{inside()}"
    return f"<div>{inside()}</div><!-- <table><tr><td>a<td>b --><script>'<tr><td>'</script>"


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8])
def test_random_markup(spark, depth):
    rng = random.Random(depth)
    htmls = [made(rng, depth) for _ in range(40)]
    ours = found(spark, htmls)
    assert any(ours.values())
    for i, html in enumerate(htmls):
        assert ours[i] == parsed(html), html


def test_depth_of_blocks_and_tables(spark):
    htmls = []
    for depth in range(1, 21):
        block = "<ul><li>Deep key: deep value</li></ul>"
        for i in range(depth):
            block = f"<div class='d{i}'>before {block}<div>beside</div></div>"
        table = "<table><tr><td>inner<td>cell</table>"
        for i in range(depth):
            table = f"<table><tr><th>key {i}</th><td>{table}</td></tr></table>"
        htmls.append(f"<div class='tech-spec'>{block}<ul><li>Last: one</li></ul></div>{table}<ul><li>not: a specification</li></ul>")
    ours = found(spark, htmls)
    for i, html in enumerate(htmls):
        assert ours[i] == parsed(html)
        assert ("deep key", "deep value") in ours[i] and ("inner", "cell") in ours[i] and ("last", "one") in ours[i]
        assert len(ours[i]) == i + 4


def test_large_pages_take_time_in_proportion(spark):
    def page(rows):
        cells = "".join(f"<tr><th>key {i}</th><td><b>value</b> {i} é</td></tr>" for i in range(rows))
        return f"<div class='spec'><table>{cells}</table><ul><li>a: b</ul></div>"

    def spent(rows):
        started = time.perf_counter()
        entries = found(spark, [page(rows)])[0]
        assert len(entries) == rows + 1 and entries[rows - 1] == (f"key {rows - 1}", f"value {rows - 1} é")
        return time.perf_counter() - started

    spent(100)
    small = spent(2500)
    large = spent(25000)  # 1.2 MB
    assert large < 25 * max(small, 0.5)
