"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

DataFrame functions only. Four strict patterns give base spans, which always stay. A wider pattern proposes more
candidates (names after a title, secrets, identity numbers, local phone numbers, long numbers). Regex, checksum,
gazetteer, context, shape and boundary labelers vote +1, -1 or 0 on every candidate, base ones too. The votes of
the whole corpus are counted by pattern and features, at most 3^6 * 144 rows whatever the input; from these counts
expectation-maximisation estimates each labeler's reliability, and a naive Bayes classifier over the features is
trained on the resulting posteriors. It decides on the candidates that are not base spans.

Cases: a null or empty text has no spans; of spans that overlap, base ones win; equal rows are judged alike; with
no candidates at all the classifier accepts nothing; other columns are passed on by ``redact`` whatever they are
called. Offsets are code points, ends exclusive. A document is one row; its time and memory are in proportion to its
length and to the number of its matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.arrays import let, running

# The strict patterns. `\\G` and the look-behind skip starts inside a run that cannot match better;
# possessive repeats only spare backtracking where nothing follows.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]+\.[0-9]+\.[0-9]+\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_VALID = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}"
BASE = ["email", "ip", "card", "phone"]
WIDE = (
    r"(?<![0-9A-Za-z])(?:(?:Mr|Mrs|Ms|Dr)\.? [A-Z]\p{L}+|[0-9A-Fa-f]{32,64}|[0-9]{3}-[0-9]{2}-[0-9]{4}"
    r"|\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}|[0-9](?:[ -]?[0-9]){12,18})(?![0-9A-Za-z])"
)
MORE = ["name", "secret", "id", "local_phone", "number"]
CONTEXT = r"(?i)(token|key|secret|password|card|phone|tel|call|mail|contact|address|account|name|ssn)[^\n]{0,12}$"
FIRST_NAMES = "James|Mary|John|Anna|Robert|Linda|Michael|Maria|David|Susan|Peter|Laura|Thomas|Julia|Daniel|Sarah"
DOMAINS = r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
LABELERS = 6
ROUNDS = 25


PIECE = 1000  #: code points of a piece of ``cut_up``


def none() -> Column:
    return F.array().cast(SPAN)


def greatest(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def cut_up(text: Column) -> Column:
    """The text in pieces of ``PIECE`` code points, as finding a place in a long string takes time in proportion to the place."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))


def text_at(pieces: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end`` out of its pieces (a lambda's variable)."""
    first = F.floor(start / PIECE).cast("int")
    count = F.floor((end - 1) / PIECE).cast("int") - first + 1
    return F.when(end > start, F.substr(F.array_join(F.slice(pieces, first + 1, count), ""), start % PIECE + 1, end - start)).otherwise("")


def matches(text: Column, pattern: str, guard: Column, kind: Callable[[Column], Column]) -> Column:
    """Leftmost non-overlapping matches with their places, which are told by the lengths of the pieces between them."""
    values, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # One piece more than there are matches.
    each = F.filter(F.zip_with(values, pieces, lambda v, p: F.struct(v.alias("value"), p.alias("piece"))), lambda x: x["value"].isNotNull())

    def placed(found: Column) -> Column:
        sizes = F.transform(found, lambda x: F.length(x["piece"]) + F.length(x["value"]))
        ends = let(sizes, lambda n: running(n, F.lit(0), lambda a, b: a + b))
        return F.zip_with(
            found,
            ends,
            lambda x, end: F.struct(kind(x["value"]).alias("kind"), (end - F.length(x["value"])).alias("start"), end.alias("end"), x["value"].alias("value")),
        )

    return F.when(guard, let(each, placed).cast(SPAN)).otherwise(none())


def clear_of(wide: Column, base: Column) -> Column:
    """The spans of ``wide`` (apart from each other) that touch none of ``base``, by one pass over both in order each way."""
    far = F.lit(2**31 - 1)

    def event(order: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("wide"), s["end"].alias("end"), s.alias("span"))

    def kept(events: Column) -> Column:
        ends = F.transform(events, lambda e: F.when(e["wide"] == 0, e["end"]).otherwise(-1))
        starts = F.reverse(F.transform(events, lambda e: F.when(e["wide"] == 0, e["start"]).otherwise(far)))
        reach = let(ends, lambda x: running(x, F.lit(-1), greatest))
        ahead = F.reverse(let(starts, lambda x: running(x, far, least)))
        return let(
            reach, lambda r: let(ahead, lambda h: F.filter(events, lambda e, i: (e["wide"] == 1) & (F.get(r, i) <= e["start"]) & (F.get(h, i) >= e["end"])))
        )

    ordered = F.array_sort(F.concat(F.transform(base, event(0)), F.transform(wide, event(1))))
    return F.when((F.size(base) == 0) | (F.size(wide) == 0), wide).otherwise(F.transform(let(ordered, kept), lambda e: e["span"]))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Checksum of a string of digits."""
    number = F.reverse(digits(value))
    weighed = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))),
        lambda i: F.when(i % 2 == 1, digit_at(number, i)).otherwise(digit_at(number, i) * 2 - F.when(digit_at(number, i) > 4, 9).otherwise(0)),
    )
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0


def digit_at(number: Column, i: Column) -> Column:
    return F.coalesce(F.try_to_number(F.substr(number, i, F.lit(1)), F.lit("9")).cast("int"), F.lit(0))


def base_spans(text: Column) -> dict[str, Column]:
    """Array expressions of the base spans of each kind."""
    own = {k: (lambda value, k=k: F.lit(k)) for k in BASE}
    card = matches(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), own["card"])
    phone = matches(text, PHONE, F.contains(text, F.lit("+")), own["phone"])
    return {
        "email": matches(text, EMAIL, F.contains(text, F.lit("@")), own["email"]),
        "ip": F.filter(matches(text, IP, text.rlike(r"[0-9]\.[0-9]"), own["ip"]), lambda s: s["value"].rlike(IP_VALID)),
        "card": F.filter(card, lambda s: F.length(digits(s["value"])).between(16, 19) & luhn(s["value"])),
        "phone": F.filter(phone, lambda s: F.length(digits(s["value"])).between(8, 15)),
    }


def wide_kind(value: Column) -> Column:
    return (
        F.when(value.rlike("^(?:Mr|Mrs|Ms|Dr)"), "name")
        .when(value.rlike("^[0-9A-Fa-f]{32,64}$"), "secret")
        .when(value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "id")
        .when(value.rlike(r"^\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}$"), "local_phone")
        .otherwise("number")
    )


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns as ``_row``, ``_text``, base spans by kind, ``_base`` (all of them) and ``_wide`` (candidates clear of them)."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), F.coalesce(docs[text], F.lit("")).alias("_text"))
    whole = F.col("_text")
    found = rows.select("_row", "_text", *(v.alias(f"_{k}") for k, v in base_spans(whole).items()))
    # Every alternative of the pattern holds one of these.
    guard = whole.rlike("[0-9]{3}|(?:Mr|Mrs|Ms|Dr)[. ]|[0-9](?:[ -]?[0-9]){12}|[0-9A-Fa-f]{32}")
    found = found.withColumn("_base", F.concat(*(F.col(f"_{k}") for k in BASE))).withColumn("_all", matches(whole, WIDE, guard, wide_kind))
    return found.withColumn("_wide", clear_of(F.col("_all"), F.col("_base"))).drop("_all")


def before_of(pieces: Column, span: Column) -> Column:
    return text_at(pieces, F.greatest(span["start"] - 24, F.lit(0)), span["start"])


def votes(pieces: Column, span: Column) -> list[Column]:
    """The labelers' votes on a span."""
    kind, value, before = span["kind"], span["value"], before_of(pieces, span)
    after = text_at(pieces, span["end"], span["end"] + 1)
    number = kind.isin("card", "number")

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    return [
        vote(kind.isin(*BASE, "secret", "id"), kind == "number"),
        vote(number & luhn(value), number & ~luhn(value)),
        vote((kind == "email") & value.rlike(DOMAINS) | (kind == "name") & value.rlike(FIRST_NAMES) | number & value.rlike(ISSUERS), number & ~value.rlike(ISSUERS)),
        vote(before.rlike(CONTEXT), F.lit(False)),
        vote((kind == "secret") & value.rlike("[0-9]") & value.rlike("(?i)[a-f]"), value.rlike(r"([0-9A-Za-z])\1{5}") | (kind == "secret") & ~value.rlike("(?i)[a-f]")),
        vote(after.rlike(r"^[\s\"'.,;:!?)#*$%&|]?$"), after.rlike(r"^[\p{L}\p{N}@]$")),
    ]


def features(pieces: Column, span: Column) -> list[Column]:
    """Kind, length band, and whether context stands before the span."""
    before = before_of(pieces, span)
    size = F.length(span["value"])
    band = F.when(size < 12, 0).when(size < 17, 1).when(size < 32, 2).otherwise(3)
    return [span["kind"], band.cast("string"), before.rlike(CONTEXT).cast("string"), luhn(span["value"]).cast("string")]


class Model:
    """Reliabilities of the labelers, and the log-odds of the classifier's features."""

    def __init__(self, counted: list[tuple[list[int], list[str], int]]):
        total = sum(n for _, _, n in counted)
        prior, table = 0.5, [{v: (0.6 if v == 1 else 0.1 if v == -1 else 0.3, 0.1 if v == 1 else 0.6 if v == -1 else 0.3) for v in (-1, 0, 1)} for _ in range(LABELERS)]
        posterior = [0.5] * len(counted)
        for _ in range(ROUNDS if total else 0):
            for i, (votes_, _, _) in enumerate(counted):
                yes, no = math.log(prior), math.log(1 - prior)
                for j, v in enumerate(votes_):
                    yes, no = yes + math.log(table[j][v][0]), no + math.log(table[j][v][1])
                posterior[i] = 1 / (1 + math.exp(min(700.0, no - yes)))
            mass = sum(p * n for p, (_, _, n) in zip(posterior, counted))
            prior = min(0.99, max(0.01, (mass + 1) / (total + 2)))
            for j in range(LABELERS):
                for v in (-1, 0, 1):
                    yes = sum(p * n for p, (vs, _, n) in zip(posterior, counted) if vs[j] == v)
                    no = sum((1 - p) * n for p, (vs, _, n) in zip(posterior, counted) if vs[j] == v)
                    table[j][v] = ((yes + 1) / (mass + 3), (no + 1) / (total - mass + 3))
        self.reliability, self.prior = table, prior
        mass = sum(p * n for p, (_, _, n) in zip(posterior, counted))
        self.bias = math.log((mass + 1) / (total - mass + 1)) if total else -1.0
        self.odds: list[dict[str, float]] = []
        for j in range(len(counted[0][1]) if counted else 0):
            values = {fs[j] for _, fs, _ in counted}
            yes = {v: sum(p * n for p, (_, fs, n) in zip(posterior, counted) if fs[j] == v) for v in values}
            no = {v: sum((1 - p) * n for p, (_, fs, n) in zip(posterior, counted) if fs[j] == v) for v in values}
            self.odds.append({v: math.log((yes[v] + 1) / (mass + len(values))) - math.log((no[v] + 1) / (total - mass + len(values))) for v in sorted(values)})

    def accepts(self, pieces: Column, span: Column) -> Column:
        """The classifier's verdict on a span."""
        score = F.lit(self.bias)
        for feature, odds in zip(features(pieces, span), self.odds):
            weight = F.lit(0.0)
            for value, w in odds.items():
                weight = F.when(feature == value, F.lit(w)).otherwise(weight)
            score = score + weight
        return score > 0


def fit(candidates: DataFrame) -> Model:
    """Votes and features of all candidates, counted; only the counts reach the driver."""
    spans = F.concat("_base", "_wide")

    def judged_spans(pieces: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(F.array(*votes(pieces, s)).alias("votes"), F.array(*features(pieces, s)).alias("features")))

    each = candidates.filter(F.size("_base") + F.size("_wide") > 0).select(F.inline(let(cut_up(F.col("_text")), judged_spans)))
    return Model([(r[0], r[1], r[2]) for r in each.groupBy("votes", "features").count().collect()])


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """``with_candidates`` and ``_more``: the candidates that the classifier accepts."""
    candidates = with_candidates(docs, text)
    model = fit(candidates)
    accepted = let(cut_up(F.col("_text")), lambda pieces: F.filter("_wide", lambda s: model.accepts(pieces, s)))
    return candidates.withColumn("_more", F.when(F.size("_wide") > 0, accepted).otherwise(none()))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def span_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts of base spans, digest of the base spans, list of all spans."""
    found = judged(docs, text)
    ordered = F.concat("_base", *(of_kind("_more", k) for k in MORE))
    return found.select(
        F.col("_row")[key].alias(key),
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        listed(ordered).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; where spans overlap, the first names them all."""
    found = judged(docs, text).withColumn("_spans", F.array_sort(F.transform(F.concat("_base", "_more"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    whole = F.col("_text")

    def replaced(pieces: Column, spans: Column, ends: Column) -> Column:
        def shown(s: Column, i: Column) -> Column:
            done = F.coalesce(F.get(ends, i - 1), F.lit(0))
            return F.when(s["start"] >= done, F.concat(text_at(pieces, done, s["start"]), F.lit("<"), s["kind"], F.lit(">"))).otherwise("")

        rest = text_at(pieces, F.get(ends, F.size(ends) - 1), F.length(whole))
        return F.concat(F.array_join(F.transform(spans, shown), ""), rest)

    def cut(spans: Column) -> Column:
        ends = let(F.transform(spans, lambda s: s["end"]), lambda x: running(x, F.lit(0), greatest))
        return let(ends, lambda e: let(cut_up(whole), lambda pieces: replaced(pieces, spans, e)))

    redacted = F.when(F.size("_spans") > 0, let(F.col("_spans"), cut)).otherwise(F.col("_row")[text])
    return found.select(F.col("_row").withField(text, redacted).alias("_row")).select("_row.*")
