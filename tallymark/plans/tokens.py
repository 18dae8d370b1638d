"""Text block, code and classification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions import codes
from tallymark.operators import classify as C
from tallymark.operators import tokens as T
from tallymark.plans.labels import origin_sql, quoted
from tallymark.plans.registry import query
from tallymark.rules import lexicon as L
from tallymark.sources.fixtures import Tables


def rx(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, {quoted(pattern)}, {group}), '')"


def ci(pattern: str) -> str:
    return "(?i)" + pattern


TOKEN_VIEWS = {
    "e_tokens": """SELECT scan_id, token_id, trim(text) AS text, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, greatest(1.0, w) AS w, greatest(1.0, h) AS h,
        round(coalesce(nullif(confidence, 0), 0.9), 4) AS confidence, coalesce(nullif(engine, ''), 'tesseract') AS engine, x + greatest(1.0, w) / 2 AS cx, y + greatest(1.0, h) / 2 AS cy
      FROM v_tokens WHERE trim(text) <> ''""",
}


def tokens(t: Tables) -> DataFrame:
    return T.clean_tokens(t.tokens)


@query("clean_tokens", "SELECT scan_id, token_id, text, CAST(w AS DOUBLE) AS w, confidence, engine, CAST(cx AS DOUBLE) AS cx, CAST(cy AS DOUBLE) AS cy FROM e_tokens", TOKEN_VIEWS)
def clean_tokens(t: Tables) -> DataFrame:
    return tokens(t).select("scan_id", "token_id", "text", "w", "confidence", "engine", "cx", "cy")


@query(
    "token_pools",
    "SELECT scan_id, string_agg(text, chr(10) ORDER BY token_id) AS text_pool FROM e_tokens GROUP BY 1",
    TOKEN_VIEWS,
)
def token_pools(t: Tables) -> DataFrame:
    return T.text_pools(tokens(t))


@query(
    "token_reading_order",
    "SELECT scan_id, token_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY y, x, token_id) AS INT) AS reading_position FROM e_tokens",
    TOKEN_VIEWS,
)
def token_reading_order(t: Tables) -> DataFrame:
    return T.reading_order(tokens(t)).select("scan_id", "token_id", "reading_position")


# Words of the printed lines: every block split at spaces, with a wide gap now and then.
WORD_VIEWS = {
    **TOKEN_VIEWS,
    "e_split": "SELECT scan_id, token_id, y, h, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS n FROM e_tokens",
    "e_words": """SELECT scan_id, 1 AS block, token_id AS line, n AS word_no, word AS text, n * 40 + CASE WHEN n >= 2 AND scan_id % 3 = 0 THEN 90 ELSE 0 END + CASE WHEN n >= 3 AND scan_id % 4 = 1 THEN 55 ELSE 0 END AS x,
        y + n % 2 AS y, 36 AS w, h, CASE WHEN (scan_id + n) % 11 = 0 THEN 0.05 ELSE 0.9 - n * 0.01 END AS confidence FROM e_split""",
    "e_kept": "SELECT *, max(x + w) OVER (PARTITION BY scan_id, block, line ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM e_words WHERE trim(text) <> '' AND confidence >= 0.10",
    "e_seg": "SELECT *, sum(CASE WHEN x - reached > greatest(h * 2.5, 45.0) THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id, block, line ORDER BY word_no) AS segment FROM e_kept",
}


def words(t: Tables) -> DataFrame:
    n = F.col("n")
    split = tokens(t).select("scan_id", "token_id", "y", "h", F.posexplode(F.split("text", " ")).alias("n", "word"))
    gap = F.when((n >= 2) & (F.col("scan_id") % 3 == 0), 90).otherwise(0) + F.when((n >= 3) & (F.col("scan_id") % 4 == 1), 55).otherwise(0)
    return split.select(
        "scan_id",
        F.lit(1).alias("block"),
        F.col("token_id").alias("line"),
        n.alias("word_no"),
        F.col("word").alias("text"),
        (n * 40 + gap).alias("x"),
        (F.col("y") + n % 2).alias("y"),
        F.lit(36).alias("w"),
        "h",
        F.when((F.col("scan_id") + n) % 11 == 0, F.lit(0.05)).otherwise(0.9 - n * 0.01).alias("confidence"),
    )


@query(
    "assembled_lines",
    """SELECT scan_id, line, CAST(segment AS BIGINT) AS segment, string_agg(text, ' ' ORDER BY word_no) AS text, min(x) AS x, CAST(max(x + w) - min(x) AS INT) AS w, round(avg(confidence), 4) AS confidence
    FROM e_seg GROUP BY 1, 2, 3""",
    WORD_VIEWS,
)
def assembled_lines(t: Tables) -> DataFrame:
    return T.assemble_lines(words(t)).select("scan_id", "line", "segment", "text", "x", "w", "confidence")


# --- headings and neighbours -----------------------------------------------------------------------
def _anchor_rows() -> str:
    return " UNION ALL ".join(
        f"SELECT '{field}' AS field_name, {i} AS i, {quoted(a)} AS a" for field, words_ in L.ANCHORS.items() for i, a in enumerate(words_)
    )


ANCHOR_VIEWS = {
    **TOKEN_VIEWS,
    "e_headings": _anchor_rows(),
    "e_ratio": """SELECT t.scan_id, t.token_id, h.field_name, h.i, h.a, CASE WHEN contains(upper(t.text), h.a) OR contains(h.a, upper(t.text)) THEN 1.0
        ELSE 1.0 - CAST(levenshtein(upper(t.text), h.a) AS DOUBLE) / greatest(length(t.text), length(h.a)) END AS ratio FROM e_tokens t CROSS JOIN e_headings h WHERE length(t.text) >= 2""",
    "e_anchor": f"""SELECT scan_id, token_id, field_name, 1 AS anchor_order, a AS anchor, ratio FROM e_ratio WHERE ratio >= 0.72
        QUALIFY row_number() OVER (PARTITION BY scan_id, token_id, field_name ORDER BY ratio DESC, i) = 1
      UNION ALL SELECT scan_id, token_id, 'net_quantity', 0, 'FOR', 1.0 FROM e_tokens WHERE regexp_matches(upper(text), {quoted(L.PROMO_QUANTITY)})""",
    "e_near": """SELECT *, row_number() OVER (PARTITION BY scan_id, token_id, field_name, anchor_order ORDER BY eff_dist, near_id) AS near_rank FROM (
        SELECT a.scan_id, a.token_id, a.field_name, a.anchor_order, n.token_id AS near_id, n.text AS near_text, n.x AS nx, n.y AS ny, n.x + n.w AS nx2, n.y + n.h AS ny2,
          round(CASE WHEN n.cx > t.cx AND abs(n.cy - t.cy) <= greatest(1.3 * t.h, 30) THEN 1.0 ELSE 1.25 END * sqrt((n.cx - t.cx) ** 2 + (n.cy - t.cy) ** 2), 6) AS eff_dist,
          CASE WHEN n.cx > t.cx AND abs(n.cy - t.cy) <= greatest(1.3 * t.h, 30) THEN 'right' ELSE 'below' END AS direction
        FROM e_anchor a JOIN e_tokens t USING (scan_id, token_id) JOIN e_tokens n ON n.scan_id = a.scan_id AND n.token_id <> a.token_id
        WHERE sqrt((n.cx - t.cx) ** 2 + (n.cy - t.cy) ** 2) <= 350 AND ((n.cx > t.cx AND abs(n.cy - t.cy) <= greatest(1.3 * t.h, 30))
          OR (n.cy - t.cy > 0.4 * t.h AND abs(n.cx - t.cx) <= greatest(2.2 * t.w, 260))))""",
}


@query("heading_tokens", "SELECT scan_id, token_id, field_name, anchor_order, anchor, CAST(ratio AS DOUBLE) AS ratio FROM e_anchor", ANCHOR_VIEWS)
def heading_tokens(t: Tables) -> DataFrame:
    return T.find_anchors(tokens(t)).select("scan_id", "token_id", "field_name", "anchor_order", "anchor", "ratio")


@query(
    "heading_neighbours",
    "SELECT scan_id, token_id, field_name, anchor_order, near_id, CAST(near_rank AS INT) AS near_rank, CAST(eff_dist AS DOUBLE) AS eff_dist, direction FROM e_near WHERE near_rank <= 5",
    ANCHOR_VIEWS,
)
def heading_neighbours(t: Tables) -> DataFrame:
    cleaned = tokens(t)
    near = T.near_tokens(T.find_anchors(cleaned), cleaned)
    return near.select("scan_id", "token_id", "field_name", "anchor_order", "near_id", "near_rank", "eff_dist", "direction")


# --- two engines -----------------------------------------------------------------------------------
@query(
    "merged_blocks",
    """WITH RECURSIVE pairs AS (SELECT e.scan_id, e.token_id AS e, t.token_id AS t, e.confidence >= t.confidence AS easy_wins,
        CAST((least(e.x + e.w, t.x + t.w) - greatest(e.x, t.x)) * (least(e.y + e.h, t.y + t.h) - greatest(e.y, t.y)) AS DOUBLE) AS inter, e.w * e.h + t.w * t.h AS areas
      FROM v_blocks e JOIN v_blocks t ON t.scan_id = e.scan_id AND e.engine = 'easyocr' AND t.engine = 'tesseract'
        AND least(e.x + e.w, t.x + t.w) > greatest(e.x, t.x) AND least(e.y + e.h, t.y + t.h) > greatest(e.y, t.y)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY e, inter / (areas - inter) DESC, t) AS k FROM pairs WHERE inter / (areas - inter) >= 0.35),
    walk AS (SELECT scan_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS es, CAST([] AS BIGINT[]) AS ts, CAST([] AS BIGINT[]) AS losers FROM (SELECT DISTINCT scan_id FROM ranked)
      UNION ALL SELECT w.scan_id, r.k, CASE WHEN list_contains(w.es, r.e) OR list_contains(w.ts, r.t) THEN w.es ELSE list_append(w.es, r.e) END,
        CASE WHEN list_contains(w.es, r.e) OR list_contains(w.ts, r.t) THEN w.ts ELSE list_append(w.ts, r.t) END,
        CASE WHEN list_contains(w.es, r.e) OR list_contains(w.ts, r.t) THEN w.losers ELSE list_append(w.losers, CASE WHEN r.easy_wins THEN r.t ELSE r.e END) END
      FROM walk w JOIN ranked r ON r.scan_id = w.scan_id AND r.k = w.k + 1),
    done AS (SELECT scan_id, es, ts, losers FROM walk QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY k DESC) = 1)
    SELECT b.scan_id, b.token_id, CASE WHEN list_contains(d.es, b.token_id) OR list_contains(d.ts, b.token_id) THEN b.engine || '|merged' ELSE b.engine END AS engine_used
    FROM v_blocks b LEFT JOIN done d USING (scan_id) WHERE NOT coalesce(list_contains(d.losers, b.token_id), false)""",
)
def merged_blocks(t: Tables) -> DataFrame:
    return T.merge_engines(t.blocks).select("scan_id", "token_id", "engine_used")


# --- codes -----------------------------------------------------------------------------------------
def _batch_sql(text: str) -> str:
    def valid(p: str) -> str:
        code = f"regexp_replace(regexp_extract({text}, {quoted(p)}, 1), '^[.,:/-]+|[.,:/-]+$', '', 'g')"
        stops = ", ".join(quoted(w) for w in L.BATCH_STOPWORDS)
        return f"CASE WHEN length({code}) >= 2 AND lower({code}) NOT IN ({stops}) THEN {code} END"

    return f"coalesce({', '.join(valid(p) for p in L.BATCH_PATTERNS)})"


@query(
    "product_codes",
    r"""SELECT scan_id, CASE WHEN code_format = 'EAN-13' AND length(trim(code_text)) = 13 THEN trim(code_text) WHEN code_format = 'UPC_A' AND length(trim(code_text)) = 12 THEN trim(code_text)
      WHEN code_format = 'EAN8' AND length(trim(code_text)) = 8 THEN trim(code_text) WHEN code_format = 'ITF-14' AND length(trim(code_text)) = 14 THEN trim(code_text)
      WHEN regexp_matches(code_text, '(?:/01/|\(01\))\d{8,14}') THEN regexp_extract(code_text, '(?:/01/|\(01\))(\d{8,14})', 1)
      WHEN regexp_full_match(trim(code_text), '\d{8}|\d{12}|\d{13}|\d{14}') THEN trim(code_text) END AS gtin FROM v_codes""",
)
def product_codes(t: Tables) -> DataFrame:
    return t.codes.select("scan_id", codes.gtin(F.col("code_text"), F.col("code_format")).alias("gtin"))


@query(
    "label_batch_codes",
    f"""WITH c AS (SELECT t.scan_id, t.token_id, {_batch_sql('text')} AS code, sqrt((t.cx - (b.bx + b.bw / 2.0)) ** 2 + (t.cy - (b.by + b.bh / 2.0)) ** 2) AS dist FROM e_tokens t JOIN v_codes b USING (scan_id)),
    best AS (SELECT scan_id, code FROM c WHERE code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY dist, token_id) = 1),
    pool AS (SELECT scan_id, {_batch_sql("string_agg(text, chr(10) ORDER BY token_id)")} AS code FROM e_tokens GROUP BY 1)
    SELECT p.scan_id, coalesce(b.code, p.code) AS batch_code, (SELECT count(*) FROM c WHERE c.scan_id = p.scan_id AND c.code IS NOT NULL) AS candidates FROM pool p LEFT JOIN best b USING (scan_id)""",
    TOKEN_VIEWS,
)
def label_batch_codes(t: Tables) -> DataFrame:
    cleaned = tokens(t)
    return T.nearest_batch_codes(cleaned, t.codes.select("scan_id", "bx", "by", "bw", "bh"), T.text_pools(cleaned))


# --- scoring and classification --------------------------------------------------------------------
def score_sql(field: str, text: str) -> str:
    def hit(p: str) -> str:
        return f"regexp_matches({text}, {quoted(ci(p))})"

    cases = [f"WHEN trim({text}) = '' THEN 0.0"]
    for has, lacks in L.VETOES.get(field, []):
        cases.append(f"WHEN {hit(has)}" + (f" AND NOT {hit(lacks)}" if lacks else "") + " THEN 0.0")
    if field == "manufacturer_name_address":
        cases.append(f"WHEN {hit(L.BARE_MAKER)} THEN 0.45")
    for pattern, conf in sorted(L.VALIDATORS[field], key=lambda v: -v[1]):
        cases.append(f"WHEN {hit(pattern)} THEN {conf}")
    return f"CAST(CASE {' '.join(cases)} ELSE 0.0 END AS DOUBLE)"


def clean_sql(field: str, raw: str) -> str:
    text = f"trim({raw})"
    if field == "country_of_origin":
        found = origin_sql(text)
        place = f"split_part({found}, '|', 4)"
        where = (
            f"CASE WHEN {place} LIKE 'State: %' THEN ' (Inferred from Location: ' || substr({place}, 8) || ')' WHEN {place} LIKE 'City: %' THEN ' (Inferred from Location: ' || substr({place}, 7) || ')' "
            f"WHEN {place} LIKE 'PIN Code: %' THEN ' (Inferred from Postal PIN Code)' WHEN {place} LIKE '% (__-%' THEN ' (Inferred from Location: ' || regexp_extract({place}, '^(.*) \\(', 1) || ')' "
            f"WHEN {place} IN ('Explicit declaration', 'India keyword') THEN '' ELSE ' (Inferred from Location: ' || regexp_extract({place}, '^(.*), ', 1) || ')' END"
        )
        return (
            f"coalesce('Country of Origin: ' || trim({rx(text, ci(L.ORIGIN_STATED))}), 'Country of Origin: ' || split_part({found}, '|', 1) || {where}, {text})"
        )
    if field == "manufacturer_name_address":
        noise = quoted(ci(L.MAKER_NOISE))
        name = f"trim(regexp_replace(coalesce(trim({rx(text, ci(L.MAKER_NAMED))}), trim({rx(text, L.MAKER_SUFFIXED)}), ''), {noise}, '', 'g'))"
        place = f"trim(regexp_replace(coalesce(trim({rx(text, ci(L.MAKER_ADDRESS))}), ''), {noise}, '', 'g'))"
        both = f"CASE WHEN {place} <> '' AND NOT contains({name}, {place}) THEN {name} || ' ' || {place} ELSE coalesce(nullif({name}, ''), {text}) END"
        return f"left(trim(regexp_replace({both}, '\\s+', ' ', 'g')), 200)"
    target = text
    if field == "net_quantity":
        target = f"coalesce(nullif(trim(regexp_replace({text}, {quoted(ci(L.QUANTITY_TAIL))}, '')), ''), {text})"
    parts = [f"{quoted(prefix)} || trim({rx(target, ci(p))})" for prefix, p in L.TEMPLATES[field]]
    return f"coalesce({', '.join(parts)}, {text})"


def by_field(build) -> str:
    return "CASE field_name " + " ".join(f"WHEN '{f}' THEN {build(f)}" for f in L.FIELDS) + " END"


CLASS_VIEWS = {
    **ANCHOR_VIEWS,
    "e_tscore": "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT scan_id, token_id, text, '{f}' AS field_name, {score_sql(f, 'text')} AS score, x, y, x + w AS x2, y + h AS y2 FROM e_tokens" for f in L.FIELDS)
    + ") WHERE score > 0",
    "e_options": """SELECT a.scan_id, a.token_id, a.field_name, a.anchor_order, a.ratio, 0 AS step, t.text, t.x, t.y, t.x + t.w AS x2, t.y + t.h AS y2 FROM e_anchor a JOIN e_tokens t USING (scan_id, token_id)
      UNION ALL SELECT a.scan_id, a.token_id, a.field_name, a.anchor_order, a.ratio, n.near_rank * 2 - 1, t.text || ' ' || n.near_text, least(t.x, nx), least(t.y, ny), greatest(t.x + t.w, nx2), greatest(t.y + t.h, ny2)
        FROM e_anchor a JOIN e_tokens t USING (scan_id, token_id) JOIN e_near n USING (scan_id, token_id, field_name, anchor_order) WHERE n.near_rank <= 5
      UNION ALL SELECT a.scan_id, a.token_id, a.field_name, a.anchor_order, a.ratio, n.near_rank * 2, n.near_text, nx, ny, nx2, ny2 FROM e_anchor a JOIN e_near n USING (scan_id, token_id, field_name, anchor_order) WHERE n.near_rank <= 5
      UNION ALL SELECT a.scan_id, a.token_id, a.field_name, a.anchor_order, a.ratio, 11, t.text || ' ' || c.chained, least(t.x, c.nx), least(t.y, c.ny), greatest(t.x + t.w, c.nx2), greatest(t.y + t.h, c.ny2) FROM e_anchor a JOIN e_tokens t USING (scan_id, token_id)
        JOIN (SELECT scan_id, token_id, field_name, anchor_order, string_agg(near_text, ' ' ORDER BY near_rank) AS chained, min(nx) AS nx, min(ny) AS ny, max(nx2) AS nx2, max(ny2) AS ny2
          FROM e_near WHERE near_rank <= 4 GROUP BY 1, 2, 3, 4) c USING (scan_id, token_id, field_name, anchor_order)""",
    "e_oscore": f"SELECT *, {by_field(lambda f: score_sql(f, 'text'))} AS score FROM e_options",
    "e_avalue": """SELECT scan_id, token_id, field_name, anchor_order, text, x, y, x2, y2, round(least(1.0, score * (0.85 + 0.15 * ratio)), 9) AS conf FROM e_oscore
      QUALIFY row_number() OVER (PARTITION BY scan_id, token_id, field_name, anchor_order ORDER BY (step = 0 AND score >= 0.80) DESC, score DESC, step) = 1""",
    "e_abest": "SELECT * FROM e_avalue WHERE conf > 0 QUALIFY row_number() OVER (PARTITION BY scan_id, field_name ORDER BY conf DESC, token_id, anchor_order) = 1",
    "e_ids": "SELECT DISTINCT scan_id FROM e_tokens",
}
for _i, _f in enumerate(L.FIELDS):
    _claimed = f"AND NOT EXISTS (SELECT 1 FROM e_claim{_i - 1} c WHERE c.scan_id = s.scan_id AND c.token_id = s.token_id)" if _i else ""
    CLASS_VIEWS[f"e_free{_i}"] = (
        f"SELECT * FROM e_tscore s WHERE field_name = '{_f}' {_claimed} QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, token_id) = 1"
    )
    _use = "coalesce(a.conf, 0) < 0.80 AND f.score > coalesce(a.conf, 0)"
    CLASS_VIEWS[f"e_pick{_i}"] = (
        f"SELECT i.scan_id, '{_f}' AS field_name, CASE WHEN {_use} THEN f.score ELSE a.conf END AS conf, CASE WHEN {_use} THEN f.text ELSE a.text END AS text, "
        f"CASE WHEN {_use} THEN f.token_id ELSE a.token_id END AS token_id, " + ", ".join(f"CASE WHEN {_use} THEN f.{c} ELSE a.{c} END AS {c}" for c in ("x", "y", "x2", "y2")) + f" FROM e_ids i LEFT JOIN (SELECT * FROM e_abest WHERE field_name = '{_f}') a USING (scan_id) LEFT JOIN e_free{_i} f USING (scan_id)"
    )
    CLASS_VIEWS[f"e_claim{_i}"] = f"SELECT scan_id, token_id FROM e_pick{_i} WHERE conf >= 0.80" + (
        f" UNION ALL SELECT scan_id, token_id FROM e_claim{_i - 1}" if _i else ""
    )
CLASS_VIEWS["e_picked"] = " UNION ALL ".join(f"SELECT * FROM e_pick{i}" for i in range(len(L.FIELDS)))
CLASS_VIEWS["e_class"] = (
    f"SELECT scan_id, field_name, token_id, round(conf, 4) AS confidence, conf >= 0.80 AS accepted, {by_field(lambda f: clean_sql(f, 'text'))} AS extracted_value, x, y, x2, y2 "
    "FROM e_picked WHERE round(conf, 4) >= 0.30"
)
_DAY = r"nullif(regexp_extract(extracted_value, '(\d{1,2}[/\.-]\d{1,2}[/\.-]\d{2,4})', 1), '')"
CLASS_VIEWS["e_dated"] = f"""SELECT * FROM e_class c WHERE NOT (field_name = 'expiry_date' AND accepted AND EXISTS (SELECT 1 FROM e_class m WHERE m.scan_id = c.scan_id AND m.field_name = 'manufacture_date'
    AND m.accepted AND {_DAY.replace('extracted_value', 'm.extracted_value')} = {_DAY.replace('extracted_value', 'c.extracted_value')}))"""
CLASS_VIEWS["e_lack"] = """SELECT scan_id, string_agg(text, chr(10) ORDER BY token_id) AS pool, (SELECT max(extracted_value) FROM e_dated d WHERE d.scan_id = t.scan_id AND d.field_name = 'manufacturer_name_address' AND d.accepted) AS maker
    FROM e_tokens t WHERE NOT EXISTS (SELECT 1 FROM e_dated d WHERE d.scan_id = t.scan_id AND d.field_name = 'country_of_origin' AND d.accepted) GROUP BY 1"""
CLASS_VIEWS["e_inferred"] = f"SELECT scan_id, coalesce({origin_sql('maker')}, {origin_sql('pool')}) AS g FROM e_lack"
CLASS_VIEWS["e_final"] = """SELECT scan_id, field_name, token_id, confidence, accepted, extracted_value, x, y, x2, y2 FROM e_dated d WHERE NOT (field_name = 'country_of_origin' AND NOT accepted
      AND EXISTS (SELECT 1 FROM e_inferred i WHERE i.scan_id = d.scan_id AND g IS NOT NULL))
    UNION ALL SELECT scan_id, 'country_of_origin', NULL, greatest(0.92, CAST(split_part(g, '|', 3) AS DOUBLE)), true, 'Country of Origin: ' || split_part(g, '|', 1), NULL, NULL, NULL, NULL FROM e_inferred WHERE g IS NOT NULL"""


@query(
    "value_boxes",
    """SELECT scan_id, field_name, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(x2 - x AS DOUBLE) AS w, CAST(y2 - y AS DOUBLE) AS h FROM e_final WHERE accepted""",
    CLASS_VIEWS,
)
def value_boxes(t: Tables) -> DataFrame:
    done = C.classify_labels(tokens(t)).where("accepted")
    return done.select("scan_id", "field_name", "box.x", "box.y", (F.col("box.x2") - F.col("box.x")).alias("w"), (F.col("box.y2") - F.col("box.y")).alias("h"))


@query("token_scores", "SELECT scan_id, token_id, field_name, score FROM e_tscore", CLASS_VIEWS)
def token_scores(t: Tables) -> DataFrame:
    return C.score_tokens(tokens(t).select("scan_id", "token_id", "text")).select("scan_id", "token_id", "field_name", "score")


@query(
    "token_clean_values",
    f"SELECT scan_id, token_id, field_name, {by_field(lambda f: clean_sql(f, 'text'))} AS clean_value FROM e_tscore",
    CLASS_VIEWS,
)
def token_clean_values(t: Tables) -> DataFrame:
    scored = C.score_tokens(tokens(t).select("scan_id", "token_id", "text"))
    return C.clean_values(scored).select("scan_id", "token_id", "field_name", "clean_value")


@query(
    "classified_fields",
    "SELECT scan_id, field_name, token_id, confidence, accepted, extracted_value FROM e_dated",
    CLASS_VIEWS,
)
def classified_fields(t: Tables) -> DataFrame:
    return C.classify(tokens(t)).drop("box")


@query(
    "classified_labels",
    """SELECT scan_id, field_name, confidence, accepted, CASE WHEN field_name = 'country_of_origin' THEN rtrim(regexp_extract(extracted_value, '^([^(]*)', 1)) ELSE extracted_value END AS extracted_value
    FROM (SELECT scan_id, field_name, confidence, accepted, trim(extracted_value) AS extracted_value FROM e_final)""",
    CLASS_VIEWS,
)
def classified_labels(t: Tables) -> DataFrame:
    done = C.classify_labels(tokens(t)).select("scan_id", "field_name", "confidence", "accepted", "extracted_value")
    bare = F.rtrim(F.regexp_extract("extracted_value", r"^([^(]*)", 1))
    return done.withColumn("extracted_value", F.when(F.col("field_name") == "country_of_origin", bare).otherwise(F.col("extracted_value")))


@query("failed_label_fields", """SELECT i.scan_id, f.field_name FROM e_ids i CROSS JOIN (SELECT DISTINCT field_name FROM e_headings) f
    WHERE NOT EXISTS (SELECT 1 FROM e_final d WHERE d.scan_id = i.scan_id AND d.field_name = f.field_name AND d.accepted)""", CLASS_VIEWS)
def failed_label_fields(t: Tables) -> DataFrame:
    return C.failed_fields(tokens(t))


CLASS_VIEWS["e_mblock"] = f"""SELECT scan_id, extracted_value AS text, CASE field_name {' '.join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(L.FIELDS))} END AS ord, confidence AS conf, engine
      FROM e_final LEFT JOIN (SELECT scan_id, token_id, engine FROM e_tokens) USING (scan_id, token_id)
    UNION ALL SELECT t.scan_id, t.text, t.token_id + 100, t.confidence, t.engine FROM e_tokens t WHERE NOT EXISTS (SELECT 1 FROM e_claim6 c WHERE c.scan_id = t.scan_id AND c.token_id = t.token_id)"""
_DEC = rx("text", ci(L.MERGE_DECIMAL))
CLASS_VIEWS["e_mfound"] = f"""SELECT *, coalesce({rx("text", ci(L.MERGE_PRICE))}, CASE WHEN TRY_CAST(replace({_DEC}, ',', '.') AS DOUBLE) > 1.0 THEN {_DEC} END) AS price, trim({rx("text", L.MERGE_MAKER)}) AS maker,
      CASE WHEN NOT contains(lower(text), 'kcal') THEN trim(regexp_replace(trim({rx("text", ci(L.MERGE_ADDRESS))}), '^\\d+[\\.\\,]\\d+\\s*', '')) END AS place FROM e_mblock"""
CLASS_VIEWS["e_mlabel"] = """SELECT scan_id, arg_min({'v': price, 'c': conf, 'e': engine}, ord) FILTER (price IS NOT NULL) AS price, arg_min({'v': maker, 'c': conf, 'e': engine}, ord) FILTER (maker IS NOT NULL) AS maker,
      arg_min(place, ord) FILTER (place IS NOT NULL) AS place FROM e_mfound GROUP BY 1"""
CLASS_VIEWS["e_mrow"] = """SELECT i.scan_id, f.field_name, CASE WHEN f.field_name = 'mrp' AND m.price IS NOT NULL THEN 'MRP Rs. ' || m.price.v WHEN f.field_name = 'manufacturer_name_address' AND m.maker IS NOT NULL
        THEN m.maker.v || CASE WHEN coalesce(m.place, '') <> '' THEN ' ' || m.place ELSE '' END ELSE d.extracted_value END AS extracted_value,
      CASE WHEN f.field_name = 'mrp' AND m.price IS NOT NULL THEN m.price.c WHEN f.field_name = 'manufacturer_name_address' AND m.maker IS NOT NULL THEN m.maker.c ELSE d.confidence END AS confidence,
      CASE WHEN f.field_name = 'mrp' AND m.price IS NOT NULL THEN m.price.e WHEN f.field_name = 'manufacturer_name_address' AND m.maker IS NOT NULL THEN m.maker.e ELSE t.engine END AS engine
    FROM e_ids i CROSS JOIN (SELECT DISTINCT field_name FROM e_headings) f LEFT JOIN e_mlabel m USING (scan_id)
    LEFT JOIN (SELECT * FROM e_final WHERE confidence >= 0.60) d ON d.scan_id = i.scan_id AND d.field_name = f.field_name LEFT JOIN e_tokens t ON t.scan_id = d.scan_id AND t.token_id = d.token_id"""


@query(
    "merged_label_fields",
    """SELECT scan_id, field_name, CASE WHEN field_name = 'country_of_origin' THEN rtrim(regexp_extract(extracted_value, '^([^(]*)', 1)) ELSE extracted_value END AS extracted_value,
      CASE WHEN extracted_value IS NULL THEN 'not_found' WHEN engine = 'easyocr' THEN 'ocr_easyocr' ELSE 'ocr_tesseract' END AS extraction_method, CAST(coalesce(confidence, 0) AS DOUBLE) AS confidence FROM e_mrow""",
    CLASS_VIEWS,
)
def merged_label_fields(t: Tables) -> DataFrame:
    merged = C.merge_fields(tokens(t))
    bare = F.rtrim(F.regexp_extract("extracted_value", r"^([^(]*)", 1))
    return merged.withColumn("extracted_value", F.when(F.col("field_name") == "country_of_origin", bare).otherwise(F.col("extracted_value")))


@query("label_blocks", "SELECT scan_id, text AS block_text, CAST(conf AS DOUBLE) AS confidence FROM (SELECT scan_id, text, ord, conf FROM e_lblock)", {
    **CLASS_VIEWS,
    "e_lblock": """SELECT scan_id, extracted_value AS text, 0 AS ord, confidence AS conf FROM e_dated UNION ALL SELECT t.scan_id, t.text, 1, t.confidence FROM e_tokens t
      WHERE NOT EXISTS (SELECT 1 FROM e_dated c WHERE c.scan_id = t.scan_id AND c.token_id = t.token_id AND c.accepted)""",
})
def label_blocks(t: Tables) -> DataFrame:
    return C.all_blocks(tokens(t)).select("scan_id", "block_text", "confidence")
