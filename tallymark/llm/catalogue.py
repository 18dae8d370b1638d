"""The queries of this subpackage, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@op
def op1_repetition_rules(spark: SparkSession, folder: str) -> DataFrame:
    from tallymark.llm.repetition import repetition_report

    return repetition_report(table(spark, folder, "documents"))


@op
def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from tallymark.llm.decontamination import contamination_report

    return contamination_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@op
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from tallymark.llm.token_counts import token_counts

    return token_counts(table(spark, folder, "documents"))


@op
def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from tallymark.llm.token_files import file_round_trip

    return file_round_trip(table(spark, folder, "documents"))


@op
def op10_byte_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    from tallymark.llm.byte_bpe import round_trip

    return round_trip(table(spark, folder, "documents"))


@op
def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    from tallymark.llm.licenses import license_report

    return license_report(table(spark, folder, "documents"))


@op
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tallymark.llm.superkmers import substring_dedup

    return substring_dedup(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@op
def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from tallymark.llm.combination_join import near_duplicate_classes

    return near_duplicate_classes(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@op
def op6_weakly_supervised_pii(spark: SparkSession, folder: str) -> DataFrame:
    from tallymark.llm.pii import span_report

    return span_report(table(spark, folder, "documents"))


@op
def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tallymark.llm.prefix_trie import conversation_trie

    base = F.col("conv") - F.col("conv") % 100
    kept = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    return conversation_trie(table(spark, folder, "conversations"), base, kept, 5)


@op
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tallymark.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, label=label)


@op
def op13_chunk_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    from tallymark.llm.chunk_bpe import round_trip

    return round_trip(table(spark, folder, "documents"))


#: Capture times and dated lists, made from the given tables in the words of both engines.
CAPTURES = "SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * ((page_id * 7919) % 2592000) AS fetched_at FROM pages"
LIST_LOG = """
SELECT CASE WHEN event_type IN ('error', 'signup') THEN 'faulty' ELSE 'spam' END AS list,
       CASE WHEN event_id % 97 = 0 THEN substring(host, strpos(host, '.') + 1)
            WHEN event_id % 2 = 0 THEN host
            ELSE concat(host, '/', folder, '/') END AS pattern,
       event_type IN ('error', 'click') AS added, ts AS at_time
FROM events JOIN (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) AS folder FROM pages) AS p
  ON p.page_id = events.user_id
WHERE event_type IN ('error', 'signup', 'click', 'purchase')
"""


@op
def op5_temporal_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    from tallymark.llm.url_filters import judge

    pages, events = table(spark, folder, "pages"), table(spark, folder, "events")
    captures = spark.sql(CAPTURES.replace("FROM pages", "FROM {pages}").replace("INTERVAL '1' SECOND * ((page_id * 7919) % 2592000)", "make_dt_interval(0, 0, 0, (page_id * 7919) % 2592000)"), pages=pages)
    entries = spark.sql(LIST_LOG.replace("FROM pages", "FROM {pages}").replace("FROM events", "FROM {events} AS events").replace("strpos(host, '.')", "instr(host, '.')"), pages=pages, events=events)
    return judge(captures, entries.withColumnRenamed("at_time", "at"))


ORACLES["op5_temporal_url_lists"] = f"""
WITH captures AS ({CAPTURES}), log AS ({LIST_LOG}),
one AS (SELECT list, pattern, at_time, bool_and(added) AS added FROM log GROUP BY ALL),
changed AS (SELECT * FROM one QUALIFY coalesce(lag(added) OVER (PARTITION BY list, pattern ORDER BY at_time), false) <> added),
held AS (SELECT list, pattern, added, at_time AS since, lead(at_time) OVER (PARTITION BY list, pattern ORDER BY at_time) AS until FROM changed),
named AS (SELECT page_id, fetched_at, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS path FROM captures),
met AS (
    SELECT page_id, list, pattern FROM named JOIN held
      ON added AND fetched_at >= since AND (until IS NULL OR fetched_at < until)
     AND (pattern = host OR (strpos(pattern, '/') = 0 AND ends_with(host, '.' || pattern) AND strpos(pattern, '.') > 0)
          OR (ends_with(pattern, '/') AND starts_with(host || path, pattern)))
)
SELECT page_id, host, fetched_at, coalesce(n_entries, 0) AS n_entries, coalesce(lists, '') AS lists, coalesce(n_entries, 0) > 0 AS blocked
FROM named LEFT JOIN (SELECT page_id, count(DISTINCT (list, pattern)) AS n_entries, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM met GROUP BY page_id) USING (page_id)
"""


# The checks below follow the contracts word by word, with joins that fit the check's small tables.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WHITE = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLES["op2_benchmark_decontamination"] = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
tests AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 10) AS size FROM (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark) WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS win FROM tests, unnest(range(1, len(w) - size + 2)) AS t(i)),
seen AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win FROM docs, (SELECT DISTINCT size FROM wanted) AS sizes, unnest(range(1, len(w) - size + 2)) AS t(i)),
hits AS (SELECT doc_id, i, size, item FROM seen JOIN wanted USING (size, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

ORACLES["op3_substring_dedup"] = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WHITE}) AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS win FROM docs, unnest(range(1, len(w) - 33)) AS t(i)),
twice AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows JOIN twice USING (win)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS words FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM docs LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES["op4_ngram_jaccard_join"] = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WHITE}) AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM docs, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

ORACLES["op12_hard_negatives"] = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS alike, list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM usable a JOIN usable r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""

ORACLES["op11_conversation_trie"] = f"""
WITH turns AS (
    SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
    FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT conv_id, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
whole AS (
    SELECT c.conv_id, 0 AS part, p, said FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND p <= h
    UNION ALL SELECT conv_id, 1, p, said FROM convs JOIN turns USING (conv_id) WHERE p > h
),
lists AS (SELECT conv_id, coalesce(list(said ORDER BY part, p) FILTER (said IS NOT NULL), []) AS l FROM convs LEFT JOIN whole USING (conv_id) GROUP BY conv_id),
members AS (SELECT conv_id, d, l[1:d] AS prefix, d = len(l) AS ends FROM lists, unnest(range(0, len(l) + 1)) AS t(d)),
nodes AS (
    SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * (CASE WHEN d = 0 THEN 0 ELSE length(prefix[d].text) END) AS saved,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM members GROUP BY prefix, d
),
children AS (SELECT prefix[1:d - 1] AS prefix, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
below AS (
    SELECT prefix[1:a] AS prefix, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (coalesce(n, 0) = 0) AS n_leaves
    FROM nodes LEFT JOIN children USING (prefix), unnest(range(0, d + 1)) AS t(a) GROUP BY 1
)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(n, 0) AS n_children, n_leaves, saved_tokens, v.ends_sha256
FROM nodes v JOIN below USING (prefix) LEFT JOIN children USING (prefix) LEFT JOIN nodes u ON v.d > 0 AND u.prefix = v.prefix[1:v.d - 1]
"""
