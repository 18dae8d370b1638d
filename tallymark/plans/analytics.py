"""Dashboard, search and register queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators import analytics as A
from tallymark.operators import search as S
from tallymark.plans.registry import query
from tallymark.sources import stores
from tallymark.sources.fixtures import Tables

HALF_EVEN_PCT = "CAST(round_even(CAST(100.0 * {good} / {total} AS DECIMAL(28,12)), 0) AS BIGINT)"


def pct(good: str, total: str) -> str:
    return HALF_EVEN_PCT.format(good=f"CAST({good} AS DOUBLE)", total=total)


GOOD = "count(*) FILTER (compliance_status IN ('compliant', 'fully_compliant'))"


@query(
    "kpi_counts",
    f"""SELECT count(*) AS total_scans, {GOOD} AS compliant,
      count(*) FILTER (compliance_status = 'non_compliant') AS non_compliant,
      count(*) FILTER (compliance_status IN ('partial_review_needed', 'partial_review_required', 'undetermined')) AS partial_review_needed,
      count(*) FILTER (compliance_status = 'insufficient_evidence') AS insufficient_evidence,
      {pct(GOOD, 'count(*)')} AS compliance_rate,
      CAST(round_even(CAST(100 * CAST(sum(confidence) AS DOUBLE) / count(confidence) AS DECIMAL(28,12)), 1) AS DOUBLE) AS average_confidence
    FROM v_scans""",
)
def kpi_counts(t: Tables) -> DataFrame:
    return A.kpi_counts(t.scans)


@query(
    "dashboard_kpis",
    """SELECT count(*) AS total_scans, count(*) FILTER (compliance_status = 'compliant') AS compliant_scans,
      count(*) FILTER (compliance_status = 'non_compliant') AS non_compliant_scans,
      count(*) FILTER (compliance_status = 'partial_review_needed') AS partial_scans,
      CAST(floor(100.0 * count(*) FILTER (compliance_status = 'compliant') / count(*) + 0.5) AS BIGINT) AS compliance_rate
    FROM v_scans""",
)
def dashboard_kpis(t: Tables) -> DataFrame:
    return A.dashboard_kpis(t.scans)


@query(
    "violation_histogram",
    """SELECT violation_type, CAST(sum(n) AS BIGINT) AS violation_count FROM (
      SELECT violation_type, count(*) AS n FROM v_violations GROUP BY 1
      UNION ALL SELECT unnest(['missing', 'incorrect_format', 'undersized_font', 'cross_validation_mismatch']), 0) GROUP BY 1""",
)
def violation_histogram(t: Tables) -> DataFrame:
    return A.violation_histogram(t.violations)


@query(
    "label_fault_counts",
    """SELECT count(*) FILTER (violation_type = 'missing') AS missing,
      count(*) FILTER (violation_type = 'incorrect_format') AS incorrect_format,
      count(*) FILTER (violation_type = 'undersized_font') AS undersized_font FROM v_violations""",
)
def label_fault_counts(t: Tables) -> DataFrame:
    return A.label_fault_counts(t.violations)


@query(
    "top_recurring_violations",
    """SELECT field_name, violation_count,
      array_to_string(list_transform(string_split(field_name, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS display_name
    FROM (SELECT field_name, count(*) AS violation_count FROM v_violations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)""",
)
def top_recurring(t: Tables) -> DataFrame:
    return A.top_recurring(t.violations)


@query(
    "category_distribution",
    f"""SELECT category, count(*) AS total, {GOOD} AS compliant, {pct(GOOD, 'count(*)')} AS compliance_rate
    FROM v_scans GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6""",
)
def category_distribution(t: Tables) -> DataFrame:
    return A.category_distribution(t.scans)


@query(
    "scans_over_time",
    f"""SELECT CAST(created_at AS DATE) AS day, count(*) AS total, {GOOD} AS compliant,
      count(*) FILTER (compliance_status = 'non_compliant') AS non_compliant
    FROM v_scans GROUP BY 1 ORDER BY 1 DESC LIMIT 14""",
)
def scans_over_time(t: Tables) -> DataFrame:
    return A.scans_over_time(t.scans)


@query("scan_categories", "SELECT DISTINCT category FROM v_scans")
def scan_categories(t: Tables) -> DataFrame:
    return A.categories(t.scans)


REGISTER_VIEW = {
    "e_register": """SELECT s.scan_id, s.scan_type, s.compliance_status AS scan_status,
      coalesce(s.product_name, 'Packaged Commodity Specimen') AS product_name, s.category AS product_category,
      CASE WHEN s.compliance_status = 'compliant' OR (v.n IS NULL AND s.compliance_status <> 'non_compliant') THEN 'green'
           WHEN v.faults > 0 THEN 'red' ELSE 'amber' END AS verdict_color,
      coalesce(v.n, 0) AS violations_count, s.created_at
    FROM v_scans s LEFT JOIN (SELECT scan_id, count(*) AS n,
        count(*) FILTER (violation_type IN ('incorrect_format', 'undersized_font', 'missing')) AS faults
      FROM v_violations GROUP BY 1) v USING (scan_id)""",
}


@query("docket_register", "SELECT * FROM e_register", REGISTER_VIEW)
def docket_register(t: Tables) -> DataFrame:
    return A.docket_register(t.scans, t.violations)


@query(
    "docket_summary",
    f"""SELECT count(*) AS total_count, count(*) FILTER (verdict_color = 'green') AS compliant_count,
      count(*) FILTER (verdict_color = 'red') AS non_compliant_count, count(*) FILTER (verdict_color = 'amber') AS partial_count,
      CAST(sum(violations_count) AS BIGINT) AS total_violations,
      {pct("count(*) FILTER (verdict_color = 'green')", 'count(*)')} AS compliance_rate FROM e_register""",
    REGISTER_VIEW,
)
def docket_summary(t: Tables) -> DataFrame:
    return A.docket_summary(A.docket_register(t.scans, t.violations))


@query(
    "batch_run_totals",
    """SELECT count(*) AS total, count(*) - count(*) FILTER (tampered) AS processed, count(*) FILTER (tampered) AS failed,
      CAST(round_even(CAST(100.0 * (count(*) - count(*) FILTER (tampered)) / count(*) AS DECIMAL(28,12)), 1) AS DOUBLE) AS success_percent
    FROM v_scans WHERE scan_type = 'batch'""",
)
def batch_run_totals(t: Tables) -> DataFrame:
    return A.run_totals(t.scans.where(F.col("scan_type") == "batch"), F.col("tampered"))


SEARCH_WHERE = """(lower(coalesce(product_name, '')) LIKE '%pack 1%' OR lower(category) LIKE '%pack 1%' OR lower(scan_uid) LIKE '%pack 1%')
      AND compliance_status = 'non_compliant'"""


@query(
    "scan_search_page",
    f"SELECT scan_id, product_name, category, compliance_status FROM v_scans WHERE {SEARCH_WHERE} ORDER BY scan_id DESC LIMIT 20 OFFSET 20",
)
def scan_search_page(t: Tables) -> DataFrame:
    hits = S.search_scans(t.scans, search="PACK 1", status="Non-Compliant")
    return S.page(hits.select("scan_id", "product_name", "category", "compliance_status"), "scan_id", 2, 20)


@query("scan_search_totals", f"SELECT count(*) AS total, (count(*) + 19) // 20 AS pages FROM v_scans WHERE {SEARCH_WHERE}")
def scan_search_totals(t: Tables) -> DataFrame:
    return S.page_totals(S.search_scans(t.scans, search="pack 1", status="non-compliant"), 20)


@query(
    "review_queue",
    """SELECT scan_id, scan_status AS compliance_status, violations_count FROM e_register
    WHERE violations_count > 0 OR scan_status IN ('partial_review_needed', 'partial_review_required', 'undetermined', 'insufficient_evidence')
    ORDER BY scan_id DESC LIMIT 50""",
    REGISTER_VIEW,
)
def review_queue(t: Tables) -> DataFrame:
    register = A.docket_register(t.scans, t.violations)
    waiting = S.review_queue(register.withColumnRenamed("scan_status", "compliance_status"))
    return waiting.select("scan_id", "compliance_status", "violations_count")


@query("recent_scans", "SELECT scan_id, created_at FROM v_scans ORDER BY created_at DESC, scan_id DESC LIMIT 200")
def recent_scans(t: Tables) -> DataFrame:
    return S.recent(t.scans.select("scan_id", "created_at"))


@query(
    "merged_scan_feed",
    """SELECT scan_id, CASE WHEN recency <= 200 THEN 0 WHEN scan_type <> 'ecommerce' THEN 1 ELSE 2 END AS source_rank,
      CASE WHEN recency <= 200 THEN 'cached' WHEN scan_type <> 'ecommerce' THEN 'stored' ELSE 'relational' END AS origin
    FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, scan_id DESC) AS recency FROM v_scans)""",
)
def merged_scan_feed(t: Tables) -> DataFrame:
    scans = t.scans.select("scan_id", "scan_type", "created_at")
    sources = [
        S.recent(scans).withColumn("origin", F.lit("cached")),
        scans.where(F.col("scan_type") != "ecommerce").withColumn("origin", F.lit("stored")),
        scans.withColumn("origin", F.lit("relational")),
    ]
    return S.precedence_union(sources).select("scan_id", "source_rank", "origin")


@query(
    "scans_with_violations",
    """SELECT s.scan_id, coalesce(p.product_name, 'Product #' || CAST(s.scan_id AS VARCHAR)) AS product_name,
      coalesce(p.category, 'General') AS category, CAST(coalesce(v.n, 0) AS INT) AS violations_count,
      CASE WHEN v.n IS NULL THEN 'compliant' ELSE 'non_compliant' END AS compliance_status, v.listed AS violation_list
    FROM v_scans s LEFT JOIN (SELECT '8901' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(9, length(CAST(p_partkey AS VARCHAR))) AS INT), '0') AS gtin, p_name AS product_name, p_type AS category
        FROM part WHERE p_type <> 'PROMO') p USING (gtin)
    LEFT JOIN (SELECT scan_id, count(*) AS n, string_agg(field_name || ':' || violation_type, ',' ORDER BY field_name, violation_type, severity) AS listed
      FROM v_violations GROUP BY 1) v USING (scan_id)""",
)
def scans_with_violations(t: Tables) -> DataFrame:
    parts = t.read("part").where(F.col("p_type") != "PROMO")
    products = parts.select(
        F.concat(F.lit("8901"), stores.padded(F.col("p_partkey"), 9)).alias("gtin"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
    )
    full = S.with_violations(t.scans, products, t.violations)
    listed = F.array_join(F.transform("violations", lambda v: F.concat_ws(":", v.field_name, v.violation_type)), ",")
    return full.select(
        "scan_id", "product_name", "category", "violations_count", "compliance_status", listed.alias("violation_list")
    )


@query(
    "scan_lookup",
    """SELECT request_key, coalesce(a.scan_id, b.scan_id) AS scan_id FROM (
      SELECT CASE o_orderstatus WHEN 'F' THEN 'LM-2026-' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(9, length(CAST(o_orderkey AS VARCHAR))) AS INT), '0') ELSE CAST(o_orderkey AS VARCHAR) END AS request_key
      FROM orders) r LEFT JOIN v_scans a ON CAST(a.scan_id AS VARCHAR) = r.request_key LEFT JOIN v_scans b ON b.scan_uid = r.request_key""",
)
def scan_lookup(t: Tables) -> DataFrame:
    number = F.col("o_orderkey").cast("string")
    asked = t.read("orders").select(
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("LM-2026-"), stores.padded(number, 9)))
        .otherwise(number)
        .alias("request_key")
    )
    return S.lookup_scans(asked, t.scans)
