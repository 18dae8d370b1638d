"""Filters, searches, pages and key lookups over scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators.analytics import REVIEW

REVIEW_QUEUE = [*REVIEW, "insufficient_evidence"]


def holds(column: str, needle: str) -> Column:
    """Case-insensitive substring test; a missing value never matches a non-empty needle."""
    return F.contains(F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(needle.lower()))


def search_scans(
    scans: DataFrame, search: str = "", status: str = "all", category: str = "all", scan_type: str = "all"
) -> DataFrame:
    """Substring search over name, category and uid, with optional equality filters."""
    if search:
        scans = scans.where(holds("product_name", search) | holds("category", search) | holds("scan_uid", search))
    if status and status != "all":
        scans = scans.where(F.col("compliance_status") == status.lower().replace("-", "_"))
    if category and category != "all":
        scans = scans.where(F.col("category") == category)
    if scan_type and scan_type != "all":
        scans = scans.where(F.col("scan_type") == scan_type)
    return scans


def page(df: DataFrame, key: str, number: int = 1, limit: int = 20) -> DataFrame:
    """Newest-first page. Spark keeps only offset+limit rows per task, so nothing is fully sorted."""
    return df.orderBy(F.col(key).desc()).offset(max(0, (number - 1) * limit)).limit(limit)


def page_totals(df: DataFrame, limit: int = 20) -> DataFrame:
    total = F.count(F.lit(1))
    pages = F.ceil(total / F.lit(limit)) if limit > 0 else F.lit(1)
    return df.agg(total.alias("total"), pages.cast("long").alias("pages"))


def review_queue(scans: DataFrame, n: int = 50) -> DataFrame:
    """Newest scans an inspector must look at. ``scans`` carries violations_count."""
    waiting = F.col("compliance_status").isin(REVIEW_QUEUE) | (F.col("violations_count") > 0)
    return scans.where(waiting).orderBy(F.col("scan_id").desc()).limit(n)


def citizen_queue(scans: DataFrame, reputation: str = "all", search: str = "") -> DataFrame:
    """Citizen submissions; ``submitter_xp`` defaults to the starting balance."""
    xp = F.coalesce(F.col("submitter_xp"), F.lit(100))
    rows = scans.where((F.lower(F.coalesce("source", F.lit(""))) == "citizen") | (F.col("user_role") == "citizen"))
    if reputation == "trusted":
        rows = rows.where(xp >= 100)
    elif reputation == "flagged":
        rows = rows.where(xp < 0)
    if search.strip():
        rows = rows.where(holds("product_name", search) | holds("category", search) | holds("gtin", search))
    return rows


def recent(scans: DataFrame, n: int = 200) -> DataFrame:
    """The recency buffer: the latest ``n`` scans."""
    return scans.orderBy(F.col("created_at").desc(), F.col("scan_id").desc()).limit(n)


def precedence_union(sources: list[DataFrame], key: str = "scan_id") -> DataFrame:
    """Union of sources where the first source holding a key wins; rows without a key are left out."""
    ranked = None
    for rank, source in enumerate(sources):
        part = source.where(F.col(key).isNotNull()).withColumn("_rank", F.lit(rank))
        ranked = part if ranked is None else ranked.unionByName(part, allowMissingColumns=True)
    first = Window.partitionBy(key).orderBy("_rank")
    return (
        ranked.withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") == 1)
        .withColumnRenamed("_rank", "source_rank")
        .drop("_n")
    )


def lookup_scans(requests: DataFrame, scans: DataFrame) -> DataFrame:
    """Requested keys (``request_key`` text) matched by numeric id or by uid; unmatched keys stay."""
    number = F.when(F.col("request_key").rlike("^[0-9]{1,18}$"), F.col("request_key")).cast("long")
    by_id = scans.select(F.col("scan_id").alias("_num"), F.col("scan_uid").alias("_uid_by_id"))
    by_uid = scans.select(F.col("scan_uid").alias("request_key"), F.col("scan_id").alias("_id_by_uid"))
    return (
        requests.withColumn("_num", number)
        .join(by_id, "_num", "left")
        .join(by_uid, "request_key", "left")
        .select(
            "request_key",
            F.coalesce(F.when(F.col("_uid_by_id").isNotNull(), F.col("_num")), F.col("_id_by_uid")).alias("scan_id"),
        )
    )


def with_violations(scans: DataFrame, products: DataFrame, violations: DataFrame) -> DataFrame:
    """Scans with product columns and nested violations; no violations means compliant."""
    nested = violations.groupBy("scan_id").agg(
        F.array_sort(F.collect_list(F.struct("field_name", "violation_type", "severity"))).alias("violations")
    )
    count = F.coalesce(F.nullif(F.size("violations"), F.lit(-1)), F.lit(0))
    return (
        scans.drop("product_name", "category", "compliance_status")
        .join(products, "gtin", "left")
        .join(nested, "scan_id", "left")
        .withColumn("violations_count", count)
        .withColumn("compliance_status", F.when(count == 0, "compliant").otherwise("non_compliant"))
        .withColumn("product_name", F.coalesce("product_name", F.concat(F.lit("Product #"), F.col("scan_id").cast("string"))))
        .withColumn("category", F.coalesce("category", F.lit("General")))
    )
