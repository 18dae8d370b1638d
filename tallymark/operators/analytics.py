"""Dashboard aggregates over scans and violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.rounding import percent, round_even

# Status groups, the violation types always reported, and the dashboard's three.
COMPLIANT = ["compliant", "fully_compliant"]
REVIEW = ["partial_review_needed", "partial_review_required", "undetermined"]
VIOLATION_TYPES = ["missing", "incorrect_format", "undersized_font", "cross_validation_mismatch"]
LABEL_FAULTS = ["incorrect_format", "undersized_font", "missing"]


def kpi_counts(scans: DataFrame) -> DataFrame:
    """All headline numbers in one aggregation."""
    status = F.col("compliance_status")
    total, good = F.count(F.lit(1)), F.count_if(status.isin(COMPLIANT))
    mean = F.sum(F.col("confidence").cast("decimal(12,6)")).cast("double") / F.nullif(F.count("confidence"), F.lit(0))
    return scans.agg(
        total.alias("total_scans"),
        good.alias("compliant"),
        F.count_if(status == "non_compliant").alias("non_compliant"),
        F.count_if(status.isin(REVIEW)).alias("partial_review_needed"),
        F.count_if(status == "insufficient_evidence").alias("insufficient_evidence"),
        percent(good, total, 0).alias("compliance_rate"),
        F.coalesce(round_even(mean * 100, 1), F.lit(0.0)).alias("average_confidence"),
    )


def dashboard_kpis(scans: DataFrame) -> DataFrame:
    """The dashboard's own counters; an empty table rates 100."""
    status = F.col("compliance_status")
    total, good = F.count(F.lit(1)), F.count_if(status == "compliant")
    rate = F.coalesce(F.floor(good * 100 / F.nullif(total, F.lit(0)) + 0.5), F.lit(100))
    return scans.agg(
        total.alias("total_scans"),
        good.alias("compliant_scans"),
        F.count_if(status == "non_compliant").alias("non_compliant_scans"),
        F.count_if(status == "partial_review_needed").alias("partial_scans"),
        rate.cast("long").alias("compliance_rate"),
    )


def violation_histogram(violations: DataFrame, seeds: list[str] = VIOLATION_TYPES) -> DataFrame:
    """Count per violation type; seeded types appear even with no rows, unseen ones are added."""
    counts = violations.groupBy(F.coalesce("violation_type", F.lit("missing")).alias("violation_type")).agg(
        F.count(F.lit(1)).alias("violation_count")
    )
    zero = violations.sparkSession.createDataFrame([(s, 0) for s in seeds], "violation_type string, violation_count long")
    return counts.unionByName(zero).groupBy("violation_type").agg(F.sum("violation_count").alias("violation_count"))


def label_fault_counts(violations: DataFrame) -> DataFrame:
    """The three-bucket version used by the dashboard: other types are ignored."""
    kind = F.col("violation_type")
    return violations.agg(
        F.count_if(kind == "missing").alias("missing"),
        F.count_if(kind == "incorrect_format").alias("incorrect_format"),
        F.count_if(kind == "undersized_font").alias("undersized_font"),
    )


def title_case(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def top_recurring(violations: DataFrame, n: int = 5) -> DataFrame:
    """Fields violated most often; equal counts are ordered by name."""
    field = F.coalesce(F.nullif("field_name", F.lit("")), F.lit("general"))
    return (
        violations.groupBy(field.alias("field_name"))
        .agg(F.count(F.lit(1)).alias("violation_count"))
        .orderBy(F.col("violation_count").desc(), "field_name")
        .limit(n)
        .withColumn("display_name", title_case(F.col("field_name")))
    )


def category_distribution(scans: DataFrame, n: int = 6) -> DataFrame:
    good = F.count_if(F.col("compliance_status").isin(COMPLIANT))
    total = F.count(F.lit(1))
    return (
        scans.groupBy("category")
        .agg(total.alias("total"), good.alias("compliant"), percent(good, total, 0).alias("compliance_rate"))
        .orderBy(F.col("total").desc(), "category")
        .limit(n)
    )


def daily_counts(scans: DataFrame) -> list[Column]:
    status = F.col("compliance_status")
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(status.isin(COMPLIANT)).alias("compliant"),
        F.count_if(status == "non_compliant").alias("non_compliant"),
    ]


def scans_over_time(scans: DataFrame, n: int = 14) -> DataFrame:
    """Daily series, oldest first, of the latest ``n`` recorded days."""
    days = scans.groupBy(F.to_date("created_at").alias("day")).agg(*daily_counts(scans))
    return days.orderBy(F.col("day").desc()).limit(n).orderBy("day")


def categories(scans: DataFrame) -> DataFrame:
    return scans.select("category").distinct()


def violation_flags(violations: DataFrame) -> DataFrame:
    """Per scan: how many violations, and whether one is a label fault."""
    return violations.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("violations_count"),
        F.bool_or(F.col("violation_type").isin(LABEL_FAULTS)).alias("label_fault"),
    )


def docket_register(scans: DataFrame, violations: DataFrame) -> DataFrame:
    """One register line per scan with its verdict colour."""
    joined = scans.join(violation_flags(violations), "scan_id", "left").withColumns(
        {
            "violations_count": F.coalesce("violations_count", F.lit(0)),
            "scan_status": normalised_status(F.col("compliance_status")),
        }
    )
    status, none = F.col("scan_status"), F.col("violations_count") == 0
    colour = (
        F.when((status == "compliant") | (none & (status != "non_compliant")), "green")
        .when(F.col("label_fault"), "red")
        .otherwise("amber")
    )
    return joined.select(
        "scan_id",
        "scan_type",
        "scan_status",
        F.coalesce(F.nullif("product_name", F.lit("")), F.lit("Packaged Commodity Specimen")).alias("product_name"),
        F.coalesce(F.nullif("category", F.lit("")), F.lit("Packaged Foods")).alias("product_category"),
        colour.alias("verdict_color"),
        "violations_count",
        "created_at",
    )


def docket_summary(register: DataFrame) -> DataFrame:
    green, red = F.count_if(F.col("verdict_color") == "green"), F.count_if(F.col("verdict_color") == "red")
    total = F.count(F.lit(1))
    return register.agg(
        total.alias("total_count"),
        green.alias("compliant_count"),
        red.alias("non_compliant_count"),
        F.count_if(F.col("verdict_color") == "amber").alias("partial_count"),
        F.coalesce(F.sum("violations_count"), F.lit(0)).alias("total_violations"),
        percent(green, total, 100).alias("compliance_rate"),
    )


def normalised_status(*candidates: Column) -> Column:
    """First non-empty status, lower-cased with underscores; non_compliant when none is given."""
    first = F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit("non_compliant"))
    return F.replace(F.lower(first), F.lit("-"), F.lit("_"))


def run_totals(items: DataFrame, failed: Column) -> DataFrame:
    """Progress counters of a batch run."""
    total, bad = F.count(F.lit(1)), F.count_if(failed)
    share = round_even((total - bad) * 100.0 / F.nullif(total, F.lit(0)), 1)
    return items.agg(
        total.alias("total"),
        (total - bad).alias("processed"),
        bad.alias("failed"),
        F.coalesce(share, F.lit(0.0)).alias("success_percent"),
    )
