"""Extraction quality against labelled truth. Missing predictions count as missing; nothing is filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.rounding import round_even


def extraction_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per field: how many values were expected, found and right.

    ``truth`` has scan_id, field_name, expected; ``predicted`` has scan_id, field_name, extracted_value. Both are as long as
    the labels' fields, however small the files they come from, so neither is ever sent whole through the driver.
    """
    guess = predicted.where(F.coalesce("extracted_value", F.lit("")) != "").select("scan_id", "field_name", "extracted_value")
    joined = truth.where(F.coalesce("expected", F.lit("")) != "").join(guess.hint("merge"), ["scan_id", "field_name"], "left")
    right = F.lower(F.trim("extracted_value")) == F.lower(F.trim("expected"))
    expected, hits, correct = F.count(F.lit(1)), F.count("extracted_value"), F.count_if(right)
    return joined.groupBy("field_name").agg(
        expected.alias("expected"),
        hits.alias("found"),
        correct.alias("correct"),
        round_even(hits * 100.0 / expected, 2).alias("found_percent"),
        round_even(correct * 100.0 / F.nullif(hits, F.lit(0)), 2).alias("precision_percent"),
    )


def verdict_confusion(truth: DataFrame, predicted: DataFrame, verdicts: list[str]) -> DataFrame:
    """Rows: true verdict; columns: predicted verdict, with unpredicted labels counted apart."""
    joined = truth.select("scan_id", F.col("compliance_status").alias("true_verdict")).join(
        predicted.select("scan_id", F.col("compliance_status").alias("guess")), "scan_id", "left"
    )
    guess = F.coalesce("guess", F.lit("unpredicted"))
    return (
        joined.withColumn("guess", guess)
        .groupBy("true_verdict")
        .pivot("guess", [*verdicts, "unpredicted"])
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )


def height_errors(measured: DataFrame) -> DataFrame:
    """Mean and largest error of measured print heights, per calibration tier, without a ceiling."""
    error = F.abs(F.col("measured_mm") - F.col("true_mm"))
    return measured.groupBy("calibration_tier").agg(
        F.count("measured_mm").alias("measurements"),
        F.round(F.avg(error), 4).alias("mean_error_mm"),
        F.round(F.max(error), 4).alias("max_error_mm"),
    )
