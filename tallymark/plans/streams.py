"""Stream queries over the event feed, and extraction evaluation."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators import evaluation, panels, rules
from tallymark.operators.fonts import DEFAULT_SCALE, height_mm
from tallymark.plans.check_sql import ROLLING_VIEWS, half_even
from tallymark.plans.citizens import CLAIM_VIEWS
from tallymark.plans.labels import LABEL_VIEWS, evaluated, scaled
from tallymark.plans.products import MERGED_VIEWS, merged_side_verdicts
from tallymark.plans.registry import query
from tallymark.schemas import DOMAINS
from tallymark.session import shared_folder
from tallymark.sources.fixtures import SCANS, Tables, project
from tallymark.streaming import feeds
from tallymark.streaming.ledger import start_ledger_stream, tickets_of


def event_stream(t: Tables) -> DataFrame:
    """The event table as a file stream of scans."""
    schema = t.read("events").schema
    events = t.spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(t.folder)
    return project(events, SCANS)


def new_folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("stream_tickets", "SELECT * FROM e_tickets", ROLLING_VIEWS)
def stream_tickets(t: Tables) -> DataFrame:
    folder = new_folder(t, "ledger")
    start_ledger_stream(event_stream(t), folder).awaitTermination()
    return tickets_of(t.spark, folder)


def last_batch(running) -> int:
    """Number of the last batch of a stream that has ended; -1 without any."""
    return max((p.batchId for p in running.recentProgress), default=-1)


@query(
    "stream_daily_counts",
    """SELECT CAST(created_at AS DATE) AS day, count(*) AS total, count(*) FILTER (compliance_status IN ('compliant', 'fully_compliant')) AS compliant,
      count(*) FILTER (compliance_status = 'non_compliant') AS non_compliant FROM v_scans GROUP BY 1""",
)
def stream_daily_counts(t: Tables) -> DataFrame:
    """Every day, open ones included."""
    folder = new_folder(t, "daily")
    counted = feeds.daily(event_stream(t))
    running = feeds.store_latest(counted, folder, "day")
    running.awaitTermination()
    return feeds.latest_rows(t.spark, folder, "day", counted.schema, last_batch(running))


@query("stream_deduplicated", "SELECT scan_id, gtin, compliance_status FROM v_scans")
def stream_deduplicated(t: Tables) -> DataFrame:
    """The feed sends every scan twice, as a device that retries would."""
    folder = new_folder(t, "once")
    twice = event_stream(t).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    feeds.store_append(feeds.deduplicate(twice), folder).awaitTermination()
    return t.spark.read.parquet(f"{folder}/rows").select("scan_id", "gtin", "compliance_status")


@query(
    "stream_balances",
    "SELECT user_id, CAST(100 + sum(xp_change) AS BIGINT) AS xp FROM e_xp GROUP BY 1",
    CLAIM_VIEWS,
)
def stream_balances(t: Tables) -> DataFrame:
    """Balances from checked claims; users in the negative are turned away from the next batch on."""
    folder = new_folder(t, "balance")
    scans = event_stream(t).where(F.col("user_role") == "citizen")
    running = feeds.start_balances(scans, t.violations, folder)
    running.awaitTermination()
    return feeds.balances_of(t.spark, folder, last_batch(running) + 1)


@query(
    "stream_progress",
    "SELECT count(*) AS scans, count(*) FILTER (compliance_status = 'non_compliant') AS failed FROM v_scans",
)
def stream_progress(t: Tables) -> DataFrame:
    """Rows and failures as the stream's progress reports tell them."""
    folder = new_folder(t, "progress")
    watched = feeds.with_progress(event_stream(t), "watched", F.col("compliance_status") == "non_compliant")
    running = feeds.store_append(watched.select("scan_id"), folder)
    running.awaitTermination()
    seen = feeds.observed(running, "watched")
    rows = [(seen.get("rows", 0), seen.get("failed", 0))]
    return t.spark.createDataFrame(rows, "scans long, failed long")


@query("stream_store_and_forward", "SELECT scan_id, gtin, compliance_status FROM v_scans")
def stream_store_and_forward(t: Tables) -> DataFrame:
    """Scans queued as JSON files and read once each."""
    folder = new_folder(t, "queue")
    queued = t.scans.select("scan_id", "gtin", "compliance_status")
    queued.write.json(f"{folder}/pending")
    feeds.store_append(feeds.pending_submissions(t.spark, f"{folder}/pending", queued.schema), folder).awaitTermination()
    return t.spark.read.parquet(f"{folder}/rows")


@query(
    "extraction_scores",
    f"""SELECT field_name, count(*) AS expected, count(g) AS found, count(*) FILTER (lower(trim(g)) = lower(trim(e))) AS correct,
      {half_even('count(g) * 100.0 / count(*)', 2)} AS found_percent, {half_even('count(*) FILTER (lower(trim(g)) = lower(trim(e))) * 100.0 / nullif(count(g), 0)', 2)} AS precision_percent
    FROM (SELECT f.field_name, f.extracted_value AS e, nullif(m.extracted_value, '') AS g FROM v_fields f LEFT JOIN e_merged m USING (scan_id, field_name) WHERE f.extracted_value <> '') GROUP BY 1""",
    MERGED_VIEWS,
)
def extraction_scores(t: Tables) -> DataFrame:
    truth = t.fields.select("scan_id", "field_name", F.col("extracted_value").alias("expected"))
    predicted = panels.merge_sides(t.side_fields).withColumnRenamed("product_id", "scan_id")
    return evaluation.extraction_scores(truth, predicted)


@query(
    "verdict_confusion",
    "SELECT s.compliance_status AS true_verdict, "
    + ", ".join(f"count(*) FILTER (m.guess = '{v}') AS {v}" for v in DOMAINS["compliance_status"])
    + ", count(*) FILTER (m.guess IS NULL) AS unpredicted FROM e_status s LEFT JOIN (SELECT scan_id, compliance_status AS guess FROM e_status2) m USING (scan_id) GROUP BY 1",
    {
        **LABEL_VIEWS,
        **{f"{name}2": re.sub(r"\b(e_\w+)\b", r"\g<1>2", body) for name, body in MERGED_VIEWS.items()},
    },
)
def verdict_confusion(t: Tables) -> DataFrame:
    truth = rules.summaries(evaluated(t)).select("scan_id", "compliance_status")
    return evaluation.verdict_confusion(truth, merged_side_verdicts(t), DOMAINS["compliance_status"])


@query(
    "print_height_errors",
    f"""SELECT CASE WHEN ar_px_per_mm > 0 OR ar_mm_per_px > 0 THEN 'ar_verified' WHEN circle_px > 0 THEN 'reference_object' WHEN package_width_mm > 0 THEN 'package_dimension' ELSE 'dpi_estimated' END AS calibration_tier,
      count(*) AS measurements, round(avg(abs(m - d)), 4) AS mean_error_mm, round(max(abs(m - d)), 4) AS max_error_mm
    FROM (SELECT c.*, {half_even('CAST(f.h AS DOUBLE) / c.px_per_mm', 2)} AS m, {half_even('CAST(f.h AS DOUBLE) / (CAST(300 AS DOUBLE) / 25.4)', 2)} AS d FROM v_fields f JOIN e_scale c USING (scan_id)) GROUP BY 1""",
    LABEL_VIEWS,
)
def print_height_errors(t: Tables) -> DataFrame:
    """How far calibrated heights are from what a plain 300 dots per inch would give."""
    joined = t.fields.join(scaled(t), "scan_id").select(
        "calibration_tier",
        height_mm(F.col("h"), F.col("px_per_mm")).alias("measured_mm"),
        height_mm(F.col("h"), F.lit(DEFAULT_SCALE)).alias("true_mm"),
    )
    return evaluation.height_errors(joined)
