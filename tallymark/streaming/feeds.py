"""Smaller streams: de-duplication, daily counts, balances, progress, and store-and-forward input."""

from __future__ import annotations

import threading
from collections import Counter
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from tallymark.functions.trust import XP_START
from tallymark.operators.analytics import daily_counts
from tallymark.operators.citizens import admit, verify_claims, xp_events
from tallymark.streaming.state import delete_superseded, in_turn, read_state, write_state

# How late a row may come. Later rows are dropped by the watermark and counted: see ``late_rows``. A resubmission
# that comes later than this is a new row to ``deduplicate``.
LATENESS = "1 day"
BALANCE_SCHEMA = "user_id long, points long"


def with_event_time(scans: DataFrame, column: str = "created_at", lateness: str = LATENESS) -> DataFrame:
    """Event time with a zone, as watermarks need it."""
    return scans.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def deduplicate(scans: DataFrame, key: str = "scan_id", lateness: str = LATENESS) -> DataFrame:
    """First arrival of every scan; resubmissions within the watermark are dropped, state stays bounded."""
    return with_event_time(scans, lateness=lateness).dropDuplicatesWithinWatermark([key])


def daily(scans: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Counts per day. In append mode a day comes once the watermark has passed it, in update mode whenever it changes."""
    return (
        with_event_time(scans, lateness=lateness)
        .groupBy(F.window("created_at", "1 day").alias("w"))
        .agg(*daily_counts(scans))
        .select(F.to_date("w.start").alias("day"), "total", "compliant", "non_compliant")
    )


class Totals(StreamingQueryListener):
    """Sums over all progress reports of every run, of which a query itself keeps only the last: late rows, and observed numbers by name."""

    def __init__(self):
        self.late, self.observed, self.ended = Counter(), {}, {}

    def onQueryStarted(self, event):
        self.ended[str(event.runId)] = threading.Event()

    def onQueryProgress(self, event):
        run = str(event.progress.runId)
        self.late[run] += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)
        for name, row in event.progress.observedMetrics.items():
            self.observed.setdefault((run, name), Counter()).update(row.asDict())

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended[str(event.runId)].set()


TOTALS: WeakKeyDictionary[SparkSession, Totals] = WeakKeyDictionary()


def listened(stream: DataFrame) -> DataFrame:
    """The stream, of whose session's queries all reports are summed from now on."""
    spark = stream.sparkSession
    if spark not in TOTALS:
        TOTALS[spark] = Totals()
        spark.streams.addListener(TOTALS[spark])
    return stream


def totals_of(query: StreamingQuery) -> Totals:
    """Sums that hold the query; reports come a little later than batches, so those of an ended query are awaited."""
    run = str(query.runId)
    for totals in TOTALS.values():
        if run in totals.ended:
            if not query.isActive and not totals.ended[run].wait(60):
                raise TimeoutError(f"reports of run {run} are not complete")
            return totals
    raise LookupError(f"run {run} was started without listened()")


def late_rows(query: StreamingQuery) -> int:
    """Rows that the watermark has dropped so far, from all progress reports of a query that this module started."""
    return totals_of(query).late[str(query.runId)]


def observed(query: StreamingQuery, name: str) -> dict[str, int]:
    """Sums of what ``with_progress`` counted under ``name``, over all progress reports."""
    return dict(totals_of(query).observed.get((str(query.runId), name), {}))


def balances_of(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """Balance per user from the batches before ``batch``."""
    stored = read_state(spark, folder, "points", "user_id", BALANCE_SCHEMA, batch)
    return stored.select("user_id", (F.col("points") + XP_START).alias("xp"))


def apply_balance_batch(scans: DataFrame, violations: DataFrame, batch: int, folder: str) -> None:
    """One micro-batch of citizen scans: users in the negative are turned away, claims are checked, points are added."""
    spark = scans.sparkSession
    stored = read_state(spark, folder, "points", "user_id", BALANCE_SCHEMA, batch)
    admitted = admit(scans, stored.select("user_id", (F.col("points") + XP_START).alias("xp")))
    added = xp_events(verify_claims(admitted, violations)).groupBy("user_id").agg(F.sum("xp_change").cast("long").alias("points")).persist()
    touched = added.select("user_id")
    before = stored.join(touched, "user_id", "left_semi")
    summed = before.unionByName(added).groupBy("user_id").agg(F.sum("points").alias("points"))
    others = stored.where(in_turn("user_id", batch)).join(touched, "user_id", "left_anti")
    write_state(summed.unionByName(others), folder, "points", batch)
    added.unpersist()
    delete_superseded(spark, folder, "points", batch)


def start_balances(scans: DataFrame, violations: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Balances of citizens from a stream of scans; ``violations`` is the table that claims are checked against."""

    def step(rows: DataFrame, batch: int) -> None:
        apply_balance_batch(rows, violations, batch, folder)

    writer = scans.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def store_latest(stream: DataFrame, folder: str, key: str, trigger: dict | None = None) -> StreamingQuery:
    """Upserts each batch's changed rows by key; a retry overwrites only its own folder."""
    fields = stream.schema

    def step(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        stored = read_state(spark, folder, "rows", key, fields, batch).where(in_turn(key, batch))
        write_state(rows.unionByName(stored.join(rows.select(key), key, "left_anti")), folder, "rows", batch)
        rows.unpersist()
        delete_superseded(spark, folder, "rows", batch)

    writer = listened(stream).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{folder}/progress")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest_rows(spark: SparkSession, folder: str, key: str, schema: StructType, after: int) -> DataFrame:
    """Current rows per key after a batch, from what ``store_latest`` wrote."""
    return read_state(spark, folder, "rows", key, schema, after + 1)


def store_append(stream: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Append-mode file sink with its own progress log."""
    writer = listened(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/progress")
    return writer.option("path", f"{folder}/rows").trigger(**(trigger or {"availableNow": True})).start()


def with_progress(df: DataFrame, name: str, failed: Column) -> DataFrame:
    """Counts rows and failures as they pass; read them by ``observed`` under ``name``."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(failed).alias("failed"))


def pending_submissions(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """Store-and-forward queue: devices drop JSON files; each is read once, and kept when a batch fails."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)
