"""Ledger and ticket stream: every micro-batch of scans updates the product ledger.

Each batch joins the stored state of the products it touches, runs the same rolling operator as the
batch job, and writes its tickets and the new state under its own batch number. A retried batch
overwrites what it wrote before, so results are exactly once. Scans count in the order they arrive,
late ones included; nothing is dropped. Hot products are split by the operator, so no key is tied to
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallymark.operators.conflicts import rolling_state, with_conflict
from tallymark.operators.consensus import EVIDENCE_LIMIT, latest
from tallymark.operators.ledger import TIERS, known_tier
from tallymark.operators.skew import DEFAULT_POLICY, SkewPolicy, minute_of
from tallymark.operators.tickets import spawn_tickets
from tallymark.streaming.state import delete_superseded, in_turn, read_state, write_state

EVIDENCE = ["gtin", "scan_id", "created_at", "batch_code", "compliance_status", "calibration_tier", "user_role", "confidence"]
EVIDENCE_SCHEMA = (
    "gtin string, scan_id long, created_at timestamp_ntz, batch_code string, compliance_status string, "
    "calibration_tier string, user_role string, confidence double, arrival long"
)
TOTALS_SCHEMA = "gtin string, " + ", ".join(f"{t} long" for t in TIERS)
ARRIVAL_ORDER = ["arrival", "created_at", "scan_id"]


def apply_batch(scans: DataFrame, batch: int, folder: str, policy: SkewPolicy = DEFAULT_POLICY) -> None:
    """One micro-batch: tickets for the scans that conflict, and the state after them."""
    spark = scans.sparkSession
    arrived = scans.where(F.col("gtin").isNotNull()).select(*EVIDENCE).withColumn("arrival", F.lit(batch).cast("long"))
    arrived = arrived.withColumn("confidence", F.col("confidence").cast("double")).persist()
    touched = arrived.select("gtin").distinct()
    evidence = read_state(spark, folder, "evidence", "gtin", EVIDENCE_SCHEMA, batch)
    totals = read_state(spark, folder, "totals", "gtin", TOTALS_SCHEMA, batch)

    known = evidence.join(touched, "gtin", "left_semi").persist()
    both = known.unionByName(arrived)
    bucket = F.concat(F.lpad(F.col("arrival").cast("string"), 12, "0"), minute_of("created_at"))
    state = rolling_state(both, policy, order=ARRIVAL_ORDER, bucket=bucket).where(F.col("arrival") == batch)

    # Lifetime counts: what the state remembers beyond the evidence rows the window saw.
    tier = known_tier(F.col("calibration_tier"))
    seen = known.groupBy("gtin").agg(*[F.count_if(tier == t).alias(f"seen_{t}") for t in TIERS])
    forgotten = totals.join(seen, "gtin", "inner").select(
        "gtin", *[(F.col(t) - F.col(f"seen_{t}")).alias(f"more_{t}") for t in TIERS]
    )
    state = state.join(forgotten, "gtin", "left")
    for t in TIERS:
        state = state.withColumn(f"prior_{t}", F.col(f"prior_{t}") + F.coalesce(F.col(f"more_{t}"), F.lit(0)))
    spawn_tickets(with_conflict(state)).write.mode("overwrite").parquet(f"{folder}/tickets/batch={batch}")

    # Beside the touched products, the share of all products whose turn it is.
    others = evidence.where(in_turn("gtin", batch)).join(touched, "gtin", "left_anti")
    kept = latest(both, "gtin", EVIDENCE_LIMIT, *[F.col(c).desc() for c in ARRIVAL_ORDER]).drop("recency")
    write_state(kept.unionByName(others), folder, "evidence", batch)

    added = arrived.groupBy("gtin").agg(*[F.count_if(tier == t).alias(t) for t in TIERS])
    before = totals.join(touched, "gtin", "left_semi")
    summed = before.unionByName(added).groupBy("gtin").agg(*[F.sum(t).alias(t) for t in TIERS])
    others = totals.where(in_turn("gtin", batch)).join(touched, "gtin", "left_anti")
    write_state(summed.unionByName(others), folder, "totals", batch)
    for frame in (known, arrived):
        frame.unpersist()
    for name in ("evidence", "totals"):
        delete_superseded(spark, folder, name, batch)


def start_ledger_stream(
    scans: DataFrame, folder: str, policy: SkewPolicy = DEFAULT_POLICY, trigger: dict | None = None
) -> StreamingQuery:
    """Starts the stream; ``folder`` must be shared by all executors."""

    def step(batch_scans: DataFrame, batch: int) -> None:
        apply_batch(batch_scans, batch, folder, policy)

    writer = scans.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def tickets_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/tickets").drop("batch")


def ledger_of(spark: SparkSession, folder: str, after: int) -> DataFrame:
    """Evidence state after a batch, ready for the consensus operator."""
    return read_state(spark, folder, "evidence", "gtin", EVIDENCE_SCHEMA, after + 1)
