"""Wall time of the headline queries. Prints one JSON line.

BENCH_SF_DIR: folder of the tables (default sf0.1). BENCH_CPUS: cores of the local master.
BENCH_QUERIES: comma-separated names, or "all".
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ledger_consensus", "ledger_batches", "rolling_ledger", "conflict_tickets", "ticket_summary", "kpi_counts", "docket_summary",
    "scan_search_page", "merged_scan_feed", "xp_running_balance", "document_scans", "label_verdicts", "rule_fail_rates", "origin_mix",
    "cross_validation", "listing_verdicts", "shelf_life", "consumption_forecast", "nutrient_coverage", "best_panel_candidates",
    "assembled_lines", "merged_blocks", "heading_neighbours", "classified_fields", "listing_pages", "stored_pages",
]


def main() -> None:
    from tallymark.plans import load_all
    from tallymark.session import get_session

    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES", "")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue = load_all()
    names = list(catalogue) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    # One small query first, so that starting the engine is not charged to any of them.
    catalogue["kpi_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    spent: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        catalogue[name](spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - started, 3)
        print(name, spent[name], file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_wall_time",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
