"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local threads, ``BENCH_QUERIES`` an optional comma list of names
(``all`` for every registered query).
"""

from __future__ import annotations

import json
import os
import sys
import time

from curatrix.plans.catalog import queries
from curatrix.session import build_session

HEADLINE = [
    "contract_checks", "check_unique", "check_range", "split_score", "split_bad_rows", "sequence_check", "volume_floor", "referential_check", "profile_columns",
    "schema_drift_result", "diff_contract_fields", "evaluate_policy", "compliance_stats", "quality_summary", "cost_by_product", "price_as_of", "grant_summary",
    "merge_columns", "desired_tags", "reconcile_tags", "discover_entities", "link_schema_to_assets", "flight_daily", "otp_daily", "sales_summary", "customer_360",
    "product_performance", "best_field", "concepts", "concept_ancestors", "business_lineage_nodes", "propagate_certification", "detect_cycles", "match_profiles",
    "match_candidates", "stream_enforce_good", "event_volume", "session_activity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    every = queries()
    names = list(every) if wanted == "all" else (wanted.split(",") if wanted else HEADLINE)
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    every["check_range"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the session
    times = {}
    for name in names:
        start = time.time()
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total seconds over the benchmark queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
