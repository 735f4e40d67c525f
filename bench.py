"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice on a warm session and the faster run counts; all output columns are
produced (no-op sink). ``BENCH_QUERIES`` may name others, or ``all``.
"""

from __future__ import annotations

import json
import os
import time

from venuelens.plans.registry import QUERIES
from venuelens.session import build_session

HEADLINE = [
    "daily_summary", "week_comparison", "trend_daily", "report_insights", "reviews_insert_new",
    "alert_messages", "sales_weekly_rollup", "top_items", "issue_by_department", "kot_hourly",
    "footfall_by_source", "knn_filtered", "value_lookup", "key_phrases", "review_digest",
    "chat_history", "chat_routing", "message_tables", "result_pages", "stream_daily_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus),
                          spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    took = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
