"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores. Each query runs once to warm up and is then timed
on a fresh plan that is executed in full.
"""

from __future__ import annotations

import json
import os
import time

from tillcast.plans.queries import REGISTRY
from tillcast.session import local_session

HEADLINE = (
    "business_day_of",
    "normalize_orders",
    "upsert_latest",
    "daily_sales",
    "daily_item_sales",
    "daily_payments",
    "customer_first_seen",
    "new_vs_returning",
    "peak_hour",
    "daily_summary",
    "forecast_features",
    "top_items",
    "data_quality",
    "validation_report",
    "rolling_features",
    "feature_table",
    "baseline_scores",
    "forecast_rows",
)


def run(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    seconds = {}
    for name in HEADLINE:
        run(spark, name, folder)
        seconds[name] = round(run(spark, name, folder), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
