"""Seconds per headline query on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then $BENCH_RUNS times; the median is reported. The whole result is
computed and discarded.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "daily_sales",
    "product_master",
    "daily_geographic",
    "ads_master",
    "hero_kpis",
    "weekly_trend",
    "period_comparison",
    "province_distribution",
    "hero_comparison",
    "trend_vs_previous",
    "products_in_period",
    "rfm_segments",
    "segment_summary",
    "frequent_itemsets",
    "association_rules",
    "dedupe_orders_latest",
    "upsert_orders",
    "all_orders",
    "content_platform_metrics",
    "engagement_histogram",
    "scalar_currency",
]


def main() -> None:
    from checks.registry import CHECKS
    from checks.session import local_session
    from tradewind.session import drop_staged

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    by_name = {check.name: check for check in CHECKS}
    spark = local_session()
    seconds = {}
    for _ in range(2):  # start the code generator and the readers before the first timing
        by_name[names[0]].run(spark, folder).write.format("noop").mode("overwrite").save()
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            by_name[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            drop_staged(spark)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    spark.stop()
    scale = Path(folder).name.removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale)}
        )
    )


if __name__ == "__main__":
    main()
