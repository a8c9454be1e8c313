"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is run once to warm up and then ``$BENCH_RUNS`` times, into a sink that takes every row; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from gopmill.plans import all_queries
from gopmill.session import local_session, remove_scratch

HEADLINE = (
    "gop_stats",
    "scene_changes",
    "plan_segments_smart_auto",
    "recommend",
    "create_segments",
    "frames_in_segments",
    "packets_in_segments",
    "assign_segments",
    "latest_segment_state",
    "job_progress",
    "log_phase",
    "silent_intervals",
    "redeem_grants",
    "validate_request",
)
# what a second of each rate counts
RATES = {
    "gop_stats": ("packets_per_sec", "events"),
    "scene_changes": ("frames_per_sec", "embeddings"),
    "recommend": ("assets_per_sec", "part"),
    "job_progress": ("events_per_sec", "lineitem"),
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "gopmill-bench")
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            all_queries.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    rates = {
        f"{name}.{unit}": round(spark.read.parquet(f"{folder}/{table}.parquet").count() / seconds[name])
        for name, (unit, table) in RATES.items()
        if name in seconds
    }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "rates": rates, "sf": folder.rsplit("sf", 1)[-1].strip("/"),
            }
        )
    )
    remove_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
