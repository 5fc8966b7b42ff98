"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Beside the seconds per query it gives the guard ratios of the metadata queries: filtered over unfiltered listing,
status filter over listing, and summary over listing.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "slot_agg", "bin_mean", "bin_median", "bin_dense", "bin_multi_var", "pyramid_time", "coverage_islands", "interval_merge", "interval_complement", "interval_overlap_join", "plan_slots",
    "replacement_apply", "list_filtered", "coverage_summary", "dedup_projection", "dedup_stats", "append_batch_starts", "batch_assign", "chunk_missing", "cf_report", "healpix_mean", "region_explode",
)


def main() -> None:
    from tessera import catalogue
    from tessera.functions.scalars import key_matches
    from tessera.operators import state_log
    from tessera.session import local_session

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, **{"spark.sql.shuffle.partitions": str(max(8, int(cpus)))})
    queries, seconds = catalogue.queries(), {}

    def timed(run) -> float:
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    timed(lambda: queries["slot_agg"](spark, folder))  # compile and load once
    for name in HEADLINE:
        seconds[name] = round(min(timed(lambda n=name: queries[n](spark, folder)) for _ in range(2)), 3)
    events, runs = catalogue._log(spark, folder)
    whole = min(timed(lambda: state_log.list_records(events, runs)) for _ in range(2))
    from pyspark.sql import functions as F

    guards = {
        "time_filter_ratio": min(timed(lambda: state_log.list_records(events, runs, time_min_after="2024-01-10T00:00:00")) for _ in range(2)) / whole,
        "overlap_filter_ratio": min(timed(lambda: state_log.list_records(events, runs, time_overlaps=("2024-01-10T00:00:00", "2024-01-12T00:00:00"))) for _ in range(2)) / whole,
        "status_filter_ratio": min(timed(lambda: state_log.list_runs(runs, status="complete")) for _ in range(2)) / whole,
        "summary_ratio": min(timed(lambda: state_log.coverage_summary(state_log.project(events, runs).where(key_matches(F.col("key"), "*")))) for _ in range(2)) / whole,
    }
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "guards": {k: round(v, 3) for k, v in guards.items()}, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
