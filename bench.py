"""Bench: run the headline plans at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with per-query seconds.

Each plan is executed in full with the ``noop`` sink (every row is
produced, nothing is collected to the driver)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelflow.plans.registry import QUERIES  # noqa: E402
from panelflow.plans import catalog  # noqa: E402,F401
from panelflow import session  # noqa: E402
from panelflow.session import local_session  # noqa: E402

HEADLINE = [
    "hourly_rollup", "gap_filter", "interval_label_last_writer", "interval_flags_closed",
    "impact_by_segment_team", "impact_top20", "criticality", "weather_resample_ffill", "features",
    "typical_profile", "network_hourly", "vehicle_mix_hourly", "flow_validation", "missing_flow_by_type",
    "geofence_tally", "missing_days", "duplicate_ids", "split_chronological", "split_kfold",
    "regression_metrics", "supplier_panel_rollup", "supplier_panel_profile",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cpus, shuffle_partitions=max(2 * cpus, 8), app_name="panelflow-bench")
    # warm-up of every plan on the smallest tables (JIT, class loading);
    # not timed, and nothing memoized for it is reused at $BENCH_SF_DIR
    for q in HEADLINE:
        QUERIES[q](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times = {}
    for q in HEADLINE:
        session.forget()        # cold: nothing that an earlier query derived is reused
        t0 = time.perf_counter()
        QUERIES[q](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[q] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
