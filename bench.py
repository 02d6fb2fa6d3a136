"""Headline timings: one JSON line.

Builds (``build_*``) go from the given tables to resolved, stored traces; the
other queries read those, as a user would. Each query is run once to warm up
and then three times; the median counts. Rows go to Spark's noop sink, so all
of them are computed and none are moved to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lifetrace.session import local_session
from lifetrace.suite import registry
from lifetrace.suite.tables import build_trace, trace

QUERIES = (
    "F7_order_numbers F8_chained F1_filter_not_freed F6_equal F13_starts_ends F10_in_threads "
    "F5_filter_on_field F18_tag_member F19_tags_equal F20_named F16_arithmetic F23_facets F27_field_catalog "
    "A1_overview_orders A2_peak_orders A3_top_sites A4_by_site A9_by_tag A14_tag_counts "
    "W1_running_orders W2_live_at_position W5_diff W10_reuse_chains_orders "
    "T1_timeline_sequence T3_filtered_timeline T4_density_time M2_occupancy_orders M8_shared_bytes_orders "
    "J4_pick_orders J6_ghosts_events J8_time_to_position J10_pointer_owners L2_chains L5_contexts L8_phases "
    "O3_size_desc O6_page_with_totals E1_add E4_changed C7_overlap_at_birth_orders C9_warnings "
    "Q1_retained_cohort Q7_stale_handles"
).split()


def once(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "lifetrace-bench")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in ("orders", "events"):
        build_trace(spark, sf_dir, name)  # warm-up
        start = time.perf_counter()
        build_trace(spark, sf_dir, name)
        times[f"build_{name}"] = time.perf_counter() - start
        trace(spark, sf_dir, name)
    for name in QUERIES:
        run = lambda fn=registry.QUERIES[name]: fn(spark, sf_dir)
        once(run)
        times[name] = statistics.median(once(run) for _ in range(3))
    rounded = {k: round(v, 4) for k, v in times.items()}
    print(
        json.dumps(
            {
                "metric": "total query time", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": rounded, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
