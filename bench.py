"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "watershed_cap_reaches", "watershed_cap_points", "multi_watershed_rollup", "band_join", "redd_density", "nearest_in_time",
    "point_in_polygon", "snap_to_line", "clip_line_length", "predict_quantile", "weighted_glm", "design_variance", "mic_screen",
    "correlation_matrix", "estimator_dispatch", "quantile_agg", "group_share", "keep_group_max", "pivot", "grand_total_row",
    "spawner_recruit_fit", "impute_missing",
]


def main() -> None:
    from reachworks.plans import catalog
    from reachworks.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus)
    names = sys.argv[1:] or HEADLINE
    # Start the JVM, the Python workers and the code generator before timing.
    catalog.QUERIES["watershed_cap_reaches"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
