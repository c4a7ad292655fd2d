"""Benchmark: seconds per registered query, one JSON line.

Each query is run to completion into a sink that discards rows, after one warm-up query.
``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores; ``BENCH_QUERIES`` is a comma list,
or ``all``. The default list has the main query of every operator family.
"""

from __future__ import annotations

import json
import os
import time

from lanespan.plans import QUERIES
from lanespan.session import local_session


HEADLINE = (
    "group_split split_audit split_members group_leakage content_leakage path_reuse dataset_digest calibration_sample "
    "pair_images pair_faults content_digest provenance_overlap merge_provenance artifact_normalize best_epoch every_n_frames "
    "letterbox_plan pixels_to_runs merge_runs morphology_close legacy_cleanup label_components hysteresis fill_holes "
    "select_road zone_runs zone_shares branch_connectors restore_runs augment_runs photometric confusion segmentation_scores "
    "boundary_iou evaluation_report compare_models comparison_gate backend_parity segmentation_loss latency_summary "
    "stage_summary min_sustained_fps frame_accounting latest_frames scene_segments ema vote ema_hysteresis branch_filter "
    "suppress_duplicates track_branches choose_main ema_stream camera_stream"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else [n for n in asked.split(",") if n] or HEADLINE
    spark = local_session(cpus)
    QUERIES["group_split"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
