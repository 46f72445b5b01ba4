"""Time the headline queries: one JSON line with seconds per query and in all."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "tools"))

from compare import session  # noqa: E402

from kerbline.plans.catalog import CATALOG  # noqa: E402
from kerbline.plans.registry import Tables  # noqa: E402

HEADLINE = ["audit_splits", "cumulative_assignment", "exact_dedup", "near_duplicates", "capture_sessions", "asof_drive", "spearman", "choose_thresholds",
            "two_half_crossfit", "out_of_range", "ratio_summary", "segment_summary", "iou_pairs", "ring_dilation", "bowl_depth", "wheel_drops", "water_ensemble", "severity_progression",
            "astm_grade", "top_k_per_group", "bootstrap_ci"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = session(cores, cores)
    tables = Tables(spark, folder)
    tables.lineitem.agg({"l_quantity": "sum"}).collect()                      # start executors and code generation
    took = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        CATALOG[name][0](tables).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
