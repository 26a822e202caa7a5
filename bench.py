"""Headline queries timed in one session: prints one JSON line."""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plumbline import catalog  # noqa: E402
from plumbline.session import local_session  # noqa: E402

HEADLINES = ["T18_check_column", "B4_evaluate", "B10_rule_stats", "Q1b_sequence_valid_events", "J3_keyref", "J1_unique", "B16_group_assert",
             "A1_profile", "A7_render_spec", "A8_infer_type_lattice", "A9_follow_pairs", "A14_counts_by_file", "Q10_repair_plan", "C8_apply_fixes", "P1_shred", "R12_cardinality"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load_all()
    times = {}
    for name in HEADLINES:
        took = []
        for _ in range(runs + 1):
            start = time.time()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
        times[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({"metric": "headline checks, sum of median times", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
