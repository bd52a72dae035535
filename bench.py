"""Benchmark: headline triage queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed fully with the `noop` sink (no collect to the driver),
once to warm up and then timed BENCH_REPS times (median); prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crashlake.plans.catalog import QUERIES  # noqa: E402
from crashlake.session import local_session  # noqa: E402

HEADLINE = [
    "prioritize",          # end-to-end triage: A -> E1 -> D22 -> C2 -> C3 -> E6 -> F2
    "classify_full",       # replay-log classification of every event log (+ symbols, sources)
    "dedup_exact",         # content-hash dedup of every document
    "symbolize_pc",        # lineitem addresses in disjoint symbol segments
    "source_snippet",      # snippet windows joined exactly on (file, line)
    "duplicate_members",   # long-form member map across the three levels
    "count_by_axis",       # grouping-sets roll-up of the ranked issues
    "scan_fuzzer_stats",   # key/value text parsing
    "plot_downsample",     # numbered series
]


def timed(build, reps: int) -> float:
    """Median seconds to build a query and run it in full."""
    took = []
    for _ in range(reps):
        t = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - t)
    return round(statistics.median(took), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    # shuffled volumes at bench scale are small: one shuffle partition per core (AQE coalesces further)
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus), app="crashlake-bench")
    times: dict[str, float] = {}
    for name in HEADLINE:
        q = QUERIES[name]
        q(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        times[name] = timed(lambda q=q: q(spark, sf_dir), reps)
        print(f"# {name}: {times[name]:.2f}s", file=sys.stderr, flush=True)
    # skew case: one stack key holds 90 % of the crashes (derived from events)
    from crashlake.plans.skew import skewed_level_b
    skewed_level_b(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times["skew_dedup_stack"] = timed(lambda: skewed_level_b(spark, sf_dir), reps)
    print(f"# skew_dedup_stack: {times['skew_dedup_stack']:.2f}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
