"""Spark queries vs. the DuckDB oracle on the smallest test tables.

The full catalog is compared; CRASHLAKE_QUICK_ORACLE=1 takes a representative
subset (every operator family).
"""

import os

import pytest

from conftest import SF_SMALL
from crashlake.plans.verify import compare

SUBSET = ["instance_from_path", "scan_fuzzer_stats", "scan_plot_data", "parse_replay_log", "reject_loader_errors",
          "stack_hash", "first_user_frame", "first_sanitizer_loc", "oob_direction", "dedup_exact",
          "sanitizer_rules", "debugger_heuristics", "normalize_distribution", "taxonomy", "classify_static",
          "classify_full", "symbolize_pc", "enrich_frames", "source_snippet", "resolve_source_path",
          "reduction_ratio", "plot_downsample", "prioritize", "duplicate_members", "recommendation"]


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="test tables missing")
def test_oracle_matches(spark):
    names = SUBSET if os.environ.get("CRASHLAKE_QUICK_ORACLE") == "1" else None
    res = compare(spark, SF_SMALL, names, verbose=False)
    bad = {k: v for k, v in res.items() if v != "match"}
    assert not bad, bad
