"""Incremental level-A dedup over a crash directory (Structured Streaming)."""

import uuid

from conftest import GIF
from crashlake.streaming.watch import read_exact_dedup, start_exact_dedup


def test_stream_dedups_new_files(spark, campaign, tmp_path):
    out = str(tmp_path / "level_a")
    name = f"t_level_a_{uuid.uuid4().hex[:8]}"   # fresh stream state under the shared checkpoint folder
    q = start_exact_dedup(spark, str(campaign), out, query_name=name, available_now=True)
    q.awaitTermination(120)
    rows = {r.input_sha1: r for r in read_exact_dedup(spark, out).collect()}
    assert len(rows) == 4
    dup = [r for r in rows.values() if r.duplicate_count == 3]
    assert len(dup) == 1 and dup[0].name.startswith("id_000000")
    # a new identical crash arrives later: the group count grows, no new issue
    (campaign / "gifdec 2" / "crashes" / "id_000009,sig_11,time_700,op_flip4").write_bytes(GIF)
    q = start_exact_dedup(spark, str(campaign), out, query_name=name, available_now=True)
    q.awaitTermination(120)
    rows = {r.input_sha1: r for r in read_exact_dedup(spark, out).collect()}
    assert len(rows) == 4
    assert max(r.duplicate_count for r in rows.values()) == 4
