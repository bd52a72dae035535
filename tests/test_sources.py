"""Ingest of a fuzzer output tree."""

from pyspark.sql import functions as F

from conftest import CRASHES, PLOT
from crashlake.operators import dedup as C
from crashlake.plans.directory import read_plot, read_stats
from crashlake.sources import ingest as I


def test_scan_reads_crashes_skips_readme(spark, campaign):
    rows = I.scan_crash_files(spark, str(campaign), with_content=True).collect()
    found = {(r.fuzzer_instance, r.name): r.size for r in rows}
    assert len(rows) == 6
    assert found == {(w, n): len(b) for w, files in CRASHES.items() for n, b in files.items()}
    assert sorted(r.signal for r in rows) == [6, 7, 8, 11, 11, 11]


def test_exact_dedup_of_tree(spark, campaign):
    raw = I.scan_crash_files(spark, str(campaign), with_content=True)
    a = C.dedup_exact(raw.select("input_sha1", "ord", "name", "path", "signal", "size"))
    rows = a.collect()
    assert len(rows) == 4
    dup = [r for r in rows if r.duplicate_count > 1]
    assert len(dup) == 1 and dup[0].duplicate_count == 3
    # the first file in (instance, name) order represents the group
    assert dup[0].name.startswith("id_000000")


def test_fuzzer_stats(spark, campaign):
    st = {s.fuzzer_instance: s for s in read_stats(spark, str(campaign)).collect()}
    assert set(st) == {"gifdec", "gifdec 2"}
    new, old = st["gifdec"], st["gifdec 2"]
    assert (new.execs_done, new.execs_per_sec, new.afl_version) == (987001, 311.25, "4.30a")
    assert (new.paths_total, new.unique_crashes, new.unique_hangs) == (77, 3, 1)
    assert new.target_binary == "--fast"      # the last token of the command line
    assert (new.start_time_epoch, new.last_update_epoch) == (1690000100, 1690007300)
    assert (old.paths_total, old.unique_crashes, old.unique_hangs, old.afl_version) == (12, 3, 0, "2.57b")
    assert old.target_binary == "qemu" and old.command_line is None


def test_stats_fallbacks_and_duplicates(spark):
    body = "execs_done : 1\nexecs_done : 2\ncorpus_count : 0\npaths_total : 7\nexecs_per_sec : n/a\nfuzzer_version : 3.0\n"
    df = spark.createDataFrame([("i0", body)], "fuzzer_instance string, body string")
    s = I.parse_fuzzer_stats(df).collect()[0]
    assert s.execs_done == 2            # last key wins
    assert s.paths_total == 7           # corpus_count 0 falls back
    assert s.execs_per_sec == 0.0       # unparsable -> 0
    assert s.afl_version == "3.0"
    assert s.target_binary is None      # no target_mode, no command_line
    assert s.start_time_epoch is None


def test_plot_data(spark, campaign):
    pts = read_plot(spark, str(campaign)).orderBy("line_no").collect()
    assert [(p.unix_time, p.unique_crashes) for p in pts] == PLOT      # the short line is dropped


def test_signal_from_name(spark):
    df = spark.createDataFrame([("id_1,sig_06,x",), ("id_2,SIG:11",), ("id_3",)], "name string")
    got = [r[0] for r in df.select(I.signal_from_name(F.col("name"))).collect()]
    assert got == [6, 11, None]


def test_instance_from_path(spark):
    df = spark.createDataFrame([("/o/fuzzer02/crashes/id_1",), ("/o/crashes/id_2",)], "p string")
    got = [r[0] for r in df.select(I.instance_from_path(F.col("p"))).collect()]
    assert got == ["fuzzer02", "o"]
