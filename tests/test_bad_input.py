"""Inputs that real logs hold must neither abort a run nor multiply its rows."""

from pyspark.sql import functions as F

from crashlake.functions.cwe import ubsan_trap
from crashlake.operators.lookup import enrich_frames, source_snippets, symbolize
from crashlake.sources.ingest import scan_crash_files

SYMBOLS = [(4096, 8191, "outer", "a.c:10"), (4200, 4300, "inner", "b.c:20"), (4200, 4300, "alias", "b.c:21"),
           (0x4000000000002FFF, 0x4000000000002FFF, "high", "c.c:1")]


def test_unknown_trap_ids(spark):
    rows = [("ud1 0xffffffff(%eax),%eax",), ("ud1 0xffffffffffffffffffff(%eax),%eax",), ("nop",), (None,)]
    got = spark.createDataFrame(rows, "insn string").select(ubsan_trap(F.col("insn")).alias("e")).collect()
    assert [r.e for r in got] == [None] * 4


def test_line_number_out_of_range(spark):
    locs = spark.createDataFrame([("/src/a.c:99999999999999999999",), ("/src/a.c:2",)], "crash_location string")
    lines = spark.createDataFrame([("/src/a.c", i, f"line {i}") for i in range(1, 4)], "file string, line int, text string")
    text, _ = source_snippets(locs, lines, [""])
    assert [(r.crash_location, r.crash_line_text) for r in text.collect()] == [("/src/a.c:2", "line 2")]


def test_large_source_files_have_snippets(spark):
    lines = spark.createDataFrame([("/src/big.c", i, "x" * 700_000) for i in (1, 2)], "file string, line int, text string")
    text, _ = source_snippets(spark.createDataFrame([("/src/big.c:2",)], "crash_location string"), lines, [""])
    assert text.count() == 1


def test_one_symbol_per_address(spark):
    symbols = spark.createDataFrame(SYMBOLS, "lo long, hi long, func string, loc string")
    rows = spark.createDataFrame([(1, 4250), (2, 5000), (3, 4250), (4, 0x4000000000002FFF), (5, None), (6, 9)], "id int, pc long")
    got = {r.id: (r.sym_func, r.sym_loc) for r in symbolize(rows, "pc", symbols).collect()}
    assert got == {1: ("alias", "b.c:21"), 2: ("outer", "a.c:10"), 3: ("alias", "b.c:21"), 4: ("high", "c.c:1"), 5: (None, None), 6: (None, None)}
    assert symbolize(rows, "pc", symbols).count() == 6


def test_overlapping_symbols_enrich_once(spark):
    symbols = spark.createDataFrame(SYMBOLS, "lo long, hi long, func string, loc string")
    frames = spark.createDataFrame([(1, ["#0  0x000000000000109a in f ()", "#1  0x0000000000001388 in g ()"])], "id int, backtrace array<string>")
    got = enrich_frames(frames, "id", symbols=symbols, bt_col="backtrace").collect()
    assert len(got) == 1 and got[0].backtrace[0].endswith(" at b.c:21") and got[0].backtrace[1].endswith(" at a.c:10")


def test_only_crash_folders_of_instances(spark, tmp_path):
    for place in ("crashes", "f 1/crashes", "f1/queue/crashes", "f1/queue"):
        (tmp_path / place).mkdir(parents=True, exist_ok=True)
        (tmp_path / place / "id_1,sig_11").write_bytes(b"x")
    # a root that has crashes of its own is the one instance; else its children are
    assert [r.fuzzer_instance for r in scan_crash_files(spark, str(tmp_path)).collect()] == [tmp_path.name]
    assert [r.fuzzer_instance for r in scan_crash_files(spark, str(tmp_path / "f 1")).collect()] == ["f 1"]
    assert scan_crash_files(spark, str(tmp_path / "f1" / "queue" / "crashes")).count() == 0


def test_instances_are_the_children(spark, tmp_path):
    for place in ("f 1/crashes", "f{2}/crashes", "f1/queue/crashes", "f1/queue"):
        (tmp_path / place).mkdir(parents=True, exist_ok=True)
        (tmp_path / place / "id_1,sig_11").write_bytes(b"x")
    assert sorted(r.fuzzer_instance for r in scan_crash_files(spark, str(tmp_path)).collect()) == ["f 1", "f{2}"]
    (tmp_path / "fuzzer_stats").write_text("execs_done : 1")  # now the root is one, without crashes
    assert scan_crash_files(spark, str(tmp_path)).count() == 0
