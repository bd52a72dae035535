"""Classification cases (sanitizer texts, priors, verdicts, taxonomy) and dedup keys."""

import pytest
from pyspark.sql import functions as F

from crashlake.functions import cwe as D
from crashlake.functions import evidence as A
from crashlake.functions import frames as B
from crashlake.operators import classify as K
from crashlake.operators import dedup as C


def _full(spark, cases):
    df = spark.createDataFrame([(i, sig, raw) for i, (sig, raw) in enumerate(cases)],
                               "ord long, signal int, raw string")
    logs = df.select("ord", A.parse_log(F.col("raw")).alias("dbg"))
    out = K.classify_full(df.select("ord", "signal"), logs)
    return {r.ord: r for r in out.select("ord", "top_cwe", "exploitability", "taxonomy",
                                         D.dist_map(F.col("cwe_distribution")).alias("d")).collect()}


def _san(spark, text):
    df = spark.createDataFrame([(text,)], "raw string")
    r = df.select(D.dist_map(D.sanitizer_evidence(F.col("raw"))).alias("d"),
                  D.sanitizer_region(F.col("raw")).alias("region")).collect()[0]
    return r.d or {}, r.region


def _asan(kind, access, tail=""):
    """An overflow report with the given access line."""
    return (f"=====\n==907==ERROR: AddressSanitizer: {kind} on address 0x61b0000007d1 at pc 0x4c2f bp 0x7ffc\n"
            f"{access} of size 2 at 0x61b0000007d1 thread T2\n    #0 0x4c2f in lzw_next /opt/gif/lzw.c:88\n{tail}")


@pytest.mark.parametrize("text,cwe,region", [
    (_asan("heap-buffer-overflow", "WRITE"), "CWE-122", "heap"),
    (_asan("stack-buffer-overflow", "WRITE"), "CWE-121", "stack"),
    (_asan("global-buffer-overflow", "WRITE"), "CWE-787", "bss"),
    (_asan("heap-buffer-overflow", "READ"), "CWE-125", "heap"),
    # a later line that begins like an access line isn't one
    (_asan("heap-buffer-overflow", "READ", "0x61b is 1 byte after a 64-byte region\nWRITE queue flushed\n"), "CWE-125", "heap"),
    ("==907==ERROR: AddressSanitizer: heap-use-after-free on 0x61b0 (thread T2)", "CWE-416", "heap"),
    ("==907==ERROR: AddressSanitizer: attempting double-free on 0x6020 in thread T0:", "CWE-415", None),
    ("lzw.c:41:17: runtime error: division by zero", "CWE-369", None),
    ("==907==ERROR: AddressSanitizer: SEGV on unknown address 0x000000000000 (pc 0x4c2f)", "CWE-476", "null_page"),
])
def test_sanitizer_texts(spark, text, cwe, region):
    d, reg = _san(spark, text)
    assert max(d, key=d.get) == cwe and d[cwe] >= 0.9
    assert reg == region


def test_read_leaves_no_write_evidence(spark):
    d, _ = _san(spark, _asan("heap-buffer-overflow", "READ"))
    assert not {"CWE-787", "CWE-122", "CWE-121"} & set(d)


def test_static_priors(spark):
    df = spark.createDataFrame([(0, 11), (1, 6), (2, 8), (3, 7), (4, 4), (5, None), (6, 9)], "ord long, signal int")
    out = {r.ord: r for r in K.classify_static(df).collect()}
    assert (out[0].top_cwe, out[0].exploitability) == ("CWE-125", "NOT_EXPLOITABLE")   # tie with 476, earlier wins
    assert (out[1].top_cwe, out[1].exploitability) == ("CWE-416", "EXPLOITABLE")
    assert (out[2].top_cwe, out[2].exploitability) == ("CWE-369", "UNKNOWN")
    for i in (3, 4, 5, 6):
        assert (out[i].top_cwe, out[i].exploitability) == ("unknown", "UNKNOWN")
    assert out[0].taxonomy.signal_class == "ERROR_SEGFAULT"
    assert out[2].taxonomy.signal_class == "ERROR_FPE"


def test_full_classification_cases(spark):
    r = _full(spark, [
        (11, "==1==ERROR: AddressSanitizer: stack-overflow on address 0x7f"),          # recursion clears all
        (11, "#0  0x41 in copy (a=1) at m.c:3\nrip            0x41\nsi_addr = 0x41414141\n=> 0x55: mov    QWORD PTR [rax],rbx"),
        (8, "Program received signal SIGFPE\n#0  0x55 in div (a=1) at m.c:2\nrip 0x5555\n=> 0x5555: idiv ecx"),
        (11, "No stack."),                                                              # no usable log -> prior only
    ])
    assert r[0].top_cwe == "unknown" and r[0].d == {"unknown": 1.0}
    assert r[1].taxonomy.control_flow_state == "ret_to_unmapped"
    assert r[1].exploitability == "EXPLOITABLE"
    assert r[2].top_cwe == "CWE-369"
    assert r[3].top_cwe == "CWE-125" and r[3].taxonomy.crash_site_kind == "unknown"


def test_distribution_rounds_half_even(spark):
    df = spark.createDataFrame([(1,)], "x int")
    d = df.select(D.dist_map(D.normalize(D.lit_dist([("a", 0.0625), ("b", 0.9375)]))).alias("d")).collect()[0].d
    assert d == {"a": 0.062, "b": 0.938}


def _hash(spark, bt):
    df = spark.createDataFrame([(bt,)], "bt array<string>")
    return df.select(B.stack_hash(F.col("bt"))).collect()[0][0]


def test_stack_hash_ignores_offsets(spark):
    one, two = (["lzw_next+0x1c in /opt/bin/gifdec", f"read_image+{off} in /opt/bin/gifdec"] for off in ("0x9", "0xfe4"))
    assert _hash(spark, one) == _hash(spark, two)
    assert _hash(spark, one) != _hash(spark, list(reversed(one)))


def test_stack_hash_filters_noise(spark):
    user = ["lzw_next at lzw.c:88", "read_image at gif.c:301", "run at cli.c:12"]
    noise = ["__GI_raise at raise.c:51", "__GI_abort at abort.c:100", "__asan_report_store2"]
    assert _hash(spark, noise + user) == _hash(spark, user)
    assert _hash(spark, []) is None


def _issues(spark, rows):
    return spark.createDataFrame(rows, "ord long, top_cwe string, backtrace array<string>, duplicate_count long, "
                                       "crash_location string, faulting_instruction string")


def test_level_b_key_is_stack_and_cwe(spark):
    stack, other = ["lzw_next at lzw.c:88", "run"], ["read_image at gif.c:301", "run"]
    df = _issues(spark, [(1, "CWE-122", stack, 3, None, None), (2, "CWE-125", stack, 1, None, None),
                         (3, "CWE-122", other, 1, None, None), (4, "CWE-122", stack, 2, None, None),
                         (5, "CWE-122", [], 4, None, None)])
    out = {r.ord: (r.duplicate_count, r.untouched_b) for r in C.dedup_stack(df).collect()}
    assert out == {1: (5, False), 2: (1, False), 3: (1, False), 5: (4, True)}


def test_level_c_merges_location(spark):
    df = _issues(spark, [(1, "CWE-125", [], 1, "/a.c:3", "mov"), (2, "CWE-125", [], 2, "/a.c:3", "mov"),
                         (3, "CWE-125", [], 1, "", None)])
    b = C.dedup_stack(df)
    out = {r.ord: r for r in C.dedup_location(b).collect()}
    assert set(out) == {1, 3}
    assert out[1].duplicate_count == 3 and out[3].untouched_c


def test_rounding_follows_python_round(spark):
    import random

    random.seed(7)
    vals = [0.0375, 0.0125, 0.3 / 1.6, 0.0625, 0.0005, 0.9995] + [random.randint(0, 10000) / 10000 for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(D.py_round3(F.col("x"))).collect()]
    assert got == [round(v, 3) for v in vals]
