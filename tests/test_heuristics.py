"""Debugger-state heuristics (D6–D9), hand-computed from the rule tables."""

from pyspark.sql import functions as F

from crashlake.functions import cwe as D
from crashlake.functions import evidence as A
from crashlake.operators import classify as K


def _classify(spark, cases):
    df = spark.createDataFrame([(i, sig, raw) for i, (sig, raw) in enumerate(cases)],
                               "ord long, signal int, raw string")
    logs = df.select("ord", A.parse_log(F.col("raw")).alias("dbg"))
    out = K.classify_full(df.select("ord", "signal"), logs, materialize=False)
    return {r.ord: r for r in out.select("ord", "top_cwe", "exploitability", "taxonomy",
                                         D.dist_text(F.col("cwe_distribution")).alias("d")).collect()}


def test_ubsan_trap_ids(spark):
    r = _classify(spark, [
        (4, "#0  0x55555a in step (a=1) at m.c:2\nrip 0x55555a\n=> 0x55555a: ud1    0x3(%eax),%eax"),   # id 3 -> 369 .8
        (4, "#0  0x55555a in step (a=1) at m.c:2\nrip 0x55555a\n=> 0x55555a: ud2    (%eax)"),            # no id -> 0 -> 190 .75
        (4, "#0  0x55555a in step (a=1) at m.c:2\nrip 0x55555a\n=> 0x55555a: ud1    0x63(%eax),%eax"),  # id 99: no entry
    ])
    # prior(4) = 476 .25, 369 .2, 190 .15, 787 .1, unknown .3
    assert r[0].d == "CWE-476:0.156|CWE-369:0.5|CWE-190:0.094|CWE-787:0.062|unknown:0.187"
    assert r[0].top_cwe == "CWE-369"
    # 190 -> .75: total 1.6 -> 476 .25/1.6=.156, 369 .125, 190 .469, 787 .062, unknown .188
    assert r[1].top_cwe == "CWE-190"
    assert r[2].top_cwe == "unknown"          # prior only: unknown .3 is the maximum


def test_glibc_free_errors_and_alloc_frames(spark):
    r = _classify(spark, [
        (6, "free(): invalid pointer\n#0  0x1 in __GI_raise (sig=6) at raise.c:1\n#1  0x2 in free (p=0) at malloc.c:3\n"
            "#2  0x55 in drop (p=0) at m.c:9"),
    ])
    # prior(6) 121 .15 122 .15 787 .2 416 .25 415 .15 unk .1; alloc frame: 416 .5, 787 .4; double-free text: 415 .85
    # total .15+.15+.4+.5+.85+.1 = 2.15
    assert r[0].d == "CWE-121:0.07|CWE-122:0.07|CWE-787:0.186|CWE-416:0.233|CWE-415:0.395|unknown:0.047"
    assert r[0].top_cwe == "CWE-415"
    assert r[0].taxonomy.crash_site_kind == "libc_alloc"      # first non-noise frame is free()


def test_segv_call_into_unmapped(spark):
    r = _classify(spark, [
        (11, "#0  0x0 in ?? ()\nrip            0x0\n=> 0x0: call   QWORD PTR [rax]"),
    ])
    # pc 0 < 0x1000: 787 .6, 416 .5; call on SEGV: 416 .5 -> ret_to_unmapped, score >= 5
    assert r[0].taxonomy.control_flow_state == "ret_to_unmapped"
    assert r[0].exploitability == "EXPLOITABLE"
    assert r[0].top_cwe == "CWE-787"


def test_sanitizer_evidence_suppresses_heuristics(spark):
    r = _classify(spark, [
        (8, "==1==ERROR: AddressSanitizer: heap-use-after-free on address 0x60\n=> 0x55: idiv ecx"),
    ])
    # sanitizer found 416 .97, so the div instruction (369 .8) is not consulted; prior(8) 369 .7 190 .2 unk .1
    assert r[0].d == "CWE-369:0.355|CWE-190:0.102|unknown:0.051|CWE-416:0.492"
    assert r[0].top_cwe == "CWE-416"


def test_recursion_clears_distribution(spark):
    frames = "\n".join(f"#{i}  0x55 in rec (a=1) at m.c:1" for i in range(6))
    r = _classify(spark, [(11, frames)])
    assert r[0].d == "unknown:1.0" and r[0].top_cwe == "unknown"
