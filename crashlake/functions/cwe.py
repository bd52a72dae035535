"""CWE evidence (D1–D14) as ordered ARRAY<STRUCT<cwe STRING, w DOUBLE>> columns.

Order matters: ties of the arg-max go to the earliest key, and a key keeps the
position of its first insertion when its weight is raised later.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from crashlake import rules as R
from crashlake.functions import frames as B
from crashlake.functions.cache import per_context
from crashlake.functions.patterns import dec, jre, once

DIST_TYPE = "array<struct<cwe:string,w:double>>"


def ev(cwe: str | Column, w: float | Column) -> Column:
    if isinstance(cwe, str) and isinstance(w, (int, float)):
        return _ev_const(cwe, float(w))
    c = F.lit(cwe) if isinstance(cwe, str) else cwe
    x = F.lit(float(w)) if isinstance(w, (int, float)) else w
    return F.struct(c.alias("cwe"), x.cast("double").alias("w"))


@per_context
def _ev_const(cwe: str, w: float) -> Column:
    return F.struct(F.lit(cwe).alias("cwe"), F.lit(w).alias("w"))


def lit_dist(pairs: list[tuple[str, float]]) -> Column:
    return _lit_dist(tuple(pairs))


@per_context
def _lit_dist(pairs: tuple) -> Column:
    return F.array(*[ev(c, w) for c, w in pairs]) if pairs else F.array().cast(DIST_TYPE)


def signal_class(sig: Column) -> Column:
    """D1."""
    out = None
    for s, name in R.SIGNAL_CLASS.items():
        out = (F.when(sig == s, name) if out is None else out.when(sig == s, name))
    return out.otherwise(R.SIGNAL_CLASS_DEFAULT)


def signal_prior(sig: Column) -> Column:
    """Per-signal ordered prior."""
    out = F.when(sig.isNull(), lit_dist(R.SIGNAL_PRIOR[None]))
    for s, pairs in R.SIGNAL_PRIOR.items():
        if isinstance(s, int):
            out = out.when(sig == s, lit_dist(pairs))
    return out.otherwise(lit_dist(R.SIGNAL_PRIOR["other"]))


def compact(items: list[Column]) -> Column:
    """Ordered array of the non-NULL evidence items."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def overflow_header(raw: Column, markers: Column | None = None) -> Column:
    """D3: evidence from a `*-buffer-overflow` header and the first READ/WRITE line."""
    kind = F.lower(F.regexp_extract(raw, jre(R.OVERFLOW_HEADER, i=True), 1))
    if markers is not None:
        kind = F.when(F.array_contains(markers, OVERFLOW_MARKER), kind).otherwise(F.lit(""))
    access = F.upper(F.regexp_extract(raw, jre(R.ACCESS_LINE, i=True, m=True), 1))

    def item(kind: Column, access: Column) -> Column:
        by_kind = (F.when(kind == "stack", R.OVERFLOW_WRITE_CWE["stack"])
                    .when(kind == "heap", R.OVERFLOW_WRITE_CWE["heap"])
                    .otherwise(R.OVERFLOW_WRITE_CWE["global"]))
        return (F.when(access == "WRITE", ev(by_kind, R.OVERFLOW_WRITE_WEIGHT))
                 .when(access == "READ", ev(*R.OVERFLOW_READ))
                 .otherwise(ev(by_kind, R.OVERFLOW_NO_ACCESS_WEIGHT)))

    return once(kind, lambda k: F.when(k == "", F.lit(None)).otherwise(once(access, lambda a: item(k, a))))


# A lowercase literal every match of the rule at the same position must
# contain (derived from each pattern).
RULE_MARKERS = [
    "after", "return", "scope", "double", "allocation",
    "segv on unknown address", "null", "segv on unknown address", "segv on unknown address",
    "segv on unknown address", "signed", "unsigned", "shift", "negation of", "zero",
    "out of bounds for type", "null", "pointer", "misaligned address", "memorysanitizer",
    "variable length array", "__ubsan_handle_", "__ubsan_handle_", "__ubsan_handle_",
    "__ubsan_handle_", "__ubsan_handle_", "__ubsan_handle_", "__ubsan_handle_", "__ubsan_handle_",
]
# the overflow header's marker goes into the same scan
OVERFLOW_MARKER = "-buffer-overflow"
# A look-ahead consumes nothing, so markers that overlap are all found; the
# class of first letters rules out most positions at once.
_EVERY_MARKER = sorted({*RULE_MARKERS, OVERFLOW_MARKER})
_MARKER_SCAN = "(?=[" + re.escape("".join(sorted({m[0] for m in _EVERY_MARKER}))) + "])(?=(" + "|".join(map(re.escape, _EVERY_MARKER)) + "))"


def rule_markers(lowered: Column) -> Column:
    """The markers that occur in the lower-cased log, found in one scan."""
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(_MARKER_SCAN), F.lit(1)))


def sanitizer_rule_hits(raw: Column, markers: Column | None = None) -> list[Column]:
    """One item per rule, NULL when the rule does not match.

    With `markers` (`rule_markers` of the log) each regex runs only where the
    rule's marker is among them.
    """
    out = []
    for (p, cwe, w, dotall), marker in zip(R.SANITIZER_RULES, RULE_MARKERS):
        hit = raw.rlike(jre(p, i=True, s=dotall))
        if markers is not None:
            hit = F.array_contains(markers, marker) & hit
        out.append(F.when(hit, ev(cwe, w)))
    return out


def sanitizer_evidence(raw: Column) -> Column:
    """D3 + D4 in insertion order (header first, then rules); empty for empty text."""
    none = F.array().cast(DIST_TYPE)
    merged = once(rule_markers(F.lower(raw)), lambda marks: F.when(F.size(marks) > 0, max_merge(
        compact([overflow_header(raw, marks), *sanitizer_rule_hits(raw, marks)]))).otherwise(none))
    return F.when(raw.isNull() | (raw == ""), none).otherwise(merged)


def sanitizer_region(raw: Column) -> Column:
    """Memory region named by the report; null page markers win."""
    def named(tok: Column) -> Column:
        region = F.when(tok == "", F.lit(None).cast("string"))
        for src, dst in R.MEMORY_REGION_RENAME.items():
            region = region.when(tok == src, dst)
        return region.otherwise(tok)

    region = once(F.lower(F.regexp_extract(raw, jre(R.MEMORY_REGION, i=True), 1)), named)
    null_page = None
    for m in R.NULL_PAGE_MARKERS:
        null_page = raw.contains(m) if null_page is None else (null_page | raw.contains(m))
    return F.when(raw.isNull() | (raw == ""), F.lit(None).cast("string")).when(null_page, "null_page").otherwise(region)


@per_context
def _trap_map() -> Column:
    return F.create_map(*[x for k, (c, w) in R.UBSAN_TRAP_HANDLERS.items() for x in (F.lit(k), ev(c, w))])


def ubsan_trap(insn: Column) -> Column:
    """`ud1/ud2 0xNN(` handler id (absent = 0) to its evidence item."""
    pat = jre(R.UD_INSN, i=True)
    g = F.regexp_extract(insn, pat, 1)
    # an id out of range is unknown, as any id that isn't in the table
    digits = F.concat(F.lit("0"), F.regexp_replace(g, "^0+", ""))
    hid = F.when(F.length(digits) <= 9, F.conv(digits, 16, 10).try_cast("int"))
    return F.when(insn.isNotNull() & insn.rlike(pat), F.try_element_at(_trap_map(), hid))


def stack_exhaustion(dbg: Column) -> Column:
    """Deep recursion pattern in the first frames."""
    bt = dbg["backtrace"]
    funcs = F.filter(F.transform(F.slice(bt, 1, R.STACK_EXHAUSTION_SCAN), B.engine_function),
                     lambda x: x.isNotNull())
    insn = F.lower(F.coalesce(dbg["faulting_instruction"], F.lit("")))
    return ((F.size(bt) >= R.STACK_EXHAUSTION_MIN_FRAMES)
            & (((F.size(funcs) >= R.STACK_EXHAUSTION_MIN_FUNCS)
                & (F.size(F.array_distinct(funcs)) <= R.STACK_EXHAUSTION_MAX_DISTINCT))
               | (insn.contains("call") & (F.size(bt) >= R.STACK_EXHAUSTION_CALL_FRAMES))))


def recursive_overflow(dbg: Column) -> Column:
    """Sanitizer stack-overflow (not '...buffer' later on the line) or D8."""
    pat = jre(R.STACK_OVERFLOW, i=True)
    return dbg["raw"].rlike(pat) | stack_exhaustion(dbg)


_ALLOC = R.ALLOC_FUNCS
_STRING = R.STRING_FUNCS


def glibc_messages(raw: Column) -> tuple[Column, Column]:
    """Whether the log reports a double free, and heap corruption."""
    return raw.rlike(jre(R.GLIBC_DOUBLE_FREE, i=True)), raw.rlike(jre(R.GLIBC_HEAP_CORRUPT, i=True))


def heuristic_items(addr: Column, pc: Column, double_free: Column, corrupt: Column, insn_raw: Column, sig_class: Column,
                    funcs: Column) -> list[Column]:
    """D6 (+D7) evidence items in rule order; `funcs` = `in NAME(` names of all frames."""
    insn = F.lower(F.coalesce(insn_raw, F.lit("")))
    has_insn = insn_raw.isNotNull() & (insn_raw != "")
    segv = sig_class == "ERROR_SEGFAULT"
    has_alloc = F.arrays_overlap(funcs, F.array(*[F.lit(x) for x in _ALLOC]))
    has_string = F.arrays_overlap(funcs, F.array(*[F.lit(x) for x in _STRING]))
    low = dec(R.LOW_ADDRESS)
    write_insn = insn_raw.rlike(jre(R.WRITE_INSN, i=True))
    read_insn = insn_raw.rlike(jre(R.READ_INSN, i=True))
    return [
        F.when(addr.isNotNull() & (addr < low), ev("CWE-476", 0.75)),
        F.when(insn.rlike(jre(R.DIV_INSN, i=True)), ev("CWE-369", 0.8)),
        F.when(segv & has_insn & write_insn, ev("CWE-787", 0.6)),
        F.when(segv & has_insn & ~write_insn & read_insn, ev("CWE-125", 0.6)),
        F.when(sig_class == "ERROR_FPE", ev("CWE-369", 0.7)),
        F.when(has_alloc, ev("CWE-416", 0.5)),
        F.when(has_alloc, ev("CWE-787", 0.4)),
        F.when(has_string, ev("CWE-787", 0.6)),
        F.when(has_string, ev("CWE-125", 0.5)),
        F.when(double_free, ev("CWE-415", 0.85)),
        F.when(corrupt, ev("CWE-787", 0.7)),
        F.when(pc.isNotNull() & (pc < low), ev("CWE-787", 0.6)),
        F.when(pc.isNotNull() & (pc < low), ev("CWE-416", 0.5)),
        F.when(insn.rlike(jre(R.CALL_INSN, i=True)) & segv, ev("CWE-416", 0.5)),
        F.when((sig_class == "ERROR_ILL") & has_insn, ubsan_trap(insn_raw)),
    ]


def frame_functions(bt: Column) -> Column:
    return F.filter(F.transform(bt, B.engine_function), lambda x: x.isNotNull())


def debugger_heuristics(dbg: Column, sig_class: Column) -> Column:
    """D6 (+D7): ordered evidence from the debugger state when the sanitizer said nothing."""
    items = heuristic_items(dbg["faulting_address"], dbg["pc"], *glibc_messages(dbg["raw"]), dbg["faulting_instruction"],
                            sig_class, frame_functions(dbg["backtrace"]))
    hints = max_merge(compact(items))
    return F.when(stack_exhaustion(dbg), F.array().cast(DIST_TYPE)).otherwise(hints)


def max_merge(items: Column) -> Column:
    """D10 core: one item per CWE in first-occurrence order, weight = max over items."""
    def merged(held: Column) -> Column:
        keys = F.array_distinct(F.transform(held, lambda x: x["cwe"]))
        return F.transform(keys, lambda k: ev(
            k, F.array_max(F.transform(F.filter(held, lambda x: x["cwe"] == k), lambda x: x["w"]))))

    return once(items, merged)


def merge_evidence(*dists: Column) -> Column:
    """Prior, sanitizer and heuristic evidence merged by per-CWE max."""
    return max_merge(F.concat(*dists))


def apply_oob_direction(dist: Column, direction: Column) -> Column:
    """A write through an out-of-bounds index drops CWE-125 and raises CWE-121."""
    cwe, w = R.OOB_WRITE_CWE

    def raised(d1: Column) -> Column:
        return (F.when(F.exists(d1, lambda x: x["cwe"] == cwe),
                       F.transform(d1, lambda x: F.when(x["cwe"] == cwe, ev(cwe, F.greatest(x["w"], F.lit(w))))
                                   .otherwise(x)))
                 .otherwise(F.concat(d1, F.array(ev(cwe, w)))))

    return once(dist, lambda d: F.when(direction == "write", once(F.filter(d, lambda x: x["cwe"] != R.OOB_READ_CWE), raised)).otherwise(d))


def _fsum(dist: Column) -> Column:
    """Compensated (Neumaier) sum of the weights, as Python's float sum computes it."""
    init = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(acc, x):
        t = acc["s"] + x["w"]
        c = F.when(F.abs(acc["s"]) >= F.abs(x["w"]), acc["c"] + ((acc["s"] - t) + x["w"])) \
             .otherwise(acc["c"] + ((x["w"] - t) + acc["s"]))
        return F.struct(t.alias("s"), c.alias("c"))

    return F.aggregate(dist, init, step, lambda acc: acc["s"] + acc["c"])


def weight_total(dist: Column) -> Column:
    return _fsum(dist)


def py_round3(x: Column) -> Column:
    """Round a non-negative double to 3 places the way Python's round() does.

    Python rounds the exact binary value; `bround` rounds its shortest decimal
    rendering.  They differ only when that rendering is a tie d.ddd5 while the
    binary value lies just above or below it (e.g. 0.0375 -> 0.037).  For a
    tie the exact side is found with integer arithmetic: x * 2^s is an exact
    integer, compared with k * 2^s where k/10^4 is the tie.
    """
    return _py_round3(x, F.round(x * 10000.0).cast("long"))


def _py_round3(x: Column, k: Column) -> Column:
    """`py_round3` with k = round(x * 10^4) given (computed once by the caller)."""
    tie = ((k % 10) == 5) & ((k.cast("double") / 10000.0) == x)
    small = x < 2.0 ** -9
    m = F.when(small, (x * float(2 ** 70)).cast("long")).otherwise((x * float(2 ** 62)).cast("long")) \
         .cast("decimal(38,0)")
    scale = F.when(small, F.lit(2 ** 62).cast("decimal(38,0)") * F.lit(256).cast("decimal(38,0)")) \
             .otherwise(F.lit(2 ** 62).cast("decimal(38,0)"))
    lhs = m * F.lit(10000).cast("decimal(38,0)")
    rhs = k.cast("decimal(38,0)") * scale
    exact = (F.when(lhs < rhs, (k - 5).cast("double") / 10000.0)
              .when(lhs > rhs, (k + 5).cast("double") / 10000.0)
              .otherwise(F.bround(x, 3)))
    return F.when(tie, exact).otherwise(F.bround(x, 3))


def normalize(dist: Column, total: Column | None = None) -> Column:
    """Weights over their total, rounded half-even to 3 places; empty -> unknown 1.0.

    The distribution and its `total` are computed once per row, not per element.
    """
    def weights(d: Column, t: Column) -> Column:
        ratios = F.transform(d, lambda x: F.struct(x["cwe"].alias("cwe"), (x["w"] / t).alias("r")))
        keyed = F.transform(ratios, lambda e: F.struct(e["cwe"].alias("cwe"), e["r"].alias("r"),
                                                       F.round(e["r"] * 10000.0).cast("long").alias("k")))
        return F.when(t <= 0, lit_dist([("unknown", 1.0)])).otherwise(
            F.transform(keyed, lambda e: ev(e["cwe"], _py_round3(e["r"], e["k"]))))

    return once(dist, lambda d: once(_fsum(d) if total is None else total, lambda t: weights(d, t)))


def top_cwe(dist: Column) -> Column:
    """First key with the maximal weight; 'unknown' when empty."""
    best = F.aggregate(dist, ev("unknown", -1.0), lambda acc, x: F.when(x["w"] > acc["w"], x).otherwise(acc))
    return best["cwe"]


def dist_text(dist: Column) -> Column:
    """Flat text form 'CWE-125:0.2|CWE-476:0.2|...' (order kept)."""
    return F.array_join(F.transform(dist, lambda x: F.concat(x["cwe"], F.lit(":"), x["w"].cast("string"))), "|")


def dist_map(dist: Column) -> Column:
    return F.map_from_entries(dist)

