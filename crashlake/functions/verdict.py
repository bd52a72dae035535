"""Exploitability verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crashlake import rules as R
from crashlake.functions.patterns import dec, jre


def evidence_verdict(raw: Column, top: Column) -> Column:
    """Tier-0 verdict read from the sanitizer text; NULL when it decides nothing."""
    not_expl = (raw.rlike(jre(R.ALLOC_TOO_BIG, i=True))
                | raw.rlike(jre(R.STACK_BUF_READ, i=True, s=True))
                | (raw.rlike(jre(R.UBSAN_TEXT, i=True)) & ~top.isin(*R.WRITE_PRIMITIVE_CWES)))
    return (F.when(raw.isNull(), F.lit(None).cast("string"))
             .when(not_expl, "NOT_EXPLOITABLE")
             .when(raw.rlike(jre(R.SAN_WRITE, i=True, m=True)), "EXPLOITABLE")
             .when(raw.rlike(jre(R.SAN_READ, i=True, m=True)), "NOT_EXPLOITABLE"))


def _lookup(key: Column, table: dict, default: int = 0) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def score(top: Column, tax: Column, dbg: Column) -> Column:
    """CWE + taxonomy (+ debugger) score."""
    s = _lookup(top, R.CWE_SCORE)
    s = s + _lookup(tax["control_flow_state"], R.CONTROL_FLOW_SCORE)
    s = s + _lookup(tax["crash_site_kind"], R.CRASH_SITE_SCORE)
    s = s + _lookup(tax["memory_region"], R.REGION_SCORE)
    segv = tax["signal_class"] == "ERROR_SEGFAULT"
    addr, pc = dbg["faulting_address"], dbg["pc"]
    low = dec(R.LOW_ADDRESS)
    insn = F.lower(F.coalesce(dbg["faulting_instruction"], F.lit("")))
    mem = None
    for w in R.INSN_MEMORY_WORDS:
        mem = insn.contains(w) if mem is None else (mem | insn.contains(w))
    br = None
    for w in R.INSN_BRANCH_WORDS:
        br = insn.contains(w) if br is None else (br | insn.contains(w))
    g = (F.when(addr.isNotNull() & (addr >= low) & segv, 1).otherwise(0)
         - F.when(addr.isNotNull() & (addr < low), 1).otherwise(0)
         + F.when(mem & segv, 1).otherwise(0)
         + F.when(br & segv, 3).otherwise(0)
         + F.when(pc.isNotNull() & (pc < low), 4).otherwise(0))
    return s + F.when(dbg.isNull(), 0).otherwise(g)


def verdict(tax: Column, dbg: Column, top: Column) -> Column:
    """D19 then D20: EXPLOITABLE / NOT_EXPLOITABLE / UNKNOWN."""
    sc = score(top, tax, dbg)
    by_score = (F.when(sc >= R.EXPLOITABLE_MIN_SCORE, "EXPLOITABLE")
                 .when(sc >= R.NOT_EXPLOITABLE_MIN_SCORE, "NOT_EXPLOITABLE")
                 .otherwise("UNKNOWN"))
    tier0 = F.when(dbg.isNull(), F.lit(None).cast("string")).otherwise(evidence_verdict(dbg["raw"], top))
    return F.coalesce(tier0, by_score)
