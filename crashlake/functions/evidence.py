"""Debugger/sanitizer log parsing (A8) and replay-attempt choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crashlake import rules as R
from crashlake.functions.patterns import PY_LINE_BREAK, extract, hex_to_decimal, jre, once, py_strip

DBG_FIELDS = ["signal_name", "backtrace", "faulting_instruction", "faulting_address", "pc", "raw"]


def log_frames(raw: Column) -> Column:
    """Stripped lines starting `#N ` (at most 20), in log order."""
    lines = F.split(raw, PY_LINE_BREAK)
    cand = F.filter(lines, lambda l: l.contains("#"))
    stripped = F.transform(cand, py_strip)
    frames = F.filter(stripped, lambda l: l.rlike(jre(R.FRAME_LINE)))
    return F.when(raw.isNull() | raw.contains("#"), F.slice(frames, 1, R.MAX_FRAMES)).otherwise(F.array().cast("array<string>"))


def has_result(raw: Column) -> Column:
    """Whether `parse_log` gives a result; the text is only cut into lines if it says that there is no stack."""
    nothing = raw.contains(R.NO_STACK_MARKER) & ~raw.contains(R.REPORT_MARKERS[0]) & ~raw.contains(R.REPORT_MARKERS[1])
    return raw.isNotNull() & ~F.coalesce(nothing & (F.size(log_frames(raw)) == 0), F.lit(False))


def signal_name(raw: Column) -> Column:
    return F.when(raw.contains("Program received signal SIG"), extract(raw, jre(R.SIGNAL_NAME)))


def parse_log(raw: Column) -> Column:
    """STRUCT dbg, or NULL when the log shows no stack and no sanitizer report.

    A regex runs only on texts that hold a word each of its matches holds.
    """
    frames = log_frames(raw)
    no_result = (raw.contains(R.NO_STACK_MARKER) & ~raw.contains(R.REPORT_MARKERS[0]) & ~raw.contains(R.REPORT_MARKERS[1])
                 & (F.size(frames) == 0))
    insn = once(F.regexp_extract(raw, jre(R.FAULTING_INSN), 1), lambda x: F.when(x != "", py_strip(x)))
    low = F.lower(raw)
    pc = low.contains("rip") | low.contains("eip") | low.contains("pc")
    dbg = F.struct(
        signal_name(raw).alias("signal_name"),
        frames.alias("backtrace"),
        F.when(raw.contains("=>"), insn).alias("faulting_instruction"),
        F.when(low.contains("si_addr"), hex_to_decimal(extract(raw, jre(R.SI_ADDR, i=True)))).alias("faulting_address"),
        F.when(pc, hex_to_decimal(extract(raw, jre(R.PC_REGISTER, i=True)))).alias("pc"),
        raw.alias("raw"),
    )
    return F.when(raw.isNull() | no_result, F.lit(None)).otherwise(dbg)


def replay_text(stdout: Column, stderr: Column) -> Column:
    """The text a replay yields: stdout, a newline, stderr."""
    return F.concat(F.coalesce(stdout, F.lit("")), F.lit("\n"), F.coalesce(stderr, F.lit("")))


def is_load_error(text: Column) -> Column:
    return text.rlike(jre(R.LOAD_ERROR))
