"""Four-axis behaviour taxonomy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crashlake import rules as R
from crashlake.functions import frames as B
from crashlake.functions.patterns import dec, once


def crash_site(bt: Column) -> Column:
    """Kind of the first meaningful frame."""
    cand = F.transform(bt, lambda f: F.struct(B.taxonomy_function(f).alias("func"), f.alias("frame")))
    keep = F.filter(cand, lambda c: c["func"].isNotNull()
                    & ~c["func"].isin(*R.SITE_NOISE_FUNCS)
                    & ~c["func"].startswith(R.SITE_NOISE_PREFIXES[0])
                    & ~c["func"].startswith(R.SITE_NOISE_PREFIXES[1]))
    return once(F.try_element_at(keep, F.lit(1)), _site_kind)


def _site_kind(first: Column) -> Column:
    fn, frame = first["func"], first["frame"]
    return (F.when(first.isNull(), "unknown")
             .when(fn.isin(*R.LIBC_ALLOC), "libc_alloc")
             .when(fn.isin(*R.LIBC_STRING), "libc_string")
             .when(fn.isin(*R.LIBC_IO), "libc_io")
             .when(fn.startswith("_dl_") | frame.contains("ld-linux"), "dynamic_linker")
             .when(fn.startswith("__") & fn.contains("syscall"), "kernel_syscall")
             .otherwise("user_code"))


def memory_region(addr: Column, fallback: Column) -> Column:
    """From the fault address, else the sanitizer's region."""
    return (F.when(addr.isNotNull() & (addr < dec(R.LOW_ADDRESS)), "null_page")
             .when(addr.isNotNull() & (addr >= dec(R.KERNEL_ADDRESS)), "kernel_space")
             .otherwise(F.coalesce(F.nullif(fallback, F.lit("")), F.lit("unknown"))))


def control_flow(pc: Column, bt: Column) -> Column:
    """D17."""
    return (F.when(pc.isNull(), "unknown")
             .when(pc < dec(R.LOW_ADDRESS), "ret_to_unmapped")
             .when(F.size(bt) > R.STACK_EXHAUSTION_FRAMES, "stack_exhaustion")
             .otherwise("normal"))


def taxonomy(sig_class: Column, dbg: Column, san_region: Column) -> Column:
    """STRUCT<signal_class, crash_site_kind, memory_region, control_flow_state>."""
    no_log = dbg.isNull()
    return F.struct(
        sig_class.alias("signal_class"),
        F.when(no_log, "unknown").otherwise(crash_site(dbg["backtrace"])).alias("crash_site_kind"),
        F.when(no_log, F.coalesce(F.nullif(san_region, F.lit("")), F.lit("unknown")))
         .otherwise(memory_region(dbg["faulting_address"], san_region)).alias("memory_region"),
        F.when(no_log, "unknown").otherwise(control_flow(dbg["pc"], dbg["backtrace"])).alias("control_flow_state"),
    )
