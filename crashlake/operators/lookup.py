"""Lookups the triage does per crash, re-aimed as set joins.

Addresses are looked up in disjoint segments: overlapping symbol ranges are cut
at their bounds and each piece is given to the narrowest range over it, so an
address has one segment.  Segments and addresses meet in pieces of the address
space (between sampled segment starts) by an equi-join, so Spark splits a hot
piece like any skewed join.  Line windows (source snippets) are exploded into
their 7 line numbers and joined exactly on (file, line), so a hot file never
fans out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from crashlake import rules as R
from crashlake.functions.patterns import hex_to_decimal, jre
from crashlake.operators.sequence import in_pieces, split_points

#: Pieces of the address space; one has a few segments of a usual symbol table.
SYMBOL_PIECES = 1 << 14
_BIAS = "9223372036854775808"
_TOP = "18446744073709551615"


def join_crash_log(issues: DataFrame, logs: DataFrame, key: str = "ord") -> DataFrame:
    """Each issue with its replay result (NULL when there is none)."""
    return issues.join(logs, on=key, how="left")


def unmatched_logs(issues: DataFrame, usable_logs: DataFrame, key: str = "ord") -> DataFrame:
    """Issues without a usable replay result (classified statically)."""
    return issues.join(usable_logs.select(key), on=key, how="left_anti")


def _signed(address: Column) -> Column:
    """Unsigned 64-bit address as BIGINT, order kept; NULL beyond 64 bits."""
    a = address.cast("decimal(20,0)")
    bias, top = (F.lit(x).cast("decimal(20,0)") for x in (_BIAS, _TOP))
    return F.when((a >= 0) & (a <= top), (a - bias).cast("bigint"))


def _shifted(c: Column, k: Column) -> Column:
    return F.call_function("shiftright", c, k)


def symbol_segments(symbols: DataFrame) -> tuple[DataFrame, Column]:
    """Disjoint address segments of `symbols(lo, hi, func, loc)`, and the split points that cut them into pieces.

    Segments: `_at` (piece), `_from`, `_until` (exclusive; NULL for the last of
    a piece), func and loc of the narrowest range over it (NULLs where none is).

    The bounds of all ranges cut the address space; which ranges hold a cut is
    asked per width class: a range of 2^k to 2^(k+1) addresses is entered in the
    few bins of 2^k addresses that it touches, however wide it is, and a cut is
    looked up in one bin of every class there is.  So a corrupt bound costs a
    few rows.  Ranges of equal bounds count as one, the first by name.
    """
    own = (symbols.select(_signed(F.col("lo")).alias("lo"), _signed(F.col("hi")).alias("hi"), "func", "loc")
           .where(F.col("lo") <= F.col("hi"))
           .groupBy("lo", "hi").agg(F.min(F.struct("func", "loc")).alias("_s")))
    width = F.col("hi").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)")
    kind = F.least(F.floor(F.log2(width.cast("double") + 1)), F.lit(62)).cast("int")
    own = own.withColumns({"_width": width, "_k": kind})
    bins = own.withColumn("_bin", F.explode(F.sequence(_shifted(F.col("lo"), F.col("_k")), _shifted(F.col("hi"), F.col("_k")))))
    after = F.when(F.col("hi") < (1 << 63) - 1, F.col("hi") + 1)
    cuts = own.select(F.explode(F.array("lo", after)).alias("_from")).where(F.col("_from").isNotNull()).distinct()
    kinds = own.agg(F.collect_set("_k").alias("_ks")).scalar()
    asked = cuts.withColumn("_ks", kinds).select("_from", F.explode("_ks").alias("_kind"))
    held = asked.join(bins, (F.col("_kind") == F.col("_k")) & (_shifted(F.col("_from"), F.col("_kind")) == F.col("_bin"))
                      & (F.col("lo") <= F.col("_from")) & (F.col("_from") <= F.col("hi")))
    owner = held.groupBy("_from").agg(F.min(F.struct("_width", "lo", "_s")).alias("_o")).select("_from", F.col("_o._s").alias("_s"))
    splits = split_points(cuts, "_from", SYMBOL_PIECES)
    placed = in_pieces(cuts.join(owner, "_from", "left"), "_from", splits, SYMBOL_PIECES, "_at")
    until = F.lead("_from").over(Window.partitionBy("_at").orderBy("_from"))
    return placed.select("_at", "_from", until.alias("_until"), "_s.func", "_s.loc"), splits


def _clean_symbol(func: Column, loc: Column) -> tuple[Column, Column]:
    f = F.when(func.isin(*R.SYMBOL_NO_FUNC), F.lit(None).cast("string")).otherwise(func)
    lc = F.when(loc.rlike(jre(R.SYMBOL_NOISE_LOC)), F.lit(None).cast("string")).otherwise(loc)
    libc = F.coalesce(lc.rlike(jre(R.LIBC_PATH)), F.lit(False))
    return (F.when(libc, F.lit(None).cast("string")).otherwise(f),
            F.when(libc, F.lit(None).cast("string")).otherwise(lc))


def symbolize(df: DataFrame, addr_col: str, symbols: DataFrame, prefix: str = "sym_") -> DataFrame:
    """Address -> (function, file:line) from a `symbols(lo, hi, func, loc)` table.

    Ranges may overlap (aliases, inlined functions): an address gets the
    narrowest range that holds it, so rows never multiply.  `df` is read once
    and not aggregated.  Unresolved addresses, '??' / 'optimized out' functions
    and '??:0' locations give NULLs; a location in libc clears both.  Rows
    without an address are dealt by their hash (no NULL-key hot partition).
    """
    segments, splits = symbol_segments(symbols)
    p = f"_{prefix}"
    placed = in_pieces(df.withColumn(f"{p}addr", _signed(F.col(addr_col))), f"{p}addr", splits, SYMBOL_PIECES, f"{p}piece")
    nowhere = -1 - F.pmod(F.xxhash64(*[f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]), F.lit(1 << 16)).cast("int")
    placed = placed.withColumn(f"{p}piece", F.when(F.col(f"{p}addr").isNull(), nowhere).otherwise(F.col(f"{p}piece")))
    own = segments.select(F.col("_at").alias(f"{p}at"), F.col("_from").alias(f"{p}from"), F.col("_until").alias(f"{p}until"),
                          F.col("func").alias(f"{p}func"), F.col("loc").alias(f"{p}loc"))
    inside = (F.col(f"{p}addr") >= F.col(f"{p}from")) & (F.col(f"{p}until").isNull() | (F.col(f"{p}addr") < F.col(f"{p}until")))
    func, loc = _clean_symbol(F.col(f"{p}func"), F.col(f"{p}loc"))
    return (placed.join(own, (F.col(f"{p}piece") == F.col(f"{p}at")) & inside, "left")
            .select(*df.columns, func.alias(f"{prefix}func"), loc.alias(f"{prefix}loc")))


def _frame_address(f: Column) -> Column:
    """Address of a frame that lacks a location."""
    return F.when(~f.contains(" at "), hex_to_decimal(F.nullif(F.regexp_extract(f, jre(R.FRAME_ADDR), 1), F.lit(""))))


def _with_symbols(df: DataFrame, key: str, symbols: DataFrame, bt_col: str, pc_col: str | None) -> DataFrame:
    """`df` with `_hits`: array position (0 the pc, then the frames from 1) -> (func, loc) of resolved addresses.

    One lookup for all addresses of a row: only (key, position, address) leave
    it, and only hits come back, grouped by key (a row has at most 21).
    """
    pc = F.lit(None).cast("decimal(20,0)") if pc_col is None else F.col(pc_col).cast("decimal(20,0)")
    every = F.concat(F.array(pc), F.transform(bt_col, _frame_address))
    asked = df.select(key, F.posexplode(every).alias("_pos", "_addr")).where(F.col("_addr").isNotNull())
    hits = (symbolize(asked, "_addr", symbols, prefix="_s").where(F.col("_sfunc").isNotNull() | F.col("_sloc").isNotNull())
            .groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_pos", F.struct("_sfunc", "_sloc")))).alias("_hits")))
    return df.join(hits, on=key, how="left")


def _located(f: Column, i: Column) -> Column:
    at = F.try_element_at(F.col("_hits"), i + 1)["_sloc"]
    return F.when(at.isNotNull(), F.concat(f, F.lit(" at "), at)).otherwise(f)


def enrich_frames(df: DataFrame, key: str, symbols: DataFrame, bt_col: str = "backtrace", out_col: str = "backtrace") -> DataFrame:
    """Append ' at file:line' to frames that have an address and no ' at '."""
    held = _with_symbols(df, key, symbols, bt_col, None)
    return held.withColumn(out_col, F.transform(bt_col, _located)).drop("_hits")


def resolve_addresses(df: DataFrame, key: str, symbols: DataFrame, prefix: str = "pcsym_") -> DataFrame:
    """E2 of `pc` and E3 of `backtrace` in one lookup; adds the pc's function and location."""
    held = _with_symbols(df, key, symbols, "backtrace", "pc")
    pc = F.try_element_at(F.col("_hits"), F.lit(0))
    return held.select("*", pc["_sfunc"].alias(f"{prefix}func"), pc["_sloc"].alias(f"{prefix}loc")) \
               .withColumn("backtrace", F.transform("backtrace", _located)).drop("_hits")


def source_files(source_lines: DataFrame) -> DataFrame:
    """Line count of each source file."""
    return source_lines.groupBy("file").agg(F.max("line").alias("n_lines"))


def _basename(p: Column) -> Column:
    return F.regexp_extract(p, r"([^/]*)$", 1)


def _join_path(root: str, p: Column) -> Column:
    if root == "":
        return p
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))


def resolve_source(locs: DataFrame, files: DataFrame, roots: list[str]) -> DataFrame:
    """E5: (crash_location) -> resolved file, by candidate priority.

    Candidates: the path itself when absolute, then for every root the path
    under the root and the base name under the root.
    """
    p = F.regexp_extract("crash_location", jre(R.SNIPPET_LOC), 1)
    cands = [F.struct(F.lit(0).alias("rank"), F.when(p.startswith("/"), p).alias("cand"))]
    for i, root in enumerate(roots or [""]):
        cands.append(F.struct(F.lit(2 * i + 1).alias("rank"), _join_path(root, p).alias("cand")))
        cands.append(F.struct(F.lit(2 * i + 2).alias("rank"), _join_path(root, _basename(p)).alias("cand")))
    c = (locs.where(F.col("crash_location").rlike(jre(R.SNIPPET_LOC)))
         .select("crash_location", F.explode(F.array(*cands)).alias("_c"))
         .select("crash_location", "_c.rank", F.col("_c.cand").alias("file"))
         .where(F.col("file").isNotNull() & (F.col("file") != "")))
    hit = c.join(files, on="file", how="inner")
    return (hit.groupBy("crash_location")
            .agg(F.min_by(F.struct("file", "n_lines"), F.col("rank")).alias("_r"))
            .select("crash_location", "_r.*"))


def source_snippets(df: DataFrame, source_lines: DataFrame, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """±3 lines around each distinct crash location.

    Returns (per-location: file, crash_line, crash_line_text; long-form
    snippet lines).  Work is per distinct location, not per crash.
    """
    locs = df.select("crash_location").where(F.col("crash_location").isNotNull()).distinct()
    files = source_files(source_lines)
    res = resolve_source(locs, files, roots)
    line = F.regexp_extract("crash_location", jre(R.SNIPPET_LOC), 2).try_cast("long")
    ok = (res.withColumn("crash_line", line)
          .where((F.col("crash_line") >= 1) & (F.col("crash_line") <= F.col("n_lines"))))
    want = ok.select("crash_location", "file", "crash_line",
                     F.explode(F.sequence(F.greatest(F.col("crash_line") - R.SNIPPET_CONTEXT, F.lit(1)),
                                          F.least(F.col("crash_line") + R.SNIPPET_CONTEXT, F.col("n_lines"))))
                     .alias("line"))
    lines = want.join(source_lines.select("file", F.col("line").cast("long").alias("line"), "text"),
                      on=["file", "line"], how="left")
    crash_text = (lines.where(F.col("line") == F.col("crash_line"))
                  .select("crash_location", F.col("file").alias("snippet_file"), "crash_line",
                          F.coalesce(F.col("text"), F.lit("")).alias("crash_line_text")))
    return crash_text, lines.select("crash_location", F.col("file").alias("snippet_file"), "crash_line",
                                    "line", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def oob_direction(raw_is_oob: Column, source_line: Column) -> Column:
    """B8: 'write' / 'read' / NULL from the text after the first ']' of the crash line."""
    idx = F.instr(source_line, "]")
    after = F.regexp_replace(F.substr(source_line, idx + 1), r"(?U)^[\s\x1c-\x1f]+", "")
    write = after.rlike(r"^[+\-*/%&|^]=") | (after.startswith("=") & ~after.startswith("=="))
    return (F.when(~raw_is_oob | source_line.isNull() | (idx == 0), F.lit(None).cast("string"))
             .when(after == "", "read")
             .when(write, "write")
             .otherwise("read"))


def severity(top_cwe: Column, sig_class: Column) -> Column:
    """CWE level (default MEDIUM), else the signal-class level (default LOW)."""
    cwe_map = F.create_map(*[F.lit(x) for kv in R.CWE_SEVERITY.items() for x in kv])
    err_map = F.create_map(*[F.lit(x) for kv in R.ERROR_SEVERITY.items() for x in kv])
    return F.when(top_cwe != "unknown", F.coalesce(F.try_element_at(cwe_map, top_cwe), F.lit(R.CWE_SEVERITY_DEFAULT))) \
            .otherwise(F.coalesce(F.try_element_at(err_map, sig_class), F.lit(R.ERROR_SEVERITY_DEFAULT)))


def severity_rank(level: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in R.SEVERITY_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(m, level), F.lit(0))


def _label(col: Column, table: dict) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, col), col)


def label_dims(df: DataFrame) -> DataFrame:
    """Display titles for the coded columns (dictionary lookups on literal maps)."""
    return df.select(
        "*",
        _label(F.col("top_cwe"), R.CWE_TITLES).alias("cwe_title"),
        _label(F.col("signal_class"), R.SIGNAL_CLASS_TITLES).alias("signal_title"),
        _label(F.col("signal_class"), R.SIGNAL_CLASS_CATEGORY).alias("signal_category"),
        _label(F.col("crash_site_kind"), R.CRASH_SITE_TITLES).alias("site_title"),
        _label(F.col("memory_region"), R.MEMORY_REGION_TITLES).alias("region_title"),
        _label(F.col("exploitability"), R.VERDICT_TITLES).alias("verdict_title"),
        F.when(F.col("top_cwe").startswith("CWE-"),
               F.concat(F.lit(R.CWE_LINK_PREFIX), F.substring_index(F.col("top_cwe"), "-", -1),
                        F.lit(R.CWE_LINK_SUFFIX))).alias("cwe_link"),
    )


def reduction_ratio(issues: DataFrame, minimized: DataFrame, key: str = "ord") -> DataFrame:
    """Raw size over minimized size (1 when the minimized input is empty)."""
    j = issues.join(minimized.select(key, "minimized_size"), on=key, how="left")
    return j.withColumn("reduction_ratio", F.when(F.col("minimized_size").isNull(), F.lit(None).cast("double"))
                        .when(F.col("minimized_size") > 0, F.col("size") / F.col("minimized_size"))
                        .otherwise(F.lit(1.0)))
