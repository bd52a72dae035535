"""One Spark query per operator of the inventory, over the test tables.

Every query reads the parquet tables of `sf` (through the fixture views) in
full; outputs are flat columns (arrays joined with '|') so they compare
column-for-column with the DuckDB oracle in `plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlake import rules as R
from crashlake.functions import cwe as D
from crashlake.functions import evidence as A
from crashlake.functions import frames as B
from crashlake.functions import taxonomy as T
from crashlake.functions import verdict as V
from crashlake.operators import classify as K
from crashlake.operators import dedup as C
from crashlake.operators import lookup as E
from crashlake.operators import rank as FR
from crashlake.functions.patterns import jre
from crashlake.operators import rollup as G
from crashlake.plans import triage as P
from crashlake.session import hold, release
from crashlake.sources import fixtures as X
from crashlake.sources import ingest as I
from crashlake.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _join(c: Column) -> Column:
    return F.array_join(c, "|")


def _s(c: Column) -> Column:
    """DECIMAL/number as text (exact, engine independent)."""
    return c.cast("string")


# --- A. sources -----------------------------------------------------------

def scan_crash_files(spark, sf):
    files = X.view(spark, sf, "v_files").withColumn("size", F.col("size").cast("bigint"))
    return I.crash_files(files, ["input_sha1"]).drop("ord")


def instance_from_path(spark, sf):
    raw = P.raw_crashes(spark, sf)
    single = F.concat(F.lit("/runs/"), F.col("fuzzer_instance"), F.lit("/crashes/"), F.col("name"))
    return raw.select("ord", I.instance_from_path(F.col("path")).alias("instance_multi"),
                      I.instance_from_path(single).alias("instance_single"))


def input_sha1(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha1(F.col("text").cast("binary")).alias("input_sha1"),
                    F.octet_length("text").cast("bigint").alias("size"))


def signal_from_name(spark, sf):
    return P.raw_crashes(spark, sf).select("ord", "name", "signal")


def _stats(spark, sf):
    return I.parse_fuzzer_stats(X.view(spark, sf, "v_stats_text"))


def scan_fuzzer_stats(spark, sf):
    return _stats(spark, sf).select(
        "fuzzer_instance", "command_line", "start_time_epoch", "last_update_epoch", "execs_done",
        "execs_per_sec", "paths_total", "unique_crashes", "unique_hangs", "afl_version",
        F.size("raw").cast("bigint").alias("n_keys"))


def stats_target_binary(spark, sf):
    return _stats(spark, sf).select("fuzzer_instance", "target_binary")


def scan_plot_data(spark, sf):
    return I.parse_plot_lines(X.view(spark, sf, "v_plot_text"))


def parse_replay_log(spark, sf):
    lc = P.log_crashes(spark, sf)
    d = F.col("dbg")
    return lc.select("ord", d.isNotNull().alias("has_result"), d["signal_name"].alias("signal_name"),
                     F.size(d["backtrace"]).cast("bigint").alias("n_frames"), _join(d["backtrace"]).alias("backtrace"),
                     d["faulting_instruction"].alias("faulting_instruction"),
                     _s(d["faulting_address"]).alias("faulting_address"), _s(d["pc"]).alias("pc"))


def reject_loader_errors(spark, sf):
    return I.first_usable(X.view(spark, sf, "v_replay"), {}).select("ord", "attempt")


# --- B. frame / text functions --------------------------------------------

def _bt(spark, sf):
    return P.log_crashes(spark, sf).select("ord", "raw", F.coalesce(F.col("dbg.backtrace"),
                                                                    F.array().cast("array<string>")).alias("bt"))


def _frames(spark, sf):
    return (_bt(spark, sf).select("ord", F.posexplode("bt").alias("pos", "frame"))
            .withColumn("pos", F.col("pos").cast("bigint")))


def noise_frames(spark, sf):
    b = _bt(spark, sf)
    m = B.meaningful_frames(F.col("bt"))
    return b.select("ord", _join(m).alias("meaningful"), F.size(m).cast("bigint").alias("n_meaningful"))


def normalize_frame(spark, sf):
    return _frames(spark, sf).select("ord", "pos", "frame", B.normalize_frame(F.col("frame")).alias("normalized"))


def stack_hash(spark, sf):
    return _bt(spark, sf).select("ord", B.stack_hash(F.col("bt")).alias("stack_hash"))


def frame_function(spark, sf):
    f = F.col("frame")
    return _frames(spark, sf).select("ord", "pos", B.engine_function(f).alias("fn_engine"),
                                     B.taxonomy_function(f).alias("fn_taxonomy"),
                                     B.recommend_function(f).alias("fn_recommend"))


def first_user_frame(spark, sf):
    u = B.first_user_frame(F.col("bt"))
    return _bt(spark, sf).select("ord", u["func"].alias("user_func"), u["loc"].alias("user_loc"))


def first_sanitizer_loc(spark, sf):
    s = B.first_sanitizer_loc(F.col("raw"))
    return _bt(spark, sf).select("ord", s["func"].alias("san_func"), s["loc"].alias("san_loc"))


def _facts_located(spark, sf):
    lc = P.log_crashes(spark, sf).select("ord", "signal", "dbg")
    release(spark)
    df = E.resolve_addresses(hold(K.facts(lc)), "ord", P.symbols(spark, sf))
    return K.locate(df, True)


def crash_site_location(spark, sf):
    return _facts_located(spark, sf).select("ord", "crash_function", "crash_location")


def oob_direction(spark, sf):
    v = X.view(spark, sf, "v_oob_lines")
    is_oob = F.col("raw").rlike(jre(R.OOB_UBSAN, i=True))
    return v.select("ord", E.oob_direction(is_oob, F.col("source_line")).alias("direction"))


def log_tail(spark, sf):
    d = table(spark, sf, "documents")
    t = B.log_tail(F.col("text"))
    return d.select("doc_id", t.alias("tail"), F.length(t).cast("bigint").alias("tail_len"),
                    B.log_tail(F.col("text"), R.STDERR_TAIL_CHARS).alias("stderr_tail"))


# --- C. dedup -------------------------------------------------------------

def dedup_exact(spark, sf):
    raw = P.raw_crashes(spark, sf).select("input_sha1", "ord", "name", "fuzzer_instance", "signal",
                                          F.col("size").cast("bigint").alias("size"))
    return C.dedup_exact(raw)


def _triage(spark, sf):
    return P.triage(spark, sf)


def dedup_stack(spark, sf):
    t = _triage(spark, sf)
    return t.level_b.select("ord", "stack_hash", "top_cwe", "duplicate_count", "merged_issues", "untouched_b")


def dedup_location(spark, sf):
    t = _triage(spark, sf)
    return t.level_c.select("ord", "crash_location", "faulting_instruction", "top_cwe", "duplicate_count",
                            "merged_issues", "untouched_b", "untouched_c")


def dedup_cascade(spark, sf):
    t = _triage(spark, sf)
    return C.cascade_counts(t.raw, t.level_a, t.level_b, t.level_c)


def duplicate_members(spark, sf):
    t = _triage(spark, sf)
    return C.issue_members(t.raw, t.classified, t.level_b)


# --- D. classification ----------------------------------------------------

def _lc(spark, sf):
    lc = P.log_crashes(spark, sf)
    return lc.withColumn("signal_class", D.signal_class(F.col("signal")))


def signal_class(spark, sf):
    return P.raw_crashes(spark, sf).select("ord", "signal", D.signal_class(F.col("signal")).alias("signal_class"))


def signal_prior(spark, sf):
    return P.raw_crashes(spark, sf).select("ord", D.dist_text(D.signal_prior(F.col("signal"))).alias("prior"))


def overflow_header(spark, sf):
    h = D.overflow_header(F.col("raw"))
    return _lc(spark, sf).select("ord", h["cwe"].alias("header_cwe"), h["w"].alias("header_w"))


def sanitizer_rules(spark, sf):
    return _lc(spark, sf).select("ord", D.dist_text(D.sanitizer_evidence(F.col("raw"))).alias("sanitizer_dist"))


def sanitizer_region(spark, sf):
    return _lc(spark, sf).select("ord", D.sanitizer_region(F.col("raw")).alias("region"))


def debugger_heuristics(spark, sf):
    df = _lc(spark, sf).where(F.col("dbg").isNotNull())
    return df.select("ord", D.dist_text(D.debugger_heuristics(F.col("dbg"), F.col("signal_class"))).alias("hints"))


def ubsan_trap_lookup(spark, sf):
    t = D.ubsan_trap(F.col("dbg.faulting_instruction"))
    return _lc(spark, sf).select("ord", t["cwe"].alias("trap_cwe"), t["w"].alias("trap_w"))


def stack_exhaustion(spark, sf):
    df = _lc(spark, sf).where(F.col("dbg").isNotNull())
    return df.select("ord", D.stack_exhaustion(F.col("dbg")).alias("exhausted"))


def recursive_overflow(spark, sf):
    df = _lc(spark, sf).where(F.col("dbg").isNotNull())
    return df.select("ord", D.recursive_overflow(F.col("dbg")).alias("recursive"))


def _evidence(spark, sf):
    return K.facts(P.log_crashes(spark, sf).select("ord", "signal", "dbg"))


def merge_evidence(spark, sf):
    return _evidence(spark, sf).select("ord", D.dist_text(F.col("evidence_dist")).alias("merged"))


def apply_oob_direction(spark, sf):
    v = X.view(spark, sf, "v_oob_lines")
    is_oob = F.col("raw").rlike(jre(R.OOB_UBSAN, i=True))
    direction = E.oob_direction(is_oob, F.col("source_line"))
    dist = D.merge_evidence(D.signal_prior(F.lit(11)), D.sanitizer_evidence(F.col("raw")))
    return v.select("ord", direction.alias("direction"),
                    D.dist_text(D.apply_oob_direction(dist, direction)).alias("dist"))


def normalize_distribution(spark, sf):
    return _evidence(spark, sf).select("ord", D.dist_text(D.normalize(F.col("evidence_dist"))).alias("distribution"))


def cwe_long(spark, sf):
    df = _evidence(spark, sf).select("ord", F.posexplode(D.normalize(F.col("evidence_dist"))).alias("pos", "e"))
    return df.select("ord", "pos", F.col("e.cwe").alias("cwe"), F.col("e.w").alias("weight"))


def top_cwe(spark, sf):
    return _evidence(spark, sf).select("ord", D.top_cwe(D.normalize(F.col("evidence_dist"))).alias("top_cwe"))


def crash_site(spark, sf):
    df = _lc(spark, sf).where(F.col("dbg").isNotNull())
    return df.select("ord", T.crash_site(F.col("dbg.backtrace")).alias("crash_site_kind"))


def memory_region(spark, sf):
    df = _lc(spark, sf).where(F.col("dbg").isNotNull())
    return df.select("ord", T.memory_region(F.col("dbg.faulting_address"),
                                            D.sanitizer_region(F.col("dbg.raw"))).alias("memory_region"))


def control_flow(spark, sf):
    df = _lc(spark, sf).where(F.col("dbg").isNotNull())
    return df.select("ord", T.control_flow(F.col("dbg.pc"), F.col("dbg.backtrace")).alias("control_flow_state"))


def _tax_cols(t: Column) -> list[Column]:
    return [t["signal_class"].alias("signal_class"), t["crash_site_kind"].alias("crash_site_kind"),
            t["memory_region"].alias("memory_region"), t["control_flow_state"].alias("control_flow_state")]


def taxonomy(spark, sf):
    df = _lc(spark, sf)
    region = F.when(F.col("dbg").isNotNull(), D.sanitizer_region(F.col("dbg.raw")))
    return df.select("ord", *_tax_cols(T.taxonomy(F.col("signal_class"), F.col("dbg"), region)))


def _full_static_logs(spark, sf):
    """Log crashes classified without debug info (symbols/sources)."""
    return K.classify_full(P.log_crashes(spark, sf).select("ord", "signal", "dbg"), None)


def exploit_evidence(spark, sf):
    return _full_static_logs(spark, sf).where("has_log").select("ord", "tier0_verdict").withColumnRenamed("tier0_verdict", "tier0")


def exploit_score(spark, sf):
    df = _full_static_logs(spark, sf)
    dbg = F.when(F.col("has_log"), F.struct("backtrace", "faulting_instruction", "faulting_address", "pc"))
    return df.select("ord", V.score(F.col("top_cwe"), F.col("taxonomy"), dbg).alias("score"), "exploitability")


def _dist_out(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("ord", *extra, "top_cwe", D.dist_text(F.col("cwe_distribution")).alias("distribution"),
                     *_tax_cols(F.col("taxonomy")), "exploitability")


def classify_static(spark, sf):
    a = C.dedup_exact(P.raw_crashes(spark, sf).select("input_sha1", "ord", "signal"))
    return _dist_out(K.classify_static(a))


def classify_full(spark, sf):
    release(spark)
    lc = P.log_crashes(spark, sf).select("ord", "signal", "dbg")
    df = K.classify_full(lc, None, P.symbols(spark, sf), P.source_lines(spark, sf), P.SOURCE_ROOTS)
    return _dist_out(df, "crash_function", "crash_location", "oob_direction")


# --- E. joins ------------------------------------------------------------

def join_crash_log(spark, sf):
    a = C.dedup_exact(P.raw_crashes(spark, sf).select("input_sha1", "ord"))
    found = {"has_log": A.has_result(F.col("_text")), "signal_name": A.signal_name(F.col("_text"))}
    logs = I.first_usable(X.view(spark, sf, "v_replay"), found, only=a).where("has_log")
    j = E.join_crash_log(a, logs)
    return j.select("ord", "input_sha1", F.coalesce("has_log", F.lit(False)).alias("has_log"), "attempt", "signal_name")


def symbolize_pc(spark, sf):
    pcs = X.view(spark, sf, "v_pc")
    out = E.symbolize(pcs, "pc", P.symbols(spark, sf))
    return out.select("l_orderkey", "l_linenumber", "pc", F.col("sym_func").alias("func"), F.col("sym_loc").alias("loc"))


def enrich_frames(spark, sf):
    b = _bt(spark, sf).select("ord", F.col("bt").alias("backtrace"))
    return E.enrich_frames(b, "ord", P.symbols(spark, sf)).select("ord", _join(F.col("backtrace")).alias("backtrace"))


def source_snippet(spark, sf):
    locs = X.view(spark, sf, "v_loc")
    _, lines = E.source_snippets(locs, P.source_lines(spark, sf), [])
    return lines


def resolve_source_path(spark, sf):
    loc = X.view(spark, sf, "v_loc")
    rel = loc.select(F.concat(F.lit("lib/"), F.regexp_extract("crash_location", r"([^/]+)$", 1)).alias("crash_location"))
    locs = loc.select("crash_location").unionByName(rel)
    files = E.source_files(P.source_lines(spark, sf))
    return E.resolve_source(locs, files, ["/nowhere", "/src"]).select("crash_location", "file")


def _ranked(spark, sf):
    t = _triage(spark, sf)
    return P.ranked_issues(t)


def severity_dim(spark, sf):
    return _triage(spark, sf).issues.select("ord", "top_cwe", "signal_class", "severity_level")


def label_dims(spark, sf):
    t = _triage(spark, sf).issues
    t = t.select("ord", "top_cwe", "signal_class", "exploitability",
                 F.col("taxonomy.crash_site_kind").alias("crash_site_kind"),
                 F.col("taxonomy.memory_region").alias("memory_region"))
    return E.label_dims(t)


def unmatched_logs(spark, sf):
    a = C.dedup_exact(P.raw_crashes(spark, sf).select("input_sha1", "ord"))
    logs = I.first_usable(X.view(spark, sf, "v_replay"), {"has_log": A.has_result(F.col("_text"))}, only=a).where("has_log")
    return E.unmatched_logs(a, logs).select("ord", "input_sha1")


def reduction_ratio(spark, sf):
    m = X.view(spark, sf, "v_minimized")
    return E.reduction_ratio(m.select("ord", "size"), m.select("ord", "minimized_size")) \
        .select("ord", "size", "minimized_size", "reduction_ratio")


# --- F. ranking -----------------------------------------------------------

def prioritize(spark, sf):
    return _ranked(spark, sf).select("ord", "severity_level", "severity_rank", "duplicate_count", "issue_rank")


def issue_rank(spark, sf):
    return _ranked(spark, sf).select("issue_rank", "ord")


def section_rank(spark, sf):
    return FR.section_rank(_triage(spark, sf).issues, P.issue_order()).select("ord", "section", "section_rank", "opened")


def split_sections(spark, sf):
    return FR.split_sections(_triage(spark, sf).issues).select("ord", "section")


def recommendation(spark, sf):
    t = _triage(spark, sf).issues.where(F.col("top_cwe") == "unknown")
    return FR.recommendation(t).select("ord", "recommendation")


def concat_passthrough(spark, sf):
    return _triage(spark, sf).level_b.select("ord", "untouched_b")


# --- G. roll-ups ----------------------------------------------------------

def _ranked_flat(spark, sf):
    r = _ranked(spark, sf)
    return r.select("issue_rank", "signal_class", "severity_level", "exploitability",
                    F.col("taxonomy.crash_site_kind").alias("crash_site_kind"),
                    F.col("taxonomy.memory_region").alias("memory_region"))


def count_by_axis(spark, sf):
    return G.count_by_axis(_ranked_flat(spark, sf))


def severity_counts(spark, sf):
    return G.severity_counts(_triage(spark, sf).issues)


def report_totals(spark, sf):
    t = _triage(spark, sf)
    return G.report_totals(t.raw, t.issues)


def instance_stats(spark, sf):
    return G.instance_stats(_stats(spark, sf))


def _plot(spark, sf):
    return X.view(spark, sf, "v_plot")


def plot_extent(spark, sf):
    return G.plot_extent(_plot(spark, sf))


def plot_normalized(spark, sf):
    return G.plot_normalized(_plot(spark, sf))


def plot_downsample(spark, sf):
    return G.plot_downsample(_plot(spark, sf))


QUERIES: dict[str, Query] = {
    # A
    "scan_crash_files": scan_crash_files, "instance_from_path": instance_from_path, "input_sha1": input_sha1,
    "signal_from_name": signal_from_name, "scan_fuzzer_stats": scan_fuzzer_stats,
    "stats_target_binary": stats_target_binary, "scan_plot_data": scan_plot_data,
    "parse_replay_log": parse_replay_log, "reject_loader_errors": reject_loader_errors,
    # B
    "noise_frames": noise_frames, "normalize_frame": normalize_frame, "stack_hash": stack_hash,
    "frame_function": frame_function, "first_user_frame": first_user_frame,
    "first_sanitizer_loc": first_sanitizer_loc, "crash_site_location": crash_site_location,
    "oob_direction": oob_direction, "log_tail": log_tail,
    # C
    "dedup_exact": dedup_exact, "dedup_stack": dedup_stack, "dedup_location": dedup_location,
    "dedup_cascade": dedup_cascade, "duplicate_members": duplicate_members,
    # D
    "signal_class": signal_class, "signal_prior": signal_prior, "overflow_header": overflow_header,
    "sanitizer_rules": sanitizer_rules, "sanitizer_region": sanitizer_region,
    "debugger_heuristics": debugger_heuristics, "ubsan_trap_lookup": ubsan_trap_lookup,
    "stack_exhaustion": stack_exhaustion, "recursive_overflow": recursive_overflow,
    "merge_evidence": merge_evidence, "apply_oob_direction": apply_oob_direction,
    "normalize_distribution": normalize_distribution, "cwe_long": cwe_long, "top_cwe": top_cwe,
    "crash_site": crash_site, "memory_region": memory_region, "control_flow": control_flow,
    "taxonomy": taxonomy, "exploit_evidence": exploit_evidence, "exploit_score": exploit_score,
    "classify_static": classify_static, "classify_full": classify_full,
    # E
    "join_crash_log": join_crash_log, "symbolize_pc": symbolize_pc, "enrich_frames": enrich_frames,
    "source_snippet": source_snippet, "resolve_source_path": resolve_source_path,
    "severity_dim": severity_dim, "label_dims": label_dims, "unmatched_logs": unmatched_logs,
    "reduction_ratio": reduction_ratio,
    # F
    "prioritize": prioritize, "issue_rank": issue_rank, "section_rank": section_rank,
    "split_sections": split_sections, "recommendation": recommendation,
    "concat_passthrough": concat_passthrough,
    # G
    "count_by_axis": count_by_axis, "severity_counts": severity_counts, "report_totals": report_totals,
    "instance_stats": instance_stats, "plot_extent": plot_extent, "plot_normalized": plot_normalized,
    "plot_downsample": plot_downsample,
}

# SURVEY §2 row of every query
SURVEY_ROW: dict[str, str] = {
    "scan_crash_files": "A1",
    "instance_from_path": "A2",
    "input_sha1": "A3",
    "signal_from_name": "A4",
    "scan_fuzzer_stats": "A5",
    "stats_target_binary": "A6",
    "scan_plot_data": "A7",
    "parse_replay_log": "A8",
    "reject_loader_errors": "A9",
    "noise_frames": "B1",
    "normalize_frame": "B2",
    "stack_hash": "B3",
    "frame_function": "B4",
    "first_user_frame": "B5",
    "first_sanitizer_loc": "B6",
    "crash_site_location": "B7",
    "oob_direction": "B8",
    "log_tail": "B9",
    "dedup_exact": "C1",
    "dedup_stack": "C2",
    "dedup_location": "C3",
    "dedup_cascade": "C4",
    "duplicate_members": "C5",
    "signal_class": "D1",
    "signal_prior": "D2",
    "overflow_header": "D3",
    "sanitizer_rules": "D4",
    "sanitizer_region": "D5",
    "debugger_heuristics": "D6",
    "ubsan_trap_lookup": "D7",
    "stack_exhaustion": "D8",
    "recursive_overflow": "D9",
    "merge_evidence": "D10",
    "apply_oob_direction": "D11",
    "normalize_distribution": "D12",
    "cwe_long": "D13",
    "top_cwe": "D14",
    "crash_site": "D15",
    "memory_region": "D16",
    "control_flow": "D17",
    "taxonomy": "D18",
    "exploit_evidence": "D19",
    "exploit_score": "D20",
    "classify_static": "D21",
    "classify_full": "D22",
    "join_crash_log": "E1",
    "symbolize_pc": "E2",
    "enrich_frames": "E3",
    "source_snippet": "E4",
    "resolve_source_path": "E5",
    "severity_dim": "E6",
    "label_dims": "E7",
    "unmatched_logs": "E8",
    "reduction_ratio": "E9",
    "prioritize": "F1",
    "issue_rank": "F2",
    "section_rank": "F3",
    "split_sections": "F4",
    "recommendation": "F5",
    "concat_passthrough": "F6",
    "count_by_axis": "G1",
    "severity_counts": "G2",
    "report_totals": "G3",
    "instance_stats": "G4",
    "plot_extent": "G5",
    "plot_normalized": "G6",
    "plot_downsample": "G7",
}
