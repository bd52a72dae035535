"""Crash classification (D21 static, D22 full) as staged projections.

All regex work on the replay log happens in one narrow projection (`facts`)
right after the log is joined; the log text is then dropped, so the later
joins (symbols, sources) and every dedup shuffle move slim rows only.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashlake import rules as R
from crashlake.functions import cwe as D
from crashlake.functions import frames as B
from crashlake.functions import taxonomy as T
from crashlake.functions import verdict as V
from crashlake.functions.cache import per_context
from crashlake.functions.patterns import jre
from crashlake.operators import lookup as E
from crashlake.operators.sequence import left_join_nonnull
from crashlake.session import hold


@per_context
def _empty():
    return F.array().cast(D.DIST_TYPE)


def classify_static(issues: DataFrame) -> DataFrame:
    """The no-replay mode — signal prior only."""
    sig = F.col("signal")
    df = issues.withColumn("signal_class", D.signal_class(sig)) \
               .withColumn("cwe_distribution", D.normalize(D.signal_prior(sig)))
    df = df.withColumn("top_cwe", D.top_cwe(F.col("cwe_distribution")))
    dbg_null = F.lit(None).cast(
        "struct<signal_name:string,backtrace:array<string>,faulting_instruction:string,"
        "faulting_address:decimal(20,0),pc:decimal(20,0),raw:string>")
    tax = T.taxonomy(F.col("signal_class"), dbg_null, F.lit(None).cast("string"))
    df = df.withColumn("taxonomy", tax)
    return df.withColumn("exploitability", V.verdict(F.col("taxonomy"), dbg_null, F.col("top_cwe")))


@per_context
def _base_cols() -> list[Column]:
    dbg = F.col("dbg")
    return [
        dbg["raw"].alias("_raw"),
        F.lower(dbg["raw"]).alias("_low"),
        D.rule_markers(F.lower(dbg["raw"])).alias("_marks"),
        F.coalesce(dbg["backtrace"], F.array().cast("array<string>")).alias("backtrace"),
        dbg["faulting_instruction"].alias("faulting_instruction"),
        dbg["faulting_address"].alias("faulting_address"),
        dbg["pc"].alias("pc"),
        dbg.isNotNull().alias("has_log"),
    ]


@per_context
def _fact_cols() -> list[Column]:
    raw, has = F.col("_raw"), F.col("has_log")
    so_pat = jre(R.STACK_OVERFLOW, i=True)
    dbg_cols = F.struct(F.col("backtrace").alias("backtrace"), F.col("faulting_instruction").alias("faulting_instruction"))
    double_free, corrupt = D.glibc_messages(raw)
    held = lambda *words: functools.reduce(operator.or_, (F.col("_low").contains(w) for w in words))
    return [
        F.when(has & (raw != "") & (F.size("_marks") > 0), D.compact([D.overflow_header(raw, F.col("_marks")),
                                             *D.sanitizer_rule_hits(raw, F.col("_marks"))]))
         .otherwise(_empty()).alias("_san_items"),
        D.frame_functions(F.col("backtrace")).alias("_funcs"),
        (has & D.stack_exhaustion(dbg_cols)).alias("_exh"),
        (has & F.coalesce(held("sanitizer:") & raw.rlike(so_pat), F.lit(False))).alias("_so"),
        F.when(has, D.sanitizer_region(raw)).alias("sanitizer_region"),
        F.coalesce(held("out of bounds for type") & raw.rlike(jre(R.OOB_UBSAN, i=True)), F.lit(False)).alias("oob_report"),
        B.first_sanitizer_loc(raw).alias("san_loc"),
        F.when(has, B.log_tail(raw)).otherwise(F.lit("")).alias("evidence"),
        F.struct(
            (held("allocation") & raw.rlike(jre(R.ALLOC_TOO_BIG, i=True))).alias("alloc_too_big"),
            (held("overflow") & raw.rlike(jre(R.STACK_BUF_READ, i=True, s=True))).alias("stack_buf_read"),
            (held("runtime error:") & raw.rlike(jre(R.UBSAN_TEXT, i=True))).alias("ubsan_text"),
            (held("write") & raw.rlike(jre(R.SAN_WRITE, i=True, m=True))).alias("san_write"),
            (held("read") & raw.rlike(jre(R.SAN_READ, i=True, m=True))).alias("san_read"),
        ).alias("tier0"),
        (held("double free", "invalid") & double_free).alias("_double_free"),
        (held("corrupted", "invalid", "malloc_consolidate") & corrupt).alias("_corrupt"),
    ]


@per_context
def _heur_col() -> Column:
    has = F.col("has_log")
    heur = D.compact(D.heuristic_items(F.col("faulting_address"), F.col("pc"), F.col("_double_free"), F.col("_corrupt"),
                                       F.col("faulting_instruction"), F.col("signal_class"), F.col("_funcs")))
    return F.when(has & (F.size("_san_items") == 0) & ~F.col("_exh"), heur).otherwise(_empty()).alias("_heur_items")


@per_context
def _all_col() -> Column:
    return F.concat(D.signal_prior(F.col("signal")), F.col("_san_items"), F.col("_heur_items")).alias("_all")


@per_context
def _evidence_col() -> Column:
    return F.when(F.col("_so") | F.col("_exh"), _empty()).otherwise(D.max_merge(F.col("_all"))).alias("evidence_dist")


def log_facts(df: DataFrame) -> DataFrame:
    """Everything that needs the log text (`dbg`), computed once per log; the text is dropped after."""
    base = [c for c in df.columns if c != "dbg"]
    df = df.select(*base, *_base_cols())
    return df.select("*", *_fact_cols()).drop("_raw", "_low", "_marks")


def crash_facts(df: DataFrame) -> DataFrame:
    """Evidence of crashes joined to their log's facts; a crash without a log has NULL facts.

    Staged projections keep every expression at one evaluation per row: evidence
    item arrays are materialized before the per-CWE merge walks them.
    """
    none = {"backtrace": F.array().cast("array<string>"), "has_log": F.lit(False), "_san_items": _empty(),
            "_funcs": F.array().cast("array<string>"), "_exh": F.lit(False), "_so": F.lit(False),
            "oob_report": F.lit(False), "evidence": F.lit("")}
    df = df.withColumns({c: F.coalesce(F.col(c), v) for c, v in none.items()})
    df = df.select("*", D.signal_class(F.col("signal")).alias("signal_class"))
    df = df.select("*", _heur_col())
    df = df.select("*", _all_col())
    df = df.select("*", _evidence_col())
    return df.drop("_san_items", "_heur_items", "_all", "_funcs", "_exh", "_so", "_double_free", "_corrupt")


def facts(df: DataFrame) -> DataFrame:
    """`log_facts` and `crash_facts` of crashes that carry their log (`signal`, `dbg`)."""
    return crash_facts(log_facts(df))


@per_context
def _locate_cols(with_symbols: bool) -> list[Column]:
    if with_symbols:
        sym_func, sym_loc = F.col("pcsym_func"), F.col("pcsym_loc")
    else:
        sym_func = sym_loc = F.lit(None).cast("string")
    uf = F.col("_user")
    need = sym_loc.isNull() | sym_func.isNull() | (sym_loc == "") | (sym_func == "")
    func = F.when(need, F.coalesce(F.nullif(sym_func, F.lit("")), uf["func"])).otherwise(sym_func)
    loc = F.when(need, F.coalesce(F.nullif(sym_loc, F.lit("")), uf["loc"])).otherwise(sym_loc)
    return [func.alias("_func"), loc.alias("_loc")]


@per_context
def _location_cols() -> list[Column]:
    absolute = F.coalesce(F.col("_loc").startswith("/"), F.lit(False))
    san = F.col("san_loc")
    return [
        F.when(~absolute & san["loc"].isNotNull(), san["loc"]).otherwise(F.col("_loc")).alias("crash_location"),
        F.when(~absolute & san["func"].isNotNull() & (F.col("_func").isNull() | (F.col("_func") == "")), san["func"])
         .otherwise(F.col("_func")).alias("crash_function"),
    ]


def locate(df: DataFrame, with_symbols: bool = False) -> DataFrame:
    """Crash function/location by priority symbol (of `lookup.resolve_addresses`) -> user frame -> sanitizer frame."""
    df = df.select("*", B.first_user_frame(F.col("backtrace")).alias("_user"))
    df = df.select("*", *_locate_cols(with_symbols))
    df = df.select("*", *_location_cols())
    drop = ["_func", "_loc", "_user", "san_loc"] + (["pcsym_func", "pcsym_loc"] if with_symbols else [])
    return df.drop(*drop)


@per_context
def _direction_col(with_text: bool) -> Column:
    if with_text:
        return E.oob_direction(F.col("oob_report"), F.col("crash_line_text")).alias("oob_direction")
    return F.lit(None).cast("string").alias("oob_direction")


@per_context
def _dist_cols() -> list[Column]:
    adj = D.apply_oob_direction(F.col("evidence_dist"), F.col("oob_direction"))
    return [adj.alias("_adj")]


@per_context
def _norm_cols() -> list[Column]:
    return [D.normalize(F.col("_adj"), D.weight_total(F.col("_adj"))).alias("cwe_distribution")]


@per_context
def _axis_cols() -> list[Column]:
    has = F.col("has_log")
    raw_bt = F.col("log_backtrace")
    return [
        F.when(has, T.crash_site(raw_bt)).otherwise("unknown").alias("_site"),
        F.when(has, T.memory_region(F.col("faulting_address"), F.col("sanitizer_region")))
         .otherwise(F.coalesce(F.col("sanitizer_region"), F.lit("unknown"))).alias("_region"),
        F.when(has, T.control_flow(F.col("pc"), raw_bt)).otherwise("unknown").alias("_flow"),
    ]


@per_context
def _taxonomy_col() -> Column:
    return F.struct("signal_class", F.col("_site").alias("crash_site_kind"), F.col("_region").alias("memory_region"),
                    F.col("_flow").alias("control_flow_state")).alias("taxonomy")


@per_context
def _tier0_col() -> Column:
    t0, top = F.col("tier0"), F.col("top_cwe")
    return (F.when(~F.col("has_log"), F.lit(None).cast("string"))
             .when(t0["alloc_too_big"] | t0["stack_buf_read"]
                   | (t0["ubsan_text"] & ~top.isin(*R.WRITE_PRIMITIVE_CWES)), "NOT_EXPLOITABLE")
             .when(t0["san_write"], "EXPLOITABLE")
             .when(t0["san_read"], "NOT_EXPLOITABLE")).alias("tier0_verdict")


@per_context
def _exploit_col() -> Column:
    dbg_like = F.when(F.col("has_log"), F.struct(
        F.col("backtrace").alias("backtrace"), F.col("faulting_instruction").alias("faulting_instruction"),
        F.col("faulting_address").alias("faulting_address"), F.col("pc").alias("pc")))
    sc = V.score(F.col("top_cwe"), F.col("taxonomy"), dbg_like)
    by_score = (F.when(sc >= R.EXPLOITABLE_MIN_SCORE, "EXPLOITABLE")
                 .when(sc >= R.NOT_EXPLOITABLE_MIN_SCORE, "NOT_EXPLOITABLE").otherwise("UNKNOWN"))
    return F.coalesce(F.col("tier0_verdict"), by_score).alias("exploitability")


@per_context
def _top_col() -> Column:
    return D.top_cwe(F.col("cwe_distribution")).alias("top_cwe")


def finish(df: DataFrame, crash_text: DataFrame | None = None) -> DataFrame:
    """D11, D12, D14, D18, D19/D20 on the slim rows."""
    if crash_text is not None:
        df = left_join_nonnull(df, crash_text, ["crash_location"])
    else:
        df = df.select("*", F.lit(None).cast("string").alias("snippet_file"),
                       F.lit(None).cast("long").alias("crash_line"),
                       F.lit(None).cast("string").alias("crash_line_text"))
    df = df.select("*", _direction_col(crash_text is not None))
    df = df.select("*", *_dist_cols())
    df = df.select("*", *_norm_cols()).drop("_adj")
    # the axes as columns of their own, so the struct only gathers them
    df = df.select("*", _top_col(), *_axis_cols())
    df = df.select("*", _taxonomy_col()).drop("_site", "_region", "_flow")
    df = df.select("*", _tier0_col())
    df = df.select("*", _exploit_col())
    return df.drop("tier0", "evidence_dist")


def classify_full(issues: DataFrame, logs: DataFrame | None, symbols: DataFrame | None = None,
                  source_lines: DataFrame | None = None, roots: list[str] | None = None,
                  key: str = "ord", materialize: bool = True) -> DataFrame:
    """Replay-log classification; `logs` holds (key, dbg) with dbg from A8/A9.

    `symbols` (lo, hi, func, loc) stands in for the debug info of the target
    (frames and pc are symbolized when given); `source_lines` (file, line, text)
    stands in for the source tree searched under `roots`.

    `logs` may also hold the facts (`log_facts`), so that no log text meets in
    the join.  The slim facts table and the located table each feed several
    branches of the plan (frame lookups, snippet lookup, the final join), so
    they are held (`session.hold`) when a query first computes them.
    """
    df = E.join_crash_log(issues, logs, key) if logs is not None else issues
    df = crash_facts(df) if "dbg" not in df.columns else facts(df)
    df = df.withColumn("log_backtrace", F.col("backtrace"))
    if symbols is not None:
        df = E.resolve_addresses(hold(df) if materialize else df, key, symbols)
    df = locate(df, symbols is not None)
    crash_text = None
    if source_lines is not None:
        df = hold(df) if materialize else df
        crash_text, _ = E.source_snippets(df, source_lines, roots or [])
    return finish(df, crash_text)
