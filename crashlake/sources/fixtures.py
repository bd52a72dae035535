"""Crash-shaped views derived from the TESTDATA tables.

The test tables hold no fuzzing output, so each view below derives it
deterministically.  The SQL text is shared by Spark and the DuckDB oracle
(`render(name, engine)`), so both engines see the same inputs.  The one view
that needs a running sum over the whole table (`v_plot`) is built in Spark
with the block-decomposed running count of `operators.sequence` instead of an
unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlake.sources.tables import register_tables

# ---------------------------------------------------------------------------
# FIXED VALUES — fixture view SQL ({LEN} = byte length function of the engine)
# ---------------------------------------------------------------------------
V_RAW = """
select concat('id_', lpad(cast(doc_id as string), 6, '0'),
         case when doc_id % 6 = 5 then '' else concat(',sig_', case doc_id % 6
           when 0 then '11' when 1 then '06' when 2 then '08' when 3 then '07' else '04' end) end,
         ',op_havoc') as name,
       source as fuzzer_instance, sha1(text) as input_sha1, {LEN}(text) as size, doc_id as ord
from documents
"""

# files of fuzzer output trees: crash inputs, notes beside them, queue entries and nested folders
V_FILES = """
select concat('/out/', coalesce(source, 'none'), case doc_id % 17 when 3 then '/queue/' when 4 then '/crashes/old/' else '/crashes/' end,
         case when doc_id % 13 = 5 then concat('README', cast(doc_id as string), '.txt')
              else concat('id_', lpad(cast(doc_id as string), 6, '0'), case when doc_id % 6 = 5 then '' else concat(',SIG:', cast(4 + doc_id % 8 as string)) end) end) as path,
       {LEN}(text) as size, sha1(text) as input_sha1
from documents
"""

_LOG_TEMPLATES = """
 (0, concat('==1==ERROR: AddressSanitizer: heap-buffer-overflow on address 0x60{h}', chr(10), 'WRITE of size 4 at 0x60{h}', chr(10), '    #0 0x4a{h} in parse_{f} /src/m{f}.c:{n}')),
 (1, concat('==1==ERROR: AddressSanitizer: heap-buffer-overflow on address 0x60{h}', chr(10), 'READ of size 1 at 0x60{h}', chr(10), '    #0 0x4a{h} in parse_{f} /src/m{f}.c:{n}')),
 (2, concat('==1==ERROR: AddressSanitizer: stack-buffer-overflow on address 0x7f{h}', chr(10), 'READ of size 8 at 0x7f{h}')),
 (3, concat('==1==ERROR: AddressSanitizer: global-buffer-overflow on address 0x55{h}', chr(10), 'WRITE of size 2')),
 (4, concat('==1==ERROR: AddressSanitizer: heap-use-after-free on address 0x60{h}', chr(10), '    #0 0x4a{h} in use_{f} /src/m{f}.c:{n}')),
 (5, '==1==ERROR: AddressSanitizer: attempting double-free on 0x60{h}'),
 (6, concat('==1==ERROR: SEGV on unknown address 0x000000000000', chr(10), 'The signal is caused by a READ memory access.')),
 (7, concat('==1==ERROR: SEGV on unknown address 0x7f{h}99', chr(10), 'The signal is caused by a WRITE memory access.', chr(10), '    #1 0x49 in free (/lib)')),
 (8, '/src/m{f}.c:{n}: runtime error: signed integer overflow: 1 + 2'),
 (9, '/src/m{f}.c:{n}:3: runtime error: index 9 out of bounds for type int'),
 (10, concat('Program received signal SIGILL', chr(10), '#0  0x55{h} in step_{f} (a=1) at m{f}.c:{n}', chr(10), 'rip            0x55{h}', chr(10), '=> 0x55{h}: ud1    0x3(%eax),%eax')),
 (11, concat('Program received signal SIGFPE', chr(10), '#0  0x55{h} in div_{f} (a=1) at m{f}.c:{n}', chr(10), 'rip            0x55{h}', chr(10), '=> 0x55{h}: idiv ecx')),
 (12, concat('free(): invalid pointer', chr(10), '#0  0x1 in __GI_raise (sig=6) at raise.c:1', chr(10), '#1  0x2 in free (p=0) at malloc.c:3', chr(10), '#2  0x55{h} in drop_{f} (p=0) at m{f}.c:{n}')),
 (13, concat('#0  0x55{h} in rec_{f} (a=1) at m.c:1', chr(10), '#1  0x55 in rec_{f} (a=1) at m.c:1', chr(10), '#2  0x55 in rec_{f} (a=1) at m.c:1', chr(10), '#3  0x55 in rec_{f} (a=1) at m.c:1', chr(10), '#4  0x55 in rec_{f} (a=1) at m.c:1')),
 (14, '==1==ERROR: AddressSanitizer: stack-overflow on address 0x7f{h}'),
 (15, concat('#0  0x55{h} in copy_{f} (a=1) at m{f}.c:{n}', chr(10), 'rip            0x41', chr(10), 'si_addr = 0x{h}', chr(10), '=> 0x55: mov    QWORD PTR [rax],rbx')),
 (16, concat('SI_ADDR=$1 = 0xffff800000000000', chr(10), 'si_addr = 0xffff800000000000', chr(10), '#0  0x55 in k_{f} (a=1) at m{f}.c:{n}')),
 (17, 'No stack.'),
 (18, 'error while loading shared libraries: libx.so')
"""

V_LOG = """
select event_id as ord,
       case k when 10 then 4 when 11 then 8 when 12 then 6 else 11 end as signal,
       replace(replace(replace(tpl, '{h}', lower(hex(event_id))),
         '{f}', cast(user_id % 7 as string)), '{n}', cast(10 + user_id % 40 as string)) as raw
from events join (values
""" + _LOG_TEMPLATES + """
) as t(k, tpl) on k = event_id % 19
"""

# Replay attempts: every crash has attempt 1 (its log as stdout, nothing on
# stderr); crashes whose first replay failed to load a library get a second
# attempt without sanitizer preload on even event ids.
V_REPLAY = """
select ord, 1 as attempt, raw as stdout, '' as stderr from v_log
union all
select ord, 2 as attempt,
       concat('Program received signal SIGSEGV', chr(10), '#0  0x55', lower(hex(ord)), ' in retry_', cast(ord % 5 as string),
              ' (a=1) at r.c:', cast(1 + ord % 30 as string), chr(10), 'rip            0x55', lower(hex(ord))) as stdout,
       '' as stderr
from v_log where ord % 19 = 18 and ord % 2 = 0
"""

V_PLOT_SQL = """
select concat('src', cast(user_id % 20 as string)) as fuzzer_instance, event_id as line_no,
       1700000000 + event_id * 60 as unix_time,
       cast(sum(case when event_type = 'error' then 1 else 0 end) over (order by event_id rows between unbounded preceding and current row) as bigint) as unique_crashes
from events
"""

V_STATS_TEXT = """
select concat('src', cast(s_suppkey as string)) as fuzzer_instance,
       concat('start_time        : ', cast(1700000000 + s_suppkey as string), chr(10), 'execs_done : ', cast(s_suppkey * 1000 as string), chr(10),
         'execs_done : ', cast(s_suppkey * 1001 as string), chr(10), 'execs_per_sec : ', case when s_suppkey % 5 = 0 then 'n/a' else '20.5' end, chr(10),
         'corpus_count : ', case when s_suppkey % 3 = 0 then '0' else '42' end, chr(10), 'paths_total : 7', chr(10),
         'command_line : afl-fuzz -i in -o out -- ./t', cast(s_suppkey as string), ' @@') as body
from supplier
"""

# plot_data text lines: a header, rows of 11 columns, and rejected lines
# (blank, too few columns, unparsable time) in a deterministic mix.
V_PLOT_TEXT = """
select concat('src', cast(user_id % 20 as string)) as fuzzer_instance, event_id as line_no,
       case when event_id % 97 = 0 then '# unix_time, cycles_done, cur_item, corpus_count, pending_total, pending_favs, map_size, saved_crashes, saved_hangs, max_depth, execs_per_sec'
            when event_id % 89 = 0 then ''
            when event_id % 83 = 0 then concat(cast(1700000000 + event_id * 60 as string), ', 0, 1')
            when event_id % 79 = 0 then concat('t', cast(event_id as string), ', 0, 0, 1, 1, 1, 10.00%, 3, 0, 1, 0.0')
            else concat(cast(1700000000 + event_id * 60 as string), ', ', cast(event_id % 4 as string), ', ', cast(user_id as string),
                        ', 42, 1, 1, 10.00%, ', case when event_id % 71 = 0 then '' else cast(user_id % 13 as string) end, ', 0, 1, 2048.5') end as line
from events
"""

V_SYMBOLS = """
select p_partkey * 256 as lo, p_partkey * 256 + 199 as hi, concat('fn_', cast(p_partkey as string)) as func,
       concat('/src/m', cast(p_size as string), '.c:', cast(1 + p_partkey % 97 as string)) as loc
from part
"""

V_PC = """
select l_orderkey, l_linenumber, l_partkey * 256 + l_orderkey % 256 as pc from lineitem
"""

V_LOC = """
select doc_id as ord, concat('/src/m', cast(doc_id as string), '.c:', cast(1 + doc_id % 9 as string)) as crash_location from documents
"""

V_MINIMIZED = """
select doc_id as ord, cast({LEN}(text) as bigint) as size, cast(floor({LEN}(text) / 3) as bigint) * (case when doc_id % 11 = 0 then 0 else 1 end) as minimized_size from documents
"""

V_SOURCE_LINES = {
    "spark": "select doc_id, concat('/src/m', cast(doc_id as string), '.c') as file, pos + 1 as line, col as text "
             "from documents lateral view posexplode(split(text, '\\n')) e as pos, col",
    "duckdb": "select doc_id, concat('/src/m', doc_id, '.c') as file, generate_subscripts(string_split(text, chr(10)), 1) as line, "
              "unnest(string_split(text, chr(10))) as text from documents",
}

# source lines with array subscripts, for the read/write direction check
V_OOB_LINES = """
select event_id as ord,
       case when event_id % 3 = 0 then 'SEGV on unknown address' else 'index 9 out of bounds for type int' end as raw,
       case event_type when 'click' then concat('  buf[', cast(user_id as string), '] = v;')
                       when 'view' then concat('  if (buf[', cast(user_id as string), '] == v) {')
                       when 'purchase' then concat('  buf[i] += ', cast(user_id as string), ';')
                       when 'signup' then concat('  return buf[', cast(user_id as string), ']')
                       else concat('  total ', cast(user_id as string)) end as source_line
from events
"""

_LEN = {"spark": "octet_length", "duckdb": "strlen"}

FIXTURE_SQL = {
    "v_raw": V_RAW,
    "v_files": V_FILES,
    "v_log": V_LOG,
    "v_replay": V_REPLAY,
    "v_plot": V_PLOT_SQL,
    "v_stats_text": V_STATS_TEXT,
    "v_plot_text": V_PLOT_TEXT,
    "v_symbols": V_SYMBOLS,
    "v_pc": V_PC,
    "v_loc": V_LOC,
    "v_minimized": V_MINIMIZED,
    "v_source_lines": V_SOURCE_LINES,
    "v_oob_lines": V_OOB_LINES,
}

# views that read other views must be created after them
_DEPENDENCIES = {"v_replay": ["v_log"]}


def render(name: str, engine: str) -> str:
    sql = FIXTURE_SQL[name]
    if isinstance(sql, dict):
        sql = sql[engine]
    return sql.replace("{LEN}", _LEN[engine])


_VIEWS: dict = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view as a Spark DataFrame over the parquet tables in `sf_dir` (lazy plan, memoized)."""
    from crashlake.functions.cache import context_key

    key = (context_key(spark.sparkContext), sf_dir, name)
    hit = _VIEWS.get(key)
    if hit is None or hit[0] is not spark:
        hit = (spark, _view(spark, sf_dir, name))
        _VIEWS[key] = hit
    return hit[1]


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register_tables(spark, sf_dir)
    if name == "v_plot":
        return plot_points(spark, sf_dir)
    for dep in _DEPENDENCIES.get(name, []):
        spark.sql(render(dep, "spark")).createOrReplaceTempView(dep)
    return spark.sql(render(name, "spark"))


def plot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`v_plot` with its running crash count computed block-wise (no global window)."""
    from crashlake.operators.sequence import running_sum

    register_tables(spark, sf_dir)
    ev = spark.table("events").select(
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("fuzzer_instance"),
        F.col("event_id").alias("line_no"),
        (F.lit(1700000000) + F.col("event_id") * 60).alias("unix_time"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_error"),
    )
    out = running_sum(ev, order_col="line_no", value_col="is_error", out_col="unique_crashes")
    return out.select("fuzzer_instance", "line_no", "unix_time",
                      F.col("unique_crashes").cast("bigint").alias("unique_crashes"))
