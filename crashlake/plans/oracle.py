"""DuckDB SQL for every query of the catalog (the correctness oracle).

The oracle is written relationally on purpose: evidence items are rows with
a sequence number, merged with GROUP BY (first position, maximal weight),
normalized with a window sum; dedup levels are GROUP BY + arg_min; ranks are
window functions.  It shares only the fixed rule values with the Spark side.
Each query is one statement: the fixture views it needs come first as CTEs.
"""

from __future__ import annotations

import re

from crashlake import rules as R
from crashlake.sources.fixtures import FIXTURE_SQL, render

WS = r"[ \t\n\r\x0b\x0c\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(p: str, i: bool = False, m: bool = False, s: bool = False) -> str:
    flags = ("i" if i else "") + ("m" if m else "") + ("s" if s else "")
    return q((f"(?{flags})" if flags else "") + p)


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def ext(x: str, p: str, g: int = 1, **fl) -> str:
    return f"nullif(regexp_extract({x}, {rx(p, **fl)}, {g}), '')"


def match(x: str, p: str, **fl) -> str:
    return f"regexp_matches({x}, {rx(p, **fl)})"


def inlist(x: str, items: list[str]) -> str:
    return f"{x} in ({', '.join(q(v) for v in items)})"


def prefix_any(x: str, items: list[str]) -> str:
    return "(" + " or ".join(f"starts_with({x}, {q(v)})" for v in items) + ")"


def hexnum(h: str) -> str:
    return f"try_cast({h} as ubigint)"


def views(*names: str) -> str:
    """`with` clause holding the fixture views (and their dependencies)."""
    order = [n for n in FIXTURE_SQL]
    need = set(names)
    if "v_replay" in need:
        need.add("v_log")
    parts = [f"{n} as ({render(n, 'duckdb')})" for n in order if n in need and n != "v_replay"]
    if "v_replay" in need:
        parts.append(f"v_replay as ({render('v_replay', 'duckdb')})")
    return ",\n".join(parts)


# ---------------------------------------------------------------------------
# Log parsing -> columns of a crash row
# ---------------------------------------------------------------------------

def parsed(src: str, raw: str = "raw", extra: str = "") -> str:
    """Rows of `src` with parsed debugger fields; `has` false for no result."""
    frames = (f"list_slice(list_filter(list_transform(string_split_regex({raw}, {q(LINE_BREAK)}), "
              f"lambda l: {strip('l')}), lambda l: regexp_matches(l, {q(R.FRAME_LINE)})), 1, {R.MAX_FRAMES})")
    insn = f"regexp_extract({raw}, {rx(R.FAULTING_INSN)}, 1)"
    return f"""select *, not ({raw} is null or (len(frames) = 0 and contains({raw}, {q(R.NO_STACK_MARKER)})
                and not contains({raw}, 'ERROR:') and not contains({raw}, 'SUMMARY:'))) as has
    from (select {extra} *, {frames} as frames,
             {ext(raw, R.SIGNAL_NAME)} as signal_name,
             case when {insn} <> '' then {strip(insn)} end as insn,
             {hexnum(ext(raw, R.SI_ADDR, i=True))} as addr,
             {hexnum(ext(raw, R.PC_REGISTER, i=True))} as pc
          from {src}) p"""


def signal_class_sql(sig: str) -> str:
    whens = " ".join(f"when {k} then {q(v)}" for k, v in R.SIGNAL_CLASS.items())
    return f"(case {sig} {whens} else {q(R.SIGNAL_CLASS_DEFAULT)} end)"


def prior_values() -> str:
    rows = []
    for sig, pairs in R.SIGNAL_PRIOR.items():
        key = -1 if sig is None else (-2 if sig == "other" else sig)
        for i, (c, w) in enumerate(pairs):
            rows.append(f"({key}, {i}, {q(c)}, cast({w} as double))")
    return "(values " + ", ".join(rows) + ") as pr(sig_key, seq, cwe, w)"


def sig_key(sig: str) -> str:
    ks = ", ".join(str(k) for k in R.SIGNAL_PRIOR if isinstance(k, int))
    return f"(case when {sig} is null then -1 when {sig} in ({ks}) then {sig} else -2 end)"


# ---------------------------------------------------------------------------
# Evidence items (D2–D7) as rows (ord, seq, cwe, w)
# ---------------------------------------------------------------------------

def header_item(src: str) -> str:
    kind = f"lower(regexp_extract(raw, {rx(R.OVERFLOW_HEADER, i=True)}, 1))"
    acc = f"upper(regexp_extract(raw, {rx(R.ACCESS_LINE, i=True, m=True)}, 1))"
    by_kind = (f"case {kind} when 'stack' then {q(R.OVERFLOW_WRITE_CWE['stack'])} "
               f"when 'heap' then {q(R.OVERFLOW_WRITE_CWE['heap'])} else {q(R.OVERFLOW_WRITE_CWE['global'])} end")
    return f"""select ord, 100 as seq,
        case when {acc} = 'WRITE' then {by_kind} when {acc} = 'READ' then {q(R.OVERFLOW_READ[0])} else {by_kind} end as cwe,
        cast(case when {acc} = 'WRITE' then {R.OVERFLOW_WRITE_WEIGHT} when {acc} = 'READ' then {R.OVERFLOW_READ[1]}
             else {R.OVERFLOW_NO_ACCESS_WEIGHT} end as double) as w
      from {src} where coalesce(raw, '') <> '' and {kind} <> ''"""


def rule_items(src: str) -> list[str]:
    out = []
    for i, (p, c, w, dotall) in enumerate(R.SANITIZER_RULES):
        out.append(f"select ord, {101 + i} as seq, {q(c)} as cwe, cast({w} as double) as w from {src} "
                   f"where coalesce(raw, '') <> '' and {match('raw', p, i=True, s=dotall)}")
    return out


def funcs_sql(frames: str, pattern: str) -> str:
    return (f"list_filter(list_transform({frames}, lambda f: regexp_extract(f, {rx(pattern)}, 1)), "
            f"lambda x: x <> '')")


def exhaustion_sql() -> str:
    funcs10 = funcs_sql(f"list_slice(frames, 1, {R.STACK_EXHAUSTION_SCAN})", R.ENGINE_FUNC)
    return (f"(len(frames) >= {R.STACK_EXHAUSTION_MIN_FRAMES} and ((len({funcs10}) >= {R.STACK_EXHAUSTION_MIN_FUNCS} "
            f"and len(list_distinct({funcs10})) <= {R.STACK_EXHAUSTION_MAX_DISTINCT}) or "
            f"(contains(lower(coalesce(insn, '')), 'call') and len(frames) >= {R.STACK_EXHAUSTION_CALL_FRAMES})))")


def recursive_sql() -> str:
    # RE2 has no look-ahead: the pattern before it, and the rest of the line that it looks at
    before, excluded = re.fullmatch(r"(.*)\(\?!\.\*(\w+)\)", R.STACK_OVERFLOW).groups()
    rest = f"regexp_extract(raw, {rx(before + '(.*)', i=True)}, 1)"
    hit = f"regexp_matches(raw, {rx(before, i=True)})"
    return f"(({hit} and not contains(lower({rest}), {q(excluded)})) or {exhaustion_sql()})"


def trap_values() -> str:
    return "(values " + ", ".join(f"({k}, {q(c)}, cast({w} as double))" for k, (c, w) in R.UBSAN_TRAP_HANDLERS.items()) + \
        ") as tr(hid, cwe, w)"


def heuristic_items(src: str) -> list[str]:
    low = R.LOW_ADDRESS
    insn_l = "lower(coalesce(insn, ''))"
    segv = "signal_class = 'ERROR_SEGFAULT'"
    has_insn = "coalesce(insn, '') <> ''"
    funcs = funcs_sql("frames", R.ENGINE_FUNC)
    alloc = "list_has_any(" + funcs + ", [" + ", ".join(q(x) for x in R.ALLOC_FUNCS) + "])"
    string = "list_has_any(" + funcs + ", [" + ", ".join(q(x) for x in R.STRING_FUNCS) + "])"
    wr = match("insn", R.WRITE_INSN, i=True)
    rd = match("insn", R.READ_INSN, i=True)
    conds = [
        (f"addr is not null and addr < {low}", "CWE-476", 0.75),
        (match(insn_l, R.DIV_INSN, i=True), "CWE-369", 0.8),
        (f"{segv} and {has_insn} and {wr}", "CWE-787", 0.6),
        (f"{segv} and {has_insn} and not {wr} and {rd}", "CWE-125", 0.6),
        ("signal_class = 'ERROR_FPE'", "CWE-369", 0.7),
        (alloc, "CWE-416", 0.5),
        (alloc, "CWE-787", 0.4),
        (string, "CWE-787", 0.6),
        (string, "CWE-125", 0.5),
        (match("raw", R.GLIBC_DOUBLE_FREE, i=True), "CWE-415", 0.85),
        (match("raw", R.GLIBC_HEAP_CORRUPT, i=True), "CWE-787", 0.7),
        (f"pc is not null and pc < {low}", "CWE-787", 0.6),
        (f"pc is not null and pc < {low}", "CWE-416", 0.5),
        (f"{match(insn_l, R.CALL_INSN, i=True)} and {segv}", "CWE-416", 0.5),
    ]
    out = [f"select ord, {200 + i} as seq, {q(c)} as cwe, cast({w} as double) as w from {src} where has and ({cond})"
           for i, (cond, c, w) in enumerate(conds)]
    g = f"regexp_extract(insn, {rx(R.UD_INSN, i=True)}, 1)"
    hid = f"case when {g} = '' then 0 when length(ltrim({g}, '0')) > 8 then -1 else cast({hexnum(chr(39) + '0x' + chr(39) + ' || ' + g)} as bigint) end"
    out.append(f"select ord, 214 as seq, tr.cwe, tr.w from {src} join {trap_values()} on tr.hid = ({hid}) "
               f"where has and signal_class = 'ERROR_ILL' and {has_insn} and {match('insn', R.UD_INSN, i=True)}")
    return out


def evidence_ctes(src: str, prior: bool = True) -> str:
    """CTEs `ev_items` (all items) and `ev_merged` (ord, cwe, pos, w) after D9's clear.

    `src` must provide ord, signal, raw, has, frames, insn, addr, pc, signal_class.
    """
    san = [header_item(f"{src} where has") .replace(f"from {src} where has where", f"from {src} where has and")]
    san += [x.replace(f"from {src} where", f"from {src} where has and") for x in rule_items(src)]
    pri = (f"select ord, seq, pr.cwe, pr.w from {src} join {prior_values()} on pr.sig_key = {sig_key('signal')}")
    heur = heuristic_items(src)
    return f"""san_items as ({' union all '.join(san)}),
heur_items as (select * from ({' union all '.join(heur)}) h
               where ord not in (select ord from san_items)
                 and ord not in (select ord from {src} where has and {exhaustion_sql()})),
ev_items as ({pri + ' union all ' if prior else ''}select * from san_items union all select * from heur_items),
ev_merged as (select ord, cwe, min(seq) as pos, max(w) as w from ev_items
              where ord not in (select ord from {src} where has and {recursive_sql()})
              group by ord, cwe)"""


def py_round3_sql(x: str) -> str:
    """Python round(x, 3) for a non-negative DOUBLE, exact on decimal ties (HUGEINT compare)."""
    k = f"cast(round({x} * 10000.0) as bigint)"
    tie = f"({k} % 10 = 5 and cast({k} as double) / 10000.0 = {x})"
    sh = f"(case when {x} >= {2.0 ** -9} then 62 else 70 end)"
    m = f"cast({x} * pow(2.0, {sh}) as hugeint)"
    scale = f"cast(pow(2.0, {sh}) as hugeint)"
    lhs, rhs = f"({m} * 10000)", f"(cast({k} as hugeint) * {scale})"
    return (f"(case when not {tie} then round_even({x}, 3) when {lhs} < {rhs} then cast({k} - 5 as double) / 10000.0 "
            f"when {lhs} > {rhs} then cast({k} + 5 as double) / 10000.0 else round_even({x}, 3) end)")


def normalize_ctes(merged: str, keys: str) -> str:
    """CTEs `dist` (ord, cwe, pos, w) normalized and `dist_agg` (ord, distribution, top_cwe).

    `keys` is a relation with every ord (those without items get unknown:1.0).
    """
    return f"""tot as (select ord, fsum(w) as total from {merged} group by ord),
dist as (select m.ord, m.cwe, m.pos, {py_round3_sql('(m.w / t.total)')} as w from {merged} m join tot t using (ord) where t.total > 0
         union all
         select k.ord, 'unknown' as cwe, 0 as pos, cast(1.0 as double) as w from {keys} k
         where k.ord not in (select ord from tot where total > 0)),
dist_agg as (select ord, string_agg(cwe || ':' || cast(w as varchar), '|' order by pos) as distribution,
                    arg_min(cwe, [-w, pos]) as top_cwe from dist group by ord)"""


def dist_text_agg(src: str) -> str:
    return f"select ord, string_agg(cwe || ':' || cast(w as varchar), '|' order by pos) as d from {src} group by ord"


# ---------------------------------------------------------------------------
# Taxonomy / location / verdict pieces
# ---------------------------------------------------------------------------

def crash_site_sql(frames: str) -> str:
    cand = (f"list_filter(list_transform({frames}, lambda f: {{'fn': regexp_extract(f, {rx(R.TAXONOMY_FUNC)}, 1), 'fr': f}}), "
            f"lambda c: c.fn <> '' and not {inlist('c.fn', R.SITE_NOISE_FUNCS)} and not "
            f"{prefix_any('c.fn', R.SITE_NOISE_PREFIXES)})[1]")
    return f"""(case when {cand} is null then 'unknown'
      when {inlist(cand + '.fn', R.LIBC_ALLOC)} then 'libc_alloc'
      when {inlist(cand + '.fn', R.LIBC_STRING)} then 'libc_string'
      when {inlist(cand + '.fn', R.LIBC_IO)} then 'libc_io'
      when starts_with({cand}.fn, '_dl_') or contains({cand}.fr, 'ld-linux') then 'dynamic_linker'
      when starts_with({cand}.fn, '__') and contains({cand}.fn, 'syscall') then 'kernel_syscall'
      else 'user_code' end)"""


def region_sql() -> str:
    tok = f"lower(regexp_extract(raw, {rx(R.MEMORY_REGION, i=True)}, 1))"
    np_ = " or ".join(f"contains(raw, {q(m)})" for m in R.NULL_PAGE_MARKERS)
    return (f"(case when coalesce(raw, '') = '' then null when {np_} then 'null_page' when {tok} = '' then null "
            f"when {tok} = 'global' then 'bss' else {tok} end)")


def memory_region_sql(san_region: str) -> str:
    return (f"(case when addr is not null and addr < {R.LOW_ADDRESS} then 'null_page' "
            f"when addr is not null and addr >= {R.KERNEL_ADDRESS} then 'kernel_space' "
            f"else coalesce({san_region}, 'unknown') end)")


def control_flow_sql(frames: str) -> str:
    return (f"(case when pc is null then 'unknown' when pc < {R.LOW_ADDRESS} then 'ret_to_unmapped' "
            f"when len({frames}) > {R.STACK_EXHAUSTION_FRAMES} then 'stack_exhaustion' else 'normal' end)")


def user_frame_sql(frames: str) -> str:
    pre = "'" + "|".join(re.escape(p) for p in R.USER_FRAME_NOISE_PREFIXES) + "'"
    return (f"list_filter(list_transform({frames}, lambda f: {{'fn': {ext('f', R.USER_FRAME_FUNC)}, "
            f"'loc': {ext('f', R.USER_FRAME_LOC)}, 'libc': regexp_matches(f, {rx(R.LIBC_PATH)})}}), "
            f"lambda c: not c.libc and (c.fn is null or not regexp_matches(c.fn, '^(?:' || {pre} || ')')) "
            f"and (c.fn is not null or c.loc is not null))[1]")


def san_loc_sql() -> str:
    pre = "|".join(re.escape(p) for p in R.SANITIZER_NOISE_PREFIXES)
    z = (f"list_zip(regexp_extract_all(raw, {rx(R.SANITIZER_FRAME)}, 1), regexp_extract_all(raw, {rx(R.SANITIZER_FRAME)}, 2), "
         f"regexp_extract_all(raw, {rx(R.SANITIZER_FRAME)}, 3))")
    return f"list_filter({z}, lambda x: not regexp_matches(x[1], {q('^(?:' + pre + ')')}))[1]"


def score_sql(top: str, site: str, region: str, flow: str) -> str:
    def lk(col, table):
        return "(case " + " ".join(f"when {col} = {q(k)} then {v}" for k, v in table.items()) + " else 0 end)"
    insn = "lower(coalesce(insn, ''))"
    mem = " or ".join(f"contains({insn}, {q(w)})" for w in R.INSN_MEMORY_WORDS)
    br = " or ".join(f"contains({insn}, {q(w)})" for w in R.INSN_BRANCH_WORDS)
    segv = "signal_class = 'ERROR_SEGFAULT'"
    low = R.LOW_ADDRESS
    g = (f"(case when addr is not null and addr >= {low} and {segv} then 1 else 0 end"
         f" - case when addr is not null and addr < {low} then 1 else 0 end"
         f" + case when ({mem}) and {segv} then 1 else 0 end"
         f" + case when ({br}) and {segv} then 3 else 0 end"
         f" + case when pc is not null and pc < {low} then 4 else 0 end)")
    return (f"({lk(top, R.CWE_SCORE)} + {lk(flow, R.CONTROL_FLOW_SCORE)} + {lk(site, R.CRASH_SITE_SCORE)} + "
            f"{lk(region, R.REGION_SCORE)} + case when has then {g} else 0 end)")


def verdict_sql(top: str, site: str, region: str, flow: str) -> str:
    wp = inlist(top, R.WRITE_PRIMITIVE_CWES)
    tier0 = (f"case when not has then null "
             f"when {match('raw', R.ALLOC_TOO_BIG, i=True)} or {match('raw', R.STACK_BUF_READ, i=True, s=True)} "
             f"or ({match('raw', R.UBSAN_TEXT, i=True)} and not {wp}) then 'NOT_EXPLOITABLE' "
             f"when {match('raw', R.SAN_WRITE, i=True, m=True)} then 'EXPLOITABLE' "
             f"when {match('raw', R.SAN_READ, i=True, m=True)} then 'NOT_EXPLOITABLE' end")
    sc = score_sql(top, site, region, flow)
    return (f"coalesce({tier0}, case when {sc} >= {R.EXPLOITABLE_MIN_SCORE} then 'EXPLOITABLE' "
            f"when {sc} >= {R.NOT_EXPLOITABLE_MIN_SCORE} then 'NOT_EXPLOITABLE' else 'UNKNOWN' end)")


def oob_direction_sql(is_oob: str, line: str) -> str:
    after = f"regexp_replace(substr({line}, strpos({line}, ']') + 1), {q('^' + WS + '+')}, '')"
    write = f"(regexp_matches({after}, '^[+\\-*/%&|^]=') or (starts_with({after}, '=') and not starts_with({after}, '==')))"
    return (f"(case when not {is_oob} or {line} is null or strpos({line}, ']') = 0 then null "
            f"when {after} = '' then 'read' when {write} then 'write' else 'read' end)")


def symbol_join(src: str, key: str, addr: str, left: bool = False) -> str:
    """(key, func, loc) of the symbol range holding `addr` (cleaned as E2)."""
    f = f"case when s.func in ('??', 'optimized out') then null else s.func end"
    l_ = f"case when regexp_matches(s.loc, {rx(R.SYMBOL_NOISE_LOC)}) then null else s.loc end"
    libc = f"coalesce(regexp_matches({l_}, {rx(R.LIBC_PATH)}), false)"
    return (f"select {key}, case when {libc} then null else {f} end as func, case when {libc} then null else {l_} end as loc "
            f"from {src} x {'left ' if left else ''}join v_symbols s on x.{addr} between s.lo and s.hi")


# ---------------------------------------------------------------------------
# Composite CTE chains
# ---------------------------------------------------------------------------

def log_rows(src_sql: str, name: str = "lc") -> str:
    """CTE `name`: parsed crash rows (+ signal_class) from a select with ord, signal, raw."""
    return (f"{name}_in as ({src_sql}),\n"
            f"{name} as (select *, {signal_class_sql('signal')} as signal_class from ({parsed(name + '_in')}) x)")


def classify_ctes(src: str, debug_info: bool, roots: list[str]) -> str:
    """CTEs ending in `cls`: full classification (D22) of the parsed rows in `src`."""
    parts = [evidence_ctes(src)]
    if debug_info:
        fr_addr = hexnum(f"nullif(regexp_extract(f, {rx(R.FRAME_ADDR)}, 1), '')")
        parts.append(f"""fr as (select ord, unnest(frames) as f, generate_subscripts(frames, 1) as pos from {src}),
fr_a as (select *, case when contains(f, ' at ') then null else {fr_addr} end as faddr from fr),
fr_s as ({symbol_join('fr_a', 'ord, pos, f', 'faddr')}),
fr_e as (select a.ord, a.pos, case when s.loc is not null then a.f || ' at ' || s.loc else a.f end as f
         from fr_a a left join fr_s s on a.ord = s.ord and a.pos = s.pos),
enr as (select ord, list(f order by pos) as bt from fr_e group by ord),
pcs as ({symbol_join(src, 'ord', 'pc')}),""")
        bt = "coalesce(enr.bt, [])"
        sym_join = "left join enr on enr.ord = x.ord left join pcs on pcs.ord = x.ord"
        sym_func, sym_loc = "pcs.func", "pcs.loc"
    else:
        parts.append("")
        bt = "x.frames"
        sym_join = ""
        sym_func = sym_loc = "cast(null as varchar)"
    uf = user_frame_sql("bt")
    parts[-1] += f"""
loc0 as (select x.*, {bt} as bt, {sym_func} as sym_func, {sym_loc} as sym_loc from {src} x {sym_join}),
loc1 as (select *, (sym_loc is null or sym_func is null or sym_loc = '' or sym_func = '') as need,
                {uf} as uf, {san_loc_sql()} as sl from loc0),
loc2 as (select *, case when need then coalesce(nullif(sym_func, ''), uf.fn) else sym_func end as f0,
                   case when need then coalesce(nullif(sym_loc, ''), uf.loc) else sym_loc end as l0 from loc1),
located as (select *, case when not coalesce(starts_with(l0, '/'), false) and sl is not null then sl[2] || ':' || sl[3] else l0 end as crash_location,
                      case when not coalesce(starts_with(l0, '/'), false) and sl is not null and (f0 is null or f0 = '') then sl[1] else f0 end as crash_function
            from loc2)"""
    if debug_info:
        cands = ["select crash_location, 0 as rank, p as file from sp where starts_with(p, '/')"]
        for i, root in enumerate(roots or [""]):
            def join(x):
                return x if root == "" else f"case when starts_with({x}, '/') then {x} else {q(root.rstrip('/') + '/')} || {x} end"
            cands.append(f"select crash_location, {2 * i + 1} as rank, {join('p')} as file from sp")
            cands.append(f"select crash_location, {2 * i + 2} as rank, {join('regexp_extract(p, ' + q('([^/]*)$') + ', 1)')} as file from sp")
        parts.append(f"""sp as (select crash_location, regexp_extract(crash_location, {rx(R.SNIPPET_LOC)}, 1) as p,
              try_cast(regexp_extract(crash_location, {rx(R.SNIPPET_LOC)}, 2) as bigint) as crash_line
       from (select distinct crash_location from located) d where regexp_matches(crash_location, {rx(R.SNIPPET_LOC)})),
sfiles as (select file, max(line) as n_lines, sum(strlen(text) + 1) as size_bytes from v_source_lines group by file),
cand as ({' union all '.join(cands)}),
res as (select crash_location, arg_min(file, rank) as file, arg_min(n_lines, rank) as n_lines,
               arg_min(size_bytes, rank) as size_bytes from cand join sfiles using (file)
        where file is not null and file <> '' group by crash_location),
ctext as (select r.crash_location, coalesce(s.text, '') as crash_line_text from res r join sp using (crash_location)
          left join v_source_lines s on s.file = r.file and s.line = sp.crash_line
          where sp.crash_line between 1 and r.n_lines),
dirs as (select l.ord, {oob_direction_sql(f"coalesce({match('l.raw', R.OOB_UBSAN, i=True)}, false)", 'c.crash_line_text')} as oob_direction
         from located l left join ctext c on c.crash_location = l.crash_location)""")
    else:
        parts.append("dirs as (select ord, cast(null as varchar) as oob_direction from located)")
    parts.append(f"""wr as (select ord from dirs where oob_direction = 'write'),
adj as (select * from ev_merged where ord not in (select ord from wr)
        union all select ord, cwe, pos, case when cwe = {q(R.OOB_WRITE_CWE[0])} then greatest(w, cast({R.OOB_WRITE_CWE[1]} as double)) else w end
          from ev_merged where ord in (select ord from wr) and cwe <> {q(R.OOB_READ_CWE)}
        union all select ord, {q(R.OOB_WRITE_CWE[0])}, 100000, cast({R.OOB_WRITE_CWE[1]} as double) from wr
          where ord not in (select ord from ev_merged where cwe = {q(R.OOB_WRITE_CWE[0])})),
{normalize_ctes('adj', 'located')},
tx as (select l.*, d.oob_direction, a.distribution, a.top_cwe,
              case when has then {crash_site_sql('frames')} else 'unknown' end as crash_site_kind,
              case when has then {memory_region_sql(region_sql())} else coalesce({region_sql()}, 'unknown') end as memory_region,
              case when has then {control_flow_sql('frames')} else 'unknown' end as control_flow_state
       from located l join dirs d using (ord) join dist_agg a using (ord)),
cls as (select *, {verdict_sql('top_cwe', 'crash_site_kind', 'memory_region', 'control_flow_state')} as exploitability from tx)""")
    return ",\n".join(p for p in parts if p)


def stack_hash_sql(bt: str) -> str:
    noise = rx(R.DEDUP_NOISE)
    kept = f"list_filter({bt}, lambda f: not regexp_matches(f, {noise}))"
    m = f"(case when len({kept}) = 0 then {bt} else {kept} end)"
    func = f"regexp_extract(f, {rx(R.NORMALIZE_FUNC)}, 1)"
    loc = f"regexp_extract(f, {rx(R.NORMALIZE_LOC)}, 1)"
    fb = strip(f"split_part(regexp_replace(f, {rx(R.HEX_ADDRESS, i=True)}, '', 'g'), '+', 1)")
    norm = f"case when {func} <> '' and {loc} <> '' then {func} || ' ' || {loc} when {func} <> '' then {func} else {fb} end"
    top = f"list_transform(list_filter(list_slice({m}, 1, {R.STACK_HASH_FRAMES}), lambda f: f <> ''), lambda f: {norm})"
    return (f"(case when {bt} is null or len({bt}) = 0 or len({top}) = 0 then null "
            f"else substr(sha1(array_to_string({top}, '|')), 1, {R.STACK_HASH_HEX_CHARS}) end)")


def normalize_frame_sql(f: str) -> str:
    func = f"regexp_extract({f}, {rx(R.NORMALIZE_FUNC)}, 1)"
    loc = f"regexp_extract({f}, {rx(R.NORMALIZE_LOC)}, 1)"
    fb = strip(f"split_part(regexp_replace({f}, {rx(R.HEX_ADDRESS, i=True)}, '', 'g'), '+', 1)")
    return f"(case when {func} <> '' and {loc} <> '' then {func} || ' ' || {loc} when {func} <> '' then {func} else {fb} end)"


SIGNAL_FROM_NAME = f"try_cast(nullif(regexp_extract(name, {rx(R.SIGNAL_IN_NAME, i=True)}, 1), '') as integer)"

RAW_CRASHES = (f"select ord, name, fuzzer_instance, input_sha1, size, "
               f"'/out/' || fuzzer_instance || '/crashes/' || name as path, {SIGNAL_FROM_NAME} as signal from v_raw")

REPLAY_CHOSEN = (f"select ord, arg_min(attempt, attempt) as attempt, arg_min(text, attempt) as text from "
                 f"(select ord, attempt, coalesce(stdout, '') || chr(10) || coalesce(stderr, '') as text from v_replay) t "
                 f"where not {match('text', R.LOAD_ERROR)} group by ord")


def triage_ctes() -> str:
    """CTEs for the end-to-end plan: raw, la, cls (level A classified), lb, lcc (level C), iss, ranked."""
    sev_c = "(case " + " ".join(f"when top_cwe = {q(k)} then {q(v)}" for k, v in R.CWE_SEVERITY.items()) + \
        f" else {q(R.CWE_SEVERITY_DEFAULT)} end)"
    sev_e = "(case " + " ".join(f"when signal_class = {q(k)} then {q(v)}" for k, v in R.ERROR_SEVERITY.items()) + \
        f" else {q(R.ERROR_SEVERITY_DEFAULT)} end)"
    rank = "(case severity_level " + " ".join(f"when {q(k)} then {v}" for k, v in R.SEVERITY_RANK.items()) + " else 0 end)"
    from crashlake.plans.triage import SOURCE_ROOTS
    return f"""{views('v_raw', 'v_replay', 'v_symbols', 'v_source_lines')},
raw as ({RAW_CRASHES}),
la as (select input_sha1, min(ord) as ord, count(*) as duplicate_count from raw group by input_sha1),
rep as ({REPLAY_CHOSEN}),
{log_rows("select la.ord, la.input_sha1, la.duplicate_count, r.signal, rep.text as raw from la join raw r on r.ord = la.ord left join rep on rep.ord = la.ord", "lcx")},
{classify_ctes('lcx', True, SOURCE_ROOTS)},
ca as (select *, {stack_hash_sql('bt')} as stack_hash, insn as faulting_instruction from cls),
lb_m as (select min(ord) as ord, cast(sum(duplicate_count) as bigint) as dup, count(*) as merged_issues from ca where stack_hash is not null group by stack_hash, top_cwe),
lb as (select ca.* replace (lb_m.dup as duplicate_count), lb_m.merged_issues, false as untouched_b from lb_m join ca using (ord)
       union all select ca.*, 1 as merged_issues, true as untouched_b from ca where stack_hash is null),
lc_m as (select arg_min(ord, [cast(untouched_b as int), ord]) as ord, cast(sum(duplicate_count) as bigint) as dup, count(*) as merged_issues from lb
         where crash_location is not null and crash_location <> '' group by crash_location, coalesce(faulting_instruction, ''), top_cwe),
lcc as (select lb.* replace (lc_m.dup as duplicate_count, lc_m.merged_issues as merged_issues), false as untouched_c from lc_m join lb using (ord)
        union all select lb.*, true as untouched_c from lb where crash_location is null or crash_location = ''),
iss0 as (select *, case when top_cwe <> 'unknown' then {sev_c} else {sev_e} end as severity_level from lcc),
iss as (select *, {rank} as severity_rank from iss0),
ranked as (select *, row_number() over (order by severity_rank desc, duplicate_count desc, untouched_c, untouched_b, ord) as issue_rank from iss)"""


# ---------------------------------------------------------------------------
# Per-query SQL
# ---------------------------------------------------------------------------

def _lc_with(*extra_views: str) -> str:
    return f"with {views('v_log', *extra_views)},\n{log_rows('select ord, signal, raw from v_log')}"


def build() -> dict[str, str]:
    Q: dict[str, str] = {}
    LC = _lc_with()
    bt = "coalesce(case when has then frames end, [])"

    # A
    Q["scan_crash_files"] = (f"with {views('v_files')} select path, regexp_extract(path, '([^/]+)$', 1) as name, "
                             f"regexp_extract(path, '([^/]+)/crashes/[^/]+$', 1) as fuzzer_instance, "
                             f"try_cast(nullif(regexp_extract(regexp_extract(path, '([^/]+)$', 1), '(?i)sig[:_]([0-9]+)', 1), '') as integer) as signal, "
                             f"size, input_sha1 from v_files where regexp_matches(path, '/crashes/[^/]+$') "
                             f"and not starts_with(regexp_extract(path, '([^/]+)$', 1), 'README')")
    Q["instance_from_path"] = (f"with {views('v_raw')}, raw as ({RAW_CRASHES}) select ord, "
                               f"regexp_extract(path, '([^/]+)/crashes/[^/]+$', 1) as instance_multi, "
                               f"regexp_extract('/runs/' || fuzzer_instance || '/crashes/' || name, '([^/]+)/crashes/[^/]+$', 1) as instance_single from raw")
    Q["input_sha1"] = "select doc_id, sha1(text) as input_sha1, strlen(text) as size from documents"
    Q["signal_from_name"] = f"with {views('v_raw')}, raw as ({RAW_CRASHES}) select ord, name, signal from raw"
    kv = (f"select fuzzer_instance, pos, {strip('split_part(l, chr(58), 1)')} as k, "
          f"{strip('substr(l, strpos(l, chr(58)) + 1)')} as v from (select fuzzer_instance, "
          f"unnest(string_split_regex(body, {q(LINE_BREAK)})) as l, generate_subscripts(string_split_regex(body, {q(LINE_BREAK)}), 1) as pos "
          f"from v_stats_text) t where contains(l, ':')")

    def g(k):
        return f"max(case when k = {q(k)} then v end)"

    def gi(k):
        return f"coalesce(try_cast({g(k)} as bigint), 0)"

    def fb(a, b):
        return f"case when {gi(a)} <> 0 then {gi(a)} else {gi(b)} end"

    stats = (f"with {views('v_stats_text')}, kv as (select fuzzer_instance, k, arg_max(v, pos) as v from ({kv}) x group by fuzzer_instance, k), "
             f"st as (select fuzzer_instance, {g('command_line')} as command_line, "
             f"case when coalesce({g('start_time')}, '') = '' then null else try_cast({g('start_time')} as bigint) end as start_time_epoch, "
             f"case when coalesce({g('last_update')}, '') = '' then null else try_cast({g('last_update')} as bigint) end as last_update_epoch, "
             f"{gi('execs_done')} as execs_done, coalesce(try_cast({g('execs_per_sec')} as double), 0.0) as execs_per_sec, "
             f"{fb('corpus_count', 'paths_total')} as paths_total, {fb('saved_crashes', 'unique_crashes')} as unique_crashes, "
             f"{fb('saved_hangs', 'unique_hangs')} as unique_hangs, coalesce(nullif({g('afl_version')}, ''), nullif({g('fuzzer_version')}, '')) as afl_version, "
             f"count(*) as n_keys, coalesce(nullif({g('target_mode')}, ''), nullif(list_filter(string_split_regex(coalesce({g('command_line')}, ''), '\\s+'), lambda t: t <> '')[-1], '')) as target_binary "
             f"from kv group by fuzzer_instance) ")
    Q["scan_fuzzer_stats"] = stats + ("select fuzzer_instance, command_line, start_time_epoch, last_update_epoch, execs_done, execs_per_sec, "
                                      "paths_total, unique_crashes, unique_hangs, afl_version, n_keys from st")
    Q["stats_target_binary"] = stats + "select fuzzer_instance, target_binary from st"
    Q["instance_stats"] = stats + ("select fuzzer_instance, execs_done, execs_per_sec, paths_total, unique_crashes, unique_hangs, "
                                   "afl_version from st")
    parts = f"list_transform(string_split({strip('line')}, ','), lambda p: {strip('p')})"
    Q["scan_plot_data"] = (f"with {views('v_plot_text')}, p as (select fuzzer_instance, line_no, {strip('line')} as s, {parts} as parts from v_plot_text) "
                           f"select fuzzer_instance, line_no, unix_time, unique_crashes from (select fuzzer_instance, line_no, s, parts, "
                           f"try_cast(parts[1] as bigint) as unix_time, case when parts[8] = '' then 0 else try_cast(parts[8] as bigint) end as unique_crashes from p) x "
                           f"where s <> '' and not starts_with(s, '#') and len(parts) >= 8 and unix_time is not null and unique_crashes is not null")
    Q["parse_replay_log"] = (LC + " select ord, has as has_result, case when has then signal_name end as signal_name, "
                             "case when has then len(frames) end as n_frames, case when has then array_to_string(frames, '|') end as backtrace, "
                             "case when has then insn end as faulting_instruction, case when has then cast(addr as varchar) end as faulting_address, "
                             "case when has then cast(pc as varchar) end as pc from lc")
    Q["reject_loader_errors"] = f"with {views('v_replay')} select ord, attempt from ({REPLAY_CHOSEN}) r"

    # B
    noise = rx(R.DEDUP_NOISE)
    kept = f"list_filter({bt}, lambda f: not regexp_matches(f, {noise}))"
    m = f"(case when len({kept}) = 0 then {bt} else {kept} end)"
    Q["noise_frames"] = LC + f" select ord, array_to_string({m}, '|') as meaningful, len({m}) as n_meaningful from lc"
    FR = LC + ", fr as (select ord, unnest(frames) as frame, generate_subscripts(frames, 1) - 1 as pos from lc where has)"
    Q["normalize_frame"] = FR + f" select ord, pos, frame, {normalize_frame_sql('frame')} as normalized from fr"
    Q["stack_hash"] = LC + f" select ord, {stack_hash_sql(bt)} as stack_hash from lc"
    rf = f"regexp_extract(frame, {rx(R.RECOMMEND_FUNC)}, 1)"
    Q["frame_function"] = FR + (f" select ord, pos, {ext('frame', R.ENGINE_FUNC)} as fn_engine, {ext('frame', R.TAXONOMY_FUNC)} as fn_taxonomy, "
                                f"case when {rf} <> '' and {rf} not in ('optimized', 'out') then {rf} else {ext('frame', R.RECOMMEND_FUNC_ANGLE)} end as fn_recommend from fr")
    uf = user_frame_sql(bt)
    Q["first_user_frame"] = LC + f" select ord, ({uf}).fn as user_func, ({uf}).loc as user_loc from lc"
    sl = san_loc_sql()
    Q["first_sanitizer_loc"] = LC + f" select ord, ({sl})[1] as san_func, ({sl})[2] || ':' || ({sl})[3] as san_loc from lc"
    cls_nd = classify_ctes("lc", False, [])
    Q["crash_site_location"] = (f"with {views('v_log', 'v_symbols', 'v_source_lines')},\n{log_rows('select ord, signal, raw from v_log')},\n"
                                f"{classify_ctes('lc', True, [])} select ord, crash_function, crash_location from located")
    oob = f"coalesce({match('raw', R.OOB_UBSAN, i=True)}, false)"
    Q["oob_direction"] = f"with {views('v_oob_lines')} select ord, {oob_direction_sql(oob, 'source_line')} as direction from v_oob_lines"
    Q["log_tail"] = ("select doc_id, case when length(text) <= 2000 then text else right(text, 2000) end as tail, "
                     "length(case when length(text) <= 2000 then text else right(text, 2000) end) as tail_len, "
                     "case when length(text) <= 4000 then text else right(text, 4000) end as stderr_tail from documents")

    # C / E / F / G over the triage plan
    T = "with " + triage_ctes()
    Q["dedup_exact"] = (f"with {views('v_raw')}, raw as ({RAW_CRASHES}), la as (select input_sha1, min(ord) as ord, count(*) as duplicate_count "
                        f"from raw group by input_sha1) select la.input_sha1, la.ord, r.name, r.fuzzer_instance, r.signal, r.size, la.duplicate_count "
                        f"from la join raw r on r.ord = la.ord")
    Q["dedup_stack"] = T + " select ord, stack_hash, top_cwe, duplicate_count, merged_issues, untouched_b from lb"
    Q["dedup_location"] = T + (" select ord, crash_location, faulting_instruction, top_cwe, duplicate_count, merged_issues, "
                               "untouched_b, untouched_c from lcc")
    Q["dedup_cascade"] = T + (" select (select count(*) from raw) as raw_crashes, (select count(*) from la) as level_a_issues, "
                              "(select count(*) from lb) as level_b_issues, (select count(*) from lcc) as level_c_issues")
    Q["duplicate_members"] = T + """,
a_b as (select input_sha1, ord as a_ord, case when stack_hash is null then ord else min(ord) over (partition by stack_hash, top_cwe) end as b_ord,
               stack_hash is null as untouched_b from ca),
b_k as (select ord as b_ord, untouched_b, crash_location as l, coalesce(faulting_instruction, '') as i, top_cwe as c,
               crash_location is not null and crash_location <> '' as usable from lb),
b_c as (select b_ord, case when usable then arg_min(b_ord, [cast(untouched_b as int), b_ord]) over (partition by l, i, c) else b_ord end as issue_ord,
               not usable as untouched_c from b_k)
select b_c.issue_ord, b_c.untouched_c, a_b.untouched_b, a_b.b_ord, a_b.a_ord, raw.ord, raw.path
from raw join a_b using (input_sha1) join b_c on b_c.b_ord = a_b.b_ord"""

    # D
    Q["signal_class"] = f"with {views('v_raw')}, raw as ({RAW_CRASHES}) select ord, signal, {signal_class_sql('signal')} as signal_class from raw"
    Q["signal_prior"] = (f"with {views('v_raw')}, raw as ({RAW_CRASHES}) select ord, string_agg(pr.cwe || ':' || cast(pr.w as varchar), '|' order by pr.seq) as prior "
                         f"from raw join {prior_values()} on pr.sig_key = {sig_key('signal')} group by ord")
    Q["overflow_header"] = LC + f", h as ({header_item('lc')}) select lc.ord, h.cwe as header_cwe, h.w as header_w from lc left join h using (ord)"
    Q["sanitizer_rules"] = LC + (f", it as ({header_item('lc')} union all {' union all '.join(rule_items('lc'))}), "
                                 f"mg as (select ord, cwe, min(seq) as pos, max(w) as w from it group by ord, cwe), d as ({dist_text_agg('mg')}) "
                                 f"select lc.ord, coalesce(d.d, '') as sanitizer_dist from lc left join d using (ord)")
    Q["sanitizer_region"] = LC + f" select ord, {region_sql()} as region from lc"
    Q["debugger_heuristics"] = LC + (f", it as ({' union all '.join(heuristic_items('lc'))}), "
                                     f"mg as (select ord, cwe, min(seq) as pos, max(w) as w from it where ord not in (select ord from lc where has and {exhaustion_sql()}) group by ord, cwe), "
                                     f"d as ({dist_text_agg('mg')}) select lc.ord, coalesce(d.d, '') as hints from lc left join d using (ord) where lc.has")
    trap = [x for x in heuristic_items("lc") if " 214 as seq" in x][0].replace("and signal_class = 'ERROR_ILL' and coalesce(insn, '') <> '' ", "")
    trap = trap.replace("where has and", "where")
    Q["ubsan_trap_lookup"] = LC + f", t as ({trap}) select lc.ord, t.cwe as trap_cwe, t.w as trap_w from lc left join t using (ord)"
    Q["stack_exhaustion"] = LC + f" select ord, {exhaustion_sql()} as exhausted from lc where has"
    Q["recursive_overflow"] = LC + f" select ord, {recursive_sql()} as recursive from lc where has"
    EV = LC + ",\n" + evidence_ctes("lc")
    Q["merge_evidence"] = EV + f", d as ({dist_text_agg('ev_merged')}) select lc.ord, coalesce(d.d, '') as merged from lc left join d using (ord)"
    Q["normalize_distribution"] = EV + ",\n" + normalize_ctes("ev_merged", "lc") + " select ord, distribution from dist_agg"
    Q["cwe_long"] = EV + ",\n" + normalize_ctes("ev_merged", "lc") + \
        " select ord, cast(row_number() over (partition by ord order by pos) - 1 as integer) as pos, cwe, w as weight from dist"
    Q["top_cwe"] = EV + ",\n" + normalize_ctes("ev_merged", "lc") + " select ord, top_cwe from dist_agg"
    oob2 = f"coalesce({match('raw', R.OOB_UBSAN, i=True)}, false)"
    Q["apply_oob_direction"] = (f"with {views('v_oob_lines')}, x as (select ord, 11 as signal, raw, true as has, "
                                f"{oob_direction_sql(oob2, 'source_line')} as direction from v_oob_lines), "
                                f"it as (select ord, seq, pr.cwe, pr.w from x join {prior_values()} on pr.sig_key = 11 union all "
                                f"{header_item('x')} union all {' union all '.join(rule_items('x'))}), "
                                f"mg as (select ord, cwe, min(seq) as pos, max(w) as w from it group by ord, cwe), "
                                f"wr as (select ord from x where direction = 'write'), "
                                f"adj as (select * from mg where ord not in (select ord from wr) union all "
                                f"select ord, cwe, pos, case when cwe = 'CWE-121' then greatest(w, cast(0.8 as double)) else w end from mg where ord in (select ord from wr) and cwe <> 'CWE-125' "
                                f"union all select ord, 'CWE-121', 100000, cast(0.8 as double) from wr where ord not in (select ord from mg where cwe = 'CWE-121')), "
                                f"d as ({dist_text_agg('adj')}) select x.ord, x.direction, coalesce(d.d, '') as dist from x left join d using (ord)")
    Q["crash_site"] = LC + f" select ord, {crash_site_sql('frames')} as crash_site_kind from lc where has"
    Q["memory_region"] = LC + f" select ord, {memory_region_sql(region_sql())} as memory_region from lc where has"
    Q["control_flow"] = LC + f" select ord, {control_flow_sql('frames')} as control_flow_state from lc where has"
    Q["taxonomy"] = LC + (f" select ord, signal_class, case when has then {crash_site_sql('frames')} else 'unknown' end as crash_site_kind, "
                          f"case when has then {memory_region_sql(region_sql())} else 'unknown' end as memory_region, "
                          f"case when has then {control_flow_sql('frames')} else 'unknown' end as control_flow_state from lc")
    CL = LC + ",\n" + cls_nd
    wp = inlist("top_cwe", R.WRITE_PRIMITIVE_CWES)
    Q["exploit_evidence"] = CL + (f" select ord, case when {match('raw', R.ALLOC_TOO_BIG, i=True)} or {match('raw', R.STACK_BUF_READ, i=True, s=True)} "
                                  f"or ({match('raw', R.UBSAN_TEXT, i=True)} and not {wp}) then 'NOT_EXPLOITABLE' "
                                  f"when {match('raw', R.SAN_WRITE, i=True, m=True)} then 'EXPLOITABLE' "
                                  f"when {match('raw', R.SAN_READ, i=True, m=True)} then 'NOT_EXPLOITABLE' end as tier0 from cls where has")
    Q["exploit_score"] = CL + f" select ord, {score_sql('top_cwe', 'crash_site_kind', 'memory_region', 'control_flow_state')} as score, exploitability from cls"
    static = (f"with {views('v_raw')}, raw as ({RAW_CRASHES}), la as (select input_sha1, min(ord) as ord from raw group by input_sha1), "
              f"x as (select la.ord, r.signal, cast(null as varchar) as raw, false as has, cast(null as ubigint) as addr, cast(null as ubigint) as pc, "
              f"cast(null as varchar) as insn, {signal_class_sql('r.signal')} as signal_class from la join raw r on r.ord = la.ord), "
              f"ev as (select ord, seq as pos, pr.cwe, pr.w from x join {prior_values()} on pr.sig_key = {sig_key('signal')}), "
              f"{normalize_ctes('ev', 'x')} select x.ord, top_cwe, distribution, signal_class, 'unknown' as crash_site_kind, 'unknown' as memory_region, "
              f"'unknown' as control_flow_state, {verdict_sql('top_cwe', chr(39) + 'unknown' + chr(39), chr(39) + 'unknown' + chr(39), chr(39) + 'unknown' + chr(39))} as exploitability "
              f"from x join dist_agg using (ord)")
    Q["classify_static"] = static
    from crashlake.plans.triage import SOURCE_ROOTS
    Q["classify_full"] = (f"with {views('v_log', 'v_symbols', 'v_source_lines')},\n{log_rows('select ord, signal, raw from v_log')},\n"
                          f"{classify_ctes('lc', True, SOURCE_ROOTS)} select ord, crash_function, crash_location, oob_direction, top_cwe, distribution, "
                          f"signal_class, crash_site_kind, memory_region, control_flow_state, exploitability from cls")

    # E
    Q["join_crash_log"] = (f"with {views('v_raw', 'v_replay')}, raw as ({RAW_CRASHES}), la as (select input_sha1, min(ord) as ord from raw group by input_sha1), "
                           f"rep as ({REPLAY_CHOSEN}), {log_rows('select ord, attempt, 0 as signal, text as raw from rep', 'pr')} "
                           f"select la.ord, la.input_sha1, coalesce(pr.has, false) as has_log, case when pr.has then pr.attempt end as attempt, "
                           f"case when pr.has then pr.signal_name end as signal_name from la left join pr on pr.ord = la.ord")
    Q["symbolize_pc"] = (f"with {views('v_pc', 'v_symbols')} "
                         + symbol_join('v_pc', 'x.l_orderkey, x.l_linenumber, x.pc', 'pc', left=True))
    fr_addr = hexnum(f"nullif(regexp_extract(f, {rx(R.FRAME_ADDR)}, 1), '')")
    Q["enrich_frames"] = (f"with {views('v_log', 'v_symbols')},\n{log_rows('select ord, signal, raw from v_log')},\n"
                          f"fr as (select ord, unnest(frames) as f, generate_subscripts(frames, 1) as pos from lc where has), "
                          f"fr_a as (select *, case when contains(f, ' at ') then null else {fr_addr} end as faddr from fr), "
                          f"fr_s as ({symbol_join('fr_a', 'ord, pos, f', 'faddr')}), "
                          f"fr_e as (select a.ord, a.pos, case when s.loc is not null then a.f || ' at ' || s.loc else a.f end as f from fr_a a left join fr_s s on a.ord = s.ord and a.pos = s.pos), "
                          f"enr as (select ord, string_agg(f, '|' order by pos) as bt from fr_e group by ord) "
                          f"select lc.ord, coalesce(enr.bt, '') as backtrace from lc left join enr using (ord)")
    Q["source_snippet"] = (f"with {views('v_loc', 'v_source_lines')}, sp as (select distinct crash_location, regexp_extract(crash_location, {rx(R.SNIPPET_LOC)}, 1) as p, "
                           f"try_cast(regexp_extract(crash_location, {rx(R.SNIPPET_LOC)}, 2) as bigint) as crash_line from v_loc where regexp_matches(crash_location, {rx(R.SNIPPET_LOC)})), "
                           f"sfiles as (select file, max(line) as n_lines, sum(strlen(text) + 1) as size_bytes from v_source_lines group by file), "
                           f"cand as (select crash_location, 0 as rank, p as file, crash_line from sp where starts_with(p, '/') union all "
                           f"select crash_location, 1, p, crash_line from sp union all select crash_location, 2, regexp_extract(p, '([^/]*)$', 1), crash_line from sp), "
                           f"res as (select crash_location, arg_min(file, rank) as file, arg_min(n_lines, rank) as n_lines, arg_min(size_bytes, rank) as size_bytes, "
                           f"any_value(crash_line) as crash_line from cand join sfiles using (file) where file <> '' group by crash_location), "
                           f"ok as (select * from res where crash_line between 1 and n_lines), "
                           f"want as (select crash_location, file, crash_line, unnest(range(greatest(crash_line - 3, 1), least(crash_line + 3, n_lines) + 1)) as line from ok) "
                           f"select w.crash_location, w.file as snippet_file, w.crash_line, w.line, coalesce(s.text, '') as text from want w "
                           f"left join v_source_lines s on s.file = w.file and s.line = w.line")
    Q["resolve_source_path"] = (f"with {views('v_loc', 'v_source_lines')}, locs as (select crash_location from v_loc union all "
                                f"select 'lib/' || regexp_extract(crash_location, '([^/]+)$', 1) from v_loc), "
                                f"sp as (select crash_location, regexp_extract(crash_location, {rx(R.SNIPPET_LOC)}, 1) as p from locs where regexp_matches(crash_location, {rx(R.SNIPPET_LOC)})), "
                                f"sfiles as (select distinct file from v_source_lines), "
                                f"cand as (select crash_location, 0 as rank, p as file from sp where starts_with(p, '/') "
                                f"union all select crash_location, 1, case when starts_with(p, '/') then p else '/nowhere/' || p end from sp "
                                f"union all select crash_location, 2, '/nowhere/' || regexp_extract(p, '([^/]*)$', 1) from sp "
                                f"union all select crash_location, 3, case when starts_with(p, '/') then p else '/src/' || p end from sp "
                                f"union all select crash_location, 4, '/src/' || regexp_extract(p, '([^/]*)$', 1) from sp) "
                                f"select crash_location, arg_min(file, rank) as file from cand join sfiles using (file) group by crash_location")
    Q["severity_dim"] = T + " select ord, top_cwe, signal_class, severity_level from iss"

    def lab(col, table):
        return "coalesce(case " + " ".join(f"when {col} = {q(k)} then {q(v)}" for k, v in table.items()) + f" end, {col})"
    Q["label_dims"] = T + (f" select ord, top_cwe, signal_class, exploitability, crash_site_kind, memory_region, "
                           f"{lab('top_cwe', R.CWE_TITLES)} as cwe_title, {lab('signal_class', R.SIGNAL_CLASS_TITLES)} as signal_title, "
                           f"{lab('signal_class', R.SIGNAL_CLASS_CATEGORY)} as signal_category, {lab('crash_site_kind', R.CRASH_SITE_TITLES)} as site_title, "
                           f"{lab('memory_region', R.MEMORY_REGION_TITLES)} as region_title, {lab('exploitability', R.VERDICT_TITLES)} as verdict_title, "
                           f"case when starts_with(top_cwe, 'CWE-') then {q(R.CWE_LINK_PREFIX)} || split_part(top_cwe, '-', 2) || {q(R.CWE_LINK_SUFFIX)} end as cwe_link from iss")
    Q["unmatched_logs"] = (f"with {views('v_raw', 'v_replay')}, raw as ({RAW_CRASHES}), la as (select input_sha1, min(ord) as ord from raw group by input_sha1), "
                           f"rep as ({REPLAY_CHOSEN}), {log_rows('select ord, 0 as signal, text as raw from rep', 'pr')} "
                           f"select ord, input_sha1 from la where ord not in (select ord from pr where has)")
    Q["reduction_ratio"] = (f"with {views('v_minimized')} select ord, size, minimized_size, case when minimized_size is null then null "
                            f"when minimized_size > 0 then size / minimized_size else 1.0 end as reduction_ratio from v_minimized")

    # F
    Q["prioritize"] = T + " select ord, severity_level, severity_rank, duplicate_count, issue_rank from ranked"
    Q["issue_rank"] = T + " select issue_rank, ord from ranked"
    sec = "case when top_cwe <> 'unknown' then 'cwe' else 'error' end"
    Q["section_rank"] = T + (f", s as (select ord, {sec} as section, row_number() over (partition by {sec} order by issue_rank) as section_rank from ranked) "
                             f"select ord, section, section_rank, section_rank <= case when section = 'cwe' then {R.SECTION_OPEN_CWE} else {R.SECTION_OPEN_ERROR} end as opened from s")
    Q["split_sections"] = T + f" select ord, {sec} as section from iss"
    Q["concat_passthrough"] = T + " select ord, untouched_b from lb"
    Q["recommendation"] = T + ", " + recommendation_ctes()

    # G
    Q["count_by_axis"] = T + (" select 'signal_class' as axis, signal_class as value, count(*) as n, min(issue_rank) as first_rank from ranked group by signal_class "
                              "union all select 'crash_site_kind', crash_site_kind, count(*), min(issue_rank) from ranked group by crash_site_kind "
                              "union all select 'memory_region', memory_region, count(*), min(issue_rank) from ranked group by memory_region "
                              "union all select 'exploitability', exploitability, count(*), min(issue_rank) from ranked group by exploitability")
    Q["severity_counts"] = T + " select severity_level, count(*) as n from iss group by severity_level"
    Q["report_totals"] = T + (" select (select count(*) from raw) as raw_crashes, count(*) as unique_issues, "
                              "count(*) filter (where severity_level = 'CRITICAL') as critical, count(*) filter (where severity_level = 'HIGH') as high from iss")
    P = f"with {views('v_plot')}"
    ext_ = "select min(unix_time) as x_min, max(unix_time) as x_max, greatest(coalesce(max(unique_crashes), 0), 1) as y_max, count(*) as n_points, greatest(max(unix_time) - min(unix_time), 1) as x_range from v_plot"
    Q["plot_extent"] = P + " " + ext_
    idx = "select *, row_number() over (order by fuzzer_instance, line_no) - 1 as idx from v_plot"
    Q["plot_normalized"] = P + (f", e as ({ext_}), p as ({idx}) select idx, fuzzer_instance, line_no, unix_time, unique_crashes, unix_time - x_min as elapsed, "
                                f"(unix_time - x_min) / x_range as fx, unique_crashes / y_max as fy from p, e")
    Q["plot_downsample"] = P + (f", e as ({ext_}), p as ({idx}) select idx, fuzzer_instance, line_no, unix_time, unique_crashes, idx = n_points - 1 as is_last "
                                f"from p, e where idx % greatest(n_points // {R.PLOT_MAX_DOTS}, 1) = 0 or idx = n_points - 1")
    return Q


def recommendation_ctes() -> str:
    noise = rx(R.RECOMMEND_NOISE)
    adv = "(case " + " ".join(f"when signal_class = {q(k)} then {q(v)}" for k, v in R.ERROR_ADVICE.items()) + \
        f" else {q(R.ERROR_ADVICE_DEFAULT)} end)"
    rf = f"regexp_extract(f, {rx(R.RECOMMEND_FUNC)}, 1)"
    fn = f"case when {rf} <> '' and {rf} not in ('optimized', 'out') then {rf} else {ext('f', R.RECOMMEND_FUNC_ANGLE)} end"
    return f"""re_ as (select ord, signal_class, bt,
        case when crash_function is not null and crash_function <> '' and not regexp_matches(crash_function, {noise}) then crash_function end as fn0,
        case when crash_location <> '' then crash_location end as loc0 from iss where top_cwe = 'unknown'),
rfr as (select ord, unnest(bt) as f, generate_subscripts(bt, 1) as pos from re_),
rfr2 as (select ord, pos, {fn} as fn, {ext('f', R.RECOMMEND_LOC)} as loc from rfr where not regexp_matches(f, {noise})),
walk as (select e.ord, e.fn0, e.loc0, rfr2.pos, rfr2.fn, rfr2.loc from re_ e left join rfr2 using (ord)),
acc as (select ord, pos, fn0, loc0,
               coalesce(fn0, first_value(fn ignore nulls) over w) as fn_acc,
               coalesce(loc0, first_value(loc ignore nulls) over w) as loc_acc from walk
        window w as (partition by ord order by pos rows between unbounded preceding and current row)),
stopped as (select ord, min(pos) as stop_pos from acc where fn_acc is not null and fn_acc <> {q(R.OPTIMIZED_OUT)} group by ord),
pick as (select a.ord, a.fn0, a.loc0,
                case when (a.fn0 is null or a.loc0 is null) and a.pos is not null then a.fn_acc else a.fn0 end as fnx,
                case when (a.fn0 is null or a.loc0 is null) and a.pos is not null then a.loc_acc else a.loc0 end as locx,
                row_number() over (partition by a.ord order by case when a.pos = s.stop_pos then 0 else 1 end, a.pos desc nulls last) as rn
         from acc a left join stopped s using (ord)),
px as (select p.ord, p.fnx, p.locx, {adv.replace('signal_class', 'e.signal_class')} as adv0 from pick p join re_ e using (ord) where rn = 1),
py as (select ord, case when fnx is not null and locx is not null then {q(R.FUNCTION_PREFIX + ' ')} || fnx || ' (' || locx || ')'
                        when fnx is not null then {q(R.FUNCTION_PREFIX + ' ')} || fnx when locx is not null then locx else '' end as prefix,
              regexp_replace(adv0, '\\.+$', '') as adv from px)
select ord, case when prefix <> '' then prefix || ': ' || lower(left(adv, 1)) || substr(adv, 2) || '.'
                 else upper(left(adv, 1)) || substr(adv, 2) || '.' end as recommendation from py"""


ORACLE: dict[str, str] | None = None


def oracle_sql() -> dict[str, str]:
    global ORACLE
    if ORACLE is None:
        ORACLE = build()
    return dict(ORACLE)
