"""Backtrace functions (B1–B6, B9): column expressions over ARRAY<STRING> frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crashlake import rules as R
from crashlake.functions.patterns import alternation, extract, jre, once, py_strip

_NOISE = jre(R.DEDUP_NOISE)
_FUNC_IN = jre(R.NORMALIZE_FUNC)
_AT_LOC = jre(R.NORMALIZE_LOC)
_HEX = jre(R.HEX_ADDRESS, i=True)


def meaningful_frames(bt: Column) -> Column:
    """B1: frames without libc/sanitizer/signal noise; all frames if every one is noise."""
    return once(F.filter(bt, lambda f: ~f.rlike(_NOISE)), lambda kept: F.when(F.size(kept) == 0, bt).otherwise(kept))


def normalize_frame(f: Column) -> Column:
    """B2: 'func file:line', 'func', or the frame without addresses cut at '+'."""
    fallback = py_strip(F.substring_index(F.regexp_replace(f, _HEX, ""), "+", 1))
    found = F.struct(F.regexp_extract(f, _FUNC_IN, 1).alias("func"), F.regexp_extract(f, _AT_LOC, 1).alias("loc"))
    return once(found, lambda x: (F.when((x["func"] != "") & (x["loc"] != ""), F.concat(x["func"], F.lit(" "), x["loc"]))
                                  .when(x["func"] != "", x["func"])
                                  .otherwise(fallback)))


def hash_frames(bt: Column) -> Column:
    """Normalized first frames that feed the stack hash."""
    top = F.filter(F.slice(meaningful_frames(bt), 1, R.STACK_HASH_FRAMES), lambda f: f != "")
    return F.transform(top, normalize_frame)


def stack_hash(bt: Column) -> Column:
    """First 16 hex chars of SHA-1 over the pipe-joined normalized top frames."""
    def h(frames: Column) -> Column:
        return F.substring(F.sha1(F.array_join(frames, "|").cast("binary")), 1, R.STACK_HASH_HEX_CHARS)

    none = F.lit(None).cast("string")
    return F.when(bt.isNull() | (F.size(bt) == 0), none).otherwise(
        once(hash_frames(bt), lambda frames: F.when(F.size(frames) == 0, none).otherwise(h(frames))))


def engine_function(f: Column) -> Column:
    """B4 variant used by the heuristics: `in NAME(`, word characters only."""
    return extract(f, jre(R.ENGINE_FUNC))


def taxonomy_function(f: Column) -> Column:
    """B4 variant used by taxonomy and user-frame search: `in NAME(` with '::'."""
    return extract(f, jre(R.TAXONOMY_FUNC))


def recommend_function(f: Column) -> Column:
    """B4 variant used by recommendations: `in NAME(` unless 'optimized'/'out', else `<NAME+`."""
    m = F.regexp_extract(f, jre(R.RECOMMEND_FUNC), 1)
    angle = extract(f, jre(R.RECOMMEND_FUNC_ANGLE))
    return F.when((m != "") & ~m.isin(*R.RECOMMEND_FUNC_REJECT), m).otherwise(angle)


_LIBC_PATH = jre(R.LIBC_PATH)
_USER_NOISE_PREFIX = jre(alternation(R.USER_FRAME_NOISE_PREFIXES, prefix=True))


def first_user_frame(bt: Column) -> Column:
    """STRUCT<func, loc> of the first non-libc, non-noise frame with a function or location."""
    cand = F.transform(bt, lambda f: F.struct(
        extract(f, jre(R.USER_FRAME_FUNC)).alias("func"),
        extract(f, jre(R.USER_FRAME_LOC)).alias("loc"),
        f.rlike(_LIBC_PATH).alias("libc"),
    ))
    keep = F.filter(cand, lambda c: ~c["libc"]
                    & (c["func"].isNull() | ~c["func"].rlike(_USER_NOISE_PREFIX))
                    & (c["func"].isNotNull() | c["loc"].isNotNull()))
    return once(F.try_element_at(keep, F.lit(1)), lambda first: F.struct(first["func"].alias("func"), first["loc"].alias("loc")))


_SAN_FRAME = jre(R.SANITIZER_FRAME)
_SAN_NOISE_PREFIX = jre(alternation(R.SANITIZER_NOISE_PREFIXES, prefix=True))


def first_sanitizer_loc(raw: Column) -> Column:
    """STRUCT<func, loc> of the first sanitizer frame whose function is not sanitizer noise."""
    funcs = F.regexp_extract_all(raw, F.lit(_SAN_FRAME), F.lit(1))
    files = F.regexp_extract_all(raw, F.lit(_SAN_FRAME), F.lit(2))
    lines = F.regexp_extract_all(raw, F.lit(_SAN_FRAME), F.lit(3))
    frames = F.arrays_zip(funcs.alias("func"), files.alias("file"), lines.alias("line"))
    found = F.try_element_at(F.filter(frames, lambda x: ~x["func"].rlike(_SAN_NOISE_PREFIX)), F.lit(1))
    return once(F.when(raw.contains("#") & raw.contains("0x"), found), lambda first: F.struct(
        first["func"].alias("func"), F.concat(first["file"], F.lit(":"), first["line"]).alias("loc")))


def log_tail(raw: Column, n: int = R.EVIDENCE_TAIL_CHARS) -> Column:
    """Last `n` characters."""
    return F.when(F.length(raw) <= n, raw).otherwise(F.substring(raw, -n, n))


def extract_loc(f: Column) -> Column:
    """`at file:line` anywhere in a frame (recommendation variant)."""
    return extract(f, jre(R.RECOMMEND_LOC))
