"""Regex dialect helpers.

Spark evaluates `rlike` / `regexp_extract` with java.util.regex (search
semantics, like Python's `re.search`).  `(?d)` (UNIX_LINES) makes `.`, `^`
and `$` treat only `\\n` as a line end, as Python does.  Patterns stay string
literals, so Spark compiles each one once per task, not per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# characters Python's str.strip() removes (Unicode white space plus \x1c-\x1f)
PY_WS = r"[\s\x1c-\x1f]"
# line breaks of Python's str.splitlines()
PY_LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


def jre(pattern: str, i: bool = False, m: bool = False, s: bool = False) -> str:
    flags = "d" + ("i" if i else "") + ("m" if m else "") + ("s" if s else "")
    return f"(?{flags}){pattern}"


def alternation(words: list[str], prefix: bool = False, exact: bool = False) -> str:
    """Regex matching any of the literal `words` (as prefix / whole string)."""
    import re

    body = "|".join(re.escape(w) for w in words)
    if exact:
        return f"^(?:{body})$"
    if prefix:
        return f"^(?:{body})"
    return f"(?:{body})"


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{PY_WS}+|{PY_WS}+$", "")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, however often `body` names it.

    Spark finds equal parts of an expression neither within array functions nor in
    branches, so a value named n times there is computed n times.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, NULL when the pattern does not match."""
    return once(F.regexp_extract(c, pattern, group), lambda x: F.when(x != "", x))


def hex_to_decimal(h: Column) -> Column:
    """'0x...' (any case) to DECIMAL(20,0); unsigned 64-bit range.

    Longer values (beyond 16 significant digits) saturate at the largest
    DECIMAL(20,0), which keeps every address comparison of the rules right.
    """
    return once(F.regexp_replace(F.substr(h, F.lit(3)), "^0+", ""), lambda digits: (
        F.when(digits.isNull(), F.lit(None).cast("decimal(20,0)"))
         .when(digits == "", F.lit(0).cast("decimal(20,0)"))
         .when(F.length(digits) > 16, F.lit("99999999999999999999").cast("decimal(20,0)"))
         .otherwise(F.conv(digits, 16, 10).cast("decimal(20,0)"))))


def dec(v: int) -> Column:
    return F.lit(str(v)).cast("decimal(20,0)")
