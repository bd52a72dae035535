"""Ranking, sections and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashlake import rules as R
from crashlake.functions import frames as B
from crashlake.functions.patterns import jre
from crashlake.operators import lookup as E
from crashlake.operators.sequence import numbered


def prioritize(issues: DataFrame) -> DataFrame:
    """E6 + F1: severity level and the sort key (rank desc, duplicates desc, list order asc)."""
    df = issues.withColumn("severity_level", E.severity(F.col("top_cwe"), F.col("signal_class")))
    return df.withColumn("severity_rank", E.severity_rank(F.col("severity_level")))


def priority_order(order_cols: list[str]) -> list[Column]:
    return [F.col("severity_rank").desc(), F.col("duplicate_count").desc(), *[F.col(c).asc() for c in order_cols]]


def sorted_index(df: DataFrame, sort: list[Column], group_cols: list[str] | None = None,
                 out_col: str = "rank") -> DataFrame:
    """1-based position of each row in `sort` order (within `group_cols`); see `sequence.numbered`."""
    return numbered(df, sort, out_col, group_cols).withColumn(out_col, F.col(out_col) + 1)


def split_sections(issues: DataFrame) -> DataFrame:
    """'cwe' issues vs unclassified 'error' issues."""
    return issues.withColumn("section", F.when(F.col("top_cwe") != "unknown", "cwe").otherwise("error"))


def section_rank(issues: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """numbering inside each section by issue rank (or by `order`, which needs no rank); the first 5 / 3 are opened."""
    df = sorted_index(split_sections(issues), order or [F.col("issue_rank").asc()], ["section"], "section_rank")
    limit = F.when(F.col("section") == "cwe", R.SECTION_OPEN_CWE).otherwise(R.SECTION_OPEN_ERROR)
    return df.withColumn("opened", F.col("section_rank") <= limit)


_REC_NOISE = jre(R.RECOMMEND_NOISE)


def recommendation(issues: DataFrame) -> DataFrame:
    """location prefix + advice for the signal class."""
    func0 = F.col("crash_function")
    func0 = F.when(func0.isNotNull() & (func0 != "") & ~func0.rlike(_REC_NOISE), func0)
    loc0 = F.when(F.col("crash_location") != "", F.col("crash_location"))
    frames = F.filter(F.coalesce(F.col("backtrace"), F.array().cast("array<string>")), lambda f: ~f.rlike(_REC_NOISE))
    cand = F.transform(frames, lambda f: F.struct(B.recommend_function(f).alias("fn"),
                                                  B.extract_loc(f).alias("loc")))
    # walk the frames: accumulate first function / location, stop after a usable function
    init = F.struct(func0.alias("fn"), loc0.alias("loc"), F.lit(False).alias("done"))

    def step(acc, c):
        fn = F.coalesce(acc["fn"], c["fn"])
        lc = F.coalesce(acc["loc"], c["loc"])
        stop = fn.isNotNull() & (fn != R.OPTIMIZED_OUT)
        return F.when(acc["done"], acc).otherwise(F.struct(fn.alias("fn"), lc.alias("loc"), stop.alias("done")))

    need = func0.isNull() | loc0.isNull()
    walked = F.when(need & (F.size(frames) > 0), F.aggregate(cand, init, step)).otherwise(init)
    df = issues.withColumn("_w", walked)
    fn, loc = F.col("_w.fn"), F.col("_w.loc")
    prefix = (F.when(fn.isNotNull() & loc.isNotNull(), F.concat(F.lit(R.FUNCTION_PREFIX + " "), fn, F.lit(" ("), loc, F.lit(")")))
               .when(fn.isNotNull(), F.concat(F.lit(R.FUNCTION_PREFIX + " "), fn))
               .when(loc.isNotNull(), loc)
               .otherwise(F.lit("")))
    adv_map = F.create_map(*[F.lit(x) for kv in R.ERROR_ADVICE.items() for x in kv])
    advice = F.coalesce(F.try_element_at(adv_map, F.col("signal_class")), F.lit(R.ERROR_ADVICE_DEFAULT))
    advice = F.regexp_replace(advice, r"\.+$", "")
    lower_first = F.concat(F.lower(F.substring(advice, 1, 1)), F.substr(advice, F.lit(2)))
    upper_first = F.concat(F.upper(F.substring(advice, 1, 1)), F.substr(advice, F.lit(2)))
    text = F.when(prefix != "", F.concat(prefix, F.lit(": "), lower_first, F.lit("."))) \
            .otherwise(F.concat(upper_first, F.lit(".")))
    return df.withColumn("recommendation", text).drop("_w")
