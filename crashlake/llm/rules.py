"""Quality rules with distribution divergence, in DataFrame expressions only.

`base` computes the plain counts.  `references` learns from all documents with
a language what its texts look like: the share of each character class, and of
each word that makes up `COMMON` or more of the language's words (so at most
1 / COMMON words a language).  `judged` compares each document's histograms
with every language's by Jensen-Shannon distance (base 2, so 0 to 1); a
document is kept if for some language both distances are small enough.  Short
texts have noisy histograms: below `CLASS_CHARS` characters or `WORD_WORDS`
words the comparison isn't made.

Windows are told apart by 64-bit hashes within their document.  All work on a
document is done in its own row, so nothing is shuffled but the words' counts.

Defined cases: a null text counts as one without words; a document without
words fails the base rules; a null language takes no part in the references;
without any reference the base rules decide; repeated rows repeat; columns
other than doc_id, text and lang aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashlake.llm.common import SPACE_CLASS

WINDOW = 8
LEAST_WORDS = 20
COMMON = 0.004
CLASS_CHARS, WORD_WORDS = 100, 40
CLASS_MAX, WORD_MAX = 0.33, 0.42
SYMBOLS = "#*$%&|<>"
#: Lower-case letters are counted by what removing them takes away, the other classes in what is left.
LOWER, CLASSES = "a-z", ("A-Z", "0-9", SYMBOLS, ".,;:!?'\"()-")
N_CLASSES = len(CLASSES) + 3


def _words(text: str = "text") -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), f"[{SPACE_CLASS}]+", -1), lambda w: w != "")


def _hashes() -> Column:
    return F.transform("_words", lambda w: F.xxhash64(w))


def _with_classes(rows: DataFrame) -> DataFrame:
    """word_chars, and _classes: lower-case letters, each of CLASSES, what is in none of these, white space."""
    rows = rows.withColumns({
        "_rest": F.regexp_replace("_text", f"[{LOWER}{SPACE_CLASS}]+", ""),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
    })
    own = [F.length(F.regexp_replace("_rest", f"[^{c}]+", "")).cast("long") for c in CLASSES]
    other = F.length("_rest") - sum(own[1:], own[0])
    return rows.withColumn("_classes", F.array(F.col("word_chars") - F.length("_rest"), *own, other, F.length("_text") - F.col("word_chars"))).drop("_rest")


def _pair_hashes(c: str, step: int) -> Column:
    """Hash of each element with the one `step` places on; the last `step` ones mean nothing."""
    return F.transform(c, lambda x, i: F.xxhash64(x, F.get(c, i + step)))


def base(docs: DataFrame) -> DataFrame:
    """doc_id, _hashes (of the words), _classes and the base counts of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"), _words().alias("_words"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    rows = _with_classes(rows).withColumns({"n_words": F.size("_words").cast("long"), "_lines": lines, "_hashes": _hashes()})
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_words", "_lines", "_text")
    # windows of two, four and eight words
    rows = rows.withColumn("_w2", _pair_hashes("_hashes", 1)).withColumn("_w4", _pair_hashes("_w2", 2)).withColumn("_w8", _pair_hashes("_w4", 4))
    windows = F.slice("_w8", F.lit(1), F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)).cast("int"))
    rows = rows.withColumn("_windows", windows).drop("_w2", "_w4", "_w8")
    # hashes with their places in order, where one occurs again: equal ones are neighbours
    again = F.size("_windows") > F.size(F.array_distinct("_windows"))
    rows = rows.withColumn("_order", F.when(again, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.filter("_order", lambda x, i: F.coalesce((i > 0) & (F.get("_order", i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get("_order", i + 1)["h"] == x["h"], F.lit(False)))
    rows = rows.withColumn("_places", F.array_sort(F.transform(same, lambda x: x["i"])))
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    rows = rows.withColumns({"n_symbols": F.element_at("_classes", 2 + CLASSES.index(SYMBOLS)), "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long"))})
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_hashes", "_classes"
    )


@dataclass
class References:
    """Per language: shares of the character classes, and of the common words by their slot."""

    languages: list[str]
    classes: list[list[float]]
    words: list[int | None]  # hashes
    shares: list[list[float]]
    low: int = 0  # bits of a word's hash that aren't compared


def references(docs: DataFrame) -> References:
    """Histograms of every language over all its documents.

    Counting is a partial aggregation before one shuffle; what reaches the
    driver is at most 1 / COMMON words and one row of classes per language.
    """
    rows = docs.where(F.col("lang").isNotNull()).select("lang", F.coalesce("text", F.lit("")).alias("_text"), _words().alias("_words"))
    sums = [F.sum(F.col("_classes")[k]).alias(f"c{k}") for k in range(N_CLASSES)]
    sizes = _with_classes(rows).select("lang", F.size("_words").alias("n"), "_classes")
    totals = {r["lang"]: r for r in sizes.groupBy("lang").agg(F.sum("n").alias("n"), *sums).collect()}
    totals = {k: r for k, r in sorted(totals.items()) if r["n"]}
    if not totals:
        return References([], [], [], [])
    names = list(totals)
    # one number for word and language, as such keys are counted fastest: the lowest bits of the hash give way
    low = (1 << max(1, len(names) - 1).bit_length()) - 1
    number = F.create_map(*[x for i, k in enumerate(names) for x in (F.lit(k), F.lit(i).cast("long"))])
    rows = rows.withColumn("_l", number[F.col("lang")]).where(F.col("_l").isNotNull())
    keys = F.transform("_words", lambda w: F.xxhash64(w).bitwiseAND(F.lit(~low)).bitwiseOR(F.col("_l")))
    counted = rows.select(F.explode(keys).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    least = _literal([COMMON * totals[k]["n"] for k in names])
    found = counted.where(F.col("n") >= F.get(least, F.col("k").bitwiseAND(F.lit(low)).cast("int"))).collect()
    found = [(r["k"] & ~low, r["k"] & low, r["n"]) for r in found]
    # the smallest table in which every common word has a slot of its own
    hashes = sorted({h for h, _, _ in found})
    size = max(64, len(hashes))
    while len({h % size for h in hashes}) < len(hashes):
        size += 1
    words: list[int | None] = [None] * size
    for h in hashes:
        words[h % size] = h
    shares = [[0.0] * size for _ in names]
    for h, k, n in found:
        shares[k][h % size] = n / totals[names[k]]["n"]
    classes = [[totals[k][f"c{j}"] / max(sum(totals[k][f"c{i}"] for i in range(N_CLASSES)), 1) for j in range(N_CLASSES)] for k in names]
    return References(names, classes, words, shares, low)


def _half(p: Column, q: Column) -> Column:
    """One bin's part of the Jensen-Shannon divergence."""
    part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return 0.5 * (part(p) + part(q))


def _literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def distances(rows: DataFrame, ref: References) -> DataFrame:
    """Rows of `base` with the distances to each language, `_class_js` and `_word_js`, in the languages' order."""
    if not ref.languages:
        none = F.array().cast("array<double>")
        return rows.withColumns({"_class_js": none, "_word_js": none})
    at = F.sequence(F.lit(0), F.lit(len(ref.languages) - 1))
    table, size = F.array(*[F.lit(w).cast("long") for w in ref.words]), len(ref.words)
    slot = lambda h: F.pmod(h, F.lit(size)).cast("int")
    cut = lambda h: h.bitwiseAND(F.lit(~ref.low))
    rows = rows.withColumn("_slots", F.sort_array(F.transform(F.filter("_hashes", lambda h: F.get(table, slot(cut(h))) == cut(h)), lambda h: slot(cut(h)))))
    starts = F.filter(F.transform("_slots", lambda x, i: i), lambda i: (i == 0) | (F.get("_slots", i) != F.get("_slots", i - 1)))
    rows = rows.withColumn("_starts", starts)
    run = lambda p, k: F.struct(
        F.get("_slots", p).alias("s"), ((F.coalesce(F.get("_starts", k + 1), F.size("_slots")) - p) / F.greatest("n_words", F.lit(1))).alias("p")
    )
    chars = F.greatest(F.aggregate("_classes", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1))
    rows = rows.withColumns({
        "_runs": F.transform("_starts", run),
        "_shares": F.transform("_classes", lambda x: x / chars),
        "_other": (F.col("n_words") - F.size("_slots")) / F.greatest("n_words", F.lit(1)),
    })
    shares, classes = F.array(*map(_literal, ref.shares)), F.array(*map(_literal, ref.classes))
    common = _literal([sum(x) for x in ref.shares])

    def word_js(k: Column) -> Column:
        q = lambda r: F.get(F.get(shares, k), r["s"])
        seen = F.aggregate("_runs", F.struct(F.lit(0.0).alias("js"), F.lit(0.0).alias("q")), lambda a, r: F.struct((a["js"] + _half(r["p"], q(r))).alias("js"), (a["q"] + q(r)).alias("q")))
        total = F.get(common, k)
        return seen, _half(F.col("_other"), 1.0 - total), total

    def distance(k: Column) -> Column:
        seen, other, total = word_js(k)
        js = seen["js"] + other + 0.5 * F.greatest(total - seen["q"], F.lit(0.0))
        return F.sqrt(F.greatest(js, F.lit(0.0)))

    def class_distance(k: Column) -> Column:
        terms = F.zip_with("_shares", F.get(classes, k), _half)
        return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))

    return rows.withColumns({"_class_js": F.transform(at, class_distance), "_word_js": F.transform(at, distance)})


def judged(docs: DataFrame, ref: References | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, class_distance and word_distance (to the nearest language) and kept of each row."""
    ref = references(docs) if ref is None else ref
    rows = distances(base(docs), ref)
    by_class = (F.col("n_words") + F.col("word_chars") < CLASS_CHARS)
    by_word = F.col("n_words") < WORD_WORDS
    fits = F.exists(
        F.arrays_zip("_class_js", "_word_js"), lambda x: (by_class | (x["_class_js"] <= CLASS_MAX)) & (by_word | (x["_word_js"] <= WORD_MAX))
    )
    verdict = ~F.col("base_failed") & (F.lit(not ref.languages) | fits)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"),
        F.array_min("_class_js").alias("class_distance"), F.array_min("_word_js").alias("word_distance"),
    )
