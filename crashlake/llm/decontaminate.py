"""Benchmark decontamination by greedy string tiling.

Tokens are the lower-cased runs of letters and digits.  A document and a test
item that share a seed of `LEAST` tokens are tiled: running Karp-Rabin matching
finds the longest matches of unmarked tokens, which are marked, longest first,
until no match of `LEAST` tokens is left.  Tiles don't overlap and may lie in
any order, so passages that were rearranged or interrupted still count.  A
document is contaminated by an item of which at least `COVERAGE` is tiled.

The benchmark is taken in blocks of at most `BLOCK_CHARACTERS` characters (an
item that is longer is a block of its own), one after another: each is broadcast
and whole documents are searched for it in place, so documents aren't shuffled
and the broadcast has a fixed bound.  Before
tiling, the share of an item's tokens within shared seeds is compared with the
threshold: tiles can't cover more, so nothing is lost.

Defined cases: an item of fewer than `LEAST` tokens must occur whole; an item
without a token matches nothing; a null or empty text is clean; a repeated item
is listed as often as it is there; an empty benchmark leaves every document
clean; repeated documents are judged alike; texts
of any length are searched whole; a column `_items` or `_coverage` is replaced,
other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from crashlake.llm.common import chunks, discard, stored, window_hashes, with_text_columns, word_hashes

LEAST = 5
COVERAGE = 0.5
BLOCK_CHARACTERS = 2_000_000
#: Pairs of equal windows that tiling looks at together.
PAIRS = 1_000_000
_TOKEN = re.compile(r"[^\W_]+")
_BITS = 20


def tokens(text: str | None) -> np.ndarray:
    return word_hashes(_TOKEN.findall(text.lower())) if text else np.empty(0, np.uint64)


def _open_windows(h: np.ndarray, marked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each window without a marked token."""
    if len(h) < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    upto = np.concatenate(([0], np.cumsum(marked)))
    at = np.flatnonzero(upto[width:] == upto[:-width])
    return window_hashes(h, width)[at], at


def _matches(
    item: np.ndarray, doc: np.ndarray, in_item: np.ndarray, in_doc: np.ndarray, p: np.ndarray, p_at: np.ndarray, t: np.ndarray, t_at: np.ndarray, width: int
) -> list[tuple[int, int, int]]:
    """(-length, place in item, place in document) of the maximal matches of unmarked tokens, from the windows p and t that are equal."""
    order = np.argsort(p, kind="stable")
    p, p_at = p[order], p_at[order]
    low, high = np.searchsorted(p, t, "left"), np.searchsorted(p, t, "right")
    hit = np.flatnonzero(high > low)
    counts = (high - low)[hit]
    out: list[tuple[int, int, int]] = []
    for a, b in chunks(counts.tolist(), PAIRS):  # pairs of equal windows, a bounded number at once
        n = counts[a:b]
        j = np.repeat(t_at[hit[a:b]], n)
        i = p_at[np.repeat(low[hit[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        inner = (i > 0) & (j > 0)
        before_i, before_j = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        inner &= (item[before_i] == doc[before_j]) & ~in_item[before_i] & ~in_doc[before_j]
        i, j = i[~inner], j[~inner]  # the others are part of a match that begins before
        length, live = np.zeros(len(i), np.int64), np.arange(len(i))
        while len(live):
            x, y = i[live] + length[live], j[live] + length[live]
            on = (x < len(item)) & (y < len(doc))
            live, x, y = live[on], x[on], y[on]
            live = live[(item[x] == doc[y]) & ~in_item[x] & ~in_doc[y]]
            length[live] += 1
        real = length >= width
        out += zip((-length[real]).tolist(), i[real].tolist(), j[real].tolist(), strict=True)
    return out


def tile(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiles (place in the item, place in the document, length), in the order of marking."""
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out: list[tuple[int, int, int]] = []
    width = max(least, min(len(item), 20))
    while True:
        # scan: all matches of at least `width` tokens that begin where no longer one does
        p, p_at = _open_windows(item, in_item, width)
        t, t_at = _open_windows(doc, in_doc, width)
        found = _matches(item, doc, in_item, in_doc, p, p_at, t, t_at, width)
        longest = max((-n for n, _, _ in found), default=0)
        if longest > 2 * width:
            width = longest
            continue
        # mark: longest first, what a longer one has covered in part is matched again
        found.sort()
        again = False
        for n, i, j in found:
            if in_item[i : i - n].any() or in_doc[j : j - n].any():
                again = True
            else:
                in_item[i : i - n] = in_doc[j : j - n] = True
                out.append((i, j, -n))
        if again:
            continue
        if width <= least:
            return out
        width = max(least, width // 2)


@dataclass
class Block:
    """Some items, with their seeds sorted."""

    ids: list[int]
    items: list[np.ndarray]

    def __post_init__(self) -> None:
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in sorted({min(LEAST, len(x)) for x in self.items if len(x)}):
            own = [(k, window_hashes(x, width)) for k, x in enumerate(self.items) if min(LEAST, len(x)) == width]
            h = np.concatenate([w for _, w in own])
            item, place = np.concatenate([np.full(len(w), k) for k, w in own]), np.concatenate([np.arange(len(w)) for _, w in own])
            order = np.argsort(h, kind="stable")
            some = np.zeros(1 << _BITS, bool)
            some[h >> np.uint64(64 - _BITS)] = True
            self.seeds[width] = h[order], item[order], place[order], some

    def matches(self, text: str | None, coverage: float) -> list[tuple[int, float]]:
        """(id, tiled share) of the items tiled to at least `coverage`."""
        doc = tokens(text)
        out = []
        for width, (seeds, item, place, some) in self.seeds.items():
            h = window_hashes(doc, width)
            h = np.unique(h[some[h >> np.uint64(64 - _BITS)]])
            a, b = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
            hit = np.concatenate([np.arange(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if y > x] or [np.empty(0, np.int64)])
            for k in np.unique(item[hit]).tolist():
                own = self.items[k]
                reach = np.zeros(len(own), bool)
                for s in place[hit[item[hit] == k]].tolist():
                    reach[s : s + width] = True
                if reach.sum() >= coverage * len(own):
                    share = sum(n for _, _, n in tile(own, doc, width)) / len(own)
                    if share >= coverage:
                        out.append((self.ids[k], share))
        return out


def _blocks(items: DataFrame) -> Iterator[Block]:
    """The distinct items (item_id, text, n) in blocks of at most `BLOCK_CHARACTERS`, or one item; one is collected at a time."""
    waiting = [(1, 0)]
    while waiting:
        parts, k = waiting.pop()
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        n, size = own.agg(F.count("*"), F.sum(F.length("text"))).first()
        if n > 1 and size > BLOCK_CHARACTERS:
            waiting += [(2 * parts, k + parts), (2 * parts, k)]
        elif n:
            rows = sorted((r["item_id"] is not None, r["item_id"] or 0, r["text"], r["n"]) for r in own.collect())
            rows = [(i if known else None, t) for known, i, t, n in rows for _ in range(n)]
            yield Block([i for i, _ in rows], [tokens(t) for _, t in rows])


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, keep: list[str] | None = None) -> DataFrame:
    """The rows of `docs` with `_items` (ids of the items found, ascending) and `_coverage` (the largest tiled share).

    One block is held at a time, on the driver and in the tasks: its hits are
    stored (row numbers and item ids) before the next one is collected.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    items = stored(items.groupBy("item_id", "text").agg(F.count("*").alias("n")), "benchmark")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("_items", "_coverage")]
    one = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if one <= BLOCK_CHARACTERS:
        found = _search(docs, next(_blocks(items), Block([], [])), coverage, kept)[0]
        discard(items)
        return found
    place = "_place"
    while place in docs.columns:
        place += "_"
    rows = stored(docs.select("*", F.monotonically_increasing_id().alias(place)), "numbered")
    hits = None
    for block in _blocks(items):
        found, shared = _search(rows, block, coverage, [place])
        own = stored(found.where(F.size("_items") > 0), "hits")
        shared.unpersist(blocking=True)
        hits = own if hits is None else hits.unionByName(own)
    every = hits.groupBy(F.col(place).alias("_hit")).agg(F.sort_array(F.flatten(F.collect_list("_items"))).alias("_items"), F.max("_coverage").alias("_coverage"))
    return rows.drop("_items", "_coverage").join(every, F.col(place) == F.col("_hit"), "left").select(
        *kept, F.coalesce("_items", F.array().cast("array<bigint>")).alias("_items"), F.coalesce("_coverage", F.lit(0.0)).alias("_coverage")
    )


def _search(docs: DataFrame, block: Block, coverage: float, kept: list[str]) -> tuple[DataFrame, Broadcast]:
    """`kept` columns of `docs` with `_items` and `_coverage` of one block, and the block's broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def of(texts: list) -> list:
        got = [sorted(shared.value.matches(t, coverage), key=lambda x: (x[0] is not None, x[0] or 0)) for t in texts]
        return [[[i for i, _ in x] for x in got], [max((c for _, c in x), default=0.0) for x in got]]

    new = [("_items", ArrayType(LongType()), pa.list_(pa.int64())), ("_coverage", DoubleType(), pa.float64())]
    return with_text_columns(docs, new, of, kept), shared
