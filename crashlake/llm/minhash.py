"""Near-duplicate documents by MinHash with tensored banding.

A document is the set of its distinct five-word shingles.  Instead of fresh
hashes for each table, `COLLECTIONS` small collections of `WIDTH` minhashes are
computed and every pair of collections forms a table, so 120 tables of four
minhashes need 32 minhashes and not 480.  Two documents meet in a table exactly
if they agree on two collections; at a similarity of 0.75 that is missed with
probability 4e-5, at 0.8 with 2e-6.

Only collections that some other document shares can form a table that does,
so those are found first by counting 16 rows per document, and table keys are
made of these alone.  Candidates are checked on the full sets, in rounds of a
linear number of pairs: first each document with the smallest of the ids it
meets.  The documents in tables that still hold several components meet again
if they share a shingle among the rarest quarter of their sets, as similar sets
must (prefix filter), and are of similar size; there, each is checked with a few
documents of other components per shingle (`CENTRES`, four times as many each
round), which are then done.  Only documents that have the shingle among the
rarest seventh of their sets are taken for that, as the smaller one of two
similar sets has the rarest one that they share: the many documents of a common
passage with surroundings of their own don't, and don't meet.  Before a pair's full sets are brought together,
small bitmaps of the sets bound what they can share, which never rejects a pair
that is similar enough.  The rounds end when no shingle holds two
components and a document to check others with, so no link between components is lost, and what is in one
component is never paired again.  Documents with equal sets are one to all
this and share their links.

Defined cases: fewer than five words make one shingle, the whole sequence; a
text without words (or a null one) has an empty set and no link; rows with the
same id are one document with the links of all of them; a row with a null id is
in no component (null) and kept; repeated rows repeat in the result; an empty
table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from crashlake.llm.common import byte_chunks, discard, mixed, stored, window_hashes, with_text_columns, word_hashes
from crashlake.llm.graph import components

SHINGLE = 5
PERCENT = 75
COLLECTIONS, WIDTH = 16, 2
CENTRES = 4
_random = np.random.default_rng(20240601)
_MUL = _random.integers(0, 1 << 63, COLLECTIONS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 1 << 63, COLLECTIONS * WIDTH, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Ascending 64-bit hashes of a text's distinct shingles."""
    words = (text or "").encode(errors="replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    return np.unique(window_hashes(h, min(SHINGLE, len(h)))) if len(h) >= SHINGLE else window_hashes(h + np.uint64(len(h)), len(h))


def collections(own: np.ndarray) -> np.ndarray:
    """One 64-bit value for each collection of minhashes."""
    least = np.full(COLLECTIONS * WIDTH, np.iinfo(np.uint64).max)
    for a in range(0, len(own), 4096):
        least = np.minimum(least, (own[a : a + 4096, None] * _MUL + _ADD).min(axis=0))
    out = np.zeros(COLLECTIONS, np.uint64)
    for k in range(WIDTH):
        out = mixed(out + (least[k::WIDTH] >> np.uint64(16)))
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets, null for empty ones) and collections of each row."""

    def of(texts: list) -> list:
        sets = [shingles(t) for t in texts]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return [[len(s) for s in sets], keys, [collections(s).view(np.int64) if len(s) else [] for s in sets]]

    new = [("n_shingles", LongType(), pa.int64()), ("set_key", BinaryType(), pa.binary()), ("collections", ArrayType(LongType()), pa.list_(pa.int64()))]
    return with_text_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), new, of, ["doc_id"])


def table_keys(reps: DataFrame) -> DataFrame:
    """(id, n, key): the tables, tensored from pairs of collections, in which a document isn't alone."""
    entries = reps.select("id", "n", F.posexplode("collections").alias("i", "u"))
    shared = entries.groupBy("i", "u").agg(F.min("id").alias("_a"), F.max("id").alias("_b")).where("_a < _b").select("i", "u")
    own = entries.join(shared, ["i", "u"]).groupBy("id", "n").agg(F.sort_array(F.collect_set(F.struct("i", "u"))).alias("c"))  # 16 at most
    pair = lambda x, y: F.xxhash64(x["i"], x["u"], y["i"], y["u"])
    later = lambda x: F.transform(F.filter("c", lambda y: y["i"] > x["i"]), lambda y: pair(x, y))
    keys = stored(own.where(F.size("c") > 1).select("id", "n", F.explode(F.flatten(F.transform("c", later))).alias("key")), "table-keys")
    met = keys.groupBy("key").agg(F.min("id").alias("_a"), F.max("id").alias("_b")).where("_a < _b").select("key")
    out = stored(keys.join(met, "key").select("id", "n", "key"), "met-keys")
    discard(keys)
    return out


def prefix_keys(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, n, key, pos, raised): the shingles of each document's prefix that another's set has, too, and how many of its own are rarer.

    Sets of which 75 % is common share a shingle of their n - ceil(0.75 n) + 1
    rarest ones, rarity being counted over these documents.  Shingles of one
    document take their places in its prefix but can't be met.  A key is a
    shingle and a class of sizes; each document is in its own class and, raised,
    in the next one, where it meets those that aren't raised.
    """
    own = sets.join(ids, "id").select("id", F.size("own").alias("n"), F.explode("own").alias("key"))
    rare = own.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    shared = own.join(rare, "key").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("c"))  # one set
    places = F.col("n") - F.floor((PERCENT * F.col("n") + 99) / 100) + 1 - (F.col("n") - F.size("c"))
    shared = shared.withColumn("r", places.cast("int")).where("r > 0")
    # sizes in the proportion of 3 to 4 or nearer are in one class or in neighbouring ones
    size = F.floor(F.log(F.col("n") + 0.5) / math.log(100 / PERCENT))
    keys = shared.withColumn("k", size).select("id", "n", "k", (F.col("n") - F.size("c")).alias("alone"), F.posexplode(F.slice("c.key", 1, F.col("r"))).alias("at", "key"))
    both = [F.struct(F.xxhash64("key", F.col("k") + up).alias("key"), F.lit(up == 1).alias("raised")) for up in (0, 1)]
    return stored(keys.select("id", "n", (F.col("alone") + F.col("at")).alias("pos"), F.inline(F.array(*both))), "prefix-keys")


def bitmap(own: np.ndarray) -> bytes:
    """A bit for each shingle, in at least four times as many bits, a power of two, as there are shingles."""
    bits = max(64, 4 << max(len(own) - 1, 0).bit_length())
    marked = np.zeros(bits, np.uint8)
    marked[own & np.uint64(bits - 1)] = 1
    return np.packbits(marked).tobytes()


def most_common(n: int, x: bytes, m: int, y: bytes) -> int:
    """At least the number of shingles that sets of sizes n and m share: each bit that only one has is a shingle of its own."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    width = min(len(p), len(q))
    p, q = (np.bitwise_or.reduce(z.reshape(-1, width), axis=0).view(np.uint64) for z in (p, q))
    return min(n - int(np.bitwise_count(p & ~q).sum()), m - int(np.bitwise_count(q & ~p).sum()))


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose bitmaps don't rule out that the sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("_n"), F.col("bits").alias("_x"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("_m"), F.col("bits").alias("_y"))

    def run(batches):
        for batch in batches:
            for part in byte_chunks(batch, batch.schema.get_field_index("_x")):  # _y is at most about twice as long
                keep = []
                for n, x, m, y in zip(*(part.column(c).to_pylist() for c in ("_n", "_x", "_m", "_y")), strict=True):
                    both = most_common(n, x, m, y)
                    keep.append(100 * both >= PERCENT * (n + m - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("own").alias("_x"))
    right = sets.select(F.col("id").alias("b"), F.col("own").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    enough = 100 * both >= PERCENT * (F.size("_x") + F.size("_y") - both)
    return pairs.join(left, "a").join(right, "b").where(enough).select("a", "b")


def _similar_size(n: str, m: str):
    """True if sets of these sizes can be similar enough."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _can_start(n: str, i: str, m: str, j: str):
    """True if sets of sizes n and m can be similar enough when the rarest shingle that they share is at places i and j of them."""
    rest = F.least(F.col(n) - F.col(i), F.col(m) - F.col(j))
    return (100 + PERCENT) * rest >= PERCENT * (F.col(n) + F.col(m))


def _can_lead():
    """True if a set can be the smaller one of two that are similar enough when its place of the key is that of the rarest shingle they share."""
    return (100 + PERCENT) * (F.col("n") - F.col("pos")) >= 2 * PERCENT * F.col("n")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of `docs`."""
    rows = stored(sketch(docs), "sketch")
    known = rows.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    least = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    member = stored(known.select("doc_id", "n_shingles", "set_key", "collections").join(least, "set_key").drop("set_key"), "members")
    copies = member.where(F.col("doc_id") != F.col("rep")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = member.where(F.col("doc_id") == F.col("rep")).select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "collections")
    sources = [table_keys(reps)]  # what `keys` is read from
    keys = sources[0].withColumns({"pos": F.lit(0), "raised": F.lit(False)})

    def full(texts: list) -> list:
        own = [shingles(t) for t in texts]
        return [[x.view(np.int64) for x in own], [bitmap(x) for x in own], [xxhash.xxh3_128_digest(x.tobytes()) for x in own]]

    # a repeated id keeps one of its texts here for each of its sets
    wanted = stored(keys.select("id", "n").distinct(), "candidates")  # of a known size: Spark broadcasts it if small
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id")
    new = [("own", ArrayType(LongType()), pa.list_(pa.int64())), ("bits", BinaryType(), pa.binary()), ("set_key", BinaryType(), pa.binary())]
    sets = with_text_columns(texts, new, full, ["id", "n"]).where(F.size("own") == F.col("n")).dropDuplicates(["id", "set_key"]).select("id", "n", "own", "bits")
    sets = stored(sets, "sets")
    discard(wanted)

    # the first round: each document with the smallest id that it meets
    first = keys.groupBy("key").agg(F.min(F.struct("id", "n")).alias("c"))
    met = keys.join(first, "key").where((F.col("id") != F.col("c.id")) & _similar_size("n", "c.n"))
    pairs = met.groupBy(F.col("id").alias("a")).agg(F.min("c.id").alias("b"))
    links = stored(verified(possible(pairs, sets), sets).unionByName(copies), "links")
    by_table, centres = True, CENTRES
    labels = components(links)
    discard(member, links)
    while True:
        placed = keys.join(labels, "id", "left").select("id", "n", "key", "pos", "raised", F.coalesce("component", "id").alias("comp"))
        held = placed.groupBy("key").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b"), F.max(_can_lead()).alias("_lead"), F.min("raised").alias("_raised"))
        left = stored(placed.join(held.where("_a < _b and _lead and not _raised").select("key"), "key"), "left-keys")
        discard(*sources)
        if left.isEmpty():
            break
        if by_table:
            keys, by_table = prefix_keys(left.select("id").distinct(), sets), False
            discard(left)
            sources = [keys]
            continue
        slot = F.pmod(F.xxhash64("id"), F.lit(centres)).alias("_s")
        centre = left.where(_can_lead()).groupBy("key", slot).agg(F.min(F.struct("id", "n", "pos", "comp", "raised")).alias("c"))
        centre = stored(centre.drop("_s"), "centres")
        can_meet = ~(F.col("raised") & F.col("c.raised")) & _can_start("n", "pos", "c.n", "c.pos")
        met = left.join(centre, "key").where((F.col("comp") != F.col("c.comp")) & can_meet)
        pairs = met.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct()
        links = stored(verified(possible(pairs, sets), sets), "links")
        if not links.isEmpty():
            old, labels = labels, components(links.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b"))))
            discard(old)
        discard(links)
        sources = [left, centre]
        centres *= 4
        done = centre.select("key", F.col("c.id").alias("id"), F.col("c.n").alias("n"))
        keys = left.join(done, ["key", "id", "n"], "left_anti").select("id", "n", "key", "pos", "raised")
    discard(left, sets)
    out = rows.select("doc_id", "n_shingles").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))
