"""Removal of repeated substrings with suffix arrays.

Every byte that lies in a `WIDTH`-byte string which starts at two places or
more, in one document or in two, is removed; strings are judged on the input.

All suffixes of a corpus don't fit one array, so the windows of `WIDTH` bytes
are dealt to shards by content.  A window's anchor is the place of its smallest
`GRAM`-byte hash; equal windows have equal anchors.  Consecutive windows with
one anchor form a piece.  Pieces with equal bytes are counted before anything
is moved: all windows of a piece that is there twice are repeated, and one of
them stands for all.  Anchors with one distinct piece are done; of the others
the pieces' bytes are fetched and sorted by anchor into shards.

A shard's suffix array (Larsson-Sadakane) and common prefixes (Kasai) tell
which of its windows are there twice.  An anchor may straddle shards of a task;
then its windows in one are looked up in the other's suffix array by binary
search.  An anchor with more than `HOT` distinct pieces (a passage that very
many documents share, each with its own surroundings) isn't gathered in a task:
its windows are counted by a 128-bit hash instead, which gives the same result.

Defined cases: texts of fewer than `WIDTH` bytes, empty or null ones keep all;
copies of a document of `WIDTH` bytes or more are removed whole; rows with equal
ids are documents of their own; an empty table gives an empty result; columns
other than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from crashlake.llm.common import byte_chunks, discard, mixed, stored, with_text_columns
from crashlake.llm.suffix import found_in, joined, repeated
from crashlake.operators.bloom import key_bits, may_hold, where_key_in

WIDTH = 400
GRAM = 32
HOT = 2000
SHARD_BYTES = 1_000_000
#: Texts are cut to blocks of so many windows, so a very long one needs no more memory than others.
WINDOWS = 1 << 21
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PIECE = pa.struct([("h", pa.int64()), ("ph", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place (by doubling)."""
    h, n = _TABLE[data], 1
    while n < GRAM:
        h = h[: len(h) - n] * np.uint64(0x9E3779B97F4A7C15 + 2 * n) + h[n:]
        n *= 2
    return mixed(h)


def anchors(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each `width` consecutive hashes, the leftmost of equal ones."""
    low = np.uint64((1 << 24) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    n = 1
    while 2 * n <= width:
        least = np.minimum(least[: len(least) - n], least[n:])
        n *= 2
    rest = width - n
    return ((least if not rest else np.minimum(least[: len(least) - rest], least[rest:])) & low).astype(np.int64)


def cut(texts: list, width: int = WIDTH) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each text the number of its pieces, and the columns h, ph, s, e (first and last window) of all pieces."""
    counts = np.zeros(len(texts), np.int64)
    out: list[list[np.ndarray]] = [[], [], [], []]
    block, held = [], 0

    def flush() -> None:
        nonlocal block, held
        if not block:
            return
        data = b"".join(d for _, d, _ in block)
        h = gram_hashes(np.frombuffer(data, np.uint8))
        m = anchors(h, width - GRAM + 1)
        begin = np.cumsum([0] + [len(d) for _, d, _ in block])
        valid = np.zeros(len(m), bool)
        owner = np.zeros(len(m), np.int64)
        for k, (_, d, _) in enumerate(block):
            valid[begin[k] : begin[k] + len(d) - width + 1] = True
            owner[begin[k] : begin[k + 1]] = k
        at = np.flatnonzero(valid)
        new = np.concatenate(([True], (m[at[1:]] != m[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])))
        s = at[new]
        e = at[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(at) - 1]))]
        own = owner[s]
        view = memoryview(data)
        ph = np.fromiter((xxhash.xxh3_64_intdigest(view[a : b + width]) for a, b in zip(s.tolist(), e.tolist(), strict=True)), np.uint64, len(s))
        base = np.array([o for _, _, o in block]) - begin[:-1]
        np.add.at(counts, np.array([i for i, _, _ in block])[own], 1)
        for column, x in zip(out, (h[m[s]].view(np.int64), ph.view(np.int64), s + base[own], e + base[own]), strict=True):
            column.append(x)
        block, held = [], 0

    for i, t in enumerate(texts):
        data = t.encode(errors="replace") if t else b""
        for a in range(0, len(data) - width + 1, WINDOWS):
            part = data[a : a + WINDOWS + width - 1]
            if held and held + len(part) > 2 * WINDOWS:
                flush()
            block.append((i, part, a))
            held += len(part)
    flush()
    return counts, [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]


def pieces(docs: DataFrame) -> DataFrame:
    """doc_id, key, size (of the text; copies have equal ones), h, ph, s, e of each piece."""

    def of(texts: list) -> list:
        counts, columns = cut(texts)
        rows = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(_PIECE))
        return [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), rows)]

    fields = StructType([StructField(n, LongType()) for n in ("h", "ph", "s", "e")])
    rows = with_text_columns(keyed(docs), [("_p", ArrayType(fields), pa.list_(_PIECE))], of, ["doc_id", "key", "size"])
    return rows.select("doc_id", "key", "size", F.inline("_p"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, its 64-bit hash and its size; texts that agree in both are taken as copies (at 10^10 texts, one pair in a thousand corpora isn't)."""
    whole = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole).alias("key"), F.octet_length(whole).alias("size"), "text")


def _runs(marked: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marked.view(np.int8), [0]))))
    yield from zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True)


class _Shard:
    """Pieces of some anchors, which of their windows are repeated, and the suffix array."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        self.text, self.starts = joined([r[-1] for r in rows])
        self.marked, self.order = repeated(self.text, WIDTH)
        self.valid = np.zeros(len(self.text), bool)
        for a, r in zip(self.starts.tolist(), rows, strict=True):
            self.valid[a : a + len(r[-1]) - WIDTH + 1] = True

    def windows(self, h: int) -> np.ndarray:
        """Places of the windows of an anchor."""
        own = [np.arange(a, a + len(r[-1]) - WIDTH + 1) for a, r in zip(self.starts.tolist(), self.rows, strict=True) if r[0] == h]
        return np.concatenate(own)

    def merge(self, other: _Shard, h: int) -> None:
        """Mark the windows of anchor h that are in both shards, here and there."""
        at = self.windows(h)
        order = other.order[other.valid[other.order]]
        hit, place = found_in(self.text, at, other.text, order, WIDTH)
        self.marked[at[hit]] = True
        other.marked[order[place[hit]]] = True
        # equal windows beside the one found are marked already, as they repeat within their shard

    def spans(self) -> Iterator[tuple]:
        for a, r in zip(self.starts.tolist(), self.rows, strict=True):
            for x, y in _runs(self.marked[a : a + len(r[-1]) - WIDTH + 1]):
                yield r[1], r[2], r[3] + x, r[3] + y


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch whose last column is bytes, converted a few MB at a time."""
    for part in byte_chunks(batch, batch.num_columns - 1):
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, size, s, e) of the repeated windows in rows (h, ph, key, size, s, data) sorted by h and ph."""

    def out(shard: _Shard) -> pa.RecordBatch:
        got = list(shard.spans())
        columns = [pa.array([x[i] for x in got], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["key", "size", "s", "e"])

    def shards() -> Iterator[list[tuple]]:
        rows: list[tuple] = []
        held, last = 0, None
        for batch in batches:
            for h, ph, key, size, s, data in _rows_of(batch):
                if last == (h, ph):
                    continue  # a repeated row of the table: equal ids and texts
                last = h, ph
                if held >= SHARD_BYTES or len(rows) >= 30_000:
                    yield rows
                    rows, held = [], 0
                rows.append((h, key, size, s, data))
                held += len(data)
        if rows:
            yield rows

    open_shards: list[_Shard] = []  # those that hold the last anchor, which may go on
    for rows in shards():
        shard = _Shard(rows)
        first = rows[0][0]
        if open_shards and open_shards[-1].rows[-1][0] == first:
            for other in open_shards:
                shard.merge(other, first)
            if rows[-1][0] != first:
                yield from map(out, open_shards)
                open_shards = []
        else:
            yield from map(out, open_shards)
            open_shards = []
        open_shards.append(shard)
    yield from map(out, open_shards)


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, key, size, s) of each window in rows (h, ph, key, size, s, data)."""
    for batch in batches:
        for _, _, key, size, s, data in _rows_of(batch):
            n = len(data) - WIDTH + 1
            w = [xxhash.xxh3_128_digest(data[i : i + WIDTH]) for i in range(n)]
            columns = [pa.array(w, pa.binary()), pa.array([key] * n, pa.int64()), pa.array([size] * n, pa.int32()), pa.array(np.arange(s, s + n))]
            yield pa.RecordBatch.from_arrays(columns, names=["w", "key", "size", "s"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(key, size, s, e): runs of first bytes, from s to e, of repeated windows in the texts with a key and size."""
    spark = docs.sparkSession
    every = stored(pieces(docs), "pieces")
    distinct = every.groupBy("h", "ph").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "size", "s", "e")).alias("one"))
    distinct = stored(distinct, "distinct-pieces")
    twice = distinct.where("n > 1").select("h", "ph")
    spans = stored(every.join(twice, ["h", "ph"]).select("key", "size", "s", "e").distinct(), "equal-pieces")
    discard(every)

    variants = distinct.groupBy("h").agg(F.count("*").alias("variants")).where("variants > 1")
    wanted = distinct.join(variants, "h").select("h", "ph", "one.*", (F.col("variants") > HOT).alias("hot"))
    of_doc = wanted.groupBy("doc_id", "key", "size").agg(F.collect_list(F.struct("h", "ph", "s", "e", "hot")).alias("_w"))
    of_doc = stored(of_doc.withColumnsRenamed({"doc_id": "_d", "key": "_k", "size": "_n"}), "wanted")
    discard(distinct)
    # a Bloom filter keeps most texts without a wanted piece from being moved
    some = where_key_in(keyed(docs), of_doc.select(F.col("_k").alias("key")), "key")
    texts = some.join(of_doc, (F.col("key") == F.col("_k")) & (F.col("size") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    texts = texts.select("key", "size", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.explode("_w").alias("w"))
    data = F.substring(F.col("text"), (F.col("w.s") + 1).cast("int"), (F.col("w.e") - F.col("w.s") + WIDTH).cast("int"))
    taken = texts.select("w.h", "w.ph", "key", "size", "w.s", data.alias("data"), "w.hot")

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cold = taken.where(~F.col("hot")).drop("hot").repartition(n, "h").sortWithinPartitions("h", "ph")
    sharded = stored(cold.mapInArrow(_sharded, "key long, size int, s long, e long"), "suffix-spans")
    spans = spans.unionByName(sharded)
    if not of_doc.where(F.exists("_w", lambda w: w["hot"])).isEmpty():
        windows = taken.where("hot").drop("hot").dropDuplicates(["h", "ph"]).mapInArrow(_window_hashes, "w binary, key long, size int, s long")
        windows = stored(windows, "hot-windows")
        again = windows.groupBy("w").agg(F.count("*").alias("_n")).where("_n > 1").select("w")
        hot = stored(windows.join(again, "w").select("key", "size", "s", F.col("s").alias("e")), "hot-spans")
        discard(windows)
        spans = spans.unionByName(hot)
    discard(of_doc)
    return spans


def _removed(text: str | None, starts: list, ends: list) -> tuple[int, int, int, str]:
    data = text.encode(errors="replace") if text else b""
    order = np.argsort(np.array(starts, np.int64))
    kept, at, gone, spans = hashlib.sha256(), 0, 0, 0
    reach = -1
    for a, b in zip(np.array(starts, np.int64)[order].tolist(), np.array(ends, np.int64)[order].tolist(), strict=True):
        if a > reach:
            spans += 1
            kept.update(data[at:a])
            at = a
        reach = max(reach, b + WIDTH)
        gone += max(0, reach - at)
        at = max(at, reach)
    kept.update(data[at:])
    return len(data), gone, spans, kept.hexdigest()


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of `docs`."""
    own = repeated_windows(docs).groupBy("key", "size").agg(F.collect_set(F.struct("s", "e")).alias("_r"))  # at most one a byte
    own = stored(own.withColumnsRenamed({"key": "_k", "size": "_n"}), "spans")
    # texts that the Bloom filter rules out keep all and aren't moved; the join sorts out the rest
    marked, every = key_bits(own.select(F.col("_k").alias("key")), "key"), keyed(docs)
    may = every.withColumn("_bits", marked).withColumn("_may", may_hold(F.col("_bits"), F.col("key"))).drop("_bits")
    whole = may.where(~F.col("_may")).select(
        "doc_id", F.col("size").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
    rows = may.where("_may").join(own, (F.col("key") == F.col("_k")) & (F.col("size") == F.col("_n")), "left")
    rows = rows.select("doc_id", "text", F.coalesce(F.col("_r.s"), F.array().cast("array<bigint>")).alias("_s"), F.coalesce(F.col("_r.e"), F.array().cast("array<bigint>")).alias("_e"))
    schema = StructType([
        StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("n_removed", LongType()),
        StructField("n_spans", LongType()), StructField("kept_sha256", StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_chunks(batch, 1):
                got = [_removed(*x) for x in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)]
                columns = [pa.array([g[i] for g in got], pa.string() if i == 3 else pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)

    return rows.mapInArrow(run, schema).unionByName(whole)
