"""Helpers shared by the training-data operators.

Words are `[^\\x20\\x09-\\x0D]+`: Python's `bytes.split()` splits on exactly
those six characters, and `bytes.lower()` lower-cases exactly A-Z.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from crashlake.session import ensure_checkpoint_dir

SPACE_CLASS = "\\x20\\x09-\\x0D"
#: Words whose hash a task remembers; forgetting them costs time only.
REMEMBERED = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % mod, F.lit(-1))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the folders of `stored` frames whose last reader is done."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def in_order(df: DataFrame, groups: list[str], order: list[str], name: str, dealt: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Number the rows of each group without gathering a group in one task.

    dealt: what partitions are cut by in place of `order`, if that has long values; `order` refines it.

    Returns the stored rows, range-partitioned by groups and order, with `_pid`
    and `_at` (the place in the partition), and one row per partition and group:
    `_pid`, the groups, `_shift` (a row's position in its group, from 0, is
    `_at` + `_shift`) and `_total`, the rows of the group.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in (*groups, *order)]
    cuts = keys if dealt is None else [*map(F.col, groups), *dealt]
    ranged = df.repartitionByRange(n, *cuts).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the bits above are the partition's
    rows = stored(ranged.select("*", F.spark_partition_id().alias("_pid"), at.alias("_at")), name)
    parts = rows.groupBy("_pid", *groups).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy(*groups)  # a group has one row per partition at most
    before = F.coalesce(F.sum("_n").over(own.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows, parts.select("_pid", *groups, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("_total"))


def placed(rows: DataFrame, parts: DataFrame, groups: list[str], pos: str = "pos") -> DataFrame:
    """Rows of `in_order` with their position and the other columns of `parts`."""
    own = parts.select(*(F.col(c).alias(f"_of_{c}") for c in ("_pid", *groups)), *(c for c in parts.columns if c not in ("_pid", *groups)))
    on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in ("_pid", *groups)]
    out = rows.join(own, on).withColumn(pos, F.col("_at") + F.col("_shift"))
    return out.drop("_pid", "_at", "_shift", *(f"_of_{c}" for c in ("_pid", *groups)))


#: What this worker's operators remember between tasks: name and how to forget it.
_kept: dict[str, Callable[[], object]] = {}


def only(name: str, forget: Callable[[], object] | None = None) -> None:
    """Workers serve one operator after another: forget what any but operator `name` remembers, which says how to forget its own."""
    for other in [x for x in _kept if x != name]:
        _kept.pop(other)()
    if forget is not None:
        _kept[name] = forget


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


_hashes = _Hashes()


def rest() -> None:
    """At the end of a task: forget word hashes and return memory, as Spark keeps idle workers beside those that it runs."""
    _hashes.clear()
    pa.default_memory_pool().release_unused()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    _kept["words"] = _hashes.clear
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each run of `width` consecutive word hashes."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
    return mixed(out)


def chunks(sizes: Sequence[int], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive values that hold `most` bytes together at most, or one value."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


LETTER = re.compile(r"[^\W\d_]")


def byte_chunks(batch: pa.RecordBatch, at: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose column `at` holds about `most` bytes, or one row; nothing is converted before."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    for a, b in chunks(sizes.tolist(), most):
        yield batch.slice(a, b - a)


def with_columns(df: DataFrame, column: str, new: Sequence[tuple[str, DataType, pa.DataType]], of: Callable[[list], list], keep: list[str] | None = None) -> DataFrame:
    """Append columns computed from lists of whole values of `column`; the rest passes as Arrow, unconverted.

    keep: the columns of `df` to return, all of them if not given; one that has the name of a new one is replaced.
    """
    at = df.columns.index(column)
    kept = [i for i, c in enumerate(df.columns) if c not in {n for n, _, _ in new}] if keep is None else [df.columns.index(c) for c in keep]
    schema = StructType([*(df.schema.fields[i] for i in kept), *(StructField(n, t) for n, t, _ in new)])
    names, kinds = schema.names, [k for _, _, k in new]

    name = of.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(name)
        try:
            for batch in batches:
                for part in byte_chunks(batch, at):
                    own = [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(of(part.column(at).to_pylist()), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *own], names=names)
                batch = part = own = None  # before the next one is read
        finally:
            rest()

    return df.mapInArrow(run, schema)


def with_text_columns(df: DataFrame, new: Sequence[tuple[str, DataType, pa.DataType]], of: Callable[[list], list], keep: list[str] | None = None) -> DataFrame:
    """`with_columns` of column `text`."""
    return with_columns(df, "text", new, of, keep)
