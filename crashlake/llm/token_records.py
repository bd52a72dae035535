"""Token ids as length-delimited binary records with a separate offset index.

Each document becomes one frame of a shard file, TFRecord style:

    uint64 length | uint32 masked checksum of the length | payload | uint32 masked checksum of the payload

all little-endian.  The checksum is CRC-32, masked by a rotation and a constant
so that a checksum stored inside a payload doesn't check itself.  The payload is
a `HEAD` (document id, null flag, bytes per token id) and the ids.  The index
file beside a shard holds one `ENTRY` per frame: a reader can seek to any
record, so an epoch can be read in shuffled order without reading a shard whole.

Documents are range-partitioned by id, so shard after shard holds them in
ascending id order; each task writes its own shard, in files of about `ROLL`
bytes.  A task that is run again writes new files; the manifest, written by
Spark's committer, names the files of successful tasks only.

Defined cases: a null text is encoded as an empty one (just the end id); a null
id sorts first; rows with equal ids are ordered by the text's hash; texts of any
length are encoded whole, in blocks; an empty table gives an empty manifest;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crashlake.llm.common import byte_chunks, only, shared_folder
from crashlake.llm.parts import CHARACTERS, share

HEAD = "<qBBH"  # document id, 1 if the id is null, bytes per token id, 0
ENTRY = np.dtype([("offset", "<u8"), ("length", "<u8"), ("n_tokens", "<u8"), ("doc_id", "<i8"), ("is_null", "u1")])
FRAME_BYTES = 16
MASK_DELTA = 0xA282EAD8
RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary, shard int, offset long"
MANIFEST = "shard int, file int, path string, n_docs long, n_tokens long, n_bytes long"
#: A shard's file is followed by another one beyond so many bytes, so its index stays small.
ROLL = 1 << 28
#: Characters of a text encoded at once, and parts joined to one text.
BLOCK = 4_000_000
JOINED = 5000
_UNSAFE = re.compile(r" (?:\s|$)|\0")
_BEFORE_WORD = re.compile(r"(?= \S)")
_JOINS = re.compile(r" \S|[,.\n][^\W_]")
#: A mark or line break that follows a letter or digit.
_AFTER_WORD = re.compile(r"(?s)[,.\n](?<=[^\W_].)")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes, at: str = "") -> bytes:
    """The payload of one frame; ValueError if a checksum or the length is wrong."""
    if len(data) < FRAME_BYTES or struct.unpack_from("<I", data, 8)[0] != masked_crc(data[:8]):
        raise ValueError(f"damaged record length {at}")
    n = struct.unpack_from("<Q", data)[0]
    payload = data[12 : 12 + n]
    if len(data) != n + FRAME_BYTES or struct.unpack_from("<I", data, 12 + n)[0] != masked_crc(payload):
        raise ValueError(f"damaged record {at}")
    return payload


class Encoder:
    """Ids of many texts, each distinct part given to the tokenizer once.

    A byte-level BPE tokenizer always ends a piece before a space that a
    non-space follows, and between a letter or digit and a comma, full stop or
    line break, so a text can be cut there and its parts encoded apart.  Parts
    cut so are given to it joined again, many in one text; their ids are told
    apart by the bytes of each token.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        #: A text with one of these is cut before spaces only.
        self.whole = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes of each token: byte-level tokens have one character a byte.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.token_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        self.token_bytes[np.fromiter(vocabulary.values(), np.int64, len(vocabulary))] = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
        for i, x in self.tokenizer.get_added_tokens_decoder().items():
            self.token_bytes[i] = len(x.content.encode())
        #: Ids of each part, as they are stored.
        self.code: dict[str, bytes] = {}
        self.held = 0
        self.kind = np.dtype(f"<u{self.width}")
        self.end = np.array([end_id], self.kind).tobytes()

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(lens.sum())), lens

    def _learn(self, new: list[str]) -> None:
        # parts that begin with a space, or else end in a letter or digit, can be joined among themselves
        joins = np.fromiter(((x[0] == " ") + 2 * x[-1].isalnum() if _JOINS.match(x) else 0 for x in new), np.int64, len(new))
        spaced, other, rest = np.flatnonzero(joins & 1), np.flatnonzero(joins == 2), np.flatnonzero(joins == 0)
        for own in [x[a : a + JOINED] for x in (spaced, other) for a in range(0, len(x), JOINED)]:
            texts = [new[k] for k in own.tolist()]
            flat, _ = self._ids(["".join(texts)])
            ends = np.cumsum(self.token_bytes[flat])
            self._add(texts, flat, np.searchsorted(ends, np.cumsum([len(x.encode()) for x in texts]), "right"))
        texts = [new[k] for k in rest.tolist()]
        flat, lens = self._ids(texts)
        self._add(texts, flat, np.cumsum(lens))

    def _add(self, parts: list[str], flat: np.ndarray, ends: np.ndarray) -> None:
        data, cuts = flat.astype(self.kind).tobytes(), [0, *(ends * self.width).tolist()]
        self.code.update(zip(parts, [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
        self.held += sum(map(len, parts))

    def _parts(self, text: str | None) -> list[str]:
        if not text:
            return []
        if _UNSAFE.search(text) or any(x in text for x in self.whole):
            return [x for x in _BEFORE_WORD.split(text) if x]
        out = _AFTER_WORD.sub("\0\\g<0>", text).replace(" ", "\0 ").split("\0")
        return out if out[0] else out[1:]

    def _encoded(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of texts given as their parts."""
        if len(self.code) > share() or self.held > CHARACTERS:
            self.code.clear()
            self.held = 0
        code = self.code
        if new := list({p: None for parts in texts for p in parts if p not in code}):
            self._learn(new)
        return [b"".join(map(code.__getitem__, parts)) for parts in texts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, with the end id, as they are stored."""
        if len(texts) > 1 or len(texts[0] or "") <= BLOCK:
            return [x + self.end for x in self._encoded([self._parts(t) for t in texts])]
        # a very long text, block by block
        text, at, found = texts[0], 0, []
        while at < len(text):
            cut = _BEFORE_WORD.search(text, at + BLOCK)
            end = cut.start() if cut else len(text)
            found += self._encoded([self._parts(text[at:end])])
            at = end
        return [b"".join([*found, self.end])]


@functools.cache
def encoder_of(path: str, end_id: int) -> Encoder:
    """One encoder per worker, so that later tasks find what earlier ones learned."""
    return Encoder(path, end_id)


def _store(path: str):
    """File system and path of a URI or plain path, for tasks."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    path = re.sub("^s3[an]:", "s3:", path)  # Hadoop's names
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


@dataclass
class RecordSet:
    """A finished set of shards: its folder and manifest."""

    spark: SparkSession
    path: str

    @property
    def manifest(self) -> DataFrame:
        """One row per file, with the ids before it: summed within a shard, and over the shards (one row per task that wrote)."""
        files = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
        shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
        shards = shards.select(F.col("shard").alias("_s"), F.coalesce(F.sum("_n").over(before(Window.orderBy("shard"))), F.lit(0)).alias("_start"))
        own = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("shard").orderBy("file"))), F.lit(0))
        files = files.withColumn("_own", own).join(shards, F.col("shard") == F.col("_s"))
        return files.withColumn("start", F.col("_start") + F.col("_own")).drop("_s", "_start", "_own")

    def read(self, seed: int | None = None) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 and ids of each record; checksums are checked.

        With a seed the records of each file are read in shuffled order, through the index.
        """

        def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for files in parts:
                for f in files.to_pylist():
                    yield from _read_file(f["path"], f["start"], f["shard"], f["file"], seed)

        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        files = self.manifest.repartition(n, "shard", "file")
        return files.mapInArrow(read, RECORDS)


def _read_file(path: str, start: int, shard: int, number: int, seed: int | None) -> Iterator[pa.RecordBatch]:
    fs, at = _store(path)
    with fs.open_input_file(at + ".idx") as f:
        raw = f.read()
    if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError(f"damaged index {path}.idx")
    index = np.frombuffer(raw[:-4], ENTRY)
    starts = start + np.cumsum(index["n_tokens"]).astype(np.int64) - index["n_tokens"].astype(np.int64)
    order = np.arange(len(index)) if seed is None else np.random.default_rng((seed, shard, number)).permutation(len(index))
    with fs.open_input_file(at) as f:
        rows, held = [], 0
        for k in order.tolist():
            e = index[k]
            f.seek(int(e["offset"]))
            payload = unframe(f.read(int(e["length"])), f"{path} at {e['offset']}")
            doc, is_null, width, _ = struct.unpack_from(HEAD, payload)
            ids = np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(HEAD)).astype("<u4").tobytes()
            rows.append((None if is_null else doc, int(starts[k]), len(ids) // 4, zlib.crc32(ids), ids, shard, int(e["offset"])))
            held += len(ids)
            if held > 8_000_000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RECORDS.split(", ")])


class _Writer:
    """One file of records and, on closing, the index beside it."""

    def __init__(self, path: str):
        self.path = path
        self.fs, self.at = _store(path)
        self.fs.create_dir(self.at.rsplit("/", 1)[0], recursive=True)
        self.file = self.fs.open_output_stream(self.at)
        self.entries, self.offset, self.n_tokens = [], 0, 0

    def add(self, doc: np.ndarray, is_null: np.ndarray, ids: list[bytes], width: int) -> None:
        own = np.zeros(len(doc), ENTRY)
        own["doc_id"], own["is_null"], own["n_tokens"] = doc, is_null, np.fromiter(map(len, ids), np.int64, len(ids)) // width
        out = [frame(struct.pack(HEAD, i, n, width, 0) + x) for i, n, x in zip(doc.tolist(), is_null.tolist(), ids, strict=True)]
        own["length"] = lens = np.fromiter(map(len, out), np.uint64, len(out))
        own["offset"] = np.uint64(self.offset) + np.cumsum(lens) - lens
        self.file.write(b"".join(out))
        self.offset += int(lens.sum())
        self.n_tokens += int(own["n_tokens"].sum())
        self.entries.append(own)

    def close(self, shard: int, number: int) -> pa.RecordBatch:
        """The file's row of the manifest."""
        self.file.close()
        index = np.concatenate(self.entries).tobytes()
        with self.fs.open_output_stream(self.at + ".idx") as f:
            f.write(index + struct.pack("<I", zlib.crc32(index)))
        row = {"shard": shard, "file": number, "path": self.path, "n_docs": len(index) // ENTRY.itemsize, "n_tokens": self.n_tokens, "n_bytes": self.offset}
        kinds = {"shard": pa.int32(), "file": pa.int32(), "path": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(n, pa.int64())) for n, v in row.items()], names=list(row))


def write_records(docs: DataFrame, tokenizer: str, end_id: int = 2, shards: int | None = None, path: str | None = None) -> RecordSet:
    """Encode `text` of `docs` and write the records in ascending `doc_id` order."""
    spark = docs.sparkSession
    path = path or shared_folder(spark, "token-records")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(__name__, encoder_of.cache_clear)
        shard, number, out = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for part in byte_chunks(batch, 1):
                if out is None:
                    out = _Writer(f"{path}/records/part-{shard:06d}-{number:04d}-{uuid.uuid4().hex}.rec")
                ids = part.column(0)
                doc, is_null = pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False)
                encoder = encoder_of(tokenizer, end_id)
                out.add(doc, is_null, encoder.encode(part.column(1).to_pylist()), encoder.width)
                if out.offset >= ROLL:
                    yield out.close(shard, number)
                    out, number = None, number + 1
        if out is not None:
            yield out.close(shard, number)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, "doc_id", F.xxhash64("text"))
    rows = rows.sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return RecordSet(spark, path)
