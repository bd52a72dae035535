"""Byte-level BPE in numpy: encoding by merge ranks, and decoding.

A text is cut by the tokenizer's pattern, and each match is encoded apart, from
its UTF-8 bytes.  A match that is a token is done.  The others, each distinct
one once, are dealt by length to padded matrices.  Every round each row merges
its leftmost pair of least rank: the pair's place gets the new id, the columns
behind it move up by one (so the matrix is a column narrower after each round),
and the ranks of the two new pairs are looked up in a hash table of all pairs
that make a token.  Rows without such a pair leave the matrix.

A match of more than `WIDE` bytes is a row of its own.  There all places of the
least rank are merged in one round, left to right, up to the first one beside
which a pair of lower rank arises; that is what merging them one by one gives.

Defined cases: a null or empty text has no ids and decodes to nothing; texts of
any length are encoded whole, in blocks of `MATCHES` matches; text that looks
like a special token is ordinary text; repeated rows are encoded alike; an empty
table gives an empty result; other columns pass or are dropped unread, whatever
their names.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType

from crashlake.llm.common import only, with_columns
from crashlake.llm.parts import PartCache

WIDE = 256
#: Columns of the matrices; a match goes to the narrowest that holds it.
WIDTHS = (4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, WIDE)
CELLS = 1 << 20
MATCHES = 500_000
NONE = np.int32(2**31 - 1)


class PairTable:
    """Open addressing: the id that a pair of ids makes, which is its rank, too; NONE for other pairs."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        bits = max(4, int(4 * len(left)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.made = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        at, rest = self._slots(keys), np.arange(len(keys))
        while len(rest):
            free = self.keys[at[rest]] < 0
            slot, first = np.unique(at[rest[free]], return_index=True)
            own = rest[free][first]
            self.keys[slot], self.made[slot] = keys[own], made[own]
            rest = rest[self.keys[at[rest]] != keys[rest]]
            at[rest] = at[rest] + 1 & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = self._slots(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.made[at], NONE)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            at[rest] = at[rest] + 1 & self.mask
            there = self.keys[at[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.made[at[rest[hit]]]
            rest = rest[~hit & (there >= 0)]
        return out


class ByteBPE:
    """A vocabulary of byte strings with their ids, which are the ranks of their merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a, b, i) for t, i in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None]
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        self.parts = PartCache(self.learn, np.int32)

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches, all in a row, and the number of each."""
        data = [w.encode() for w in words]
        ids = [self.ranks.get(d, -1) for d in data]
        found = [(np.flatnonzero(np.array(ids) >= 0), np.array([[i] for i in ids if i >= 0], np.int32).reshape(-1, 1))]
        rest = [k for k, i in enumerate(ids) if i < 0]
        sizes = np.fromiter((len(data[k]) for k in rest), np.int64, len(rest))
        bucket = np.searchsorted(WIDTHS, sizes)
        rest = np.array(rest, np.int64)
        for b, width in enumerate(WIDTHS):
            own = rest[bucket == b]
            for a in range(0, len(own), CELLS // width):
                some = own[a : a + CELLS // width]
                found += [(some[rows], out) for rows, out in self._merge([data[k] for k in some.tolist()], width)]
        found += [(np.array([k]), self._merge_long(data[k])[None, :]) for k in rest[bucket == len(WIDTHS)].tolist()]
        lens = np.zeros(len(words), np.int64)
        for k, out in found:
            lens[k] = (out >= 0).sum(axis=1)
        starts, flat = np.cumsum(lens) - lens, np.empty(lens.sum(), np.int32)
        for k, out in found:
            real = out >= 0
            flat[(starts[k][:, None] + np.arange(out.shape[1]))[real]] = out[real]
        return flat, lens

    def _merge(self, words: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and their final ids, padded with -1."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.full((len(words), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((len(words), width - 1), NONE, np.int32)
        pair = ids[:, 1:] >= 0
        rank[pair] = self.pairs.find(ids[:, :-1][pair], ids[:, 1:][pair])
        rows = np.arange(len(words))
        while len(rows):
            place = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            least = rank[np.arange(len(rows)), place] if rank.shape[1] else np.full(len(rows), NONE)
            go = least != NONE
            if not go.all():
                yield rows[~go], ids[~go]
                rows, ids, rank, place, least = rows[go], ids[go], rank[go], place[go], least[go]
                if not len(rows):
                    return
            every, here = np.arange(len(rows)), place[:, None]
            ids[every, place] = least
            ids = np.where(np.arange(ids.shape[1] - 1) <= here, ids[:, :-1], ids[:, 1:])
            rank = np.where(np.arange(rank.shape[1] - 1) <= here, rank[:, :-1], rank[:, 1:])
            before = np.flatnonzero(place > 0)
            rank[before, place[before] - 1] = self.pairs.find(ids[before, place[before] - 1], least[before])
            more = np.flatnonzero(place < rank.shape[1])
            after = ids[more, place[more] + 1]
            rank[more, place[more]] = np.where(after >= 0, self.pairs.find(least[more], np.maximum(after, 0)), NONE)

    def _merge_long(self, word: bytes) -> np.ndarray:
        ids = self.bytes[np.frombuffer(word, np.uint8)]
        rank = self.pairs.find(ids[:-1], ids[1:])
        while len(rank) and (least := rank.min()) != NONE:
            at = np.flatnonzero(rank == least)
            new_run = np.concatenate(([True], np.diff(at) != 1))
            start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]  # overlapping pairs of one id: every other
            # ranks that arise on either side, as merging goes from left to right
            joined = np.concatenate(([False], at[1:] - at[:-1] == 2))
            left, right = np.where(joined, least, ids[np.maximum(at - 1, 0)]), ids[np.minimum(at + 2, len(ids) - 1)]
            made = np.full(len(at), least, np.int32)
            lower = (at > 0) & (self.pairs.find(left, made) < least) | (at + 2 < len(ids)) & (self.pairs.find(made, right) < least)
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            ids[at] = least
            ids, rank = np.delete(ids, at + 1), np.delete(rank, at)
            place = at - np.arange(len(at))
            for p in (place[place > 0] - 1, place[place < len(rank)]):
                rank[p] = self.pairs.find(ids[p], ids[p + 1])
        return ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        own: list[list[str]] = []

        def flush() -> None:
            flat, bounds = self.parts.encode(own)
            out.extend(flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            own.clear()

        for t in texts:
            if t and len(t) > 4 * MATCHES:
                flush()
                matches, found = (m.group() for m in self.pattern.finditer(t)), []
                while block := list(islice(matches, MATCHES)):
                    found.append(self.parts.encode([block])[0])
                out.append(np.concatenate(found))
            else:
                own.append(self.pattern.findall(t) if t else [])
        flush()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; KeyError for an unknown one."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line per token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def tokenizer_of(path: str, pattern: str) -> ByteBPE:
    """One per worker, so that later tasks find what earlier ones learned."""
    return ByteBPE(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """`docs` with `ids` of `text`, little-endian unsigned 32-bit; decoded: also the bytes they decode to, as `decoded`."""

    def of(texts: list) -> list:
        only(__name__, tokenizer_of.cache_clear)
        own = tokenizer_of(path, pattern)
        ids = own.encode(texts)
        return [[x.astype("<u4").tobytes() for x in ids], *([[own.decode(x) for x in ids]] if decoded else [])]

    new = [(n, BinaryType(), pa.binary()) for n in ("ids", *(["decoded"] if decoded else []))]
    return with_columns(docs, "text", new, of, keep)


def decode(frames: DataFrame, path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """`frames` with the bytes that column `ids` decodes to, as `decoded`; nothing for null."""

    def of(ids: list) -> list:
        only(__name__, tokenizer_of.cache_clear)
        own = tokenizer_of(path, pattern)
        return [[own.decode(np.frombuffer(x or b"", "<u4")) for x in ids]]

    return with_columns(frames, "ids", [("decoded", BinaryType(), pa.binary())], of, keep)
