"""Token ids of texts that are cut into parts, each distinct part encoded once."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from itertools import chain, repeat

import numpy as np

#: Parts that the Python workers of an executor remember together (Spark may keep more of them than it runs at once),
#: and characters that one does.  A worker beyond its share forgets all before the next texts; that costs time only.
PARTS = 900_000
CHARACTERS = 16_000_000


def share() -> int:
    """Parts that this worker may remember."""
    parent = os.getppid()
    try:
        with open(f"/proc/{parent}/task/{parent}/children") as f:
            workers = len(f.read().split())
    except OSError:
        workers = 4
    return PARTS // max(2, workers)


class PartCache:
    """Remembers the ids of parts.  learn: parts -> all their ids, and the number of ids of each."""

    def __init__(self, learn: Callable[[list], tuple[np.ndarray, np.ndarray]], dtype: np.dtype):
        self.learn, self.dtype = learn, np.dtype(dtype)
        self.forget()

    def forget(self) -> None:
        self.code: dict = {}
        self.flat = np.empty(1 << 16, self.dtype)
        self.starts, self.lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.held = 0

    def _add(self, new: list) -> None:
        flat, lens = self.learn(new)
        n = len(self.code)
        while n + len(new) > len(self.starts):
            self.starts, self.lens = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lens))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        self.starts[n : n + len(new)] = self.used + np.cumsum(lens) - lens
        self.lens[n : n + len(new)] = lens
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.held += sum(map(len, new))
        self.code.update(zip(new, range(n, n + len(new)), strict=True))

    def encode(self, texts: Sequence[list], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts given as lists of parts, and where each text's ids begin (one more entry at the end).

        end_id: an id that follows each text.
        """
        parts = list(chain.from_iterable(texts))
        if len(self.code) > share() or self.held > CHARACTERS:
            self.forget()
        codes = np.fromiter(map(self.code.get, parts, repeat(-1)), np.int64, len(parts))
        if len(unknown := np.flatnonzero(codes < 0).tolist()):
            self._add(list({parts[i]: None for i in unknown}))
            codes[unknown] = [self.code[parts[i]] for i in unknown]
        lens = self.lens[codes]
        ends = np.concatenate(([0], np.cumsum(lens)))
        first = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        places = np.repeat(self.starts[codes] - ends[:-1], lens) + np.arange(ends[-1])
        if end_id is None:
            return self.flat[places], ends[first]
        bounds = ends[first] + np.arange(len(texts) + 1)
        out = np.full(bounds[-1], end_id, self.dtype)
        body = np.ones(len(out), bool)
        body[bounds[1:] - 1] = False
        out[body] = self.flat[places]
        return out, bounds
