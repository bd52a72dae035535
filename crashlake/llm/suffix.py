"""Suffix arrays of concatenated pieces of text, in numpy."""

from __future__ import annotations

import numpy as np

BITS = 15  # of a symbol: 256 bytes and the separators of at most 2^15 - 256 pieces


def joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The pieces' bytes as symbols, each piece ended by a separator of its own, and where each piece begins."""
    starts = np.cumsum([0] + [len(p) + 1 for p in pieces])
    text = np.empty(starts[-1], np.int64)
    text[np.setdiff1d(np.arange(starts[-1]), starts[1:] - 1, assume_unique=True)] = np.frombuffer(b"".join(pieces), np.uint8)
    text[starts[1:] - 1] = 256 + np.arange(len(pieces))
    return text, starts[:-1]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: sort by the first four symbols, then refine the groups that are still tied.

    A suffix's rank is where its group begins; the rank `k` symbols on orders
    a group by twice as many symbols.  Suffixes alone in their group are done.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(3, text.dtype)))
    key = padded[:n]
    for j in (1, 2, 3):
        key = (key << BITS) | padded[j : n + j]
    order = np.argsort(key)
    key = key[order]
    place = np.arange(n)
    first = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(first, place, 0))
    k = 4
    while True:
        alone = first & np.concatenate((first[1:], [True]))
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return order
        own = order[tied]
        group = rank[own]
        both = group * (n + 1) + rank[np.minimum(own + k, n)] + 1
        by = np.argsort(both)
        own, both = own[by], both[by]
        order[tied] = own
        new = np.concatenate(([True], both[1:] != both[:-1]))
        first[tied] = new
        rank[own] = np.maximum.accumulate(np.where(new, tied, 0))
        k *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai: length of the common prefix of each suffix and the one before it in the order (0 for the first).

    Going through the text, the length falls by at most one a step, and exactly
    by one where both suffixes follow the same symbol.  So only the others are
    compared, all at once, and the rest follows from a running maximum.
    """
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    known = (at == 0) | (before <= 0) | (text[at - 1] != text[before - 1])
    own = np.flatnonzero(known & (before >= 0))
    length = np.zeros(len(own), np.int64)
    live = np.arange(len(own))
    while len(live):
        a, b = own[live] + length[live], before[own[live]] + length[live]
        live = live[(a < n) & (b < n) & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])]
        length[live] += 1
    reach = np.where(before < 0, at, 0)
    reach[own] = length + own
    out = np.empty(n, np.int64)
    out[:] = np.maximum(np.maximum.accumulate(reach) - at, 0)
    out[before < 0] = 0
    return out[order]


def repeated(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes share their first `least` symbols with another, and the suffix array."""
    order = suffix_array(text)
    near = common_prefixes(text, order) >= least
    out = np.zeros(len(text), bool)
    out[order[near]] = True
    out[order[np.flatnonzero(near) - 1]] = True
    return out, order


def found_in(query: np.ndarray, at: np.ndarray, text: np.ndarray, order: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary search: which windows of `query` at `at` start a suffix in `order` of `text`, and the place found.

    Windows are compared symbol by symbol in bounded blocks of rows.
    """
    hit, place = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
    step = np.arange(width)
    for a in range(0, len(at), 4096):
        rows = query[at[a : a + 4096, None] + step]
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(order))
        while np.any(low < high):
            mid = (low + high) // 2
            other = text[np.minimum(order[np.minimum(mid, len(order) - 1)][:, None] + step, len(text) - 1)]
            differ = rows != other
            d = differ.argmax(axis=1)
            i = np.arange(len(rows))
            less = differ[i, d] & (other[i, d] < rows[i, d])
            go = low < high
            low, high = np.where(go & less, mid + 1, low), np.where(go & ~less, mid, high)
        if len(order):
            other = text[np.minimum(order[np.minimum(low, len(order) - 1)][:, None] + step, len(text) - 1)]
            hit[a : a + 4096] = (low < len(order)) & (rows == other).all(axis=1)
        place[a : a + 4096] = low
    return hit, place
