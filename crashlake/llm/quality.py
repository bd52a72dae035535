"""Document quality by a generalised additive model with pairwise interactions.

Each text becomes a row of counts and ratios (`FEATURES`).  Features are binned
by quantiles of the training rows.  Cyclic boosting then visits the features in
turn: a shallow tree (at most `LEAVES` leaves, found on the bins' gradients) is
fitted to the residual and its leaf values, times the learning rate, are added
to the feature's lookup table.  When the single features have been learned, the
feature pairs whose residual tables explain most are boosted in the same way on
a coarser grid.  A score is a sum of table entries: per batch, one bin search
and one vectorised lookup and addition per table.

Learned on a bounded, documented sample of labelled rows (`SAMPLE` rows, the
first by a hash of the id); only their features reach the driver.

Defined cases: a null text has the features of an empty one and is scored; with
no labelled row every score is 0.5; rows labelled twice take the lower label;
repeated rows are scored alike; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from crashlake.llm.common import with_text_columns

FEATURES = (
    "words", "mean_word", "long_words", "distinct_words", "top_word", "same_as_last", "repeated_5grams", "lines", "line_length", "repeated_lines",
    "ended_lines", "upper", "lower", "digit", "mark", "symbol", "other", "space", "marked_words", "short_words",
)
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 150, 60, 0.1, 3
THRESHOLD = 0.3
_SYMBOLS = "#*$%&|<>@^~_={}[]\\/+"


def _class_table() -> np.ndarray:
    """Class of each code point below 0x250: 0 other, 1 upper, 2 lower, 3 digit, 4 mark, 5 symbol, 6 space."""
    out = np.zeros(0x250, np.uint8)
    for i in range(len(out)):
        c = chr(i)
        out[i] = 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 6 if c.isspace() else 5 if c in _SYMBOLS else 4 if c.isprintable() else 0
    return out


_CLASS = _class_table()
_ALNUM = re.compile(r"[^\W_]")


def features(text: str | None) -> list[float]:
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds = np.bincount(_CLASS[codes[codes < len(_CLASS)]], minlength=7).astype(float)
    kinds[2 if len(codes) else 0] += (codes >= len(_CLASS)).sum()
    n_chars = max(len(codes), 1)
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    lens = np.fromiter(map(len, words), np.int64, n)
    five = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    ended = sum(x.rstrip()[-1] in ".!?\"'" for x in lines)
    marked = sum(k for w, k in counts.items() if not _ALNUM.match(w[-1]))
    return [
        float(n), float(lens.mean()), float((lens > 12).mean()), len(counts) / n, max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, 1.0 - len(set(five)) / max(len(five), 1),
        float(len(lines)), sum(map(len, lines)) / max(len(lines), 1), 1.0 - len(set(lines)) / max(len(lines), 1), ended / max(len(lines), 1),
        kinds[1] / n_chars, kinds[2] / n_chars, kinds[3] / n_chars, kinds[4] / n_chars, kinds[5] / n_chars, kinds[0] / n_chars, kinds[6] / n_chars,
        marked / n, float((lens < 4).mean()),
    ]


@dataclass
class Model:
    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            out += t[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_cuts[j], x[:, j], side="right") for a, b, _ in self.pairs for j in (a, b)}
        for a, b, t in self.pairs:
            out += t[coarse[a], coarse[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Leaf value of each bin: a tree over ordered bins grown at the best split, on gradients g and curvatures h."""
    sg, sh = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    gain = lambda a, b: (sg[b] - sg[a]) ** 2 / (sh[b] - sh[a] + 1.0)
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, 0)
        for a, b in parts:
            if b - a > 1:
                m = np.arange(a + 1, b)
                own = gain(a, m) + gain(m, b) - gain(a, b)
                if own.max() > best[0]:
                    best = (own.max(), (a, b), int(m[own.argmax()]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (sg[b] - sg[a]) / (sh[b] - sh[a] + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over a grid: the better axis is split first, each half along the other."""
    best = None
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        out, fit = np.zeros_like(gg), 0.0
        top = _tree(gg.sum(axis=1), hh.sum(axis=1), 2)
        cut = int(np.flatnonzero(np.diff(top))[0]) + 1 if np.any(np.diff(top)) else len(top)
        for s in (slice(0, cut), slice(cut, None)):
            own_g, own_h = gg[s].sum(axis=0), hh[s].sum(axis=0)
            v = _tree(own_g, own_h, 2)
            out[s] = v[None, :]
            fit += float((own_g * v).sum())
        if best is None or fit > best[0]:
            best = (fit, out if axis == 0 else out.T)
    return best[1]


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of single-feature tables, then of the strongest pairs."""
    f = len(FEATURES)
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(rate / (1.0 - rate)))
    cuts, coarse = [_quantiles(x[:, j], BINS) for j in range(f)], [_quantiles(x[:, j], PAIR_BINS) for j in range(f)]
    model = Model(base, cuts, [np.zeros(len(c) + 1) for c in cuts], coarse, [])
    if not len(y) or y.min() == y.max():
        return model
    bins = [np.searchsorted(cuts[j], x[:, j], side="right") for j in range(f)]
    z = np.full(len(y), base)
    grad = lambda: (lambda p: (y - p, p * (1.0 - p)))(1.0 / (1.0 + np.exp(-z)))
    for _ in range(ROUNDS):
        for j in range(f):
            g, h = grad()
            n = len(cuts[j]) + 1
            step = RATE * _tree(np.bincount(bins[j], g, n), np.bincount(bins[j], h, n))
            model.tables[j] += step
            z += step[bins[j]]
    small = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(f)]
    size = [len(c) + 1 for c in coarse]
    grid = lambda a, b, v: np.bincount(small[a] * size[b] + small[b], v, size[a] * size[b]).reshape(size[a], size[b])
    g, h = grad()
    strength = []
    for a in range(f):
        for b in range(a + 1, f):
            gg, hh = grid(a, b, g), grid(a, b, h)
            strength.append((-float((gg * _pair_tree(gg, hh)).sum()), a, b))
    model.pairs = [(a, b, np.zeros((size[a], size[b]))) for _, a, b in sorted(strength)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, t in model.pairs:
            g, h = grad()
            step = RATE * _pair_tree(grid(a, b, g), grid(a, b, h))
            t += step
            z += step[small[a], small[b]]
    return model


def train(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = SAMPLE) -> Model:
    """Fit on the features of at most `sample` labelled rows that may be learned from."""
    own = labels.where(allowed & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers
    new = [("x", ArrayType(DoubleType()), pa.list_(pa.float64()))]
    found = with_text_columns(rows, new, lambda texts: [[features(t) for t in texts]], ["doc_id", "quality"]).collect()
    found.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in found], float).reshape(len(found), len(FEATURES))
    return fit(x, np.array([float(r["quality"] > 0) for r in found]))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The rows of `docs` with `_quality` (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    of = lambda texts: [shared.value.score(np.array([features(t) for t in texts]))]
    return with_text_columns(docs, [("_quality", DoubleType(), pa.float64())], of, keep)
