"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded, documented sample of labelled rows (`EXAMPLES` rows,
the first by a hash of the id).  Terms are the lower-cased letter runs whose
presence goes with the label (likelihood ratio of at least `LEAST_RATIO`, in
however few rows: four toxic ones are enough if a ninth of all are toxic);
indifferent words would let chance word matches choose the neighbours.  Examples
with the same vector are held once, with the counts of their labels.

The index is inverted and cut into blocks of `BLOCK` vectors: each term keeps
its largest weight in every block.  A query takes the blocks in the order of
their upper bounds and ends when the next bound is below the weakest of the K
nearest so far, so the neighbours are exact, all ties included.  The vote is
the similarity-weighted share of toxic examples among them; a monotone table
fitted on the examples, each left out of its own vote, turns it into a
probability.  The nearest examples are returned as evidence.

Defined cases: a text without a known term (also an empty or null one) has no
neighbour and gets the share of toxic examples among those without one; with no
label at all every score is 0; rows labelled twice count as toxic if one label
says so; repeated rows are scored alike; other columns pass or are dropped, but
are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from crashlake.llm.common import stored, with_text_columns

EXAMPLES = 20_000
NEIGHBOURS = 15
BLOCK = 1024
#: A chi-squared value: one in 27,000 indifferent terms reaches it by chance, whatever the number of rows.
LEAST_RATIO = 17.0
TERMS = 20_000
THRESHOLD = 0.3
_TERM = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> list[str]:
    return _TERM.findall(text.lower()) if text else []


@dataclass
class Index:
    """Unit vectors of distinct examples in blocks."""

    idf: dict[str, float]
    vectors: list[dict[str, float]]
    clean: np.ndarray
    toxic: np.ndarray
    evidence: list[int]
    calibration: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(1), np.zeros(1)))
    unmatched: float = 0.0

    def __post_init__(self) -> None:
        self.block = BLOCK
        n_blocks = -(-len(self.vectors) // self.block)
        postings: dict[str, list[tuple[int, float]]] = {}
        for i, v in enumerate(self.vectors):
            for t, w in v.items():
                postings.setdefault(t, []).append((i, w))
        self.lists: dict[str, tuple[np.ndarray, np.ndarray, list[int]]] = {}
        self.block_max: dict[str, np.ndarray] = {}
        for t, p in postings.items():
            at, w = np.array([x for x, _ in p]), np.array([x for _, x in p])
            self.lists[t] = at % self.block, w, np.searchsorted(at, np.arange(n_blocks + 1) * self.block).tolist()
            top = np.zeros(n_blocks)
            np.maximum.at(top, at // self.block, w)
            self.block_max[t] = top
        self.seen: dict[tuple, tuple[float, list[int]]] = {}

    def vector(self, text: str | None) -> dict[str, float]:
        counts = Counter(t for t in terms(text) if t in self.idf)
        v = {t: (1.0 + math.log(n)) * self.idf[t] for t, n in sorted(counts.items())}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    def nearest(self, query: dict[str, float], k: int = NEIGHBOURS, without: int = -1) -> list[tuple[float, int]]:
        """(cosine, vector) of the vectors that hold the k nearest examples, ties included, nearest first.

        One example of vector `without` is left out.
        """
        known = [(t, w) for t, w in query.items() if t in self.lists]
        if not known:
            return []
        bound = sum(w * self.block_max[t] for t, w in known)
        found_score, found_at = np.empty(0), np.empty(0, np.int64)
        least = 0.0
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0.0 or bound[b] < least - 1e-12:
                break
            score = np.zeros(self.block)
            for t, w in known:
                at, weight, cut = self.lists[t]
                if cut[b] < cut[b + 1]:
                    score[at[cut[b] : cut[b + 1]]] += w * weight[cut[b] : cut[b + 1]]
            hit = np.flatnonzero((score > 0.0) & (score >= least - 1e-12))
            found_score, found_at = np.concatenate([found_score, score[hit]]), np.concatenate([found_at, b * self.block + hit])
            order = np.lexsort((found_at, -found_score))
            found_score, found_at = found_score[order], found_at[order]
            held = np.cumsum(self.clean[found_at] + self.toxic[found_at] - (found_at == without))
            j = int(np.searchsorted(held, k))
            if j < len(held):
                least = float(found_score[j])
                n = int(np.searchsorted(-found_score, 1e-12 - least, "right"))
                found_score, found_at = found_score[:n], found_at[:n]
        return list(zip(found_score.tolist(), found_at.tolist(), strict=True))

    def vote(self, query: dict[str, float], without: int = -1, toxic: bool = False) -> tuple[float | None, list[int]]:
        """Share of toxic examples among the nearest, weighted by similarity, and the nearest vectors; None if there is none."""
        bad = every = 0.0
        near = self.nearest(query, without=without)
        for s, i in near:
            own = i == without
            bad += s * (self.toxic[i] - (own and toxic))
            every += s * (self.clean[i] + self.toxic[i] - own)
        return (bad / every if every > 0 else None), [i for _, i in near[:3]]

    def score(self, text: str | None) -> tuple[float, list[int]]:
        """Calibrated probability, and ids of the nearest examples."""
        v = self.vector(text)
        key = tuple((t, round(w, 9)) for t, w in v.items())
        if key not in self.seen:
            if len(self.seen) > 10_000:
                self.seen.clear()
            share, near = self.vote(v)
            p = self.unmatched if share is None else float(np.interp(share, *self.calibration))
            self.seen[key] = p, [self.evidence[i] for i in near]
        return self.seen[key]


def monotone(share: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: increasing probabilities over ascending shares."""
    order = np.argsort(share, kind="stable")
    pools: list[list[float]] = []
    for s, y, w in zip(share[order], toxic[order], weight[order], strict=True):
        pools.append([s * w, y, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def build(examples: list[tuple[int, bool, dict[str, int]]], df: dict[str, int], n_rows: int) -> Index:
    """Index of (id, toxic, term counts); df: rows with each chosen term, of n_rows."""
    idf = {t: math.log(1.0 + n_rows / n) for t, n in df.items()}
    groups: dict[tuple, list] = {}
    for doc, toxic, counts in examples:
        v = {t: (1.0 + math.log(n)) * idf[t] for t, n in sorted(counts.items())}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        groups.setdefault(tuple((t, round(x / norm, 9)) for t, x in v.items()), []).append((doc, toxic))
    # neighbours in the order share their heaviest term, so blocks have few terms and tight bounds
    keys = sorted((k for k in groups if k), key=lambda k: (sorted(k, key=lambda x: (-x[1], x[0])), k))
    toxic = np.array([sum(y for _, y in groups[k]) for k in keys], float)
    clean = np.array([len(groups[k]) for k in keys], float) - toxic
    index = Index(idf, [dict(k) for k in keys], clean, toxic, [min(d for d, _ in groups[k]) for k in keys])
    bare = groups.get((), [])
    index.unmatched = sum(y for _, y in bare) / len(bare) if bare else 0.0
    return index


def calibrate(spark: SparkSession, index: Index) -> Index:
    """Fit the table from votes to probabilities; tasks vote on the index's own vectors, each left out (2 rows a vector)."""
    shared = spark.sparkContext.broadcast(index)

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            out = []
            for i in batch["id"].tolist():
                for y, n in ((True, own.toxic[i]), (False, own.clean[i])):
                    if n and (share := own.vote(own.vectors[i], i, y)[0]) is not None:
                        out.append((share, n * y, n))
            yield pd.DataFrame(out, columns=["share", "toxic", "n"], dtype=float)

    places = spark.range(0, len(index.vectors), 1, spark.sparkContext.defaultParallelism)
    found = places.mapInPandas(votes, "share double, toxic double, n double").collect()
    if found:
        index.calibration = monotone(*map(np.array, zip(*found, strict=True)))
    return index


def train(labelled: DataFrame) -> Index:
    """Index over the rows of `labelled` (doc_id, text, toxic), a bounded sample as `labelled_rows` takes it."""
    rows = labelled.where(F.col("toxic").isNotNull()).select("doc_id", "text", (F.col("toxic") > 0).alias("toxic"))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows with each term, by label, summed over what this task reads."""
        seen, size = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                size[toxic] += 1
                seen.update((t, toxic) for t in set(terms(text)))
        out = [(t, int(y), n) for (t, y), n in seen.items()] + [("", int(y), n) for y, n in size.items()]
        yield pd.DataFrame(out, columns=["term", "toxic", "n"])

    counted = rows.select("text", "toxic").mapInPandas(words, "term string, toxic int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")
    )
    total = counted.where(F.col("term") == "").first()
    if total is None:
        return build([], {}, 0)
    a, b = float(total["a"]), float(total["b"])
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    n = F.col("a") + F.col("b")
    ratio = 2 * sum(
        part(x, y) for x, y in ((F.col("a"), n * a / (a + b)), (F.col("b"), n * b / (a + b)), (a - F.col("a"), (a + b - n) * a / (a + b)), (b - F.col("b"), (a + b - n) * b / (a + b)))
    )
    chosen = counted.where(F.col("term") != "").withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    df = {r["term"]: r["a"] + r["b"] for r in chosen.orderBy(F.desc("ratio"), "term").limit(TERMS).collect()}
    vocabulary = rows.sparkSession.sparkContext.broadcast(frozenset(df))

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [Counter(t for t in terms(x) if t in vocabulary.value) for x in batch["text"]]
            yield batch[["doc_id", "toxic"]].assign(terms=[list(c) for c in own], n=[list(c.values()) for c in own])

    found = rows.mapInPandas(counts, "doc_id long, toxic boolean, terms array<string>, n array<int>").collect()
    examples_ = [(r["doc_id"], bool(r["toxic"]), dict(zip(r["terms"], r["n"], strict=True))) for r in found]
    index = build(sorted(examples_, key=lambda x: (x[0], x[1], sorted(x[2].items()))), df, int(a + b))
    return calibrate(rows.sparkSession, index)


def labelled_rows(docs: DataFrame, labels: DataFrame, allowed: Column, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, text and toxic of at most `examples` labelled documents that may be learned from, the first by a hash of the id.

    The ids are chosen among the labels, so no text is moved but those of the
    chosen rows (a broadcast of at most `examples` pairs of numbers); they are
    stored once.  Of rows with one id, one is taken.
    """
    own = labels.where(allowed & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).alias("_t")
    return stored(rows.groupBy("doc_id", "toxic").agg(first).select("doc_id", F.col("_t.text").alias("text"), "toxic"), "examples")


def score(docs: DataFrame, index: Index, keep: list[str] | None = None) -> DataFrame:
    """The rows of `docs` with `_toxicity` (0 to 1) and `_evidence` (ids of the nearest examples)."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    new = [("_toxicity", DoubleType(), pa.float64()), ("_evidence", ArrayType(LongType()), pa.list_(pa.int64()))]
    return with_text_columns(docs, new, lambda texts: list(zip(*map(shared.value.score, texts), strict=True)), keep)
