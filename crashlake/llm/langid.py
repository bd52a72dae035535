"""Language identification with blended-spectrum string kernels.

The kernel of two texts is the cosine of their presence vectors over byte
n-grams of 1 to 4 bytes of the lower-cased UTF-8 text, hashed to `DIM` places.
A bounded, documented sample of labelled rows (`SAMPLE` rows, the first by a
hash of the id) trains it: `LANDMARKS` of these, dealt evenly to the languages,
span the Nystroem feature space Z = K(x, landmarks) K(landmarks)^-1/2, in which
one-versus-rest kernel ridge regression is solved.  A batch of texts is scored
by two matrix products: presence matrix times landmark matrix gives the kernel
rows, and these times the folded weights give one value per language.

Defined cases: a null text or one without a letter is `und` with score 0; with
no labelled row every text is `und`; equal values go to the language that sorts
first; repeated rows are scored alike; columns other than doc_id, text and (to
learn from) lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from crashlake.llm.common import LETTER, with_text_columns

DIM = 8192
SAMPLE = 3000
LANDMARKS = 192
RIDGE = 1e-3
UNKNOWN = "und"
_SEEDS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]


def presence(text: str | None) -> np.ndarray:
    """The places, ascending, of the n-grams in a text."""
    b = np.frombuffer((text or "").lower().encode(errors="replace"), np.uint8).astype(np.uint32)
    seen = np.zeros(DIM, bool)
    code = np.zeros(len(b), np.uint32)
    for n in range(min(4, len(b))):  # n + 1 bytes
        code = (code[: len(b) - n] << np.uint32(8)) | b[n:]
        seen[((code * _SEEDS[n]) ^ (code >> np.uint32(13))) * _SEEDS[0] >> np.uint32(19)] = True
    return np.flatnonzero(seen)


def presence_rows(places_of: list[np.ndarray]) -> np.ndarray:
    """Presence vectors of unit length (of length 0 for an empty text)."""
    out = np.zeros((len(places_of), DIM), np.float32)
    for row, places in zip(out, places_of, strict=True):
        row[places] = 1.0 / np.sqrt(max(len(places), 1))
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def values(self, texts: list[str | None]) -> np.ndarray:
        return presence_rows([presence(t) for t in texts]) @ self.landmarks.T @ self.weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best, score = [], []
        for a in range(0, len(texts), 256):
            v = self.values(texts[a : a + 256])
            k = v.argmax(axis=1)
            best += [self.languages[x] for x in k]
            score.append(np.clip(v[np.arange(len(k)), k], 0.0, 1.0))
        lettered = np.array([t is not None and LETTER.search(t) is not None for t in texts], bool)
        names = [x if ok else UNKNOWN for x, ok in zip(best, lettered, strict=True)]
        return names, np.where(lettered, np.concatenate(score) if score else 0.0, 0.0)


def fit(places: list[np.ndarray], languages: list[str], n_landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on Nystroem features; landmarks are the first texts (by their presence places) of each language in turn."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((0, DIM), np.float32), np.zeros((0, 0), np.float32))
    own = [[i for i, x in enumerate(languages) if x == name] for name in names]
    turns = [i for k in range(max(map(len, own))) for x in own for i in x[k : k + 1]]
    marks = presence_rows([places[i] for i in turns[:n_landmarks]])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.concatenate([presence_rows(places[a : a + 256]) @ marks.T for a in range(0, len(places), 256)]) @ root
    y = np.array([[float(x == name) for name in names] for x in languages])
    balance = 1.0 / (y.sum(axis=0)[y.argmax(axis=1)] * len(names))  # languages weigh alike
    zw = z * balance[:, None]
    w = np.linalg.solve(z.T @ zw + ridge * np.eye(z.shape[1]) / max(1, len(names)), zw.T @ y)
    return Model(names, marks, (root @ w).astype(np.float32))


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` rows of `labelled` (doc_id, text, lang), the first by a hash of the id."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    first = rows.select(F.xxhash64("doc_id").alias("_h")).orderBy("_h").limit(sample).agg(F.max("_h").alias("_h")).first()
    if first is None or first["_h"] is None:
        return fit([], [])
    chosen = rows.where(F.xxhash64("doc_id") <= first["_h"])

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["h", "doc_id", "lang"]].assign(places=[presence(t).astype("<u2").tobytes() for t in batch["text"]])

    chosen = chosen.withColumn("h", F.xxhash64("doc_id")).mapInPandas(places, "h long, doc_id long, lang string, places binary")
    found = chosen.orderBy("h", "doc_id", "lang", "places").limit(sample).collect()  # at most 2 * DIM bytes a row
    return fit([np.frombuffer(r["places"], "<u2").astype(np.int64) for r in found], [r["lang"] for r in found])


def identify(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    new = [("lang_pred", StringType(), pa.string()), ("score", DoubleType(), pa.float64())]
    return with_text_columns(rows, new, lambda texts: list(shared.value.predict(texts)), ["doc_id", "held_out"])
