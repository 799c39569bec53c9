"""Quality scores by Bradley-Terry pairwise ranking (operator 8).

A document's strength is linear in its features. Every pair of a better and a
worse labelled document is one comparison, won with a probability that is the
logistic of the difference of strengths; the weights minimise the logistic loss
on feature differences, with a small ridge. The strengths of the labelled sample
then give the threshold: the quantile that leaves the share of worse documents
below it. The score is the logistic of the distance to that threshold, so 0.5 is
the threshold.

The model is fitted on at most ``MAX_LABELLED`` labelled documents, chosen by a
hash of their ids; only their features (a fixed number of columns) reach the
driver. Scoring is one pass over all texts without a shuffle.

Features look at the text alone: shares of ASCII characters, lengths, repeated
words and lines. Null and empty texts are scored like any other. Rows
without a label or id are scored but not learnt from; repeated labels count as often as they
occur. Without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import byte_texts, slices

#: Bound on the labelled documents the model is fitted on.
MAX_LABELLED = 20_000
#: Comparisons per labelled document of the rarer kind.
PAIRS_EACH = 20
RIDGE = 1e-3
STEPS = 30
N_FEATURES = 128 + 8


def features(text: bytes) -> np.ndarray:
    """A fixed number of measures of one text."""
    out = np.zeros(N_FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, len(text))
    out[:128] = np.sqrt(counts[:128] / size)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n = max(1, len(words))
    out[128] = counts[128:].sum() / size
    out[129] = np.log1p(len(words))
    out[130] = np.log1p(len(text) / n)
    out[131] = len(set(words)) / n
    out[132] = len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2)
    out[133] = len(set(lines)) / max(1, len(lines))
    out[134] = np.log1p(len(text) / max(1, len(lines)))
    out[135] = counts[65:91].sum() / max(1, counts[65:91].sum() + counts[97:123].sum())
    return out


@dataclass
class Ranking:
    mean: np.ndarray
    weights: np.ndarray  # on centred features
    threshold: float
    scale: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) @ self.weights - self.threshold) / self.scale
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, better: np.ndarray, pairs_each: int = PAIRS_EACH) -> Ranking:
    """Bradley-Terry strengths from features and labels, by Newton's method on the pairs."""
    mean, spread = x.mean(0), x.std(0)
    spread[spread < 1e-9] = np.inf
    z = (x - mean) / spread
    up, down = np.flatnonzero(better), np.flatnonzero(~better)
    few, many = (up, down) if len(up) < len(down) else (down, up)
    # Every document of the rarer kind meets documents spread over the other kind.
    rng = np.random.default_rng(1)
    met = rng.integers(0, len(many), (len(few), pairs_each))
    won, lost = (few.repeat(pairs_each), many[met.ravel()]) if few is up else (many[met.ravel()], few.repeat(pairs_each))
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        gradient, hessian = RIDGE * w, RIDGE * np.eye(len(w))
        for i in range(0, len(won), 50_000):
            diff = z[won[i : i + 50_000]] - z[lost[i : i + 50_000]]
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # chance of the other outcome
            gradient -= diff.T @ p / len(won)
            hessian += (diff * (p * (1 - p))[:, None]).T @ diff / len(won)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    strength = z @ w
    # Between the worst of the better and the best of the worse, as many below as are worse.
    ordered = np.sort(strength)
    cut = len(down)
    return Ranking(mean, w / spread, (ordered[cut - 1] + ordered[cut]) / 2, max(strength.std(), 1e-9))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Ranking | None:
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.select(F.col("doc_id").alias("_id"), "quality").orderBy(F.xxhash64("_id"), "_id", "quality").limit(most)
    # At most `most` rows of two numbers: a proven bound.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "quality", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [features(t).tolist() for t in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality").cast(pa.int64()), pa.array(x, pa.list_(pa.float64()))],
                ["doc_id", "quality", "x"],
            )

    rows = texts.mapInArrow(measure, "doc_id bigint, quality bigint, x array<double>").toArrow().sort_by("doc_id")
    better = rows.column("quality").to_numpy() == 1
    if better.all() or not better.any():
        return None
    x = rows.column("x").combine_chunks().values.to_numpy().reshape(-1, N_FEATURES)
    return fit(x, better)


def scored(docs: DataFrame, model: Ranking | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = byte_texts(batch.column("text"))
            values = model.scores(np.array([features(t) for t in texts])) if model and texts else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def ranked(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    return scored(docs, train(docs, labels, most))
