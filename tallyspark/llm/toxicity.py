"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of lower-cased character n-grams (n from 3 to 6, hashed). Each is scaled by its
log-count ratio, log((p + a) / |p|) - log((q + a) / |q|) with p and q the numbers of toxic and other
texts that hold it; of the n-grams that `least` texts hold, at most the `width` with the largest likelihood ratio
statistic are kept (both are parameters of the model), and a ridge-penalised logistic regression over the scaled
features gives the score. Different n-grams may share one of the 22 hash bits' buckets and then count as one.

Learnt from a bounded, fixed sample of labelled rows (`per_class` texts of each class, of at most
`max_chars`), weighted back to the classes' shares of all labelled rows; every text is scored as a whole.
Ties get one score.
Nulls: a null text counts as empty; labels that are null, or of null ids, are not used, and a document
with several labels counts as toxic if any says so; a null id is returned as null and never held out.
Where one class is missing, all texts get that class's score (0 without labels). Repeated rows are
scored each for itself. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, ship, sigmoid, table
from .ngrams import class_counts, collected, distinct_grams, in_sample, presence_blocks

ORDERS, BITS, WIDTH, LEAST, PER_CLASS, MAX_CHARS, ALPHA, RIDGE, STEPS = range(3, 7), 22, 4096, 5, 3000, 16_000, 1.0, 1e-4, 30
THRESHOLD = 0.7


@dataclass
class Model:
    slots: np.ndarray
    weights: np.ndarray
    constant: float

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), sigmoid(np.array(self.constant)))
        if len(self.weights):
            for rows, block in presence_blocks(texts, self.slots, len(self.weights), ORDERS, BITS):
                out[rows] = sigmoid(block @ self.weights + self.constant)
        return out


def logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int], target: np.ndarray, weight: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and constant of a weighted, penalised logistic regression, by Newton steps that conjugate gradients solve."""
    n, d = shape
    weight = weight / weight.sum()
    times = lambda w: np.bincount(rows, values * w[columns], n) + w[d]
    back = lambda g: np.append(np.bincount(columns, values * g[rows], d), g.sum())
    penalty = np.append(np.full(d, ridge), 1e-9)

    def loss(w: np.ndarray, margin: np.ndarray) -> float:
        return float(weight @ (np.logaddexp(0, margin) - target * margin) + (penalty * w * w).sum() / 2)

    w, margin = np.zeros(d + 1), np.zeros(n)
    for _ in range(steps):
        p = sigmoid(margin)
        g = back(weight * (p - target)) + penalty * w
        size = np.linalg.norm(g)
        if size < 1e-7:
            break
        curve = weight * p * (1 - p)
        x, r = np.zeros(d + 1), -g
        q, rr = r.copy(), r @ r
        for _ in range(200):
            h = back(curve * times(q)) + penalty * q
            a = rr / max(q @ h, 1e-300)
            x, r = x + a * q, r - a * h
            rr, before = r @ r, rr
            if rr < (0.01 * size) ** 2:
                break
            q = r + rr / before * q
        now, step, along = loss(w, margin), 1.0, times(x)
        while step > 1e-6 and loss(w + step * x, margin + step * along) > now + 1e-4 * step * (g @ x):
            step /= 2
        w, margin = w + step * x, margin + step * along
    return w[:d], float(w[d])


def fit(sample: list[tuple[str, int]], counts: dict, width: int = WIDTH, least: int = LEAST) -> Model:
    """From (text, label) pairs; counts: how many labelled rows each label has."""
    target = np.array([float(bool(y)) for _, y in sample])
    if not len(target) or target.min() == target.max():
        return Model(np.full(1 << BITS, -1, np.int16), np.zeros(0, np.float32), -20.0 if not target.sum() else 20.0)
    texts = pa.array([t for t, _ in sample])
    held = np.zeros((2, 1 << BITS), np.int32)
    for rows, got in distinct_grams(texts, ORDERS, BITS):
        for y, buckets in zip(target[rows].astype(int), got, strict=True):
            held[y, buckets] += 1
    total = np.bincount(target.astype(int), minlength=2)
    q, p = held.astype(np.float64)
    seen = np.flatnonzero(p + q >= least)
    p, q = p[seen], q[seen]
    ratio = np.log((p + ALPHA) / (p + ALPHA).sum()) - np.log((q + ALPHA) / (q + ALPHA).sum())
    part = lambda a, n: np.where(a > 0, a * np.log(np.maximum(a, 1e-9) / n), 0)
    share = total / total.sum()
    gain = part(p, (p + q) * share[1]) + part(q, (p + q) * share[0]) + part(total[1] - p, (total.sum() - p - q) * share[1] + 1e-9) + part(total[0] - q, (total.sum() - p - q) * share[0] + 1e-9)
    # What is kept must stand out of as many n-grams as were tried; a small sample keeps few.
    ranked = np.lexsort((seen, -np.round(gain, 9)))[:width]
    best = np.sort(ranked[: max(64, int((gain[ranked] >= np.log(max(2, len(seen)))).sum()))])
    slots = np.full(1 << BITS, -1, np.int16)
    slots[seen[best]] = np.arange(len(best))
    ratio = ratio[best]
    pairs = [(np.asarray(r)[i], j) for r, block in presence_blocks(texts, slots, len(best), ORDERS, BITS) for i, j in [np.nonzero(block)]]
    rows, columns = (np.concatenate(x) for x in zip(*pairs, strict=True))
    known = {int(bool(k)): 0 for k in counts}
    for k, n in counts.items():
        known[int(bool(k))] += n
    weight = np.array([known.get(0, 1) / total[0], known.get(1, 1) / total[1]])[target.astype(int)]
    w, b = logistic(rows, columns, ratio[columns], (len(sample), len(best)), target, weight, RIDGE, STEPS)
    return Model(slots, (w * ratio).astype(np.float32), float(b))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1)))], ["doc_id", "score"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """From docs (doc_id, text) and labels (doc_id, label)."""
    one = labels.toDF("doc_id", "label").where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = class_counts(one.select("label"), 2)
    if not counts:
        return fit([], {})
    most = 2 * per_class * len(counts)
    picked = F.broadcast(one.where(in_sample(counts, per_class)).limit(most))
    return fit(collected(docs.select("doc_id", "text").join(picked, "doc_id"), most, max_chars), counts)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1)).select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
