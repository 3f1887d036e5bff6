"""Quality by random Fourier features of document statistics.

Every whole text gives a vector of statistics (counts of kinds of signs, words and lines, and how often
they repeat). Standardised, they go through random Fourier features, which approximate a Gaussian
kernel. Ridge regression is fitted from normal equations summed by partition over all labelled rows
of the fitting folds; its scores are calibrated by isotonic regression over another fold, from sums in
fixed bins over all its rows. Only sums of fixed size come to the driver.

Nulls: a null text counts as empty; labels that are null, or of null ids, are not used, and a document
with several labels counts as good only if all say so; a null id is returned as null and never held
out. Where there are no labels, or only one class, the score is that of the calibration: the class's
share (1 without labels). Ties get one score. A very long text gives the same statistics as a short one; it is
held whole, its words and lines are hashed part by part. Repeated rows are scored each for itself. Empty
tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, STEP, cut, held_out, mix, segments, ship, sums, table

FEATURES, RIDGE, BINS, TASKS, THRESHOLD = 256, 1e-3, 512, 32, 0.3
LONG = 300_000  # code points of the texts that are read at once
KINDS = 8  # of code points, see _kinds
N_SUMS = 2 * KINDS + 12


def _kinds() -> np.ndarray:
    """0 other, 1 lower case, 2 upper case, 3 digit, 4 space, 5 line end, 6 mark of a sentence, 7 other ASCII sign."""
    t = np.zeros(65536, np.uint8)
    for i in range(65536):
        c = chr(i)
        t[i] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 5 if c == "\n" else 4 if c.isspace() else 6 if c in ".,;:'\"?()-" else 7 if i < 127 else 0
    return t


KIND = _kinds()


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true, none of which goes over a piece's end."""
    first = np.zeros(len(inside) + 1, bool)
    first[offsets[:-1]] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    return np.flatnonzero(inside & (~before | first[:-1])), np.flatnonzero(inside & (~after | np.concatenate([first[1:-1], [True]]))) + 1


def hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of codes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int((ends - starts).max()), STEP, np.uint64))
        place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes)))) if starts[0] == 0 else None
        if place is None:
            place = np.arange(len(codes)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(codes)]])))
        term = mix(codes.astype(np.uint64) + MIX) * power[np.minimum(place, len(power) - 1)]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
        return mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64))


def repeats(row: np.ndarray, hashed: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each row has."""
    _, first = np.unique(hashed ^ mix(row.astype(np.uint64) + MIX), return_index=True)
    return np.bincount(row[first], minlength=n)


def hashes_of_long(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """hashes() of the spans of a very long text, for as many spans at a time as LONG code points hold; a longer span goes part by part."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        low = int(starts[i])
        if ends[i] - low > LONG:
            total = np.zeros(1, np.uint64)
            with np.errstate(over="ignore"):
                for at in range(low, int(ends[i]), LONG):
                    part = codes[at : min(at + LONG, int(ends[i]))]
                    power = np.cumprod(np.full(len(part), STEP, np.uint64)) * np.uint64(pow(int(STEP), at - low, 1 << 64))
                    total += (mix(part.astype(np.uint64) + MIX) * power).sum(dtype=np.uint64)
                out[i] = mix(total + np.uint64(ends[i] - low))[0]
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, low + LONG, "right")))
        out[i:j] = hashes(codes[low : int(ends[j - 1])], starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


def counted(texts: pa.Array) -> np.ndarray:
    """Sums for each text."""
    out = np.zeros((len(texts), N_SUMS))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    long = pc.utf8_length(texts).to_numpy() > LONG
    chunks = segments(pc.if_else(pa.array(long), "", texts), LONG)
    whole = ((np.frombuffer(texts[int(i)].as_py().encode("utf-32-le"), "<u4"), int(i)) for i in np.flatnonzero(long))
    for codes, offsets, rows in itertools.chain(chunks, ((c, np.array([0, len(c)]), np.array([i])) for c, i in whole)):
        hashed = hashes_of_long if len(codes) > LONG else hashes
        kind = np.where(codes < 65536, KIND[np.minimum(codes, 65535)], 0)
        n = len(rows)
        got = [sums(kind == k, offsets) for k in range(KINDS)]
        space = (kind == 4) | (kind == 5)
        starts, ends = spans(~space, offsets)
        words = np.searchsorted(starts, offsets)
        row = np.repeat(np.arange(n), np.diff(words))
        of_kind = np.concatenate([[0], np.cumsum(kind == 7)]), np.concatenate([[0], np.cumsum(kind == 2)]), np.concatenate([[0], np.cumsum((kind == 1) | (kind == 2))])
        signs, upper, letters = (x[ends] - x[starts] for x in of_kind)
        size = ends - starts
        by_row = lambda x: np.bincount(row, x, n)
        got += [by_row(np.ones(len(row))), by_row(size * size), by_row(signs > 0), by_row((upper > 1) & (upper == letters)), by_row(letters == 0), by_row(size == 1), by_row(size > 15), repeats(row, hashed(codes, starts, ends), n)]
        l_starts, l_ends = spans(kind != 5, offsets)
        l_row = np.repeat(np.arange(n), np.diff(np.searchsorted(l_starts, offsets)))
        got += [np.bincount(l_row, minlength=n), repeats(l_row, hashed(codes, l_starts, l_ends), n), np.bincount(l_row, (l_ends - l_starts) < 30, n), sums((codes == 124) | (codes == 9), offsets)]
        same = np.concatenate([[False], codes[1:] == codes[:-1]]) if len(codes) else np.zeros(0, bool)
        same[offsets[:-1][offsets[:-1] < len(codes)]] = False  # a text's first sign follows none
        got += [sums(same & (kind == k), offsets) for k in range(KINDS)]
        out[rows] += np.column_stack(got)
    return out


def statistics(texts: pa.Array) -> np.ndarray:
    """Ratios and logarithms of the counts."""
    c = counted(texts)
    chars, words, lines = (np.maximum(x, 1) for x in (c[:, :KINDS].sum(1), c[:, KINDS], c[:, KINDS + 8]))
    return np.column_stack([np.log1p(c[:, :KINDS].sum(1)), c[:, :KINDS] / chars[:, None], np.log1p(words), (chars - c[:, 4] - c[:, 5]) / words, np.sqrt(c[:, KINDS + 1] / words), c[:, KINDS + 2 : KINDS + 8] / words[:, None], np.log1p(lines), c[:, KINDS + 9 : KINDS + 11] / lines[:, None], words / lines / 50, c[:, KINDS + 11] / words, c[:, KINDS + 12 :] / chars[:, None]]).astype(np.float64)


N_STATS = 1 + KINDS + 3 + 6 + 1 + 2 + 2 + KINDS


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # the calibrated score of each bin

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.sqrt(2 / self.waves.shape[1]) * np.cos(z @ self.waves + self.phases), np.ones(len(z))])

    def bins(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((self.features(stats) @ self.weights * 0.5 + 0.25) * BINS, 0, BINS - 1).astype(np.int64)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.steps[self.bins(stats)]


def isotonic(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Rising means of the bins (pool adjacent violators), one success and one failure added to the whole; empty bins take the level before."""
    whole = (total.sum() + 1) / (count.sum() + 1) if count.sum() else 1.0
    blocks: list[list[float]] = []
    for n, t in zip(count, total, strict=True):
        blocks.append([n + 1e-6, t + 1e-6 * whole, 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] > blocks[-1][1] / blocks[-1][0]:
            n2, t2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + t2, blocks[-1][2] + k2]
    return np.clip(np.concatenate([np.full(k, t / n) for n, t, k in blocks]), 0, 1)


def _as_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS).astype(np.float64)


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, stats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics(batch.column(1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, stats.size + 1, N_STATS, dtype=np.int32), pa.array(stats.ravel()))], ["doc_id", "stats"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, stats array<float>")


def _summed(rows: DataFrame, columns: list[str], make) -> np.ndarray | None:
    """make(batch) summed over all rows of a frame: in each task, then by TASKS tasks over those sums, then on the driver."""

    def sum_up(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            total = part.astype(np.float64) if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return sum_up(make(b) for b in batches if len(b))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return sum_up(np.frombuffer(x) for b in batches for x in b.column(0).to_pylist())

    by_task = rows.select(*columns).mapInArrow(first, "sums binary").withColumn("to", F.pmod(F.spark_partition_id(), F.lit(TASKS)))
    got = [np.frombuffer(r[0]) for r in by_task.repartition(TASKS, "to").select("sums").mapInArrow(second, "sums binary").collect()]
    return np.sum(got, axis=0) if got else None


def fit(labelled: DataFrame, fold=None, features: int = FEATURES, seed: int = 11) -> Model:
    """labelled (doc_id, stats, label); rows where the condition fold holds calibrate, the others fit."""
    fold = F.lit(False) if fold is None else fold
    rows = labelled.withColumn("calibrates", fold)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _as_matrix(batch.column(0))
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    m = _summed(rows, ["stats"], moments)
    mean = m[1 : 1 + N_STATS] / m[0] if m is not None else np.zeros(N_STATS)
    deviation = np.sqrt(np.maximum(m[1 + N_STATS :] / m[0] - mean**2, 0)) if m is not None else np.ones(N_STATS)
    rng = np.random.default_rng(seed)
    waves, phases = rng.normal(size=(N_STATS, features)) * np.sqrt(1.0 / N_STATS), rng.uniform(0, 2 * np.pi, features)
    model = Model(mean, np.where(deviation > 1e-6, deviation, 1.0), waves, phases, np.zeros(features + 1), np.ones(BINS))
    if m is None:
        return model

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z, y = model.features(_as_matrix(batch.column(0))), batch.column(1).to_numpy().astype(np.float64)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    eq = _summed(rows.where(~F.col("calibrates")), ["stats", "label"], normal)
    if eq is None:
        eq = _summed(rows, ["stats", "label"], normal)
    d = features + 1
    gram = eq[: d * d].reshape(d, d)
    model.weights = np.linalg.solve(gram + RIDGE * max(1.0, gram[-1, -1]) * np.diag(np.append(np.ones(d - 1), 1e-6)), eq[d * d :])

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        b, y = model.bins(_as_matrix(batch.column(0))), batch.column(1).to_numpy().astype(np.float64)
        return np.concatenate([np.bincount(b, minlength=BINS), np.bincount(b, y, BINS)])

    held = _summed(rows.where("calibrates"), ["stats", "label"], binned)
    if held is None:
        held = _summed(rows, ["stats", "label"], binned)
    model.steps = isotonic(held[:BINS], held[BINS:])
    return model


def score(with_stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, stats) -> doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_as_matrix(batch.column(1))))], ["doc_id", "score"])

    return with_stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def learn(with_stats: DataFrame, labels: DataFrame) -> Model:
    """From statistics and labels (doc_id, label) of the rows to learn from; a fifth of them, by the id's hash, calibrates."""
    one = labels.toDF("doc_id", "label").where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").cast("double").alias("label"))
    return fit(cut(with_stats.join(one, "doc_id")), F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")))
    model = learn(stats, table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)).select("doc_id", "quality"))
    return score(stats, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
