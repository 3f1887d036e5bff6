"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams of a blended spectrum (n from 2 to 4) that
both hold, over the root of the product of their own numbers of n-grams. Nystrom features against landmarks,
texts of every language, feed one-versus-rest kernel ridge regression; kernel, Nystrom map and ridge weights
fold into one matrix with a row for each n-gram of the landmarks, so that a block of texts is scored by
products of its 0/1 presence, a tile of n-grams at a time. n-grams are lower-cased and hashed to 22 bits.

Learnt from a bounded, fixed sample: about `per_language` texts, of at most `max_chars`, for each of the
`languages` most frequent values; with many languages fewer texts and landmarks each. Every text is scored as a
whole. Nulls: a null text, or one without a letter, is "und" with score 0, as is every text where
nothing can be learnt; a null id is returned as null and never held out, but not learnt from. Ties go to the first
language by name. Rows that share an id are learnt from and scored each for itself. Empty tables give
no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, ship, table
from .ngrams import class_counts, collected, distinct_grams, in_sample

ORDERS, BITS, RIDGE, BLOCK, TILE = range(2, 5), 22, 1e-2, 256, 8192
LANGUAGES, PER_LANGUAGE, MAX_CHARS, LANDMARKS = 1024, 400, 20_000, 32
SAMPLE, ALL_LANDMARKS = 8_000, 1024  # at most, over all languages


def presence(slots: list[np.ndarray], width: int) -> Iterator[tuple[slice, np.ndarray]]:
    """(columns, 0/1 block of the texts' slots in these columns), tile by tile."""
    row = np.repeat(np.arange(len(slots)), [len(x) for x in slots])
    slot = np.concatenate(slots) if slots else np.zeros(0, np.int64)
    tile = slot // TILE
    order = np.argsort(tile, kind="stable")
    ends = np.searchsorted(tile[order], np.arange(-(-width // TILE)), "right")
    begin = 0
    for k, end in enumerate(ends):
        at = order[begin:end]
        out = np.zeros((len(slots), min(TILE, width - k * TILE)), np.float32)
        out[row[at], slot[at] - k * TILE] = 1
        yield slice(k * TILE, k * TILE + out.shape[1]), out
        begin = end


@dataclass
class Model:
    languages: list[str]
    known: np.ndarray  # sorted buckets of the landmarks' n-grams
    weights: np.ndarray  # by n-gram and language
    constant: np.ndarray

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of the best language, score from 0 to 1) of each text."""
        best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        slots = np.full(1 << BITS, -1, np.int32)
        slots[self.known] = np.arange(len(self.known))
        for rows, buckets in distinct_grams(texts, ORDERS, BITS):
            for low in range(0, len(rows), BLOCK):
                some, at = buckets[low : low + BLOCK], rows[low : low + BLOCK]
                held = [x[x >= 0] for x in (slots[b] for b in some)]
                out = sum((block @ self.weights[columns] for columns, block in presence(held, len(self.known))), np.zeros((len(some), len(self.languages)), np.float32))
                out = out / np.sqrt(np.maximum([len(b) for b in some], 1))[:, None] + self.constant
                best[at] = out.argmax(1)
                score[at] = np.clip((1 + out.max(1)) / 2, 0, 1)
        return best, score


def fit(sample: list[tuple[str, str]]) -> Model | None:
    """From (text, language) pairs."""
    languages = sorted({lang for _, lang in sample})
    if not languages:
        return None
    each = max(1, min(LANDMARKS, ALL_LANDMARKS // len(languages)))
    by = {lang: [i for i, (_, x) in enumerate(sample) if x == lang] for lang in languages}
    marks = [at[k] for at in by.values() for k in np.unique(np.linspace(0, len(at) - 1, each).astype(int))]
    grams_of = [b for _, got in distinct_grams(pa.array([t for t, _ in sample]), ORDERS, BITS) for b in got]
    known = np.unique(np.concatenate([grams_of[i] for i in marks]))
    slot_of = np.full(1 << BITS, -1, np.int32)
    slot_of[known] = np.arange(len(known))
    slots = [x[x >= 0] for x in (slot_of[b] for b in grams_of)]
    unit = 1 / np.sqrt(np.maximum([len(b) for b in grams_of], 1))
    kernel = np.zeros((len(sample), len(marks)))
    for low in range(0, len(sample), BLOCK):
        for (_, landmarks), (_, block) in zip(presence([slots[i] for i in marks], len(known)), presence(slots[low : low + BLOCK], len(known)), strict=True):
            kernel[low : low + BLOCK] += block @ landmarks.T
    kernel *= unit[:, None] * unit[marks]
    values, vectors = np.linalg.eigh(kernel[marks])
    keep = values > 1e-6 * max(values.max(initial=0), 1e-12)
    nystrom = vectors[:, keep] / np.sqrt(values[keep])
    features = np.column_stack([kernel @ nystrom, np.ones(len(sample))])
    number = np.array([languages.index(x) for _, x in sample])
    weight = (len(sample) / len(languages) / np.bincount(number))[number]
    target = np.where(number[:, None] == np.arange(len(languages)), 1.0, -1.0)
    gram = (features * weight[:, None]).T @ features + RIDGE * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, (features * weight[:, None]).T @ target)
    of_mark = unit[marks][:, None] * (nystrom @ solved[:-1])
    folded = np.concatenate([landmarks.T.astype(np.float64) @ of_mark for _, landmarks in presence([slots[i] for i in marks], len(known))] or [np.zeros((0, len(languages)))])
    return Model(languages, known, folded.astype(np.float32), solved[-1].astype(np.float32))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score."""
    names = model.languages if model else ["und"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = batch.column(2).to_numpy(zero_copy_only=False)
            best, score = model.score(pc.if_else(batch.column(2), batch.column(1), "")) if model else (np.zeros(len(batch), np.int64), np.zeros(len(batch)))
            pred = np.where(lettered, np.array(names, object)[best], "und")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(np.where(lettered, score, 0.0))], ["doc_id", "lang_pred", "score"])

    ship(docs.sparkSession)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), "text", lettered.alias("lettered")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS) -> Model | None:
    """From docs (doc_id, text, lang): rows with a language that are not held out."""
    rows = docs.where(~held_out("doc_id", 3, 1)).select("doc_id", "text", F.col("lang").alias("label")).where("doc_id is not null and label is not null")
    counts = class_counts(rows.select("label"), LANGUAGES)
    if not counts:
        return None
    each = max(1, min(per_language, SAMPLE // len(counts)))
    return fit(collected(rows.where(in_sample(counts, each)), 2 * each * len(counts), max_chars))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, learn(docs)).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
