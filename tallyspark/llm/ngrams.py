"""Presence of character n-grams in whole texts, as dense 0/1 blocks, and bounded samples to learn from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import grams, lower, segments


def presence_blocks(texts: pa.Array, slots: np.ndarray, width: int, orders: range, bits: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, block of 0/1 floats): whether a text holds an n-gram of slot j. slots: bucket -> slot or -1.

    A long text comes in pieces, whose blocks are united before they are handed out.
    """
    held: tuple[np.ndarray, np.ndarray] | None = None
    for codes, offsets, rows in segments(texts, overlap=orders.stop - 2):
        found = []
        for bucket, inside in grams(lower(codes), offsets, orders, bits):
            slot = slots[bucket]
            at = np.flatnonzero((slot >= 0) & inside)
            found.append((at, slot[at]))
        text_of = np.repeat(np.arange(len(rows)), np.diff(offsets))
        for low in range(0, len(rows), block):
            high = min(low + block, len(rows))
            out = np.zeros((high - low, width), np.float32)
            for at, slot in found:
                i, j = np.searchsorted(at, [offsets[low], offsets[high]])
                out[text_of[at[i:j]] - low, slot[i:j]] = 1
            if held is not None and len(rows) == 1 and held[0][0] == rows[0]:
                np.maximum(held[1], out, out=held[1])
                continue
            if held is not None:
                yield held
            held = (rows[low:high], out)
            if len(rows) > 1:
                yield held
                held = None
    if held is not None:
        yield held


def distinct_grams(texts: pa.Array, orders: range, bits: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(rows, the distinct n-gram buckets of each, in no order) of a chunk of texts; a long text comes by itself."""
    place, number = np.zeros(1 << bits, np.int32), np.arange(0, dtype=np.int32)
    row, parts = None, []

    def once(buckets: np.ndarray) -> np.ndarray:
        """Of equal buckets the last; it alone finds its own number in its place."""
        nonlocal number
        if len(number) < len(buckets):
            number = np.arange(2 * len(buckets), dtype=np.int32)
        mine = number[: len(buckets)]
        place[buckets] = mine
        return buckets[place[buckets] == mine]

    for codes, offsets, rows in segments(texts, overlap=orders.stop - 2):
        found = [bucket for bucket, _ in grams(lower(codes), offsets, orders, bits)]
        within = lambda a, b: once(np.concatenate([x[a : max(a, b - n + 1)] for n, x in zip(orders, found, strict=True)]))
        got = [within(a, b) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        if row is not None and (len(rows) > 1 or rows[0] != row):
            yield np.array([row]), [once(np.concatenate(parts))]
            row = None
        if len(rows) > 1:
            yield rows, got
        else:
            parts = [*parts, *got] if row is not None else got
            row = rows[0]
    if row is not None:
        yield np.array([row]), [once(np.concatenate(parts))]


def class_counts(labels: DataFrame, classes: int) -> dict:
    """How many rows the `classes` most frequent values of a column label have."""
    return dict(labels.where("label is not null").groupBy("label").count().orderBy(F.desc("count"), "label").limit(classes).collect())


def in_sample(counts: dict, per_class: int) -> Column:
    """Whether a row (doc_id, label) is among about per_class of its class, by a fixed hash of the id: the same ones in every run."""
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_class / n))])
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.lit(1_000_003)) < share[F.col("label")] * 1_000_003


def collected(rows: DataFrame, most: int, max_chars: int) -> list[tuple[str, object]]:
    """Sorted (text, label) of at most `most` rows (text, label) whose texts have at most max_chars."""
    got = rows.where(F.length("text") <= max_chars).select("text", "label").limit(most).toArrow()
    return sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
