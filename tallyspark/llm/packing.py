"""Packing token streams into windows of near-equal length by Karmarkar-Karp differencing.

A text's tokens (with an end id) are cut: whole windows stand for themselves; the rest goes into pieces
of at most `piece` tokens. A group of pieces worth `windows` windows is partitioned by multiway largest
differencing: partial partitions are merged, the one with the largest spread first, heavy windows of one
with light windows of the other. If the heaviest window exceeds the capacity, the group gets a window
more and is partitioned again. A group's last piece is cut so that the group fills its windows but for
`slack` tokens each, and the rest of the text goes on in the next group.

Everything happens in the task that reads the texts, group by group: no shuffle, and memory for one
group and one text. Nulls: a null text is empty (its end id is packed), a null id is returned as null. An added token's string in
a text becomes that token, which is the library's default. A very long text is held whole, with its ids.
Repeated rows are packed each for itself. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

CAPACITY, PIECE, WINDOWS, SLACK, END_ID = 1024, 256, 384, 2, 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


_RUN = re.compile(r"\s{4096}")


@functools.lru_cache(1)
def tokenizer(json_path: str) -> Callable[[str], list[int]]:
    """A function text -> ids, as the JSON's library gives them with add_special_tokens=False.

    Where the same vocabulary lies beside as a rank file, that gives equal ids in a fifth of the time for texts without
    an added token's string and without long runs of spaces; all others are read by the JSON's library.
    """
    import json
    import os

    @functools.cache
    def model():
        import tokenizers

        return tokenizers.Tokenizer.from_file(json_path)

    whole = lambda text: model().encode(text, add_special_tokens=False).ids
    ranks = json_path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return whole
    import public_tokenizers
    import tiktoken

    with open(json_path, encoding="utf-8") as f:
        kind = f.read()
    # Only the added tokens are read here; a worker that meets none of them needs no second copy of the vocabulary.
    found = kind.find("[", kind.find('"added_tokens"'))
    added = [t["content"] for t in json.JSONDecoder().raw_decode(kind, found)[0]]
    with open(ranks, "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def encode(text: str) -> list[int]:
        # Long runs of spaces overflow the stack of its regex engine.
        return whole(text) if any(t in text for t in added) or _RUN.search(text) else fast.encode_ordinary(text)

    return encode


def difference(sizes: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each size, sums of the n windows) by multiway Karmarkar-Karp.

    Partial partitions keep their sums in falling order. A merge adds one's heaviest to the other's
    lightest; how it reordered them is kept, and the windows are read off from the last merge down.
    """
    if n == 1:
        return np.zeros(len(sizes), np.int64), np.array([sum(sizes)])
    sums: list[np.ndarray] = []
    made: list[tuple[int, int, np.ndarray] | None] = []
    heap = []
    for i, size in enumerate(sizes):
        s = np.zeros(n, np.int64)
        s[0] = size
        sums.append(s)
        made.append(None)
        heap.append((-size, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        s = sums[a] + sums[b][::-1]
        order = np.argsort(-s, kind="stable")
        s = s[order]
        sums[a] = sums[b] = None
        sums.append(s)
        made.append((a, b, order))
        heapq.heappush(heap, (-(int(s[0]) - int(s[-1])), len(sums) - 1))
    windows = np.zeros(len(sizes), np.int64)
    place: dict[int, np.ndarray] = {len(sums) - 1: np.arange(n)}
    for node in range(len(sums) - 1, -1, -1):
        here = place.pop(node)
        if made[node] is None:
            windows[node] = here[0]
        else:
            a, b, order = made[node]
            before = np.empty(n, np.int64)
            before[order] = here
            place[a], place[b] = before, before[::-1]
    return windows, sums[-1]


def partition(sizes: list[int], capacity: int) -> np.ndarray:
    """Windows of near-equal sums of at most capacity; as many as needed."""
    n = max(1, -(-sum(sizes) // capacity))
    while True:
        windows, sums = difference(sizes, n)
        if sums.max() <= capacity:
            return windows
        n += 1


class Packer:
    """Takes texts' ids one after another; hands out rows of placed pieces. number: the first sequence's."""

    def __init__(self, number: int, capacity: int = CAPACITY, piece: int = PIECE, windows: int = WINDOWS, slack: int = SLACK):
        self.number, self.capacity, self.piece, self.goal = number, capacity, piece, windows * (capacity - slack)
        self.open: list[tuple] = []
        self.total, self.placed = 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.capacity:
            self.place(doc_id, ids, at, self.capacity, self.number, 0)
            self.number += 1
            at += self.capacity
        while at < n:
            size = min(self.piece, n - at, self.goal - self.total)
            self.open.append((doc_id, ids, at, size))
            self.total += size
            at += size
            if self.total >= self.goal:
                self.flush()

    def place(self, doc_id, ids, start, length, sequence, offset) -> None:
        part = ids[start : start + length]
        self.placed.append((doc_id, start, length, zlib.crc32(part.tobytes()), len(ids), sequence, offset, part))

    def flush(self) -> None:
        if not self.open:
            return
        windows = partition([p[3] for p in self.open], self.capacity)
        ends = np.zeros(int(windows.max()) + 1, np.int64)
        for (doc_id, ids, start, size), w in zip(self.open, windows, strict=True):
            self.place(doc_id, ids, start, size, self.number + int(w), int(ends[w]))
            ends[w] += size
        self.number += len(ends)
        self.open, self.total = [], 0

    def rows(self) -> list[tuple]:
        out, self.placed = self.placed, []
        return out


def pack(docs: DataFrame, json_path: str, with_ids: bool = False, **limits) -> DataFrame:
    """docs (doc_id, text) -> PIECES, a row for each piece; with_ids adds the piece's token ids."""
    schema = PIECES + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = tokenizer(json_path), Packer(TaskContext.get().partitionId() << 33, **limits)

        def out() -> Iterator[pa.RecordBatch]:
            if rows := packer.rows():
                columns = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:7]]
                if with_ids:
                    columns.append(pa.array([r[7].astype(np.int32) for r in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(len(batch)):
                tokens = encode(texts[i].as_py() or "")
                packer.add(ids[i].as_py(), np.array([*tokens, END_ID], "<u4"))
                if len(packer.placed) >= 4096:
                    yield from out()
        packer.flush()
        yield from out()

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
