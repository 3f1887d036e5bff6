"""Near-duplicate vectors by a subspace pigeonhole join, exact for any threshold.

Unit vectors with cosine c are sqrt(2 - 2c) apart. They are rotated to their principal axes, which are dealt to
`blocks` subspaces; the squared distance is split among these in proportion to their variance. Two near
vectors are within its share in some block. Each block is joined by range over a grid on its first axes: a
row lies in its own cell and is sent to those later cells that its range touches. What is in range in a block is
verified by the exact cosine, and a pair counts only in the first block where it is in range.

Equal vectors are one node with a weight. Cells with many rows are cut into tiles, which pair chunks of
rows, so that no task gets more than two chunks at once; a tile hands out counts and a spanning forest
of its links, never its pairs. The rotation comes from sums of a fixed size over all rows.

Nulls: a null id, a null vector, a zero one and one holding null or non-finite components link with
nothing (a null id gets a null component and is not kept). Shorter vectors count as padded with zeros.
Repeated rows are vectors of their own, linked with each other. Empty tables give no rows. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, ship, table
from .topk_search import whole

BLOCKS, TILE, CELL_ROWS, PART, EPS = 4, 8192, 4096, 512, 1e-9


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Subspaces:
    """The rotation, the blocks' axes and their shares of the squared distance."""

    def __init__(self, count: int, total: np.ndarray, square: np.ndarray, cosine: float, blocks: int):
        width = len(total)
        mean = total / max(1, count)
        values, vectors = np.linalg.eigh(square / max(1, count) - np.outer(mean, mean))
        order = np.argsort(-values, kind="stable")
        self.width, self.blocks = width, min(blocks, width)
        self.axes = [order[b :: self.blocks] for b in range(self.blocks)]
        self.rotation = np.ascontiguousarray(vectors[:, np.concatenate(self.axes)])
        self.edges = np.concatenate([[0], np.cumsum([len(a) for a in self.axes])])
        spread = np.maximum([values[a].sum() for a in self.axes], 1e-9)
        self.shares = (2 - 2 * cosine) * spread / spread.sum() + EPS
        self.grid = int(np.clip(log(max(1, count / CELL_ROWS), 8), 1, min(6, min(map(len, self.axes)))))

    def part(self, rotated: np.ndarray, b: int) -> np.ndarray:
        return rotated[:, self.edges[b] : self.edges[b + 1]]

    def cells(self, rotated: np.ndarray, b: int) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """(rows, cell, whether it is their own): the rows' own cells and the later ones within range."""
        g, radius = self.grid, np.sqrt(self.shares[b]) * (1 + 1e-9) + EPS
        x = self.part(rotated, b)[:, :g]
        own = np.floor(x / (2 * radius)).astype(np.int64)
        base = 1 << (60 // g)
        code = lambda q: ((q + base // 2) * base ** np.arange(g - 1, -1, -1)).sum(1)
        home = code(own)
        out = [(np.arange(len(x)), home, True)]
        for step in np.ndindex(*[3] * g):
            move = np.array(step) - 1
            other = own + move
            if not move.any():
                continue
            low, high = other * 2 * radius, (other + 1) * 2 * radius
            away = np.maximum(np.maximum(low - x, x - high), 0)
            cell = code(other)
            rows = np.flatnonzero(((away**2).sum(1) <= radius**2) & (cell > home))
            if len(rows):
                out.append((rows, cell[rows], False))
        return out


def fitted(nodes: DataFrame, width: int, cosine: float, blocks: int) -> Subspaces:
    """From the sums of all unit vectors and of their products; one array for each of at most 32 tasks comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + width + width * width)
        for batch in batches:
            x = unit(matrix(batch.column(0), width))
            total += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    s = sum((np.frombuffer(r[0]) for r in nodes.select("vector").coalesce(32).mapInArrow(run, "sums binary").collect()), np.zeros(1 + width + width * width))
    return Subspaces(int(s[0]), s[1 : 1 + width], s[1 + width :].reshape(width, width), cosine, blocks)


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots of all rows after joining i with j; a root is its set's least row."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]
        i, j = i[apart], j[apart]


def tile_links(raw: np.ndarray, chunk: np.ndarray, home: np.ndarray, weight: np.ndarray, s: Subspaces, b: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(linked weight of each row, the row it is joined to) over those pairs of a tile that first meet in block b.

    Rows of one chunk are paired with each other where the tile has one chunk, else with the other chunk's;
    part by part, so that memory does not follow the number of links.
    """
    x = unit(raw)
    rotated = x @ s.rotation
    part, norm = s.part(rotated, b), np.sqrt((raw**2).sum(1))
    # One product in single precision gives minus half the squared distance, near enough to pass all that are in range.
    half, ones = (part**2).sum(1, keepdims=True) / 2, np.ones((len(raw), 1))
    left, right = (np.hstack(h).astype(np.float32) for h in ([part, -half, ones], [part, ones, -half]))
    x32, least = x.astype(np.float32), np.float32(-s.shares[b] / 2 - 1e-5)
    one = np.flatnonzero(chunk == chunk.min())
    two = one if chunk.min() == chunk.max() else np.flatnonzero(chunk == chunk.max())
    links, label = np.zeros(len(raw)), np.arange(len(raw))
    for at in range(0, len(one), PART):
        p = one[at : at + PART]
        for to in range(at if two is one else 0, len(two), 4 * PART):
            q = two[to : to + 4 * PART]
            near = left[p] @ right[q].T >= least
            if np.count_nonzero(near) > near.size // 50:
                near &= x32[p] @ x32[q].T >= np.float32(cosine - 1e-5)
            at_once = np.flatnonzero(near)
            i, j = p[at_once // len(q)], q[at_once % len(q)]
            ok = (home[i] | home[j]) & ((i < j) if two is one else True)
            i, j = i[ok], j[ok]
            keep = np.zeros(len(i), bool)
            for low in range(0, len(i), 1 << 16):
                u, v = i[low : low + (1 << 16)], j[low : low + (1 << 16)]
                good = (raw[u] * raw[v]).sum(1) / (norm[u] * norm[v]) >= cosine
                for c in range(b):
                    good &= ((s.part(rotated, c)[u] - s.part(rotated, c)[v]) ** 2).sum(1) > s.shares[c]
                good &= ((part[u] - part[v]) ** 2).sum(1) <= s.shares[b]
                keep[low : low + (1 << 16)] = good
            i, j = i[keep], j[keep]
            links += np.bincount(i, weight[j], len(raw)) + np.bincount(j, weight[i], len(raw))
            label = unite(label, i, j)
    return links, label


def near_duplicates(rows: DataFrame, cosine: float = 0.9, blocks: int = BLOCKS) -> DataFrame:
    """rows (id, vector) -> id, n_links, component_id, kept."""
    ship(rows.sparkSession)
    rows = rows.toDF("id", "vector").withColumn("id", F.col("id").cast("long"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    good = F.col("id").isNotNull() & whole(F.col("vector")) & F.coalesce(square > 0, F.lit(False))
    marked = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    keys = [F.when(F.col("good"), F.xxhash64("vector")).alias("h1"), F.when(F.col("good"), F.xxhash64(F.lit(7), "vector")).alias("h2")]
    marked = marked.select("id", "vector", "good", *keys)
    nodes = cut(marked.where("good").groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector")))
    width = max(1, nodes.agg(F.max(F.size("vector"))).first()[0] or 1)
    s = fitted(nodes, width, cosine, blocks)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rotated = batch.column(0).to_numpy(), unit(matrix(batch.column(1), width)) @ s.rotation
            for b in range(s.blocks):
                for at, cell, own in s.cells(rotated, b):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), b, np.int32)), pa.array(cell), pa.array(np.full(len(at), own))], ["node", "block", "cell", "home"])

    # A node id may stand for several vectors if rows share an id; so places go by the row's own hash too.
    keyed = nodes.select(F.xxhash64("h1", "h2").alias("key"), "vector")
    placed = cut(keyed.mapInArrow(place, "node long, block int, cell long, home boolean").withColumnRenamed("node", "key"))
    crowd = placed.groupBy("block", "cell").agg(F.count("*").alias("n"), F.max("home").alias("any")).where("any and n > 1").select("block", "cell", F.ceil(F.col("n") / TILE).alias("k"))
    tiled = placed.join(crowd, ["block", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("k")))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).select("key", "block", "cell", "home", "chunk", F.least("chunk", "other").alias("t1"), F.greatest("chunk", "other").alias("t2"))
    carried = nodes.select(F.xxhash64("h1", "h2").alias("key"), "node", "copies", "vector")
    tiles = tiled.join(carried, "key").select("block", "cell", "t1", "t2", "chunk", "home", "node", "copies", "vector", "key")

    def run(group: pa.Table) -> pa.Table:
        raw = matrix(group.column("vector"), width)
        as_numpy = lambda c: group.column(c).to_numpy()
        node, chunk = as_numpy("node"), as_numpy("chunk")
        if len(raw) < 2 or (as_numpy("t1")[0] != as_numpy("t2")[0] and chunk.min() == chunk.max()):
            return pa.table({"key": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        links, label = tile_links(raw, chunk, as_numpy("home"), as_numpy("copies"), s, int(as_numpy("block")[0]), cosine)
        at = np.flatnonzero(links > 0)
        return pa.table({"key": as_numpy("key")[at], "node": node[at], "other": node[label[at]], "links": links[at].astype(np.int64)})

    found = cut(tiles.groupBy("block", "cell", "t1", "t2").applyInArrow(run, "key long, node long, other long, links long"))
    joined = components(found.select("node", "other"))
    totals = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = nodes.select("h1", "h2", "node", "copies", F.xxhash64("h1", "h2").alias("key")).join(totals, "key", "left").join(joined, "node", "left")
    known = known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = marked.select("id", "h1", "h2").join(known, ["h1", "h2"], "left")
    return out.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).withColumnRenamed("id", "vec_id")


ORACLE = """
with recursive vectors as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from vectors a join vectors b on a.vec_id <> b.vec_id
  where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.9),
reach(x, y) as (select vec_id, vec_id from embeddings union select reach.x, links.b from reach join links on reach.y = links.a)
select vec_id, (select count(*) from links where a = vec_id) as n_links, (select min(y) from reach where x = vec_id) as component_id,
  vec_id = (select min(y) from reach where x = vec_id) as kept from embeddings
"""
