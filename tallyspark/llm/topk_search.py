"""Exact top-k search by inner product with a three-phase uniform threshold.

Vectors are split by dimension into `lists` lists, as if each list knew only a part of every score. Queries go
in tiles of a bounded size, which are broadcast; rows stay where they are read, and are never shuffled.
1. Gather: each task keeps, for each list and query, the k rows with the largest part in that list alone. The
   scores of these rows are completed; the k-th best of a query over all tasks is a cutoff that no true answer is below.
2. Collect: with the cutoff t sent to all tasks, each list gives the rows whose part is at least
   t / lists; some list must give a row whose score reaches t. Rows whose norm in the list rules that out for all
   queries of a block are left out of the product.
3. Resolve: the scores of the rows that were given are completed exactly; the best k of those that reach t are the answer.

Copies of a vector tie; ties go to the smaller id.

Nulls: a null id, a null vector and one holding null or non-finite components take no part. Vectors of different
lengths count as padded with zeros. Components so large that a score may not fit 64 bits are an error. Repeated
rows are candidates of their own; of a repeated query id the smallest vector is the query. Empty tables give no
rows. Both frames are read by position: id, vector; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import append, cut, ship, table

TILE, BLOCK, CELLS = 16_384, 512, 1 << 22  # queries of a tile and of a block; components of a block of rows
NONE = -(2**62)  # below every score


def whole(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def as_integers(vectors: pa.Array, width: int, scale: float) -> np.ndarray:
    sizes = np.diff(vectors.offsets.to_numpy())
    values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if np.abs(values).max(initial=0) >= 2.0**53:
        raise OverflowError("a component is beyond 53 bits once scaled")
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values.astype(np.int64)
    return out


def comparable(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in doubles where all sums of products are exact in these, else as integers."""
    most = x.shape[1] * int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0))
    if most >= 2**62:
        raise OverflowError("scores may be beyond 64 bits")
    return (x.astype(np.float64), q.astype(np.float64)) if most < 2**53 else (x, q)


def best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the best k of their query."""
    order = np.lexsort((ids, -score, q))
    ranked = q[order]
    return order[np.arange(len(q)) - np.searchsorted(ranked, ranked) < k]


class Tile:
    """A tile of queries and what a task does with it."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, lists: int, k: int):
        order = np.argsort(ids)
        self.ids, self.matrix, self.k = ids[order], matrix[order], k
        edges = np.linspace(0, matrix.shape[1], lists + 1).astype(int)
        self.lists = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) where a row has the query's id."""
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        row = np.flatnonzero(self.ids[at] == ids)
        return at[row], row

    def completed(self, x: np.ndarray, q: np.ndarray, row: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Whole scores of some pairs."""
        out, step = np.zeros(len(row), np.int64), max(1, CELLS // max(1, x.shape[1]))
        for at in range(0, len(row), step):
            part = slice(at, at + step)
            out[part] = (x[row[part]] * q[query[part]]).sum(1)
        return out

    def gather(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the rows that lists name, the best k of each query."""
        least = np.full((len(self.lists), len(self.ids)), -np.inf)  # each list's k-th largest part so far
        tops = [(np.zeros(0, np.int64), np.zeros(0)) for _ in self.lists]
        found = tuple(np.zeros(0, np.int64) for _ in range(3))
        for ids, rows in blocks:
            x, q = comparable(rows, self.matrix)
            own_q, own_r = self.own(ids)
            named = [np.zeros(0, np.int64)]
            for j, dims in enumerate(self.lists):
                some_q, some_r, part = [], [], []
                for low in range(0, len(q), BLOCK):
                    p = (q[low : low + BLOCK, dims] @ x[:, dims].T).astype(np.float64)
                    mine = (own_q >= low) & (own_q < low + BLOCK)
                    p[own_q[mine] - low, own_r[mine]] = -np.inf
                    a, b = np.nonzero(p > least[j, low : low + BLOCK, None])
                    if len(a) > 4 * self.k * len(p):  # the list is still open: only its best can stay
                        top = np.argpartition(p, -min(self.k, p.shape[1]), axis=1)[:, -self.k :]
                        a, b = np.repeat(np.arange(len(p)), top.shape[1]), top.ravel()
                        a, b = a[p[a, b] > -np.inf], b[p[a, b] > -np.inf]
                    some_q.append(a + low)
                    some_r.append(b)
                    part.append(p[a, b])
                a, b, v = (np.concatenate(z) for z in (some_q, some_r, part))
                named.append(a * len(x) + b)
                a, v = np.concatenate([tops[j][0], a]), np.concatenate([tops[j][1], v])
                keep = best(a, np.zeros(len(a)), v, self.k)
                tops[j] = a[keep], v[keep]
                full = np.bincount(a[keep], minlength=len(self.ids)) >= self.k
                lowest = np.full(len(self.ids), np.inf)
                np.minimum.at(lowest, a[keep], v[keep])
                least[j] = np.where(full, lowest, -np.inf)
            pair = np.unique(np.concatenate(named))
            query, row = pair // len(x), pair % len(x)
            found = tuple(np.concatenate(z) for z in zip(found, (query, ids[row], self.completed(x, q, row, query)), strict=True))
            keep = best(*found, self.k)
            found = tuple(z[keep] for z in found)
        return found

    def answer(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]], cutoffs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the best k rows of each query whose scores reach its cutoff."""
        least = -(-cutoffs // len(self.lists))
        found = tuple(np.zeros(0, np.int64) for _ in range(3))
        for ids, rows in blocks:
            x, q = comparable(rows, self.matrix)
            own_q, own_r = self.own(ids)
            for low in range(0, len(q), BLOCK):
                block, bound = q[low : low + BLOCK], least[low : low + BLOCK]
                given = [np.zeros(0, np.int64)]
                for dims in self.lists:
                    size, length = (np.sqrt((z[:, dims].astype(np.float64) ** 2).sum(1)) for z in (x, block))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        shortest = np.where(bound <= 0, 0, np.where(length > 0, bound / length, np.inf)).min(initial=np.inf)
                    near = np.flatnonzero(size * (1 + 1e-9) >= shortest)
                    if len(near):
                        a, b = np.nonzero(block[:, dims] @ x[near][:, dims].T >= bound[:, None])
                        given.append(a * len(x) + near[b])
                pair = np.unique(np.concatenate(given))
                query, row = pair // len(x) + low, pair % len(x)
                mine = np.isin(pair + low * len(x), own_q * len(x) + own_r)
                query, row = query[~mine], row[~mine]
                score = self.completed(x, q, row, query)
                keep = score >= cutoffs[query]
                found = tuple(np.concatenate(z) for z in zip(found, (query[keep], ids[row[keep]], score[keep]), strict=True))
            keep = best(*found, self.k)
            found = tuple(z[keep] for z in found)
        return found


def search(rows: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, lists: int = 4) -> DataFrame:
    """rows (id, vector), queries (id, vector) -> query_id, rank, vec_id, score. Components become floor(scale * x)."""
    spark = rows.sparkSession
    ship(spark)
    two = lambda df: df.select(df[df.columns[0]].cast("long").alias("id"), df[df.columns[1]].alias("vector")).where(F.col("id").isNotNull() & whole(F.col("vector")))
    rows, queries = two(rows), two(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    queries = cut(queries)
    n, wide = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = max(1, wide or 1, rows.agg(F.max(F.size("vector"))).first()[0] or 1)
    tiles = max(1, -(-n // TILE))
    tile_of = F.pmod(F.xxhash64("id"), F.lit(tiles))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    step, schema = max(1, CELLS // width), "query_id long, vec_id long, score long"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                yield part.column(0).to_numpy(zero_copy_only=False), as_integers(part.column(1), width, scale)

    def over_rows(tile, cutoffs) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = tile.value
            query, ids, score = t.gather(blocks(batches)) if cutoffs is None else t.answer(blocks(batches), cutoffs.value)
            yield pa.RecordBatch.from_arrays([pa.array(t.ids[query]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

        return rows.mapInArrow(run, schema)

    def answers(number: int) -> DataFrame:
        got = queries.where(tile_of == number).toArrow().combine_chunks()
        vectors = got.column(1).combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.float64()))
        tile = Tile(got.column(0).to_numpy().astype(np.int64), as_integers(vectors, width, scale), min(lists, width), k)
        if not len(tile.ids):
            return spark.createDataFrame([], schema + ", rank int")
        sent = spark.sparkContext.broadcast(tile)
        known = top(over_rows(sent, None)).groupBy("query_id").agg(F.min("score").alias("cutoff"), F.count("*").alias("n")).where(F.col("n") == k).toArrow()
        cutoffs = np.full(len(tile.ids), NONE)
        cutoffs[np.searchsorted(tile.ids, known.column(0).to_numpy())] = known.column(1).to_numpy()
        return top(over_rows(sent, spark.sparkContext.broadcast(cutoffs)))

    found = answers(0) if tiles == 1 else append(answers(t) for t in range(tiles))
    return found.select("query_id", "rank", "vec_id", "score")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0), k=5, scale=256.0)


ORACLE = """
with vectors as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score from vectors q join vectors c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scored qualify rank <= 5
"""
