"""Helpers shared by the training-data operators: lineage cuts, connected components, text arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.shipping import ship as ship_code

ROWS_AT_ONCE = 2048


def ship(spark: SparkSession) -> None:
    """Give this package to all executors. Texts are long, so Python gets fewer rows at once than the default 10,000."""
    ship_code(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tallyspark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which all executors share: what the session names in spark.checkpoint.dir."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(named or _local_folder()).rstrip('/')}/tallyspark-{sc.applicationId}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and go on from there, so that a lost executor costs a reread.

    The shuffle files of the write go when it has ended; drop() deletes the table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_paths = [path]
    return out


def append(parts: Iterator[DataFrame]) -> DataFrame:
    """cut() of the union of frames of one schema, each written before the next one is made."""
    out = path = None
    for df in parts:
        path = path or f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
        df.write.mode("append").parquet(path)
        out = df
    out = out.sparkSession.read.schema(out.schema).parquet(path)
    out.cut_paths = [path]
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the tables that cut() wrote for these frames, once nothing unfinished reads them."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        for path in getattr(df, "cut_paths", []):
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def spread(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Joins many rows for each key with one row for each key, so that adaptive execution can split a hot key's rows.

    It splits a side only if that is read straight from its exchange. An aggregate by the key would be joined as
    it lies; the second join column, a hash of the key, asks for an exchange after it.
    """
    hashed = lambda df: df.withColumn("_hash", F.xxhash64(key))
    return hashed(many).join(hashed(one).hint("merge"), [key, "_hash"]).drop("_hash")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): rows (node, component), component the smallest node reached.

    Alternates large-star and small-star steps until the edges stay as they are. Every step is a
    minimum by key (combined before the shuffle) and a join of the edges with one row per node, so a
    node with very many edges is split by the skew join and never gathered. Node type: any orderable.
    Nulls and loops are no edges; nodes without an edge are not returned. drop() takes the result.
    """
    u, v = edges.columns
    ordered = edges.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    now = cut(ordered)
    mark = None
    while True:
        both = now.union(now.select("v", "u")).toDF("a", "b")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = spread(both.where("b > a"), low, "a").select(F.col("b").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread(large, least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, now = now, cut(small.select("e.u", "e.v").where("u != v").distinct())
        drop(last)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    out = now.union(now.select("v", "v").distinct()).toDF("node", "component")
    out.cut_paths = now.cut_paths
    return out


def held_out(id_col: str, modulus: int, remainder: int):
    """crc32 of the id as text, modulo; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def take_share(id_col: str, share: float):
    """A fixed pseudo-random share of the ids, the same in every run."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(17)), F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1)


def _lower_table() -> np.ndarray:
    t = np.arange(65536, dtype=np.uint32)
    for i in range(0x2000):
        low = chr(i).lower()
        if len(low) == 1:
            t[i] = ord(low)
    return t


LOWER = _lower_table()


def lower(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < 65536, LOWER[np.minimum(codes, 65535)], codes)


def segments(texts: pa.Array, limit: int = 300_000, overlap: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The texts' code points in chunks of about limit: (codes, offsets of the pieces, row of each piece).

    Whole texts; one longer than the limit comes as several pieces which share overlap code points.
    Nulls count as empty texts.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.utf8_length(texts).to_numpy()
    i, n = 0, len(sizes)
    while i < n:
        if sizes[i] > limit:
            codes = np.frombuffer(texts[i].as_py().encode("utf-32-le"), "<u4")
            for at in range(0, len(codes), limit - overlap):
                part = codes[at : at + limit]
                yield part, np.array([0, len(part)]), np.array([i])
                if at + limit >= len(codes):
                    break
            i += 1
            continue
        ends = np.cumsum(sizes[i:])
        j = i + max(1, int(np.searchsorted(ends, limit, "right")))
        joined = "".join(texts.slice(i, j - i).to_pylist())
        yield np.frombuffer(joined.encode("utf-32-le"), "<u4"), np.concatenate([[0], ends[: j - i]]), np.arange(i, j)
        i = j


MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(codes: np.ndarray, offsets: np.ndarray, orders: range, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order n: the bucket of the n-gram at every position, and the number of code points left in its piece."""
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(codes))
    c = codes.astype(np.uint64) + np.uint64(1)
    h = c.copy()
    for n in range(1, orders.stop):
        if n > 1:
            h = h[:-1] * STEP + c[n - 1 :] if len(h) > 1 else h[:0]
        if n >= orders.start:
            x = (h ^ (h >> np.uint64(29))) * MIX
            yield (x >> np.uint64(64 - bits)).astype(np.int64), left[: len(h)] >= n


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values over each piece; empty pieces give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64 if values.dtype.kind in "biu" else np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
