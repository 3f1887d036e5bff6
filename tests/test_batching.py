"""Numbers of rows do not depend on how two reads of the same rows are dealt."""

import random

from tallyspark.operators import batching
from tallyspark.queries import queries

APART = {"spark.sql.exchange.reuse": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def shuffled(spark, keys, path, kind="long"):
    spark.createDataFrame([(k,) for k in random.Random(1).sample(keys, len(keys))], f"o_orderkey {kind}").repartition(3).write.parquet(str(path / "orders.parquet"))


def test_sync_batches_when_reads_are_dealt_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batching, "RANGE_ROWS", 700, raising=False)
    keys = [7 * i for i in range(20_000)]
    shuffled(spark, keys, tmp_path)
    had = {k: spark.conf.get(k) for k in APART}
    try:
        for k, v in APART.items():
            spark.conf.set(k, v)
        got = queries()["sync_batches"](spark, str(tmp_path)).collect()
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)
    assert sorted((r["o_orderkey"], r["batch"], r["n_rows"]) for r in got) == [(k, i // 100, 20_000) for i, k in enumerate(keys)]


def test_numbers_of_texts_with_ties_and_nulls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batching, "RANGE_ROWS", 50, raising=False)
    keys = [None] * 9 + [f"{i:03d}é" for i in range(300) for _ in range(1 + 200 * (i == 7))]
    shuffled(spark, keys, tmp_path, "string")
    got = batching.numbered(spark.read.parquet(str(tmp_path / "orders.parquet")), "o_orderkey").collect()
    assert [r["o_orderkey"] for r in sorted(got, key=lambda r: r["number"])] == keys
    assert sorted(r["number"] for r in got) == list(range(len(keys)))
