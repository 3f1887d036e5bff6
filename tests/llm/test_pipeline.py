"""The pipeline's stages on their own inputs."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stage_names_and_columns(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        docs = out


def test_language_stage(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "", "en", "s", 0), (10_003, "12345 !!! ???", "en", "s", 9)], SCHEMA)
    kept = {r[0] for r in corpus_pipeline.language(spark, docs.unionByName(odd), SF).select("doc_id").collect()}
    assert not kept & {10_001, 10_002, 10_003}
    assert len(kept) > 0.95 * docs.count()


def test_near_duplicate_stage(spark):
    from llm.test_joins import brute

    rng = random.Random(2)
    rows = []
    for _ in range(40):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([30, 100, 300]))]
        for _ in range(rng.randrange(1, 4)):
            rows.append((len(rows), " ".join(w if rng.random() > 0.01 else f"w{rng.randrange(300)}" for w in base), "en", "s", 1))
    twice = [*rows, rows[0], rows[0], (None, rows[0][1], "en", "s", 1), (None, None, None, None, None)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(twice, SCHEMA).repartition(3), SF).collect()
    expected = {i for i, (_, c) in brute([r[:2] for r in rows], 5, 80).items() if i == c}
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert sorted(ids) == sorted(expected)
    assert sum(r["doc_id"] is None for r in got) == 2


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    # All that the third stage kept is packed.
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert {r[0] for r in docs.select("doc_id").collect()} == {r[0] for r in out.select("doc_id").distinct().collect()}
