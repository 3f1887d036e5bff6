"""A corpus pipeline of four stages: language, quality, near duplicates, packing.

run() applies them to documents; each stage's rows are written as Parquet to the shared folder and read again
as the next one's docs. All but the last return the columns of documents. A row with a null doc_id goes
through the filters like any other and belongs to no group of near duplicates.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import language_id, packing, quality, set_join
from tallyspark.llm.common import cut, held_out, shared_folder, ship, table

LEAST_LANGUAGE = 0.3  # below: no known language claims the text
SHINGLE, PERCENT = 5, 80


def keep_rows(docs: DataFrame, decide: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows whose text decide says yes to, all columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 2048):
                part = batch.slice(low, 2048)
                yield part.filter(pa.array(decide(part.column(at))))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a language that the identifier knows; texts that are null, have no letter, or fit none go."""
    model = language_id.learn(docs)
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    if model is None:
        return lettered.limit(0)
    return keep_rows(lettered, lambda texts: model.score(texts)[1] >= LEAST_LANGUAGE)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts whose quality score reaches the threshold. Learns from the labelled documents that are still there."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)).select("doc_id", "quality")
    model = quality.learn(cut(quality.with_statistics(docs.select("doc_id", "text"))), labels)
    return keep_rows(docs, lambda texts: model.score(quality.statistics(texts).astype(np.float32).astype(np.float64)) >= quality.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id; repeated rows of it go.

    Only rows whose id may be one that goes, or comes twice, are shuffled; all others stay where they are.
    """
    groups = cut(set_join.similar_components(docs, SHINGLE, PERCENT).where("doc_id is not null"))
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    twice = groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    touched = cut(gone.union(twice).distinct())
    held = "held_"
    while any(c.lower().startswith(held) for c in docs.columns):
        held += "_"
    marked = set_join.mark_held(docs, "doc_id", touched, held)
    kept = marked.where(~F.col(held)).drop(held)
    doubtful = marked.where(held).drop(held).join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return kept.union(doubtful.select(*docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in windows, with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("language", language), ("quality", good_quality), ("near_duplicates", near_duplicates), ("packing", packed)]

#: Learnt models and tokens can't be said in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
