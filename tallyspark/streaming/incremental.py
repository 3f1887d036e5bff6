"""Incremental runs: pages that arrive in a folder go through a run in micro-batches.

What was seen before is in the state, without a horizon, so no watermark is needed: a batch that is delivered
again is found in the state and does nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyspark.plans.run import process
from tallyspark.schemas import PAGE
from tallyspark.sources.state import State


def watch(spark: SparkSession, folder: str, state: State, as_of: dt.date, checkpoint: str) -> StreamingQuery:
    """Takes in all Parquet pages of a folder that are there now, then stops."""

    def run(batch: DataFrame, number: int) -> None:
        process(batch, state, as_of)

    return spark.readStream.schema(PAGE).parquet(folder).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
