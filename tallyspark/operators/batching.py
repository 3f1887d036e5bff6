"""Row numbers over a whole table without one task that sees all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about; keys looked at for each range's bound, about.
RANGE_ROWS, RANGE_KEYS = 100_000, 50


def bounds_of(rows: DataFrame, key: str) -> list:
    """Keys between which about RANGE_ROWS rows lie. They only part the rows: any keys give the same numbers."""
    n = rows.count()
    ranges = -(-n // RANGE_ROWS)
    if ranges < 2:
        return []
    looked_at = [r[0] for r in rows.select(key).where(F.col(key).isNotNull()).sample(min(1.0, ranges * RANGE_KEYS / n), 1).sort(key).collect()]
    return sorted({looked_at[len(looked_at) * i // ranges] for i in range(1, ranges)}) if looked_at else []


def range_of(key: Column, bounds: list) -> Column:
    """How many bounds are not above a key, by bisection; a null key is below all of them."""
    if not bounds:
        return F.lit(0)

    @F.pandas_udf("int")
    def up_to(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(pd.Series(bounds).to_numpy(), keys.to_numpy(), side="right").astype("int32"))

    return F.when(key.isNull(), 0).otherwise(up_to(F.coalesce(key, F.lit(bounds[0]))))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Adds number, from 0 in order of key: a row's place in its range of keys, after the rows of the ranges before it.

    A range is told by a row's key alone and not by the partition that it lies in, which two reads of the same rows
    need not agree on. The ranges' sizes are one row each; they are summed up in a window over ranges only.
    """
    placed = rows.withColumn("_range", range_of(F.col(key), bounds_of(rows, key))).repartition("_range")
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    row = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return placed.withColumn("_row", row - 1).join(F.broadcast(before), "_range").withColumn("number", F.col("_before") + F.col("_row")).drop("_range", "_row", "_before")
