"""Rows dealt by ranges of an id, with bounds that are fixed before the rows move."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_ids(df: DataFrame, id_col: str, n: int) -> list[int]:
    """The smallest id of each of at most n ranges of about the same size, ascending; none of an empty table.

    Only the id column is read and moved, by Spark's range partitioner, whose sample of the ids
    is bounded; the driver gets one number a range. All rows of one id are in one range. df must
    give the same rows each time it is read (a table does).
    """
    ids = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"))
    dealt = ids.repartitionByRange(max(n, 1), "id").select("id", F.spark_partition_id().alias("range"))
    return sorted(r.first for r in dealt.groupBy("range").agg(F.min("id").alias("first")).collect())


def range_of(ids: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The range that holds each id."""
    return (np.searchsorted(firsts, ids, "right") - 1).astype(np.int32)


def part_of(df: DataFrame, id_col: Column, firsts: list[int]) -> Column:
    """The range of an id, by binary search in the broadcast list (eight bytes a range); only ids reach Python."""
    shared = df.sparkSession.sparkContext.broadcast(np.array(firsts, dtype=np.int64))

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(range_of(ids.to_numpy(), shared.value))

    return part(id_col)
