"""Embeddings as blocks of numpy rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(True))


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """A list column whose lists have one length, as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(rows, -1) if rows else np.empty((0, 0))


def block_of(column: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def blocks_for(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def each_pair_once(df: DataFrame, blocks: int) -> DataFrame:
    """Copy every row with its ``block`` to the cells ``(i, j)``, ``i <= j``, of its block with every other."""
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    return df.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn(
        "j", F.greatest("block", "other")).drop("other")
