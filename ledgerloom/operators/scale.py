"""Ordered work on keys of any size.

A window over ``(key order by position)`` puts a whole key into one task. These helpers cut
each key into blocks along its order, do the per-row work inside a block, and carry only one
summary row per block across blocks. A key holding a third of all rows is then spread over
as many tasks as it has blocks, and results are the same as from the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
#: Rows of a task that makes several wide rows of each and sorts them more than once; a chain of windows has a fixed cost
#: per task (several seconds, as its code outgrows Spark's cache), so tasks are not smaller than the second figure.
ROWS_PER_TASK, LEAST_ROWS = 120_000, 5_000


def spread(df: DataFrame, keys: Sequence[str], rows: int, per_task: int = ROWS_PER_TASK, least: int = LEAST_ROWS) -> DataFrame:
    """Deal ``rows`` rows by key over so many partitions that one holds about ``per_task`` of them at most.

    Adaptive execution sizes tasks by the bytes they read, so rows that grow many times after the exchange make tasks
    whose memory grows with the input. Partitions dealt by number keep it the same, and their count grows instead.
    Small tables still use all cores where a core gets ``least`` rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, math.ceil(rows / per_task), min(cores, math.ceil(rows / least))), *keys)


def previous_value(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str,
                   block: int = BLOCK) -> DataFrame:
    """Nearest earlier non-null ``value`` of the same key; ``order`` is an integer position."""
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    group = [*keys, "_block"]
    # One row per block, with map-side combine: the newest non-null value of the block.
    blocks = blocked.groupBy(*group).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(*group, F.last("_last", ignorenulls=True).over(across).alias("_carry"))
    inside = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = blocked.withColumn("_prev", F.last(value, ignorenulls=True).over(inside))
    return (within.join(carry, group, "left")
            .withColumn(out, F.coalesce("_prev", "_carry"))
            .drop("_block", "_prev", "_carry"))


def exact_rank(df: DataFrame, keys: Sequence[str], bins: Sequence[str], order: Sequence[Column],
               rank: str, total: str | None = None) -> DataFrame:
    """1-based rank inside ``keys`` ordered by ``bins`` then ``order``.

    ``bins`` are leading sort columns that split a key into parts that fit one task; only the
    bin counts are windowed over the whole key.
    """
    group = [*keys, *bins]
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(*bins).rowsBetween(Window.unboundedPreceding, -1)
    columns = [*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")]
    if total:
        columns.append(F.sum("_n").over(whole).alias(total))
    offsets = counts.select(*columns)
    inside = Window.partitionBy(*group).orderBy(*order)
    return (df.withColumn("_in", F.row_number().over(inside))
            .join(offsets, group)
            .withColumn(rank, F.col("_before") + F.col("_in"))
            .drop("_before", "_in"))


def take_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, rank: str) -> DataFrame:
    """First ``limit`` rows per key.

    The constant bound lets Spark keep at most ``limit`` rows per key and map task before the
    shuffle (WindowGroupLimit), so a hot key never arrives whole at one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= F.lit(limit))
