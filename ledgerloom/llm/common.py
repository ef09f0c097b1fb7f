"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import materialise, shared_dir, ship_package

__all__ = ["WORD", "counted_join", "fresh_dir", "hash_bin", "id_order", "let_go", "materialise", "null_last", "once_per_worker", "read", "running_sum", "shared_dir", "ship_package",
           "shuffle_parts", "store", "word_count"]

#: A word: a run of characters that are neither the space nor one of U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def null_last(column: Column) -> list[Column]:
    """Sort keys for ascending order with nulls at the end."""
    return [column.isNull().asc(), column.asc()]


def id_order(column: Column) -> Column:
    """A long that orders ids ascending, null ids last."""
    return F.coalesce(column.cast("long"), F.lit(2**63 - 1))


def hash_bin(hashed: Column, bits: int) -> Column:
    """The top ``bits`` of a 64-bit hash as a non-negative integer."""
    return F.shiftrightunsigned(hashed, 64 - bits)


def running_sum(df: DataFrame, keys: Sequence[str], bins: Sequence[str], order: Sequence[Column], value: str,
                out: str, nulls: bool = True) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same ``keys``, in the order of ``bins`` and then ``order``.

    ``bins`` are leading sort columns without nulls that cut a key into parts of one task each; only sums per bin are
    windowed over a whole key, so a key with a third of all rows is spread like the others.
    Without ``nulls`` no key is null, and one exchange of the rows serves window and join.
    """
    group = [*keys, *bins]
    whole = Window.partitionBy(*keys).orderBy(*bins).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group).agg(F.sum(value).alias("_sum"))
    base = sums.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(group)],
                       F.coalesce(F.sum("_sum").over(whole), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = df.withColumn("_within", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"_b{i}")) if nulls else F.col(c) == F.col(f"_b{i}") for i, c in enumerate(group)]
    joined = within.join(base, same)
    return joined.withColumn(out, F.col("_base") + F.col("_within")).select(*df.columns, out)


#: Keys that hold more than one in so many of all rows are joined by broadcast; there are fewer of them than this.
HOT_SHARE = 1000


def counted_join(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """Inner join of ``rows`` with the written table ``keyed``: one row per key, with the ``count`` of its rows.

    Keys with more than one in ``HOT_SHARE`` of all counted rows are fewer than ``HOT_SHARE`` whatever the data, so they
    are broadcast; the others are shuffled, and none of them is larger than that share.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(keyed.filter(F.col(count) * HOT_SHARE > total))
    cold = keyed.filter(F.col(count) * HOT_SHARE <= total)
    rest = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti")
    return rows.join(hot, list(keys)).unionByName(rest.join(cold, list(keys)))


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a folder that all executors reach, by URI or absolute path."""
    return fs.FileSystem.from_uri(path)


def texts_of(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of few rows, so that Python objects of one slice live at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


#: Cached builders of models; a worker process outlives its tasks and would hold whatever any of them built.
_MODELS: list = []


def once_per_worker(build: Callable) -> Callable:
    """``build`` with its last result kept by the worker process until a task there calls ``let_go``."""
    kept = functools.lru_cache(maxsize=1)(build)
    _MODELS.append(kept)
    return kept


def let_go(*but: Callable) -> None:
    """Drop the models that this worker process holds, except those of the given builders, and give their memory back."""
    dropped = [model for model in _MODELS if model not in but and model.cache_info().currsize]
    for model in dropped:
        model.cache_clear()
    if dropped:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)


def single_thread() -> None:
    """Keep native tokenizer threads out of Spark's task slots."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
