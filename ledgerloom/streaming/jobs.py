"""Structured Streaming jobs (STR1-STR5).

Every job writes files with a checkpoint in a shared folder, so a restarted job continues
where it stopped and a lost executor only costs a retry of its task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators.scale import BLOCK
from ledgerloom.session import shared_dir, ship_package

#: State on disk, so that it may be larger than memory; a batch writes its changes, not a copy of the state.
DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their keyed state in RocksDB; the session's own settings come back afterwards."""
    before = {name: spark.conf.get(name, None) for name in DISK_STATE}
    ship_package(spark)
    for name, value in DISK_STATE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A parquet table of a folder as a file stream; the table is one file or a folder of files.

    A stream refuses the plain path of a file, so the path is a pattern that only this table matches.
    """
    path = f"{folder.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[t]")


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a stream into a fresh table of the shared folder and return that table."""
    target = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{target}/data")
             .option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/data")


def run_batches(spark: SparkSession, stream: DataFrame, name: str, summarise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Summarise each micro-batch into its own partition of a table and return the table.

    A replayed batch replaces its partition, so partial results are counted exactly once. A table without rows gives no
    partial results.
    """
    nothing = summarise(spark.createDataFrame([], stream.schema)).limit(0).withColumn("batch_id", F.lit(0))
    target = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        (summarise(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{target}/data"))

    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    nothing.drop("batch_id").write.mode("append").parquet(f"{target}/data")  # the folder, if no batch made it
    return spark.read.schema(nothing.schema).parquet(f"{target}/data")


def new_statements(stream: DataFrame, key: str, event_time: str, delay: str = "1 day") -> DataFrame:
    """Each fingerprint once within the watermark delay (STR1); a short state for repeated deliveries."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def run_new_statements(spark: SparkSession, stream: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """Keys that neither ``known`` nor an earlier micro-batch holds, each once (STR1).

    Keys live in the state store, hashed over its partitions on disk: a batch looks up its own keys there and reads
    none of the others, however many batches came before. ``known`` is a fixed table and doesn't grow with the stream.
    A null key is a key like any other.
    """
    fresh = stream.select(key)
    if known is not None:
        held = known.select(F.col(key).alias("_known"))
        fresh = fresh.join(held, fresh[key].eqNullSafe(held["_known"]), "left_anti")
    with disk_state(spark):
        return run_to_table(spark, fresh.dropDuplicates([key]), "keys")


def feedback_rates(stream: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Rows, sum and mean of the deposits per method in tumbling windows; late rows are dropped (STR2)."""
    return (stream.withWatermark("created_at", delay).groupBy(F.window("created_at", window).alias("w"), "method")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("total_deposits").alias("deposits"))
            .select(F.col("w.start").alias("start"), "method", "n", "deposits",
                    (F.col("deposits").cast("double") / F.col("n")).alias("mean_deposits")))


def monthly_deltas(batch: DataFrame) -> DataFrame:
    """Income and expenses of one micro-batch per month (STR3)."""
    credit = F.col("type") == "credit"
    return batch.groupBy("month_key").agg(
        F.sum(F.when(credit, F.col("amount"))).alias("income"), F.sum(F.when(~credit, F.col("amount"))).alias("expenses"),
        F.count(F.lit(1)).alias("n"))


def merge_months(deltas: DataFrame) -> DataFrame:
    """Running totals: the sum of all batch deltas (STR3)."""
    return deltas.groupBy("month_key").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("income", "expenses", "n")])


def retrain_counter(batch: DataFrame) -> DataFrame:
    """Auto-labelled pages of one micro-batch (STR4)."""
    return batch.agg(F.count_if(F.col("stem").startswith("auto_")).alias("auto_pages"))


def retrain_due(counts: DataFrame, min_pages: int) -> DataFrame:
    """Whether the pages counted so far call for a retraining run (STR4)."""
    return counts.agg(F.coalesce(F.sum("auto_pages"), F.lit(0)).alias("auto_pages")).withColumn(
        "ready_for_retrain", F.col("auto_pages") >= min_pages)


def partial_counts(stream: DataFrame, key: str) -> DataFrame:
    """Rows per key of each Arrow batch, so that a hot key reaches its state as few rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally = pa.table([batch.column(0)], ["key"]).group_by("key").aggregate([([], "count_all")])
            yield from pa.table([tally.column("key"), tally.column("count_all")], ["key", "n"]).to_batches()

    return stream.select(F.col(key).cast("string").alias("key")).mapInArrow(count, "key string, n long")


def run_retrain_signals(spark: SparkSession, stream: DataFrame, key: str, min_pages: int) -> DataFrame:
    """One row ``key, signal, pages`` each time a key's pages reach another ``min_pages`` (STR4).

    The counter is keyed state, so a restarted or replayed batch continues from the count before it and a crossing is
    signalled once; the file sink takes each batch once. Null keys are counted together.
    """

    def crossings(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        after = before + sum(int(frame["n"].sum()) for frame in frames)
        state.update((after,))
        signals = range(before // min_pages + 1, after // min_pages + 1)
        if signals:
            yield pd.DataFrame([(key[0], k, k * min_pages) for k in signals], columns=["key", "signal", "pages"])

    counted = partial_counts(stream, key).groupBy("key").applyInPandasWithState(
        crossings, "key string, signal long, pages long", "pages long", "append", GroupStateTimeout.NoTimeout)
    with disk_state(spark):
        return run_to_table(spark, counted, "signals")


_HAS_AMOUNT, _HAS_BALANCE = 1, 2


def known_before(known: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier entry that is known, -1 where there is none."""
    upto = np.maximum.accumulate(np.where(known, np.arange(len(known)), -1))
    return np.append(-1, upto[:-1])[:len(known)]


def balances_before(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a row of ``seq, amount, balance, flags`` columns has an earlier balance, and that balance."""
    at = known_before((table[3] & _HAS_BALANCE) != 0)
    return at >= 0, np.where(at >= 0, table[2][at], 0) if len(at) else at


def block_answers(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Merge rows into a block of a statement; rows whose previous balance in the block is new or has changed go out."""
    held = np.array(state.get, np.int64) if state.exists else np.empty((4, 0), np.int64)
    given = np.concatenate([frame[["seq", "amount", "balance", "flags"]].to_numpy(np.int64).T for frame in frames], axis=1)
    given = given[:, np.lexsort((given[1], given[2], given[3], given[0]))]
    given = given[:, np.append(given[0, 1:] != given[0, :-1], True)]
    kept = ~np.isin(held[0], given[0])
    table = np.concatenate([held[:, kept], given], axis=1)
    order = np.argsort(table[0])
    table = table[:, order]
    state.update(tuple(row.tolist() for row in table))
    has, value = balances_before(table)
    had, was = balances_before(held)
    fresh = np.ones(table.shape[1], bool)
    old = order < kept.sum()  # rows held before, in the order of their positions
    fresh[old] = (had[kept] != has[old]) | (was[kept] != value[old])
    out = table[:, fresh]
    yield pd.DataFrame({"stem": pd.Series([key[0]] * out.shape[1], dtype=object), "block": key[1], "seq": out[0], "amount": out[1],
                        "balance": out[2], "flags": out[3], "prev": value[fresh], "has_prev": has[fresh]})


def run_balances(spark: SparkSession, stream: DataFrame, block: int = BLOCK) -> DataFrame:
    """Previous known balance of every row of a stream of ``stem, seq, amount, balance_after``, in any order (STR5).

    State is kept per statement and block of ``block`` positions, so a busy statement is spread over tasks, a value of
    state is bounded, and a batch rewrites only blocks that it touches. Each batch appends the rows whose answer inside
    their block is new or has changed: a late row corrects the rows after it. The result is the latest answer per
    position, where the first known balance of a block is carried over from the blocks before it.

    Defined cases: a position that is delivered again takes the newest row (in one batch the one with a balance, then the
    larger); rows without a position have no previous balance and stay as they are; null stems are one statement.
    """
    target = f"{shared_dir(spark)}/balances-{uuid.uuid4().hex}"
    cents = lambda c: F.coalesce((F.col(c).cast("decimal(18,2)") * 100).cast("long"), F.lit(0))
    flags = (F.when(F.col("amount").isNull(), 0).otherwise(_HAS_AMOUNT) + F.when(F.col("balance_after").isNull(), 0).otherwise(_HAS_BALANCE)).cast("long")
    rows = stream.select(F.col("stem").cast("string").alias("stem"), F.col("seq").cast("long").alias("seq"), cents("amount").alias("amount"),
                         cents("balance_after").alias("balance"), flags.alias("flags")).withColumn("block", F.floor(F.col("seq") / block))
    changed = rows.filter("seq is not null").groupBy("stem", "block").applyInPandasWithState(
        block_answers, "stem string, block long, seq long, amount long, balance long, flags long, prev long, has_prev boolean",
        "seqs array<bigint>, amounts array<bigint>, balances array<bigint>, flags array<bigint>", "update", GroupStateTimeout.NoTimeout)
    unplaced = rows.filter("seq is null").withColumns({"prev": F.lit(0).cast("long"), "has_prev": F.lit(False)})

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{target}/data"))

    with disk_state(spark):
        query = (changed.unionByName(unplaced).writeStream.foreachBatch(write).outputMode("update")
                 .option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
    fields = "stem string, block long, seq long, amount long, balance long, flags long, prev long, has_prev boolean, batch_id long"
    return latest_balances(spark.read.schema(fields).parquet(f"{target}/data"))


def latest_balances(log: DataFrame) -> DataFrame:
    """The newest answer per position of the log that ``run_balances`` writes, carried across blocks."""
    placed = (log.filter("seq is not null").groupBy("stem", "block", "seq")
              .agg(F.max_by(F.struct("amount", "balance", "flags", "prev", "has_prev"), "batch_id").alias("r")).select("stem", "block", "seq", "r.*"))
    # one row per block: what the next blocks carry
    ends = (placed.groupBy("stem", "block")
            .agg(F.max_by("balance", F.when(F.col("flags").bitwiseAND(_HAS_BALANCE) != 0, F.col("seq"))).alias("end")))
    earlier = Window.partitionBy("stem").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(F.col("stem").alias("_stem"), F.col("block").alias("_block"), F.last("end", ignorenulls=True).over(earlier).alias("_carry"))
    whole = placed.join(carry, F.col("stem").eqNullSafe(F.col("_stem")) & (F.col("block") == F.col("_block")), "left")
    rows = whole.withColumn("prev", F.when(F.col("has_prev"), F.col("prev")).otherwise(F.col("_carry"))).select(
        "stem", "seq", "amount", "balance", "flags", "prev").unionByName(
        log.filter("seq is null").select("stem", "seq", "amount", "balance", "flags", F.lit(None).cast("long").alias("prev")))
    money = lambda c: (F.col(c).cast("decimal(20,0)") / 100).cast("decimal(18,2)")
    return rows.select("stem", "seq", F.when(F.col("flags").bitwiseAND(_HAS_AMOUNT) != 0, money("amount")).alias("amount"),
                       F.when(F.col("flags").bitwiseAND(_HAS_BALANCE) != 0, money("balance")).alias("balance_after"), money("prev").alias("prev_balance"))


def event_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")
