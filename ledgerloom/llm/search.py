"""Exact top-k search by three-phase uniform threshold.

Vectors are whole numbers, ``floor(256 x)`` of each component, and a score is an inner product. The components are
cut into ``LISTS`` slices; a slice's partial score of a query with every row is one list, held in parts where the rows
are. The query set and all rows are cut into blocks, and a cell holds one block of either.

Phase 1: every cell takes the first ``k`` rows of each of its lists per query and sends their scores; the ``k``-th best
of all is a safe cutoff, since at least ``k`` rows reach it. Phase 2: the cutoff goes to every cell. A row that reaches
it has at least one partial score of cutoff / lists; only rows with such an entry are looked at, and of these only rows
whose known entries, with that threshold for the unknown ones, still reach the cutoff. Phase 3: their missing partials
are resolved, and the first ``k`` of a cell by score and id that reach the cutoff are sent and merged.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part; rows
with one id are rows of their own, as candidates of each other too, and as queries each has answers of its own; vectors of
different lengths don't meet; fewer than ``k`` other rows give fewer answers; ties go to the smaller id; an empty table
gives an empty result. Extra columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, ship_package
from ledgerloom.llm.vectors import block_of, blocks_for, matrix, usable
from ledgerloom.operators.scale import take_per_key

LISTS, QUERY_BLOCK, ROW_BLOCK, CHUNK = 4, 16384, 8192, 64
SCALE = 256
SENT = "query long, query_id long, row long, vec_id long, score long"


def partials(asked: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Partial scores of every slice, queries by rows; whole numbers far below 2**53, so doubles are exact."""
    cuts = np.linspace(0, asked.shape[1], LISTS + 1).astype(int)
    return [asked[:, a:b] @ rows[:, a:b].T for a, b in zip(cuts, cuts[1:])]


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best of one query, by score and then id."""
    if len(scores) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= limit)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def cell_entries(table: pa.Table, k: int, resolve: bool) -> pa.Table:
    """Entries that a cell sends: phase 1, or with cutoffs phases 2 and 3."""
    asks = np.asarray(table["asked"])
    numbers = np.floor(SCALE * matrix(table["vector"], table.num_rows))
    ids, marks, limits = np.asarray(table["id"]), np.asarray(table["row"]), np.asarray(table["cutoff"].fill_null(-(2**62)))
    order = np.lexsort((marks[~asks], ids[~asks]))
    rows, row_ids, row_marks = numbers[~asks][order], ids[~asks][order], marks[~asks][order]
    found: list[tuple[np.ndarray, ...]] = []
    asked, asked_ids, asked_marks, asked_limits = numbers[asks], ids[asks], marks[asks], limits[asks].astype(np.float64)
    for start in range(0, len(asked) if len(rows) else 0, CHUNK):
        parts = partials(asked[start:start + CHUNK], rows)
        whole = sum(parts)
        for q in range(len(whole)):
            mark = asked_marks[start + q]
            if resolve:
                limit = asked_limits[start + q]
                least = limit / LISTS
                known = np.flatnonzero(np.max([p[q] for p in parts], axis=0) >= least)
                bound = sum(np.where(p[q, known] >= least, p[q, known], least) for p in parts)
                some = known[bound >= limit - 0.5]
                some = some[whole[q, some] >= limit]
            else:
                size = min(k + 1, len(rows))  # one more, as the query itself may be among them
                some = np.unique(np.concatenate([np.argpartition(p[q], len(rows) - size)[len(rows) - size:] for p in parts]))
            some = some[row_marks[some] != mark]
            best = some[first(whole[q, some], row_ids[some], k)]
            found.append((np.full(len(best), mark), np.full(len(best), asked_ids[start + q]), row_marks[best], row_ids[best],
                          whole[q, best].astype(np.int64)))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 5
    return pa.table([pa.array(np.asarray(c, np.int64)) for c in columns], ["query", "query_id", "row", "vec_id", "score"])


def search(rows: DataFrame, asked: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
           row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row where ``asked`` holds, its ``k`` best other rows."""
    ship_package(rows.sparkSession)
    given = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"),
                        F.coalesce(asked, F.lit(False)).alias("asked"))
    given = given.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    given = materialise(given.withColumn("row", F.monotonically_increasing_id()), "vectors")  # written, so a row keeps its mark
    n, queries = given.agg(F.count(F.lit(1)), F.count(F.when(F.col("asked"), 1))).first()
    row_blocks, query_blocks = blocks_for(n, row_block), blocks_for(queries, query_block)
    all_of = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    key = ["dim", "row_block", "query_block"]
    there = given.select("row", "id", "vector", F.lit(False).alias("asked"), F.lit(None).cast("long").alias("cutoff"),
                         F.size("vector").alias("dim"), block_of("row", row_blocks).alias("row_block"), all_of(query_blocks).alias("query_block"))

    def run(cutoffs: DataFrame | None) -> DataFrame:
        resolve = cutoffs is not None
        asks = given.filter("asked")
        asks = asks.join(cutoffs, "row", "left") if resolve else asks.withColumn("cutoff", F.lit(None).cast("long"))
        asks = asks.select("row", "id", "vector", "asked", "cutoff", F.size("vector").alias("dim"),
                           all_of(row_blocks).alias("row_block"), block_of("row", query_blocks).alias("query_block"))
        return asks.unionByName(there).groupBy(*key).applyInArrow(lambda table: cell_entries(table, k, resolve), SENT)

    order = [F.col("score").desc(), F.col("vec_id"), F.col("row")]
    gathered = take_per_key(run(None), ["query"], order, k, "rank")
    cutoffs = gathered.filter(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("cutoff"))
    found = take_per_key(run(materialise(cutoffs, "cutoffs")), ["query"], order, k, "rank")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as q from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, cast(list_dot_product(cast(a.q as double[]), cast(b.q as double[])) as bigint) as score
  from v a, v b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
