"""Near-duplicate embeddings by collision-counting projections.

Unit vectors are projected on ``PROJECTIONS`` seeded Gaussian directions. Along one direction two vectors at distance
``d`` differ by a normal variable of deviation ``d``, so a pair at the threshold falls into a window of ``WIDTH`` either
way with a known probability, independently for each direction; the count that such a pair reaches with probability
``RECALL`` is the calibrated count, and nearer pairs reach it more often. Pairs that pass are verified by their cosine
in double precision, so no pair below the threshold is linked.

Each block of vectors is sorted along every direction. Sets of the first 64, 128, ... of a sorted list are kept as bits,
so the window around a query is the difference of two such sets, 64 vectors a word; the windows of all directions are
added up in carry-save bit counters that start where the calibrated count overflows them. Windows are rounded
outward to whole steps of a list. Cells of two blocks are independent, and a cell sends, for each vector, how many
it links with and one link to its local group, never its pairs.

The cost grows with the square of the distinct vectors, as window counting does at these distances: a window that
keeps a near pair also keeps a third of all others. The constant is a few word operations for 64 pairs.

Defined cases: equal vectors are one class that is compared once; vectors that are null, zero, or hold null or
non-finite components, and rows without an id, link with nothing and are their own component (null for a null id);
vectors of different lengths don't link; repeated rows are vectors of their own; an empty table gives an empty
result. Extra columns are never looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, ship_package
from ledgerloom.llm.graph import components
from ledgerloom.llm.simhash import joined_labels
from ledgerloom.llm.vectors import block_of, blocks_for, each_pair_once, matrix, usable

THRESHOLD, RECALL = 0.9, 0.9999
PROJECTIONS, WIDTH, SEED = 40, 0.6, 20
BLOCK, STEP, QUERIES, PAIRS = 8192, 64, 256, 1 << 16
COUNTER_BITS = 6
SENT = "node long, links long, root long"


def calibrated_count(threshold: float, recall: float = RECALL) -> int:
    """Largest count that a pair at the threshold reaches with probability ``recall``."""
    near = math.erf(WIDTH / math.sqrt(2 - 2 * threshold) / math.sqrt(2)) if threshold < 1 else 1.0
    reached, count = 1.0, 0
    while count < PROJECTIONS:
        reached -= math.comb(PROJECTIONS, count) * near**count * (1 - near) ** (PROJECTIONS - count)
        if reached < recall:
            return count
        count += 1
    return count


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, PROJECTIONS))


class SortedLists:
    """A block's sorted lists with the bit sets of their beginnings."""

    def __init__(self, projected: np.ndarray):
        n = len(projected)
        self.order = np.argsort(projected, axis=0, kind="stable")
        self.values = np.take_along_axis(projected, self.order, axis=0)
        steps = -(-n // STEP)
        self.heads = []
        for j in range(projected.shape[1]):
            sets = np.zeros((steps + 1, -(-n // 64)), np.uint64)
            member = self.order[:, j]
            np.bitwise_or.at(sets, (np.arange(n) // STEP + 1, member >> 6), np.uint64(1) << (member & 63).astype(np.uint64))
            self.heads.append(np.bitwise_or.accumulate(sets, axis=0))

    def window(self, j: int, centres: np.ndarray) -> np.ndarray:
        """Bit sets of the vectors within ``WIDTH`` of each centre along direction ``j``."""
        low = np.searchsorted(self.values[:, j], centres - WIDTH, "left") // STEP
        high = -(-np.searchsorted(self.values[:, j], centres + WIDTH, "right") // STEP)
        return self.heads[j][np.maximum(high, low)] ^ self.heads[j][low]


def passing(lists: SortedLists, projected: np.ndarray, count: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, vector) of all pairs with at least ``count`` collisions."""
    words = lists.heads[0].shape[1]
    begin = 2**COUNTER_BITS - count
    full = np.uint64(2**64 - 1)
    counter = [np.full((len(projected), words), full if begin >> b & 1 else np.uint64(0)) for b in range(COUNTER_BITS)]
    over = np.zeros((len(projected), words), np.uint64)
    for j in range(projected.shape[1]):
        carry = lists.window(j, projected[:, j])
        for b in range(COUNTER_BITS):
            counter[b], carry = counter[b] ^ carry, counter[b] & carry
        over |= carry
    if count <= 0:
        over[:] = full
    query, word = np.nonzero(over)
    found, bit = np.nonzero(np.unpackbits(over[query, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    lane = word[found] * 64 + bit
    return query[found][lane < n], lane[lane < n]


def cell_links(table: pa.Table, threshold: float) -> pa.Table:
    """Links of one cell: per linked vector the number of vectors it links with, and a vector of its group."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    block, node, weight = (np.asarray(table[c]) for c in ("block", "node", "n"))
    vectors = matrix(table["vector"], table.num_rows)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # keeps squares of huge and tiny numbers finite
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    links = np.zeros(len(node), np.int64)
    count = calibrated_count(threshold)

    def pairs():
        if not len(left) or not len(right):
            return
        axes = directions(vectors.shape[1])
        lists = SortedLists(vectors[right] @ axes)
        for start in range(0, len(left), QUERIES):
            asked = left[start:start + QUERIES]
            a, b = passing(lists, vectors[asked] @ axes, count, len(right))
            a, b = asked[a], right[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            for at in range(0, len(a), PAIRS):
                p, q = a[at:at + PAIRS], b[at:at + PAIRS]
                keep = np.einsum("ij,ij->i", vectors[p], vectors[q]) >= threshold
                p, q = p[keep], q[keep]
                np.add.at(links, p, weight[q])
                np.add.at(links, q, weight[p])
                yield p, q

    label = joined_labels(len(node), pairs())
    linked = np.flatnonzero(links)
    return pa.table([pa.array(node[linked]), pa.array(links[linked]), pa.array(node[label[linked]])], ["node", "links", "root"])


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", vector: str = "embedding",
                 block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    ship_package(rows.sparkSession)
    given = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    some = F.exists("vector", lambda x: x != 0)
    fit = F.col("vec_id").isNotNull() & usable(F.col("vector")) & F.coalesce(some, F.lit(False))
    marks = [F.when(fit, F.xxhash64("vector")).alias("c1"), F.when(fit, F.xxhash64("vector", F.lit("salt"))).alias("c2")]
    marked = given.select("vec_id", "vector", *marks)
    classes = (marked.filter("c1 is not null").groupBy("c1", "c2")
               .agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.min("vector").alias("vector")))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    blocks = blocks_for(classes.count(), block)
    cells = each_pair_once(classes.select("node", "n", "vector", F.size("vector").alias("dim"), block_of("node", blocks).alias("block")), blocks)
    found = cells.groupBy("dim", "i", "j").applyInArrow(lambda table: cell_links(table, threshold), SENT)
    found = materialise(found, "links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = (classes.select("c1", "c2", "n", "least", "node").join(linked, "node", "left").join(roots, "node", "left")
             .select("c1", "c2", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                     F.coalesce("root", "node").alias("root")))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").select("c1", "c2", "n_links", "component_id")
    return marked.drop("vector").join(named, ["c1", "c2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))


ORACLE = """
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
    and len([x for x in embedding if x <> 0]) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
          where list_cosine_similarity(a.e, b.e) >= 0.9),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from reach group by a)
select e.vec_id, (select count(*) from links l where l.a = e.vec_id) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join c on e.vec_id = c.vec_id
"""
