"""Whitening of embeddings by a weighted covariance of distinct vectors.

Entries are put on a lattice of integers, ``floor(64 * c) + 1000000``. Rows with identical lattice vectors are one row
of a table with their number, which weighs it (``weights="counts"``; with ``"one"`` every distinct vector weighs one).
The table is read three times, each time as blocks of numpy rows: for the sums per dimension, for the covariance as a
product of matrices of centred rows, and for the whitening of each distinct vector, which is then joined back to all
rows. Tasks hold one Arrow batch and one square matrix; the driver holds a square matrix of the vectors' width.

Sums are exact: tasks add the halves of the integers apart, the driver puts them together as Python integers. Rows are
centred before they are multiplied, by the integer next to the mean and then by the small rest. A deviation is computed
modulo 2**64, which is exact where the true value is below 2**63.

Defined cases: a vector that is null, empty, holds a null or a non-finite entry, or one whose lattice value a long does
not hold, takes no part; nor does one of another length than most vectors have (of equally frequent lengths the longest
counts). A null id and repeated rows stay rows of their own. Components whose eigenvalue is not above ``LEAST`` of the
largest are rounding and are left out, so a table of equal vectors, like an empty one, gives no rows. A deviation beyond
a long is null. Each component's largest coefficient is positive. Extra columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import counted_join, materialise, ship_package
from ledgerloom.llm.vectors import matrix, usable

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LEAST = 1e-11
LIMIT = 2.0 ** 56
HALF = 1 << 32
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def lattice(vector: Column) -> Column:
    """Integers of a vector's entries; null for an entry beyond ``LIMIT``, so that no order of evaluation overflows."""
    whole = lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long")
    return F.transform(vector, lambda c: F.when(F.abs(c.cast("double")) < LIMIT, whole(c)))


def lattice_rows(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, x`` of every vector that takes part, but for its length."""
    fits = F.forall(vector, lambda c: F.abs(c.cast("double")) < LIMIT)
    good = rows.filter(usable(F.col(vector))).filter((F.size(vector) > 0) & fits)
    return good.select(F.col(vec_id).cast("long").alias("vec_id"), lattice(F.col(vector)).alias("x"))


def integers(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(rows, -1)


def exact_sums(distinct: DataFrame, width: int) -> tuple[int, list[int]]:
    """Weight of all rows and, per dimension, the weighted sum, as Python integers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, total = np.zeros(width, np.int64), np.zeros(width, np.int64), 0
        for batch in batches:
            x, w = integers(batch.column(0), batch.num_rows), batch.column(1).to_numpy()
            high += w @ (x >> 32)
            low += w @ (x & (HALF - 1))
            total += int(w.sum())
        yield pa.record_batch([pa.array(np.arange(width)), pa.array(high), pa.array(low), pa.array(np.full(width, total))],
                              ["at", "high", "low", "n"])

    parts = distinct.select("x", "weight").mapInArrow(add, "at long, high long, low long, n long")
    sums = parts.groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).orderBy("at").collect()
    return (sums[0].n if sums else 0), [s.high * HALF + s.low for s in sums]


def product(rows: DataFrame, width: int, block) -> np.ndarray:
    """Sum over all rows of weight times the outer product of ``(1, block(column))`` with itself."""
    size = width + 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            y = np.ones((batch.num_rows, size))
            y[:, 1:] = block(batch.column(0), batch.num_rows)
            total += (y * batch.column(1).to_numpy()[:, None]).T @ y
        yield pa.record_batch([pa.array(np.arange(size)), pa.array(list(total), pa.list_(pa.float64()))], ["at", "part"])

    def add(table: pa.Table) -> pa.Table:
        parts = matrix(table.column("part"), table.num_rows)
        return pa.table({"at": table.column("at")[:1], "part": pa.array([parts.sum(axis=0)], pa.list_(pa.float64()))})

    schema = "at long, part array<double>"
    parts = rows.mapInArrow(multiply, schema).groupBy("at").applyInArrow(add, schema).collect()
    out = np.zeros((size, size))
    for row in parts:
        out[row.at] = row.part
    return out


class Basis:
    """Where the mean lies, and the map from centred rows to whitened ones."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.near = np.array([round(s / n) if abs(s) < 2**52 else (2 * s + n) // (2 * n) for s in sums], np.int64)
        rest = [s - n * int(b) for s, b in zip(sums, self.near)]
        self.rest = np.array(rest, np.int64)
        self.mean = np.array([r / n for r in rest])
        self.map = self.explained = None

    def centred(self, column: pa.Array, rows: int) -> np.ndarray:
        return (integers(column, rows) - self.near).astype(np.float64) - self.mean

    def fit(self, covariance: np.ndarray, components: int) -> None:
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        order = np.argsort(-values, kind="stable")[:components]
        order = order[values[order] > LEAST * max(values.max(), 0)]
        values, vectors = values[order], vectors[:, order]
        signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))]) if len(order) else np.ones(0)
        self.map = vectors * signs / np.sqrt(values)
        self.explained = (values / np.trace(covariance)).tolist() if len(order) else []

    def deviation(self, column: pa.Array, rows: int) -> pa.Array:
        """Sum over dimensions of ``(n * x - S)**2``; null where a long does not hold it."""
        apart = integers(column, rows) - self.near
        rough = ((apart * float(self.n) - self.rest) ** 2).sum(axis=1)
        whole = apart.view(np.uint64) * np.uint64(self.n) - self.rest.view(np.uint64)
        exact = (whole * whole).sum(axis=1).view(np.int64)
        return pa.array(exact, mask=rough >= 2.0 ** 63 * (1 - 1e-9))


def whiten(rows: DataFrame, components: int = COMPONENTS, weights: str = "counts", vec_id: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row per vector and component."""
    if weights not in ("counts", "one"):
        raise ValueError(f"weights must be 'counts' or 'one', not {weights!r}")
    spark = rows.sparkSession
    ship_package(spark)
    given = lattice_rows(rows, vec_id, vector)
    table = materialise(given.groupBy("x").agg(F.count(F.lit(1)).alias("rows")), "whiten-distinct")
    sizes = table.groupBy(F.size("x").alias("width")).agg(F.sum("rows").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if sizes is None:
        return spark.createDataFrame([], SCHEMA)
    width = sizes.width
    distinct = table.filter(F.size("x") == width).withColumn("weight", F.col("rows") if weights == "counts" else F.lit(1).cast("long"))
    n, sums = exact_sums(distinct, width)
    basis = Basis(n, sums)
    seconds = product(distinct.select("x", "weight"), width, basis.centred)
    shift = seconds[0, 1:] / n  # what rounding has left of the mean of the centred rows
    basis.fit(seconds[1:, 1:] / n - np.outer(shift, shift), components)
    found = len(basis.explained)
    if not found:
        return spark.createDataFrame([], SCHEMA)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, many = batch.column(0), batch.num_rows
            out = basis.centred(x, many) @ basis.map
            yield pa.record_batch([x, batch.column(1), batch.column(2), basis.deviation(x, many),
                                   pa.array(list(out), pa.list_(pa.float64()))], ["x", "rows", "weight", "deviation", "whitened"])

    white = materialise(distinct.select("x", "rows", "weight").mapInArrow(
        whitened, "x array<long>, rows long, weight long, deviation long, whitened array<double>"), "whiten-whitened")
    unit = product(white.select("whitened", "weight"), found, matrix)
    mean = unit[0, 1:] / n
    error = float(np.abs(unit[1:, 1:] / n - np.outer(mean, mean) - np.eye(found)).max())
    back = counted_join(given.filter(F.size("x") == width), white.select("x", "rows", "deviation", "whitened"), ["x"], "rows")
    explained = F.array(*[F.lit(e) for e in basis.explained])
    long = back.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
