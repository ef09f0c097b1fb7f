"""Whitening against numpy over all rows; odd rows, repeated rows, hot vectors, empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from ledgerloom.llm import whitening
from ledgerloom.llm.common import read

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                     T.StructField("x", T.StringType()), T.StructField("rows", T.StringType()), T.StructField("n", T.StringType())])


@pytest.fixture
def vectors_of(spark):
    return lambda rows: spark.createDataFrame([(i, v, "a", "b", None) for i, v in rows], ROWS)


def plain(rows, components=32, once=False):
    """(vec_id, component) -> (n, deviation, whitened, explained), vectors of one length, by Python integers and numpy."""
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    fit = [list(x) for x in sorted({tuple(x) for _, x in good})] if once else [x for _, x in good]
    n, sums = len(fit), [sum(column) for column in zip(*fit)]
    centre = lambda x: np.array([(n * a - s) / n for a, s in zip(x, sums)])
    covariance = sum(np.outer(centre(x), centre(x)) for x in fit) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in good:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for k in range(min(components, len(values))):
            out.setdefault((i, k + 1), []).append((n, deviation, centre(x) @ vectors[:, k] / math.sqrt(values[k]), values[k] / values.sum()))
    return out


def same(got, expected):
    found = {}
    for r in got:
        found.setdefault((r.vec_id, r.component), []).append(r)
    assert set(found) == set(expected)
    signs = {}
    for key, rows in expected.items():
        rows, mine = sorted(rows, key=lambda r: abs(r[2])), sorted(found[key], key=lambda r: abs(r.whitened))
        assert len(rows) == len(mine)
        for e, m in zip(rows, mine):
            assert (m.n, m.deviation) == e[:2]
            assert abs(m.explained - e[3]) <= 1e-9
            assert abs(abs(m.whitened) - abs(e[2])) <= 1e-7
            assert m.identity_error <= 1e-9
            if abs(e[2]) > 1e-3:
                signs.setdefault(key[1], set()).add(bool((m.whitened > 0) == (e[2] > 0)))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_equals_numpy(spark):
    rows = read(spark, "/root/testdata/sf0.001", "embeddings")
    given = [(r.vec_id, r.embedding) for r in rows.collect() if r.embedding]
    same(whitening.whiten(rows).collect(), plain(given))


def test_odd_rows_and_weights(vectors_of):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=5) * [1, 2, 3, 4, 5]).tolist()) for k in range(300)]
    rows += [(1, rows[0][1])] * 40 + [(None, rows[7][1]), (500, rows[0][1])]
    odd = [(900, None), (901, [0.1, None, 0.2, 0.3, 0.4]), (902, [math.nan] * 5), (903, [math.inf, 0.0, 0.0, 0.0, 0.0]), (904, []),
           (905, [1.0, 2.0]), (906, [1e300, 0.0, 0.0, 0.0, 0.0])]
    same(whitening.whiten(vectors_of(rows + odd)).collect(), plain(rows))
    same(whitening.whiten(vectors_of(rows + odd), weights="one").collect(), plain(rows, once=True))
    two = whitening.whiten(vectors_of(rows), components=2).collect()
    assert {r.component for r in two} == {1, 2} and len(two) == 2 * len(rows)


def test_one_vector_holds_most_rows(vectors_of):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=3).tolist() if k % 3 else [0.5, -0.25, 0.125]) for k in range(3000)]
    same(whitening.whiten(vectors_of(rows)).collect(), plain(rows))


def test_large_entries_stay_exact(vectors_of):
    rows = [(k, [1e12 + k * 1000.0, float(k % 7), float(k * k % 11)]) for k in range(50)]
    got = whitening.whiten(vectors_of(rows)).collect()
    expected = plain(rows)
    assert all((r.n, r.deviation) == expected[r.vec_id, r.component][0][:2] for r in got if r.deviation is not None)
    far = whitening.whiten(vectors_of([(k, [k * 1e13, 1.0 * (k % 2)]) for k in range(9)])).collect()
    assert far and all(r.deviation is None for r in far if r.vec_id in (0, 8))


def test_no_rows_without_a_spread(vectors_of):
    assert whitening.whiten(vectors_of([])).count() == 0
    assert whitening.whiten(vectors_of([(1, None)])).count() == 0
    assert whitening.whiten(vectors_of([(k, [1.0, 2.0]) for k in range(4)])).count() == 0
    lower = whitening.whiten(vectors_of([(k, [float(k), 2.0 * k, 7.0]) for k in range(4)])).collect()
    assert {r.component for r in lower} == {1} and lower[0].explained == pytest.approx(1)
