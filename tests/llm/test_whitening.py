"""Whitening against exact fractions and numpy."""

from __future__ import annotations

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabmeld.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string"


def fitted(vectors):
    """(n, sums, covariance) of the distinct integer vectors, by the plain formula in fractions."""
    fit = sorted({tuple(math.floor(64 * c) + 1000000 for c in v) for v in vectors})
    n, size = len(fit), len(fit[0])
    sums = [sum(column) for column in zip(*fit, strict=True)]
    centred = [[n * x - s for x, s in zip(row, sums, strict=True)] for row in fit]
    cov = [
        [float(Fraction(sum(row[i] * row[j] for row in centred), n**3)) for j in range(size)] for i in range(size)
    ]
    return n, sums, np.array(cov)


def check(rows, vectors, components=16):
    """``vectors`` by id, valid ones only."""
    n, sums, cov = fitted(vectors.values())
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    wide = max(r.component for r in rows)
    assert wide <= components and all(v <= 1e-9 * values[0] for v in values[wide:components])
    assert Counter((r.vec_id, r.component) for r in rows) == Counter((i, c + 1) for i in vectors for c in range(wide))
    made = {}
    for row in rows:
        y = [n * (math.floor(64 * c) + 1000000) - s for c, s in zip(vectors[row.vec_id], sums, strict=True)]
        assert row.n == n and row.deviation == sum(v * v for v in y)
        at = row.component - 1
        assert row.explained == pytest.approx(values[at] / cov.trace(), rel=1e-9) and row.identity_error <= 1e-4
        made[row.vec_id, at] = (row.whitened, float(np.array(y) / n @ axes[:, at]) / math.sqrt(values[at]))
    for at in range(wide):
        pairs = np.array([pair for (_, c), pair in made.items() if c == at])
        sign = np.sign((pairs[:, 0] * pairs[:, 1]).sum())
        assert np.abs(pairs[:, 0] - sign * pairs[:, 1]).max() < 1e-6


def test_op13_whole_result(run, ready):
    rows = run("op13_embedding_whitening")
    given = ready.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    check(rows, {r.vec_id: r.embedding for r in given if r.embedding is not None})


def test_awkward_rows(ready):
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=5).astype(np.float32).tolist() for i in range(40)}
    vectors |= {i: [0.5, -1.25, 3.0, 1e5, -0.001] for i in range(40, 70)}  # copies
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [math.nan] * 5), (104, [math.inf, 0.0, 0.0, 0.0, 0.0]),
           (105, [1.0, 2.0]), (106, [3e38, 0.0, 0.0, 0.0, 0.0])]
    rows = [(i, v, 7, "x") for i, v in [*vectors.items(), *bad]] + [(0, vectors[0], 7, "x")]
    table = ready.createDataFrame(rows, SCHEMA)
    found = whitening.whiten(table, F.col("vec_id"), F.col("embedding")).collect()
    again = Counter(r.vec_id for r in found)
    assert again[0] == 10 and again[1] == 5 and not any(i >= 100 for i in again)
    seen, once = set(), []
    for r in found:
        if (r.vec_id, r.component) not in seen:
            seen.add((r.vec_id, r.component))
            once.append(r)
    check(once, vectors)
    with_null = ready.createDataFrame([(None, v, 1, "x") for v in vectors.values()], SCHEMA)
    assert whitening.whiten(with_null, F.col("vec_id"), F.col("embedding")).count() == 5 * len(vectors)


def test_degenerate_tables(ready):
    table = ready.createDataFrame([(i, [1.0, 2.0, 3.0], 1, "x") for i in range(9)], SCHEMA)
    run = lambda t: whitening.whiten(t, F.col("vec_id"), F.col("embedding"))
    assert run(table).count() == 0 and run(table.limit(0)).count() == 0
    flat = ready.createDataFrame([(i, [float(i), 2.0 * i, 5.0], 1, "x") for i in range(9)], SCHEMA)
    rows = run(flat).collect()
    assert {r.component for r in rows} == {1} and rows[0].explained == pytest.approx(1.0)


def test_squares_beyond_64_bits():
    rng = np.random.default_rng(1)
    for spread in (1 << 10, 1 << 23, 1 << 40, 1 << 52):
        z = rng.integers(-spread, spread, (300, 4))
        wide = [[int(v) for v in row] for row in z]
        want = [sum((r[i] if i == j else r[i] + r[j]) ** 2 for r in wide) for i in range(4) for j in range(i, 4)]
        assert whitening.squared_sums(z).tolist() == want


def test_covariances_from_variances():
    rng = np.random.default_rng(2)
    x = rng.integers(999_000, 1_001_000, (57, 6))
    sums, n = x.sum(axis=0), len(x)
    whole, rest = sums // n, (sums % n).tolist()
    got = whitening.covariances(whitening.squared_sums(x - whole).tolist(), rest, n)
    assert np.allclose(got, np.cov(x.T, bias=True), rtol=1e-12, atol=1e-9)
