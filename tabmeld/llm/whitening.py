"""Embedding whitening from covariances by polarisation.

Entries become integers, and all sums are exact. For every dimension and for the sum of every
pair of dimensions, tasks add up squared centred values; with Q the resulting sums of squares,

    cov(i, j) = (Q(i + j) - Q(i) - Q(j)) / (2 n),

so no product of two dimensions is ever summed. Means are fractions S / n: tasks centre by their
whole part m = S div n, which leaves small integers z, and the rest r = S - n m is put in on the
driver, where sum((n x - S)^2) = n (n sum(z^2) - r^2) for integers of any length. The matrix, of a
size that only the number of dimensions decides, goes to eigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmeld.session import materialize

STEPS = 64
SHIFT = 1_000_000
COMPONENTS = 16
# Entries whose multiple of 1 / STEPS is beyond this have no exact place among doubles.
FURTHEST = 2.0**53
# Rows whose squares are added at once, and the centred size up to which 64 bits hold their sum.
_ROWS = 1 << 12
_SAFE = 1 << 24
_LONG = (1 << 63) - 1


def _parsed(size: int | None):
    """Valid vectors of a batch as rows of integers; only those of ``size`` entries, if given."""

    def parse(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        cells = batch.column("vector")
        lengths = pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False)
        entries = pc.list_flatten(cells).cast(pa.float64())
        bad = ~np.isfinite(entries.fill_null(np.nan).to_numpy(zero_copy_only=False))
        values = np.floor(STEPS * np.where(bad, 0.0, entries.fill_null(0.0).to_numpy(zero_copy_only=False)))
        bad |= np.abs(values) > FURTHEST
        ends = np.cumsum(lengths)
        wrong = np.concatenate(([0], np.cumsum(bad)))
        good = (lengths > 0) & (wrong[ends] == wrong[ends - lengths])
        if size is not None:
            good &= lengths == size
        rows = np.flatnonzero(good)
        whole = np.where(bad, 0, values).astype(np.int64) + SHIFT
        if size is None:
            return rows, [whole[ends[row] - lengths[row] : ends[row]] for row in rows]
        places = (ends[rows] - size)[:, None] + np.arange(size)
        return rows, whole[places] if len(rows) else np.empty((0, size), np.int64)

    return parse


def _size_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, int] = {}
    parse = _parsed(None)
    for batch in batches:
        for vector in parse(batch)[1]:
            counts[len(vector)] = counts.get(len(vector), 0) + 1
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["size", "n"]
    )


def _vector_rows(size: int):
    parse = _parsed(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = parse(batch)
            # Four bytes an entry where they hold it, else eight: the length tells which.
            narrow = (np.abs(x) < 1 << 31).all(axis=1)
            cells = [row.astype("<i4" if short else "<i8").tobytes() for row, short in zip(x, narrow, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary())], names=["x"])

    return run


def _matrix(cells: pa.Array, size: int) -> np.ndarray:
    out = np.empty((len(cells), size), np.int64)
    for at, cell in enumerate(cells.to_pylist()):
        out[at] = np.frombuffer(cell, "<i4" if len(cell) == 4 * size else "<i8")
    return out


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for low in range(0, batch.num_rows, _ROWS):
            yield _matrix(batch.column("x").slice(low, _ROWS), size)


def _exact_rows(totals: np.ndarray) -> pa.RecordBatch:
    values = [Decimal(int(v)) for v in totals]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(values)), pa.int64()), pa.array(values, pa.decimal128(38, 0))], names=["place", "total"]
    )


_EXACT = "place long, total decimal(38,0)"


def _sum_rows(size: int):
    """Sums of every dimension, then the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(size + 1, object)
        for x in _blocks(batches, size):
            high = x >> 20  # apart from the low bits, so that no sum of a block leaves 64 bits
            totals[:size] += high.sum(axis=0).astype(object) * (1 << 20) + (x - (high << 20)).sum(axis=0).astype(object)
            totals[size] += len(x)
        yield _exact_rows(totals)

    return run


def squared_sums(z: np.ndarray) -> np.ndarray:
    """Exact sums of squares of every dimension i and of every sum of dimensions i < j, in that order by i."""
    size = z.shape[1]
    if len(z) and np.abs(z).max() >= _SAFE:
        z = z.astype(object)
    parts = []
    for i in range(size):
        sums = z[:, i:].copy()
        sums[:, 1:] += z[:, i : i + 1]
        parts.append((sums * sums).sum(axis=0) if z.dtype == object else np.einsum("ij,ij->j", sums, sums))
    return np.concatenate(parts).astype(object)


def _square_rows(whole_means: list[int]):
    size = len(whole_means)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means = np.array(whole_means, np.int64)
        totals = np.zeros(size * (size + 1) // 2, object)
        for x in _blocks(batches, size):
            totals += squared_sums(x - means)
        yield _exact_rows(totals)

    return run


def _totals(rows: DataFrame, n: int) -> list[int]:
    """One exact number per place; the number of places depends on the number of dimensions alone."""
    out = [0] * n
    for row in rows.groupBy("place").agg(F.sum("total").alias("total")).collect():
        out[row.place] = int(row.total)
    return out


def covariances(squares: list[int], rest: list[int], n: int) -> np.ndarray:
    """The covariance matrix from sums of squares of whole-centred values and the means' rests over n."""
    size = len(rest)
    exact: dict[tuple[int, int], int] = {}
    at = 0
    for i in range(size):
        for j in range(i, size):
            shift = rest[i] + (rest[j] if j > i else 0)
            exact[i, j] = n * squares[at] - shift * shift  # n times the sum of squared centred values
            at += 1
    out = np.empty((size, size))
    for (i, j), value in exact.items():
        # Polarisation; Python divides integers of any length with one rounding.
        out[i, j] = out[j, i] = value / (n * n) if i == j else (value - exact[i, i] - exact[j, j]) / (2 * n * n)
    return out


def _project(z: np.ndarray, rest_means: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return (z.astype(np.float64) - rest_means) @ axes


def _moment_rows(model):
    """Sums and products of whitened components over the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, rest_means, axes = model.value[:3]
        wide = axes.shape[1]
        sums, products = np.zeros(wide), np.zeros((wide, wide))
        for x in _blocks(batches, len(whole)):
            made = _project(x - whole, rest_means, axes)
            sums += made.sum(axis=0)
            products += made.T @ made
        values = np.concatenate((sums, products.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["place", "value"])

    return run


def _whitened_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, rest_means, axes, rest, n, explained, error = model.value
        parse, wide = _parsed(len(whole)), axes.shape[1]
        for batch in batches:
            for low in range(0, batch.num_rows, _ROWS):
                part = batch.slice(low, _ROWS)
                rows, x = parse(part)
                z = x - whole
                made = _project(z, rest_means, axes)
                furthest = int(np.abs(z).max()) if z.size else 0
                if len(whole) * (n * (furthest + 1)) ** 2 <= _LONG:
                    deviations = ((n * z - rest) ** 2).sum(axis=1).tolist()
                else:
                    exact = ((n * z.astype(object) - rest.astype(object)) ** 2).sum(axis=1)
                    deviations = [value if value <= _LONG else None for value in exact]
                columns = {
                    "vec_id": part.column("vec_id").take(pa.array(np.repeat(rows, wide))),
                    "component": pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), len(rows))),
                    "n": pa.array(np.full(len(rows) * wide, n, np.int64)),
                    "deviation": pa.array(deviations, pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), wide))),
                    "whitened": pa.array(made.ravel()),
                    "explained": pa.array(np.tile(explained, len(rows))),
                    "identity_error": pa.array(np.full(len(rows) * wide, error)),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def whiten(vectors: DataFrame, vec_id: Column, vector: Column, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, one row per vector and component.

    Vectors that are null or empty, or hold a null or non-finite entry, are dropped, as are those
    with an entry beyond 2^53 / 64, which has no exact integer. All others must have one length; of
    several lengths the most frequent (of these the longest) counts and the rest is dropped. The fit
    list is each distinct integer vector once, so repeated rows weigh nothing and get equal rows.
    Components whose eigenvalue is no more than rounding (constant or dependent dimensions, fewer
    vectors than dimensions) are left out; a single distinct vector, like an empty table, gives an
    empty table. Eigenvectors have their largest entry positive. ``deviation`` is null where a long
    can't hold it. ``identity_error`` is measured over the fit list. Other columns are ignored.
    """
    spark = vectors.sparkSession
    chosen = vectors.select(vec_id.alias("vec_id"), vector.cast("array<double>").alias("vector"))
    kind = chosen.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    only = chosen.select("vector")
    sizes = only.mapInArrow(_size_rows, "size int, n long").groupBy("size").agg(F.sum("n").alias("n"))
    top = sizes.agg(F.max(F.struct("n", "size")).alias("top")).first().top
    if top is None:
        return spark.createDataFrame([], schema)
    size = top["size"]
    # Copies meet inside the tasks first, so a vector with many rows is one row of each task.
    fit = materialize(only.mapInArrow(_vector_rows(size), "x binary").distinct(), "fit")
    *sums, n = _totals(fit.mapInArrow(_sum_rows(size), _EXACT), size + 1)
    whole, rest = [s // n for s in sums], [s % n for s in sums]
    squares = _totals(fit.mapInArrow(_square_rows(whole), _EXACT), size * (size + 1) // 2)
    matrix = covariances(squares, rest, n)
    trace = float(np.trace(matrix))
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1], axes[:, ::-1]
    kept = np.flatnonzero(values > size * np.finfo(float).eps * max(float(values[0]), 0.0))[:components]
    if not len(kept):
        return spark.createDataFrame([], schema)
    values, axes = values[kept], axes[:, kept]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(kept))])
    centre = (np.array(whole, np.int64), np.array(rest) / n, axes / np.sqrt(values))
    shared = spark.sparkContext.broadcast(centre)
    moments = fit.mapInArrow(_moment_rows(shared), "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    found = np.zeros(len(kept) * (len(kept) + 1))
    for row in moments.collect():
        found[row.place] = row.value
    means = found[: len(kept)] / n
    measured = found[len(kept) :].reshape(len(kept), -1) / n - np.outer(means, means)
    error = float(np.abs(measured - np.eye(len(kept))).max())
    model = spark.sparkContext.broadcast((*centre, np.array(rest, np.int64), n, values / trace, error))
    return chosen.mapInArrow(_whitened_rows(model), schema)
