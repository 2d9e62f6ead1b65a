"""Whitening of embeddings, from exact cross-products that are counted bit by bit.

Each entry becomes an integer. Less the smallest one of its dimension it is not negative, and its bits make up the
dimension's *planes*: one bit a row, packed into words of 64 rows. The cross-product of two dimensions is the sum over
their planes of ``2**(p + q)`` times the bits set in both, so AND and a population count of whole words give it exactly.
Tasks add up such counts over blocks of rows; what reaches the driver is one integer for each pair of
dimensions, whatever the number of rows. There the products are centred as integers, and only
the covariance, correctly rounded, goes to the eigensolver.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import stored
from plumbline.llm.vectors import by_dims, coded

#: Rows whose planes are packed together.
BLOCK = 8192
_EXACT = pa.decimal128(38, 0)


class Space(NamedTuple):
    """What is known of the distinct vectors of one length: their number, and by dimension the least, the sum and the planes."""

    n: int
    low: np.ndarray
    total: list[int]
    planes: np.ndarray
    #: The largest distance of an entry from the mean, times n.
    reach: int


class Basis(NamedTuple):
    """Eigenvectors as columns, eigenvalues, and the shares of the trace."""

    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def _spaces(fit: DataFrame) -> dict[int, Space]:
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for batch in batches:
            for dims, _, matrix in by_dims(batch, 0, 1, BLOCK):
                if dims:
                    part = len(matrix), matrix.min(axis=0), matrix.max(axis=0), matrix.astype(object).sum(axis=0)
                    old = known.get(dims, part)
                    seen = old is not part
                    known[dims] = (
                        part[0] + (old[0] if seen else 0), np.minimum(part[1], old[1]), np.maximum(part[2], old[2]),
                        part[3] + (old[3] if seen else 0),
                    )
        for dims, (n, low, high, total) in known.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(dims, dims, np.int32)), pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n)),
                    pa.array(low), pa.array(high), pa.array([Decimal(v) for v in total], _EXACT),
                ],
                names=["dims", "axis", "n", "low", "high", "total"],
            )

    parts = fit.mapInArrow(ranges, "dims int, axis int, n bigint, low bigint, high bigint, total decimal(38,0)")
    sums = parts.groupBy("dims", "axis").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"))
    found: dict[int, list] = {}
    for row in sums.orderBy("dims", "axis").collect():
        found.setdefault(row.dims, []).append(row)
    return {
        dims: Space(
            rows[0].n, np.array([r.low for r in rows], np.int64), [int(r.total) for r in rows],
            np.array([(r.high - r.low).bit_length() for r in rows]),
            max(max(rows[0].n * r.high - int(r.total), int(r.total) - rows[0].n * r.low) for r in rows),
        )
        for dims, rows in found.items()
    }


def plane_products(matrix: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Cross-products of the columns of ``matrix``, which are not negative and have so many bits; the upper triangle."""
    rows, dims = matrix.shape
    ends = np.cumsum(planes)
    words = np.zeros((ends[-1], -(-rows // 64) * 8), np.uint8)
    for axis in range(dims):
        bits = (matrix[:, axis] >> np.arange(planes[axis])[:, None]) & 1
        packed = np.packbits(bits.astype(np.uint8), axis=1)
        words[ends[axis] - planes[axis] : ends[axis], : packed.shape[1]] = packed
    words = words.view(np.uint64)
    wide = 2 * int(planes.max()) + rows.bit_length() >= 63
    weights = np.array([1 << p for k in planes.tolist() for p in range(k)], object if wide else np.int64)
    products = np.zeros((dims, dims), object)
    for axis in np.flatnonzero(planes):
        first = ends[axis] - planes[axis]
        both = np.bitwise_count(words[first : ends[axis], None] & words[None, first:]).sum(axis=2, dtype=np.int64)
        summed = weights[first : ends[axis]] @ (both.astype(object) if wide else both) * weights[first:]
        upto = np.concatenate([[0], np.cumsum(summed)])
        products[axis, axis:] = upto[ends[axis:] - first] - upto[ends[axis:] - planes[axis:] - first]
    return products


def _scatter(fit: DataFrame, spaces: dict[int, Space]) -> dict[int, np.ndarray]:
    """Exact sums of ``(x - low) (y - low)`` over the distinct vectors, by length."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {dims: np.zeros((dims, dims), object) for dims in spaces}
        for batch in batches:
            for dims, _, matrix in by_dims(batch, 0, 1, BLOCK):
                if dims and spaces[dims].planes.any():
                    sums[dims] += plane_products(matrix - spaces[dims].low, spaces[dims].planes)
        for dims, of in sums.items():
            x, y = np.triu_indices(dims)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(x), dims, np.int32)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)),
                    pa.array([Decimal(int(v)) for v in of[x, y]], _EXACT),
                ],
                names=["dims", "x", "y", "product"],
            )

    parts = fit.mapInArrow(products, "dims int, x int, y int, product decimal(38,0)")
    found = {dims: np.zeros((dims, dims), object) for dims in spaces}
    for row in parts.groupBy("dims", "x", "y").agg(F.sum("product").alias("product")).collect():
        found[row.dims][row.x, row.y] = found[row.dims][row.y, row.x] = int(row["product"])
    return found


def _basis(space: Space, products: np.ndarray, components: int) -> Basis:
    shifted = np.array([t - space.n * int(low) for t, low in zip(space.total, space.low)], object)
    centred = space.n * products - np.outer(shifted, shifted)
    covariance = np.array([[float(Fraction(v, space.n**2)) for v in row] for row in centred.tolist()])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    positive = values > len(covariance) * np.finfo(float).eps * max(values.max(initial=0), 0)
    values, vectors = values[positive], vectors[:, positive]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1, 1)
    trace = Fraction(sum(centred.diagonal().tolist()), space.n**2)
    return Basis(vectors, values, values / float(trace) if len(values) else values)


def _projected(matrix: np.ndarray, space: Space, basis: Basis) -> tuple[np.ndarray, np.ndarray]:
    """``n * x - S`` exactly, and the whitened components."""
    safe = space.reach < 2**62
    centred = matrix * space.n - np.array(space.total) if safe else matrix.astype(object) * space.n - np.array(space.total, object)
    return centred, (centred / space.n).astype(np.float64) @ (basis.vectors / np.sqrt(basis.values))


def _identity_errors(fit: DataFrame, spaces: dict[int, Space], bases: dict[int, Basis]) -> dict[int, float]:
    """How far the covariance of the whitened distinct vectors is from the identity, by length."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, _, matrix in by_dims(batch, 0, 1, BLOCK):
                if dims:
                    white = _projected(matrix, spaces[dims], bases[dims])[1]
                    k = white.shape[1]
                    padded = np.hstack([white, np.ones((len(white), 1))])
                    sums = (padded.T @ padded)[: k + 1, :k].ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(sums), dims, np.int32)), pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)],
                        names=["dims", "place", "total"],
                    )

    parts = fit.mapInArrow(products, "dims int, place int, total double")
    sums = {(r.dims, r.place): r.total for r in parts.groupBy("dims", "place").agg(F.sum("total").alias("total")).collect()}
    errors = {}
    for dims, space in spaces.items():
        k = len(bases[dims].values)
        table = np.array([sums.get((dims, i), 0.0) for i in range(k * (k + 1))]).reshape(k + 1, k) / space.n
        errors[dims] = float(np.abs(table[:k] - np.outer(table[k], table[k]) - np.eye(k)).max(initial=0))
    return errors


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256
) -> DataFrame:
    """``(vec_id, dims, component, n, deviation, whitened, explained, identity_error)`` for every row and component.

    An entry ``c`` counts as ``floor(scale * c)``. The covariance is that of the distinct vectors, each once, with their number ``n`` as divisor;
    components are its unit eigenvectors, numbered from 1 by falling eigenvalue, and the entry
    of largest size in each is positive. ``deviation`` is the sum over dimensions of ``(n * x - S) ** 2``, ``S`` being
    the dimension's sum over the distinct vectors, as a decimal; ``whitened`` is the projection of ``x - S / n`` over the
    root of the eigenvalue. ``identity_error`` is measured on the distinct vectors: the largest entry by which the
    covariance of ``whitened`` differs from the identity.

    Rows whose vector is NULL or holds a NULL, NaN or infinite entry are left out. Vectors of different length are
    spaces apart, each with its own ``n`` and components; empty vectors have none. Components without variance are left out, so a space of one
    distinct vector has no rows. Every row of a repeated vector or id gets its rows, as does a NULL id. No rows: no
    rows. Entries of ``2**61 / scale`` or more are an error. Other columns are not looked at.
    """
    rows = coded(vectors, id_col, vector_col, scale)
    fit = stored(rows.select("dims", "code").distinct(), "vectors")
    spaces = _spaces(fit)
    bases = {dims: _basis(spaces[dims], products, components) for dims, products in _scatter(fit, spaces).items()}
    errors = _identity_errors(fit, spaces, bases)
    names = ["vec_id", "dims", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, places, matrix in by_dims(batch, 1, 2, BLOCK):
                if not dims or not len(bases[dims].values):
                    continue
                space, basis = spaces[dims], bases[dims]
                centred, white = _projected(matrix, space, basis)
                if space.reach**2 * dims < 2**63:
                    deviation = pa.array((centred**2).sum(axis=1)).cast(_EXACT)
                else:
                    deviation = pa.array([Decimal(v) for v in (centred.astype(object) ** 2).sum(axis=1)], _EXACT)
                k, size = white.shape[1], white.size
                each = pa.array(np.repeat(np.arange(len(white)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(places)).take(each), pa.array(np.full(size, dims, np.int32)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(white))), pa.array(np.full(size, space.n)),
                        deviation.take(each), pa.array(white.ravel()), pa.array(np.tile(basis.explained, len(white))),
                        pa.array(np.full(size, errors[dims])),
                    ],
                    names=names,
                )

    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, dims int, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return rows.mapInArrow(project, schema)
