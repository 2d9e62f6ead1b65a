"""k-means clusters of integer vectors, with bounds that save most of the comparisons.

Each vector keeps its cluster, its exact distance to that centroid, and a lower bound on its distance to all others
(Hamerly, 2010). When centroids move, the bound must give way by as much as another centroid can have come nearer. The plain
answer is the farthest that any has moved. A tighter one looks at the sphere around a cluster's centroid that holds its vectors
(Rysavy and Hamerly, 2016): only the plane through that centroid and the way of the other matters, and in it the
centroid can have come nearer to a point of the disc by much less than it has moved, or gone away
from all of it. Vectors that are then nearer to their own centroid than the bound keep it; the others are
compared with all centroids, in integers.

Vectors stay where they are. A round reads one stored table and writes the next; shuffled are the sums of the vectors
that have changed cluster, and the driver sees one row for each cluster and dimension.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import stored
from plumbline.llm.vectors import coded, decode

#: Rows that are compared at a time, and arcs of the half circle on which the nearest approach is sought.
BLOCK, ARCS = 8192, 256
#: What floating point may add to a bound, relative to the numbers it comes from.
SLACK = 1e-9
#: Squares and products below this are exact in floating point.
_FLOAT_EXACT, _LONG_EXACT = 2**53, 2**62


def approach(centre: np.ndarray, radius: float, start: np.ndarray, end: np.ndarray) -> float:
    """The most by which going from ``start`` to ``end`` can bring a point nearer to any place in a ball; negative if it goes away from all.

    With ``s`` along the way and ``h`` beside it, the ball becomes a disc, and what is sought the largest
    ``|(s, h)| - |(s - way, h)|`` on it. That grows with ``s``, so it lies on the disc's front half; with ``h`` it
    falls where ``s`` is beyond the middle of the way and rises before. Each small arc of the front is bounded by its box.
    """
    step = end - start
    way = float(np.sqrt(step @ step))
    if way == 0:
        return 0.0
    offset = centre - start
    along = float(offset @ step) / way
    beside = float(np.sqrt(max(0.0, float(offset @ offset) - along**2)))
    angles = np.linspace(-np.pi / 2, np.pi / 2, ARCS + 1)
    s, h = along + radius * np.cos(angles), beside + radius * np.sin(angles)
    s = np.maximum(s[:-1], s[1:])
    near = np.where(h[:-1] * h[1:] <= 0, 0.0, np.minimum(np.abs(h[:-1]), np.abs(h[1:])))
    far = np.maximum(np.abs(h[:-1]), np.abs(h[1:]))
    h = np.where(s >= way / 2, near, far)
    most = float((np.hypot(s, h) - np.hypot(s - way, h)).max())
    return min(most, way) + SLACK * (way + abs(along) + beside + radius)


def loosening(before: np.ndarray, after: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each cluster, by how much the lower bounds of its vectors must give way when the centroids move."""
    give = np.full(len(before), -np.inf)
    for a in range(len(before)):
        for j in range(len(before)):
            if j != a and radii[a] >= 0:
                give[a] = max(give[a], approach(before[a], radii[a], before[j], after[j]))
    return give


def distances(matrix: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    most = int(np.abs(matrix).max(initial=0)) + int(np.abs(centroids).max(initial=0))
    if most**2 * matrix.shape[1] >= _LONG_EXACT:
        raise OverflowError("a squared distance does not fit a long")
    if most**2 * matrix.shape[1] < _FLOAT_EXACT:
        x, c = matrix.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((matrix - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _scanned(matrix: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, distance and lower bound of vectors that are compared with all centroids; ties go to the smaller number."""
    all_of = distances(matrix, centroids)
    cluster = all_of.argmin(axis=1)
    rows = np.arange(len(matrix))
    nearest = all_of[rows, cluster]
    all_of[rows, cluster] = np.iinfo(np.int64).max
    lower = np.sqrt(all_of.min(axis=1).astype(np.float64)) * (1 - SLACK) if len(centroids) > 1 else np.full(len(matrix), np.inf)
    return cluster, nearest, lower


def reassigned(
    matrix: np.ndarray, cluster: np.ndarray, lower: np.ndarray, centroids: np.ndarray, give: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(cluster, distance, lower, scanned)`` after a move of the centroids that makes lower bounds give way by ``give``."""
    lower = lower - give[cluster]
    cluster = cluster.copy()
    distance = np.zeros(len(matrix), np.int64)
    for k in np.unique(cluster):
        rows = cluster == k
        distance[rows] = distances(matrix[rows], centroids[k : k + 1])[:, 0]
    scanned = ~(np.sqrt(distance.astype(np.float64)) * (1 + SLACK) < lower)
    if scanned.any():
        cluster[scanned], distance[scanned], lower[scanned] = _scanned(matrix[scanned], centroids)
    return cluster, distance, lower, scanned


def _assigned(state: DataFrame, dims: int, centroids: np.ndarray, give: np.ndarray | None) -> DataFrame:
    """The next state: ``(id, code, before, cluster, distance, lower, scanned)``. Without ``give`` all are compared with all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(start, BLOCK)
                matrix = decode(rows.column(1).to_pylist(), dims)
                before = rows.column(2).to_numpy() if give is not None else np.full(len(matrix), -1)
                if give is None:
                    found = *_scanned(matrix, centroids), np.ones(len(matrix), bool)
                else:
                    found = reassigned(matrix, before, rows.column(3).to_numpy(), centroids, give)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0), rows.column(1), pa.array(before.astype(np.int32)), pa.array(found[0].astype(np.int32)),
                        *(pa.array(x) for x in found[1:]),
                    ],
                    names=["id", "code", "before", "cluster", "distance", "lower", "scanned"],
                )

    kind = state.schema["id"].dataType.simpleString()
    columns = ["id", "code"] if give is None else ["id", "code", "cluster", "lower"]
    schema = f"id {kind}, code binary, before int, cluster int, distance bigint, lower double, scanned boolean"
    return stored(state.select(columns).mapInArrow(run, schema), "clusters")


def _moved(state: DataFrame, dims: int, k: int) -> dict[tuple[int, int], int]:
    """``(cluster, axis) -> change`` of the clusters' sums, from the vectors whose cluster is another than before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, touched = np.zeros((k, dims), object), np.zeros(k, bool)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(start, BLOCK)
                matrix = decode(rows.column(2).to_pylist(), dims)
                for sign, place in ((-1, 0), (1, 1)):
                    at = rows.column(place).to_numpy()
                    for c in np.unique(at[at >= 0]):
                        sums[c] += sign * matrix[at == c].sum(axis=0).astype(object)
                        touched[c] = True
        of = np.flatnonzero(touched)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(of, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(of))),
                pa.array([Decimal(int(v)) for v in sums[of].ravel()], pa.decimal128(38, 0)),
            ],
            names=["cluster", "axis", "total"],
        )

    parts = state.filter("cluster <> before").select("before", "cluster", "code").mapInArrow(run, "cluster int, axis int, total decimal(38,0)")
    return {(r.cluster, r.axis): int(r.total) for r in parts.groupBy("cluster", "axis").agg(F.sum("total").alias("total")).collect()}


def first_centroids(rows: DataFrame, dims: int, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest digests, with the seed in front; NULL ids come last, equal ids by their codes."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select(digest.alias("digest"), "code").orderBy(F.asc_nulls_last("digest"), "code").limit(clusters).collect()
    return decode([bytes(r.code) for r in first], dims)


def _statistics(state: DataFrame) -> dict[int, tuple[int, int, int]]:
    """Vectors, largest distance and sum of distances of each cluster."""
    of = state.groupBy("cluster").agg(
        F.count("*").alias("n"), F.max("distance").alias("farthest"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")
    )
    return {r.cluster: (r.n, r.farthest, int(r.inertia)) for r in of.collect()}


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, clusters: int = 16,
    rounds: int = 3, scale: int = 64, seed: int = 1,
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for every vector of ``dims`` finite entries.

    An entry counts as ``floor(scale * entry)``. Centroids start as the ``clusters`` vectors whose ids have the smallest
    SHA-256 (of ``seed:id``), as many as there are. In each round every vector goes to the nearest centroid,
    ties to the smaller number, and centroids with vectors become the floor of their mean; then vectors are assigned once more.
    ``distance`` is squared; ``inertia`` is the sum of all, ``cluster_inertia`` of the cluster's; the digest is of the
    final centroid's integers, joined by commas.

    Rows whose vector is NULL, of another length, or holds a NULL, NaN or infinite entry are left out. Repeated ids and
    vectors are rows like others; a NULL id gets a cluster too, and starts one only where there are too few others. No rows: no
    rows. Entries so large that a squared distance is no long are an error. Other columns are not looked at.
    """
    if dims < 1 or clusters < 1:
        raise ValueError("dims and clusters must be positive")
    rows = stored(coded(vectors, id_col, vector_col, scale, dims).select("id", "code"), "vectors")
    centroids = first_centroids(rows, dims, clusters, seed)
    k = len(centroids)
    if not k:
        centroids = np.zeros((1, dims), np.int64)
    sums, state, give = np.zeros((len(centroids), dims), object), rows, None
    for after in range(rounds + 1):
        state = _assigned(state, dims, centroids, give)
        found = _statistics(state)
        if after == rounds:
            break
        for (cluster, axis), change in _moved(state, dims, len(centroids)).items():
            sums[cluster, axis] += change
        moved = centroids.copy()
        for cluster, (n, _, _) in found.items():
            moved[cluster] = [int(v) // n for v in sums[cluster]]
        radii = np.array([np.sqrt(found[c][1]) * (1 + SLACK) if c in found else -1.0 for c in range(len(centroids))])
        give = loosening(centroids.astype(np.float64), moved.astype(np.float64), radii)
        centroids = moved
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertias = [found.get(c, (0, 0, 0))[2] for c in range(len(centroids))]
    number = F.col("cluster") + 1
    return state.select(
        F.col("id").alias("vec_id"), "cluster", "distance",
        F.element_at(F.array(*(F.lit(v).cast("bigint") for v in inertias)), number).alias("cluster_inertia"),
        F.lit(sum(inertias)).cast("bigint").alias("inertia"),
        F.element_at(F.array(*map(F.lit, digests)), number).alias("centroid_sha256"),
    )
