"""Ball k-means on Spark: exact Lloyd rounds that compare a vector only with the centroids that can be nearer.

A cluster is a ball: its centroid and a radius that holds every member. Another centroid ``i`` is a neighbour of cluster
``j`` if it lies within twice the radius, for a member at distance ``d`` can only move to ``i`` if ``2 d >= |c_i - c_j|``
(triangle inequality; the equal case may be a tie that a smaller number wins). So a cluster without neighbours is left as it
is; in the others the members below half the distance to the nearest neighbour are the stable core, and those beyond
fall into annuli between the half distances of neighbours in ascending order: an annulus is compared with the neighbours
up to its own one, exactly and in whole numbers.

A round is two narrow passes without a shuffle of vectors: one sums members by cluster (``k`` rows a task) and takes the
largest distance, one assigns. The radius about a moved centroid is bounded by the old radius and the way that it moved.
State is written to the shared folder after every assignment, so a lost executor costs its tasks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy

DIMS, SCALE = 64, 64
CLUSTERS, ROUNDS = 16, 3
#: Largest size of a component: squared distances of 64 of them stay below 2^63.
MOST = 1 << 27
_STATE = "vec_id long, v array<long>, cluster int, distance long"


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: vectors of ``dims`` components, none null or non-finite, as whole numbers ``floor(scale * x)``; others are left out.

    A component beyond ``MOST`` stops the query with an error, since its squared distances would not fit a long.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("x"))
    rows = rows.where((F.size("x") == dims) & ~F.exists("x", bad))
    fits = F.forall("x", lambda x: F.abs(x) * scale <= MOST)
    v = F.when(fits, F.transform("x", lambda x: F.floor(x * scale))).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST / scale}")).cast("array<long>"))
    return rows.select("vec_id", v.alias("v"))


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``1:<vec_id>``, ascending; rows that repeat an id by their components, null ids last."""
    hashed = rows.withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    top = hashed.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).select("v").collect()  # k rows
    return np.array([r["v"] for r in top], np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of every vector by comparing all centroids; the smaller number wins ties."""
    best, at = squared(v, centroids[:1]), np.zeros(len(v), np.int32)
    for i in range(1, len(centroids)):
        d = squared(v, centroids[i : i + 1])
        closer = d < best
        best[closer], at[closer] = d[closer], i
    return at, best


def neighbours(centroids: np.ndarray, radii: list[int]) -> list[list[tuple[int, int]]]:
    """For each ball, ``(squared distance, number)`` of the centroids within twice its radius, nearest first. Radius -1: no member."""
    out = []
    for j, r in enumerate(radii):
        apart = squared(centroids, centroids[j : j + 1]).tolist()
        out.append(sorted((d, i) for i, d in enumerate(apart) if i != j and d <= 4 * r * r) if r >= 0 else [])
    return out


def reassign(v: np.ndarray, cluster: np.ndarray, centroids: np.ndarray, near: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance after the centroids moved, and how many vectors were compared with another centroid."""
    own = squared(v, centroids[cluster])
    at, best, compared = cluster.copy(), own.copy(), 0
    for j, others in enumerate(near):
        members = np.flatnonzero(cluster == j) if others else []
        for apart, i in others:
            members = members[4 * own[members] >= apart]  # the stable core and the annuli further in need no more
            if not len(members):
                break
            compared += len(members)
            d = squared(v[members], centroids[i : i + 1])
            closer = (d < best[members]) | ((d == best[members]) & (i < at[members]))
            moved = members[closer]
            best[moved], at[moved] = d[closer], i
    return at, best, compared


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _assign(rows: DataFrame, centroids: np.ndarray, near: list | None, dims: int) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1), dims)
            if near is None:
                at, best = nearest(v, centroids)
            else:
                at, best, _ = reassign(v, batch.column(2).to_numpy(), centroids, near)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "v", "cluster", "distance"])

    return rows.mapInArrow(run, _STATE)


def _sums(state: DataFrame, k: int, dims: int) -> tuple[dict[int, tuple[int, int]], dict[int, list[int]]]:
    """By cluster: members and largest squared distance; sums of components. One row a task, cluster and component reaches the shuffle."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            at = batch.column(1).to_numpy()
            v = _matrix(batch.column(0), dims)
            n += np.bincount(at, minlength=k)
            np.maximum.at(far, at, batch.column(2).to_numpy())
            order = np.argsort(at, kind="stable")
            held, starts = np.unique(at[order], return_index=True)
            if len(held):
                total[held] += np.add.reduceat(v[order], starts, axis=0)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held]), pa.array(far[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "far", "total"])

    parts = state.select("v", "cluster", "distance").mapInArrow(run, "cluster int, n long, far long, total array<long>")
    dims_of = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dims)]
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("far").alias("far"), *dims_of).collect()  # a row a cluster
    return {r["cluster"]: (r["n"], r["far"]) for r in found}, {r["cluster"]: [r[f"s{i}"] for i in range(dims)] for r in found}


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, v, cluster, distance`` after ``rounds`` rounds and a last assignment, and the centroids.

    Vectors that are null, of another length, or hold a null or non-finite component are left out. With fewer than ``k``
    vectors there are as many centroids as vectors; an empty table gives none. Ties go to the smaller number; rows that
    repeat an id are vectors of their own; null ids stay and start no cluster while others can. Other columns are ignored.
    """
    rows = stored(whole_vectors(vectors, id_col, vec_col, dims, scale), "vectors")
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], _STATE), centroids.reshape(0, dims)
    state = stored(_assign(rows, centroids, None, dims), "assigned")
    for _ in range(rounds):
        balls, total = _sums(state, len(centroids), dims)
        moved, radii = centroids.copy(), [-1] * len(centroids)
        for j, (n, far) in balls.items():
            moved[j] = [s // n for s in total[j]]
            way = sum(int(x) ** 2 for x in moved[j] - centroids[j])
            radii[j] = isqrt(far) + 1 + (isqrt(way) + 1 if way else 0)
        centroids = moved
        state = stored(_assign(state, centroids, neighbours(centroids, radii), dims), "assigned")
    return state, centroids


def clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector that :func:`cluster` keeps."""
    state, centroids = cluster(vectors, id_col, vec_col, k, rounds, dims, scale)
    marks = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    known = state.sparkSession.createDataFrame(marks, "cluster int, centroid_sha256 string")
    per = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = state.agg(F.sum("distance").alias("inertia"))
    about = known.join(per, "cluster").crossJoin(F.broadcast(total))  # a row a cluster; one row
    out = state.join(F.broadcast(about), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    far = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [
        f"q AS MATERIALIZED (SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        f" WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS i, v AS c FROM q ORDER BY sha256('1:' || vec_id), v LIMIT {CLUSTERS})",
    ]
    for t in range(ROUNDS + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT vec_id, v, min(struct_pack(d := d, i := i)) AS best FROM (SELECT nr, vec_id, v, i, {far} AS d FROM q, c{t}) GROUP BY nr, vec_id, v)")
        if t < ROUNDS:
            # Whole division rounds towards zero, so the remainder is taken off first.
            parts.append(
                f"m{t} AS (SELECT i, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY k) AS c FROM (SELECT best.i AS i, k, sum(v[k])::HUGEINT AS s, count(*) AS n"
                f" FROM a{t}, (SELECT unnest(range(1, {DIMS + 1})) AS k) GROUP BY 1, 2) GROUP BY i)"
            )
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT i, coalesce(m.c, o.c) AS c FROM c{t} o LEFT JOIN m{t} m USING (i))")
    return (
        "WITH " + ", ".join(parts) + " SELECT vec_id, best.i::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.i))::BIGINT AS cluster_inertia,"
        f" (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} o ON o.i = best.i"
    )


SQL = _sql()
