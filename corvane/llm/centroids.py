"""Exact k-means over integer vectors, with distances screened by block norms.

The compressed form of a vector is one signed byte for each component, and for
each block of components the norm of what the bytes leave out.  By Cauchy and
Schwarz the scalar product with a centroid is at most that of the bytes plus,
over all blocks, the norm left out times the norm of the centroid's block; so
distances have lower bounds.  For each vector the centroid with the least
bound gets its exact integer distance, and of the others only those whose
bound does not exceed it.

Compressed forms are worked out once and stored with the vectors.  A round
reads them, sums components by task and centroid, and sends those sums: a row
for each centroid and component of a task, whatever the size of a cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import bounded_batches, tidy
from corvane.scratch import discard, unused, written

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Components of a block.
BLOCK = 8
#: A component's least size that is refused: distances beyond it don't fit a long.
TOO_LARGE = 1 << 27


@dataclass(frozen=True)
class Compressed:
    """Of each vector: one byte a component, the step of its bytes, the norm left out of each block, and the squared norm."""

    codes: np.ndarray
    steps: np.ndarray
    lost: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(vectors: np.ndarray) -> Compressed:
        steps = np.maximum(1, -(-np.abs(vectors).max(1, initial=0) // 127))
        codes = np.rint(vectors / steps[:, None]).astype(np.int8)
        left = (vectors - codes * steps[:, None]).reshape(len(vectors), -1, BLOCK)
        return Compressed(codes, steps, np.sqrt((left * left).sum(2)), (vectors * vectors).sum(1))


@dataclass(frozen=True)
class Screen:
    """Centroids beside which vectors are held."""

    centroids: np.ndarray

    def bounds(self, vectors: Compressed) -> np.ndarray:
        """Lower bounds of squared distances, rounding allowed for: a row for each vector, a column for each centroid."""
        own = self.centroids.astype(np.float64)
        norms = np.sqrt((own**2).reshape(len(own), -1, BLOCK).sum(2))
        most = vectors.steps[:, None] * (vectors.codes.astype(np.float64) @ own.T) + vectors.lost @ norms.T
        size = vectors.sizes[:, None] + (own**2).sum(1)
        return size - 2 * most - 1e-9 * size - 1

    def nearest(self, vectors: np.ndarray, compressed: Compressed) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of the nearest centroid of each vector, ties to the smaller number; exact distances made."""
        bounds = self.bounds(compressed)
        first = bounds.argmin(1)
        every = np.arange(len(vectors))
        best, distance = first.copy(), self._exact(vectors, first)
        made = len(vectors)
        bounds[every, first] = np.inf
        for k in range(len(self.centroids)):
            open_ = np.flatnonzero(bounds[:, k] <= distance)
            if len(open_):
                made += len(open_)
                d = self._exact(vectors[open_], np.full(len(open_), k))
                nearer = (d < distance[open_]) | ((d == distance[open_]) & (k < best[open_]))
                best[open_[nearer]], distance[open_[nearer]] = k, d[nearer]
        return best, distance, made

    def _exact(self, vectors: np.ndarray, which: np.ndarray) -> np.ndarray:
        away = vectors - self.centroids[which]
        return (away * away).sum(1)


def integer_vectors(column: Column, dims: int = DIMS, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component x, as integers; null unless there are ``dims`` components, none null or non-finite."""
    sound = (F.size(column) == dims) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(column, lambda x: F.when(F.abs(x.cast("double")) * scale < TOO_LARGE, F.floor(x.cast("double") * scale)).otherwise(F.raise_error(F.lit("a component is too large for distances that fit a long")).cast("long")))
    return F.when(F.coalesce(sound, F.lit(False)), whole.cast("array<int>"))


#: Columns of compressed forms.
FORM = "codes binary, step bigint, lost array<double>, size bigint"


def _read(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, Compressed]:
    """The vectors of a batch and their compressed forms."""
    column = lambda name: batch.column(batch.schema.get_field_index(name))
    codes = np.frombuffer(b"".join(column("codes").to_pylist()), dtype=np.int8).reshape(-1, dims)
    lost = column("lost").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims // BLOCK)
    return _matrix(column("v"), dims), Compressed(codes, column("step").to_numpy(zero_copy_only=False), lost, column("size").to_numpy(zero_copy_only=False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def with_compressed(vectors: DataFrame, dims: int) -> DataFrame:
    """(id, v) and the columns of FORM: vectors beside their compressed forms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form = Compressed.of(_matrix(batch.column(1), dims))
            codes = pa.array([row.tobytes() for row in form.codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, codes, pa.array(form.steps, pa.int64()), pa.array(form.lost.tolist(), pa.list_(pa.float64())), pa.array(form.sizes, pa.int64())], names=["id", "v", "codes", "step", "lost", "size"])

    return vectors.mapInArrow(tidy(run), f"id {vectors.schema['id'].dataType.simpleString()}, v array<int>, {FORM}")


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the least SHA-256 of ``seed:id``; null ids last, and of repeated ids the least vector first."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.orderBy(F.asc_nulls_last(rank), "v").limit(clusters).select("v").collect()
    return np.array([r.v for r in rows], dtype=np.int64).reshape(len(rows), len(rows[0].v) if rows else 0)


def moved(table: DataFrame, centroids: np.ndarray, dims: int) -> tuple[np.ndarray, int]:
    """The centroids after one round: exact floors of their vectors' means; and the exact distances made."""
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(shared.value)
        sums, counts, made = np.zeros(shared.value.shape, dtype=np.int64), np.zeros(len(shared.value), dtype=np.int64), 0
        for batch in batches:
            vectors, forms = _read(batch, dims)
            best, _, more = screen.nearest(vectors, forms)
            made += more
            counts += np.bincount(best, minlength=len(counts))
            for k in np.unique(best).tolist():
                sums[k] += vectors[best == k].sum(0)
        full = np.column_stack([sums, counts, np.append(made, counts[1:] * 0)])  # after the components: vectors, and exact distances
        k, place = np.divmod(np.arange(full.size), full.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(place, pa.int32()), pa.array(full.ravel())], names=["k", "place", "part"])

    parts = table.drop("id").mapInArrow(tidy(run), "k int, place int, part bigint")
    totals = np.zeros((len(centroids), dims + 2), dtype=np.int64)
    for r in parts.groupBy("k", "place").agg(F.sum("part").alias("part")).collect():
        totals[r.k, r.place] = r.part
    shared.destroy()
    some = np.flatnonzero(totals[:, dims])
    out = centroids.copy()
    out[some] = totals[some, :dims] // totals[some, dims : dims + 1]
    return out, int(totals[:, dims + 1].sum())


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, report: dict | None = None) -> DataFrame:
    """One row per kept vector: id, cluster (int), distance (squared, long), cluster_inertia, inertia (long), centroid_sha256.

    Kept are vectors of ``dims`` finite components, null in none; null vectors
    and all others are left out.  They become floor(scale * x).  The first
    centroids are those with the least SHA-256 of ``seed:id``; with fewer kept
    vectors than clusters there are as many centroids.  Rows with null ids are
    clustered like others and are first centroids only if there are no other
    rows.  Repeated rows each count.  Ties go to the smaller number; a
    centroid without vectors stays where it is.  Components of 2^27 or more,
    scaled, are an error, since distances would not fit a long.  Other columns
    are ignored, whatever their names.  An empty table gives an empty result.
    ``report`` gets the exact distances made and those of a full search.
    """
    if dims % BLOCK:
        raise ValueError(f"dims must be a multiple of {BLOCK}")
    bounded_batches(vectors.sparkSession)
    whole = vectors.select(F.col(id_col).alias("id"), integer_vectors(F.col(vector_col), dims, scale).alias("v")).where("v is not null")
    table = written(with_compressed(whole, dims), "vectors")
    centroids = first_centroids(table, clusters, seed)
    if not len(centroids):
        return table.select(F.col("id").alias(id_col), *[F.lit(None).cast(kind).alias(name) for name, kind in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    made = 0
    for _ in range(rounds):
        centroids, more = moved(table, centroids, dims)
        made += more
    if report is not None:
        report |= {"made": made, "full": table.count() * len(centroids) * rounds}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        for batch in batches:
            best, distance, _ = screen.nearest(*_read(batch, dims))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], names=[id_col, "cluster", "distance"])

    assigned = written(table.mapInArrow(tidy(run), f"`{id_col}` {whole.schema['id'].dataType.simpleString()}, cluster int, distance bigint"), "assigned")
    sums = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    discard(table)
    spark = vectors.sparkSession
    totals = spark.createDataFrame([(k, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, s in sums.items()], "k int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    (k,) = unused([id_col], "k")
    return assigned.join(F.broadcast(totals.withColumnRenamed("k", k)), assigned["cluster"] == F.col(k)).select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
