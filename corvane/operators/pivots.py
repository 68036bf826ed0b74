"""Exact cosine search that skips clusters: vectors stored by their nearest pivot, with the angle that bounds each block.

Angles between vectors obey the triangle inequality: if a query stands a from
a pivot and all vectors of a block stand at most r from it, none of them is
nearer to the query than a - r.  A first pass over the blocks of each query's
nearest pivot gives it a k-th best score; the second reads, for each block,
only the queries that may still find a better one there.  No vector that
belongs to the best is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.vectors import QUERY_BLOCK, SMALL_NORM
from corvane.scratch import discard, written

#: Vectors that pivots are chosen from, most pivots, and vectors of one block, on average.
SAMPLE, MOST_PIVOTS, BLOCK_ROWS = 8192, 1024, 512
#: How much a bound may miss a score by: rounding to nine places and of arc cosines.
MARGIN = 1e-6


def _units(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > SMALL_NORM)


def _rows(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != size * len(column):
        raise ValueError("vectors of different sizes")
    return flat.reshape(len(column), size)


def chosen_pivots(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """``n`` unit vectors amid those of the sample: the mean directions of clusters, after some rounds."""
    pivots = sample[np.linspace(0, len(sample) - 1, n).astype(int)]
    for _ in range(rounds):
        near = (sample @ pivots.T).argmax(1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, sample)
        length = np.linalg.norm(sums, axis=1)
        some = length > SMALL_NORM
        pivots[some] = sums[some] / length[some, None]
    return pivots


@dataclass(frozen=True)
class PivotIndex:
    """blocks(pivot, radius, ids, data): the unit vectors of a block as doubles, one after the other; pivot -1 holds zero vectors."""

    blocks: DataFrame
    pivots: np.ndarray
    rows: int
    id_type: T.DataType

    @staticmethod
    def build(vectors: DataFrame, id_col: str = "doc_id", vector_col: str = "embedding", pivots: int | None = None) -> PivotIndex:
        """Store ``vectors`` by their nearest pivots. Every vector is stored; pivots are chosen from SAMPLE of them, those with the least hash of their ids.

        Null vectors are left out; vectors of different sizes are an error.
        A pivot with many vectors has many blocks, dealt by a hash of the ids.
        """
        spark = vectors.sparkSession
        slim = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        table = written(slim, "vectors")
        n = table.count()
        sample = [r.v for r in table.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()]
        size = len(sample[0]) if sample else 1
        if any(len(v) != size for v in sample):
            raise ValueError("vectors of different sizes")
        some = _units(np.array(sample, dtype=np.float64).reshape(len(sample), size))
        some = some[some.any(axis=1)]
        made = chosen_pivots(some, max(1, min(len(some), pivots or int(n**0.5), MOST_PIVOTS))) if len(some) else np.zeros((0, size))
        shared = spark.sparkContext.broadcast(made)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                units = _units(_rows(batch.column(1), size))
                zero = ~units.any(axis=1)
                score = units @ own.T if len(own) else np.zeros((len(units), 1))
                near = np.where(zero, -1, score.argmax(1))
                angle = np.arccos(np.clip(score.max(1), -1, 1))
                data = pa.array([u.tobytes() for u in units], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.int32()), pa.array(angle), data], names=["id", "pivot", "angle", "unit"])

        kind = table.schema["id"].dataType
        placed = written(table.mapInArrow(assign, f"id {kind.simpleString()}, pivot int, angle double, unit binary"), "placed")
        slices = placed.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("slices"))  # a row for each pivot
        dealt = placed.join(F.broadcast(slices), "pivot").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")))
        packed = dealt.groupBy("pivot", "slice").agg(F.max("angle").alias("radius"), F.collect_list(F.struct("id", "unit")).alias("x"))
        blocks = written(packed.select("pivot", "radius", F.col("x.id").alias("ids"), F.col("x.unit").alias("units")), "blocks")
        discard(table, placed)
        return PivotIndex(blocks, made, n, kind)

    def _searched(self, ids: pa.Array, units: np.ndarray, top_k: int, floor: np.ndarray | None) -> DataFrame:
        """(query_id, doc_id, total, pairs): of each task the best of each query; without ``floor`` in the blocks of its nearest pivot only."""
        shared = self.blocks.sparkSession.sparkContext.broadcast((ids, units, self.pivots, floor))
        schema = f"query int, doc_id {self.id_type.simpleString()}, total double, pairs bigint"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, q, pivots, least = shared.value
            some = q.any(axis=1)
            score = np.clip(q @ pivots.T, -1, 1)
            angle = np.arccos(score)
            nearest = score.argmax(1) if len(pivots) else np.full(len(q), -1)
            best: dict[int, list[tuple[float, object]]] = {}
            pairs, kind = 0, None
            for batch in batches:
                kind = batch.schema.field(2).type.value_type
                for pivot, radius, own, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    if pivot < 0:
                        open_ = np.arange(len(q))
                    elif least is None:
                        open_ = np.flatnonzero(nearest == pivot)
                    else:
                        reach = np.cos(np.maximum(0, angle[:, pivot] - radius))
                        open_ = np.flatnonzero((reach >= least - MARGIN) | ~some)
                    if not len(open_):
                        continue
                    held = np.frombuffer(b"".join(packed.values.to_pylist()), dtype=np.float64).reshape(-1, q.shape[1])
                    pairs += len(open_) * len(held)
                    scores = np.round(q[open_] @ held.T, 9)
                    names = own.values
                    for i, row in zip(open_.tolist(), scores, strict=True):
                        at = np.arange(len(row)) if len(row) <= top_k else np.flatnonzero(row >= np.partition(row, len(row) - top_k)[len(row) - top_k])
                        mine = best.setdefault(i, [])
                        mine += zip((-row[at]).tolist(), names.take(pa.array(at)).to_pylist(), strict=True)
                        if len(mine) > 4 * top_k:
                            mine.sort()
                            del mine[top_k:]
            out = [(i, d, -s) for i, mine in best.items() for s, d in sorted(mine)[:top_k]]
            out.append((-1, None, 0.0))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], kind), pa.array([x[2] for x in out], pa.float64()), pa.array([0] * (len(out) - 1) + [pairs], pa.int64())], names=["query", "doc_id", "total", "pairs"])

        return self.blocks.select("pivot", "radius", "ids", "units").mapInArrow(run, schema)

    def search(self, queries: DataFrame, top_k: int = 50, query_id: str = "query_id", query_vector: str = "embedding", report: dict | None = None) -> DataFrame:
        """query_id, doc_id, rank, score (4 places), as ``cosine_top_k``. ``report`` gets the pairs compared and those of a full scan."""
        spark = self.blocks.sparkSession
        asked = written(queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("q")), "queries")
        n, parts, best = asked.count(), [], Window.partitionBy("query").orderBy(F.desc("total"), "doc_id")
        blocks = max(1, -(-n // QUERY_BLOCK))
        for k in range(blocks):
            block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).toArrow()  # about QUERY_BLOCK rows
            if not len(block) or not self.rows:
                continue
            ids = block.column(0).combine_chunks()
            units = _units(_rows(block.column(1).combine_chunks(), self.pivots.shape[1] if len(self.pivots) else len(block.column(1)[0])))
            first = self._searched(ids, units, top_k, None).where("query >= 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") == top_k)
            floor = np.full(len(units), -2.0)
            for r in first.select("query", "total").collect():  # a row for each query of the block
                floor[r["query"]] = r.total
            found = written(self._searched(ids, units, top_k, floor), "near")
            if report is not None:
                report["pairs"] = report.get("pairs", 0) + found.agg(F.sum("pairs")).first()[0]
                report["all"] = report.get("all", 0) + len(units) * self.rows
            names = spark.createDataFrame(pa.table({"query": pa.array(range(len(ids)), pa.int32()), "query_id": ids}))
            ranked = found.where("query >= 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
            parts.append(ranked.join(F.broadcast(names), "query").select("query_id", "doc_id", "rank", F.round("total", 4).alias("score")))
        if parts:
            return reduce(DataFrame.union, parts)
        return spark.createDataFrame([], T.StructType([asked.schema["query_id"], T.StructField("doc_id", self.id_type), T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType())]))
