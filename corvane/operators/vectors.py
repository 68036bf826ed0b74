"""Exact cosine search over vector tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corvane.scratch import written

SMALL_NORM = 1e-12
#: Queries that are compared at once: the bound of what one broadcast holds.
QUERY_BLOCK = 4096
#: Scores that a task works out at once.
CELLS = 1 << 20


def normalised(vector: Column) -> Column:
    """The vector at length 1; zeros if its length is next to nothing."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(length > SMALL_NORM, x.cast("double") / length).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors of the same size; an error if their sizes differ."""
    product = F.aggregate(F.zip_with(normalised(a), normalised(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.raise_error(F.lit("vectors of different sizes")))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != size * len(column) or column.null_count:
        raise ValueError("vectors of different sizes")
    rows = flat.reshape(len(column), size)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > SMALL_NORM)


def best_pairs(batches: Iterator[tuple[np.ndarray, np.ndarray]], q: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(query numbers, ids, scores): the best ``top_k`` rows of (ids, unit rows) for each row of ``q``; ties go to the least id.

    CELLS scores are worked out at once; what is kept are pairs that can be
    among the best, so memory doesn't grow with queries times rows.
    """
    kept = None
    floor = np.full(len(q), -np.inf)
    for every, rows in batches:
        step = max(1, CELLS // max(1, len(q)))
        for start in range(0, len(rows), step):
            scores = np.round(rows[start : start + step] @ q.T, 9)
            scores[np.isnan(scores)] = -np.inf
            if len(scores) > top_k:
                np.maximum(floor, np.partition(scores, len(scores) - top_k, axis=0)[len(scores) - top_k], out=floor)
            at, query = np.nonzero(scores >= floor)
            some = (query, every[start : start + step][at], scores[at, query])
            query, ids, values = some if kept is None else (np.concatenate(x) for x in zip(kept, some, strict=True))
            order = np.lexsort((ids, -values, query))
            query = query[order]
            starts = np.searchsorted(query, np.arange(len(q)))
            place = np.arange(len(query)) - starts[query]
            order, query = order[place < top_k], query[place < top_k]
            kept = query, ids[order], values[order]
            last = np.searchsorted(query, np.arange(len(q)), side="right") - 1
            full = np.bincount(query, minlength=len(q)) == top_k
            floor[full] = kept[2][last[full]]
    return kept


def _near(vectors: DataFrame, asked: list, top_k: int, schema: T.StructType) -> DataFrame:
    """(query_id, doc_id, total): of every partition of ``vectors`` (doc_id, v) the best of each query (query_id, q)."""
    names = pa.array([r["query_id"] for r in asked], to_arrow_type(schema["query_id"].dataType))
    rows = np.array([r["q"] for r in asked], dtype=np.float64)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    shared = vectors.sparkSession.sparkContext.broadcast(np.divide(rows, length, out=rows, where=length > SMALL_NORM))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        kind = None

        def units() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), q.shape[1])

        kept = best_pairs(units(), q, top_k)
        if kept is not None:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(kept[0])), pa.array(kept[1], kind), pa.array(kept[2])], names=["query_id", "doc_id", "total"])

    return vectors.mapInArrow(run, schema)


def cosine_top_k(queries: DataFrame, vectors: DataFrame, top_k: int = 50, query_id: str = "query_id", query_vector: str = "embedding", id_col: str = "doc_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, doc_id, rank, score (4 places): the nearest ``top_k`` vectors of every query; ties go to the least id.

    Queries are taken in blocks of about QUERY_BLOCK, dealt by a hash of their
    ids; the driver and the tasks hold one block at a time.  Every task
    multiplies its batches of vectors with the block and carries the best
    ``top_k`` of each query from batch to batch, so it sends so many rows of a
    query and no more; these meet in a shuffle by query.  Null vectors are left
    out; vectors of different sizes are an error.
    """
    spark = vectors.sparkSession
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("q"))
    slim = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(vector_col).alias("v"))
    schema = T.StructType([asked.schema["query_id"], slim.schema["doc_id"], T.StructField("total", T.DoubleType())])
    first = asked.take(QUERY_BLOCK + 1)
    if not first:
        found = spark.createDataFrame([], schema)
    elif len(first) <= QUERY_BLOCK:
        found = _near(slim, first, top_k, schema)
    else:
        table = written(asked, "queries")
        blocks = -(-table.count() // QUERY_BLOCK)
        parts = []
        for k in range(blocks):
            block = table.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).collect()  # about QUERY_BLOCK rows
            if block:
                parts.append(written(_near(slim, block, top_k, schema), "near"))
        found = reduce(DataFrame.union, parts)
    best = Window.partitionBy("query_id").orderBy(F.desc("total"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).select("query_id", "doc_id", "rank", F.round("total", 4).alias("score"))


def mean_pooled(tokens: Column, mask: Column) -> Column:
    """The mean of the token vectors whose mask is 1, at length 1."""
    size = F.size(F.get(tokens, F.lit(0)))
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, x: a + x), F.lit(1e-9))
    weighted = F.zip_with(tokens, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    total = F.aggregate(weighted, F.array_repeat(F.lit(0.0), size), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return normalised(F.transform(total, lambda x: x / count))
