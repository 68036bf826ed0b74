"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each text becomes a short vector of statistics.  Random Fourier features of
the standardised vector approximate a Gaussian kernel.  Every partition sums
its part of the normal equations; the sums give the ridge weights.  Raw
scores of labelled rows that the weights haven't seen are binned, and pooled
to a rising curve that turns a raw score into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import words as W
from corvane.llm.shared import bounded_batches, tidy
from corvane.scratch import SPLITS_PER_FILE, discard, written

FOURIER_FEATURES = 256
KERNEL_WIDTH = 4.0
RIDGE = 1.0
SEED = 7
CALIBRATION_BINS = 400
#: One in so many labelled rows calibrates and isn't fitted.
CALIBRATION_FOLDS = 5
ACCEPT = 0.7

#: Classes of ASCII bytes whose shares are statistics.
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\x0b\x0c\r", b".,;:", b"!?", b"|", b"#$%&*@^~+=_\\/", b"<>{}[]()\"'`-")
_CLASS = np.full(256, len(_CLASSES) + 1, dtype=np.int64)
for _i, _bytes in enumerate(_CLASSES):
    _CLASS[list(_bytes)] = _i
_CLASS[128:] = len(_CLASSES)
N_CLASSES = len(_CLASSES) + 2
N_STATISTICS = N_CLASSES + 8


def statistics(column: pa.Array) -> np.ndarray:
    """A row of N_STATISTICS numbers for each text. Null and empty texts give zeros."""
    data, offsets = W.text_bytes(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    classes = np.bincount(np.repeat(np.arange(n) * N_CLASSES, size) + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    starts, ends, counts = W.word_bounds(data, offsets, W.NON_BLANK)
    out = np.zeros((n, N_STATISTICS))
    out[:, :N_CLASSES] = classes / np.maximum(size, 1)[:, None]
    row = np.repeat(np.arange(n), counts)
    words = np.maximum(counts, 1)
    length = ends - starts
    out[:, N_CLASSES] = np.log1p(counts)
    out[:, N_CLASSES + 1] = np.bincount(row, length, n) / words
    out[:, N_CLASSES + 2] = np.bincount(row, length > 12, n) / words
    hashes = W.word_hashes(W.LOWER[data], starts, ends)
    if len(hashes):
        same = np.zeros(len(hashes), dtype=np.bool_)
        same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        out[:, N_CLASSES + 3] = np.bincount(row, same, n) / words
        by = np.argsort(hashes)
        rows = row[by]
        by = by[np.argsort(rows.astype(np.uint16) if n < 1 << 16 else rows, kind="stable")]
        value, own = hashes[by], row[by]
        new = np.ones(len(value), dtype=np.bool_)
        new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(value)))
        distinct = np.bincount(own[first], minlength=n)
        out[:, N_CLASSES + 4] = distinct / np.sqrt(words)
        out[:, N_CLASSES + 5] = distinct / words
        most = np.zeros(n)
        np.maximum.at(most, own[first], times)
        out[:, N_CLASSES + 6] = most / words
    out[:, N_CLASSES + 7] = np.log1p(np.bincount(np.searchsorted(offsets, np.flatnonzero(data == 10), "right") - 1, minlength=n)[:n] / words)
    return out


def statistics_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, stats) for each row."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([slim.schema["id"], T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = statistics(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * N_STATISTICS), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "stats"])

    return slim.mapInArrow(tidy(run), schema)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw_at: np.ndarray
    score_at: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = (stats - self.mean) / self.scale
        rising = np.sqrt(2.0 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        return np.concatenate([rising, np.ones((len(x), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.raw_at, self.score_at), 0.0, 1.0)

    def score_table(self, table: DataFrame) -> DataFrame:
        """(id, score) from (id, stats)."""
        schema = T.StructType([table.schema["id"], T.StructField("score", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stats = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(self.score(stats))], names=["id", "score"])

        return table.select("id", "stats").mapInArrow(tidy(run), schema)

    def accepted(self, docs: DataFrame, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
        """The rows of ``docs`` whose score is at least ``accept``, unchanged. No shuffle."""
        bounded_batches(docs.sparkSession)
        at = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(self.score(statistics(batch.column(at))) >= accept))

        return docs.mapInArrow(tidy(run), docs.schema)


def pooled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators: the rising means closest to total / count."""
    blocks: list[list[float]] = []
    for n, s in zip(count.tolist(), total.tolist(), strict=True):
        blocks.append([n, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, s, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + s, blocks[-1][2] + k]
    return np.repeat([s / n for n, s, _ in blocks], [k for _, _, k in blocks])


def _summed(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """The sums of features'features and features'y over (stats, y), by block of matrix rows."""
    size = len(model.weights)
    step = 32

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            stats = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS)
            x = model.features(stats)
            total[:, :size] += x.T @ x
            total[:, size] += x.T @ batch.column(1).to_numpy(zero_copy_only=False)
        blocks = list(range(0, size, step))
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([total[b : b + step].tobytes() for b in blocks], pa.binary())], names=["block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=np.float64) for x in table.column("sums").to_pylist())
        return pa.table({"block": table.column("block").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    summed = rows.select("stats", "y").mapInArrow(tidy(parts), "block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary").collect()
    if not summed:
        return np.zeros((size, size)), np.zeros(size)
    whole = np.concatenate([np.frombuffer(r["sums"]).reshape(-1, size + 1) for r in sorted(summed, key=lambda r: r["block"])])
    return whole[:, :size], whole[:, size]


def fit_quality(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", learn: Column | None = None) -> QualityModel:
    """A model from all labelled rows of ``table`` (id, stats); ``learn``: which labels (by a condition on ``labels``) may be used.

    Labels that are null, or whose id is null or not in the table, are
    ignored; several labels of one id are averaged.  With no labels every text
    scores one half.
    """
    spark = table.sparkSession
    chosen = labels if learn is None else labels.where(learn)
    truth = chosen.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    rows = written(table.join(truth, F.col("id") == F.col("_id")).select("stats", "y", (F.pmod(F.xxhash64("id"), F.lit(CALIBRATION_FOLDS)) == 0).alias("calibrates")), "labelled")
    moments = rows.select(*[f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(N_STATISTICS) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(N_STATISTICS)])
    scale = np.array([moments[f"s{i}"] or 0.0 for i in range(N_STATISTICS)])
    rng = np.random.RandomState(SEED)
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(N_STATISTICS, FOURIER_FEATURES)) / KERNEL_WIDTH, rng.uniform(0, 2 * np.pi, FOURIER_FEATURES), np.zeros(FOURIER_FEATURES + 1), np.array([0.0]), np.array([0.5]))
    left, right = _summed(rows.where("not calibrates"), model)
    if not left.any():
        return model
    model.weights = np.linalg.solve(left + RIDGE * np.eye(len(right)), right)
    fitted = spark.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(CALIBRATION_BINS), np.zeros(CALIBRATION_BINS)
        for batch in batches:
            stats = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS)
            at = np.clip(((fitted.value.raw(stats) + 0.5) * (CALIBRATION_BINS / 2)).astype(int), 0, CALIBRATION_BINS - 1)
            count += np.bincount(at, minlength=CALIBRATION_BINS)
            total += np.bincount(at, batch.column(1).to_numpy(zero_copy_only=False), CALIBRATION_BINS)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(total[some])], names=["bin", "n", "total"])

    held = rows.where("calibrates").select("stats", "y").mapInArrow(tidy(bins), "bin int, n double, total double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("bin").collect()
    if held:
        model.raw_at = (np.array([r["bin"] for r in held]) + 0.5) / (CALIBRATION_BINS / 2) - 0.5
        model.score_at = pooled(np.array([r["n"] for r in held]), np.array([r["total"] for r in held]))
    else:
        model.raw_at, model.score_at = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn: Column | None = None) -> DataFrame:
    """(id, score) for every row of ``docs``, null and empty texts too. Other columns are never read."""
    bounded_batches(docs.sparkSession)
    table = written(statistics_table(docs, id_col, text_col), "statistics", SPLITS_PER_FILE)
    return fit_quality(table, labels, id_col, label_col, learn).score_table(table).select(F.col("id").alias(id_col), "score")


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn: Column | None = None, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, unchanged.

    Null and empty texts are scored like any other; texts of any length are
    read whole.  Repeated rows share their fate, and so do rows of equal texts:
    the id is no input of a score.  All columns pass through, whatever their
    names.  An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    table = written(statistics_table(docs, id_col, text_col), "statistics", SPLITS_PER_FILE)
    model = fit_quality(table, labels, id_col, label_col, learn)
    discard(table)
    return model.accepted(docs, text_col, accept)
