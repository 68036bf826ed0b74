"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features are the distinct words, the beginnings of words (their first
STEM_BYTES bytes, up to the end of a character, so that inflected forms meet),
word pairs and pairs with one word between them, hashed to FEATURE_BITS bits.  The learner keeps a rate of its own for
every coordinate and an L1 penalty that leaves most weights at zero, so the
weights that every executor gets are a few thousand numbers.
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
from corvane.llm.mixing import HASH_BITS, hash60
from corvane.llm.shared import bounded_batches, tidy
from corvane.scratch import written

FEATURE_BITS = 20
STEM_BYTES = 6
#: Bounds of what the training task learns from: labelled rows (about), bytes of their texts, and bytes of one text.
SAMPLE_ROWS = 16_000
SAMPLE_BYTES = 64 << 20
LONGEST_SAMPLE = 1 << 20
#: Hash ranges whose bytes are counted to find the sample.
SAMPLE_BITS = 12
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(feature numbers, row of each, rows); a feature may occur several times in a row."""
    data, offsets = W.text_bytes(column)
    data = W.LOWER[data]
    starts, ends, counts = W.word_bounds(data, offsets, W.ALNUM)
    word = W.word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(counts)), counts)
    cut = np.minimum(ends, starts + STEM_BYTES)
    for _ in range(3):  # to the end of a character
        cut += (cut < ends) & (data[np.minimum(cut, len(data) - 1)] & 0xC0 == 0x80)
    stem = W.word_hashes(data, starts, cut)
    values, rows = [word, W.mix(stem)], [row, row]
    for gap, salt in ((1, 0x632BE59BD9B4E019), (2, 0x8CB92BA72F3D8DD7)):
        pair = W.mix(word[:-gap] * np.uint64(salt) + word[gap:])
        whole = row[:-gap] == row[gap:]
        values.append(pair[whole])
        rows.append(row[:-gap][whole])
    number = (np.concatenate(values) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    return number, np.concatenate(rows), len(counts)


def _distinct(number: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((row << FEATURE_BITS) | number)
    return both & ((1 << FEATURE_BITS) - 1), both >> FEATURE_BITS


@dataclass
class ToxicityModel:
    """Sparse weights and a bias; ``score`` makes a dense table of them once in a worker."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        dense = getattr(self, "_dense", None)
        if dense is None:
            dense = self._dense = np.zeros(1 << FEATURE_BITS)
            dense[self.index] = self.weight
        number, row, n = features(column)
        some = dense[number] != 0
        number, row = _distinct(number[some], row[some])
        total = np.bincount(row, dense[number], n) if len(row) else np.zeros(n)
        return 1.0 / (1.0 + np.exp(-np.clip(total + self.bias, -35, 35)))

    def score_documents(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, score) for every row. Null and empty texts score by the bias alone."""
        bounded_batches(docs.sparkSession)
        slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        shared = docs.sparkSession.sparkContext.broadcast(self)
        schema = T.StructType([T.StructField(id_col, slim.schema["id"].dataType), T.StructField("score", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1)))], names=[id_col, "score"])

        return slim.mapInArrow(tidy(run), schema)


def ftrl(examples: list[np.ndarray], truth: list[float], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes over the examples (arrays of distinct feature numbers)."""
    size = (1 << FEATURE_BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    l1 = np.full(size, L1)
    l1[-1] = 0.0  # the bias

    def weights(at: np.ndarray) -> np.ndarray:
        own, limit = z[at], l1[at]
        return np.where(np.abs(own) <= limit, 0.0, -(own - np.sign(own) * limit) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for x, y in zip(examples, truth, strict=True):
            at = np.append(x, size - 1)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
            n[at] = new
    all_at = np.arange(size)
    w = weights(all_at)
    return w[:-1], float(w[-1])


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int, sample_bytes: int) -> DataFrame:
    """(h, y, text) of the labelled rows to learn from: those with the least hash of their id, within the bounds."""
    truth = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    hashed = written(truth.withColumn("h", hash60(F.col("label_id"))), "labels")
    under = int(min(1.0, sample_rows / max(hashed.count(), 1)) * (1 << HASH_BITS))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(hashed.where(F.col("h") < under)), F.col("id") == F.col("label_id")).select("h", "y", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST_SAMPLE)
    shift = HASH_BITS - SAMPLE_BITS
    sizes = sorted(rows.groupBy(F.shiftright("h", shift).alias("part")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).collect())  # at most 2**SAMPLE_BITS rows
    total = 0
    for part, size in sizes:
        total += size
        if total > sample_bytes:
            return rows.where(F.col("h") < (part << shift))
    return rows


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> ToxicityModel:
    """A model from a sample of the labelled rows; ``learn``: which labels may be used.

    About ``sample_rows`` rows and at most ``sample_bytes`` bytes of text are
    taken, those with the least hash of their id, so the choice depends on
    nothing but ids and sizes; texts over LONGEST_SAMPLE bytes are scored but
    not learned from.  Labels that are null or whose id is null are ignored,
    several labels of one id are averaged.  With no labels every text scores
    one half.
    """
    bounded_batches(docs.sparkSession)
    rows = _sample(docs, labels if learn is None else labels.where(learn), id_col, text_col, label_col, sample_rows, sample_bytes)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, row, m = features(batch.column(2))
            number, row = _distinct(number, row)
            where = np.searchsorted(row, np.arange(m + 1))
            raw = number.astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([raw[a:b].tobytes() for a, b in zip(where[:-1], where[1:], strict=True)], pa.binary())], names=["h", "y", "x"])

    def learn_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples: list[np.ndarray] = []
        truth: list[float] = []
        for batch in batches:
            examples += [np.frombuffer(x, dtype=np.int32) for x in batch.column(2).to_pylist()]
            truth += batch.column(1).to_pylist()
        weight, bias = ftrl(examples, truth) if examples else (np.zeros(1), 0.0)
        some = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1], pa.int32()), pa.array([*weight[some].tolist(), bias])], names=["at", "w"])

    sparse_rows = rows.mapInArrow(tidy(sparse), "h long, y double, x binary")
    learned = sparse_rows.repartition(1).sortWithinPartitions("h", "x").mapInArrow(tidy(learn_all), "at int, w double").collect()
    weights = {r["at"]: r["w"] for r in learned}
    bias = weights.pop(-1, 0.0)
    return ToxicityModel(np.array(list(weights), dtype=np.int64), np.array(list(weights.values())), bias)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None) -> DataFrame:
    """(id, score) for every row of ``docs``. Only the text is read for a score."""
    return fit_toxicity(docs, labels, id_col, text_col, label_col, learn).score_documents(docs, id_col, text_col)
