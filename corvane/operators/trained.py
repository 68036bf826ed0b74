"""Models that the library trains itself: word vectors from co-occurrence counts, and a ranker learned from judgements.

Both learn in Spark from whole tables.  What the driver holds is bounded by
the vocabulary (``vocabulary`` x dimensions numbers) or by the number of
features; it never grows with the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import let, terms
from corvane.operators.vectors import cosine
from corvane.scratch import written

#: Commonest words that get a vector, their least occurrences, numbers in a vector, and words to each side that count as near.
VOCABULARY, LEAST, DIMENSIONS, NEAR = 20_000, 2, 64, 5
#: Tokens that a task works on at once, and pairs that it keeps to be added up.
SLICE, PENDING = 65_536, 2_000_000
#: Columns beyond the wanted ones, and multiplications that sharpen them, in the randomised decomposition.
SPARE, ROUNDS = 8, 2
#: Words much commoner than this share of all words count less in a text's vector.
COMMON = 1e-3
FEATURES = ["lexical", "lexical_rank", "dense", "covered", "adjacent", "length", "density"]


# --- word vectors -----------------------------------------------------------------------------------------------
def _merged(pending: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes, each once and in order, with the sums of their weights."""
    codes = np.concatenate([x for x, _ in pending])
    weights = np.concatenate([x for _, x in pending])
    found, at = np.unique(codes, return_inverse=True)
    return found, np.bincount(at, weights, len(found)).astype(np.int64)


def near_pairs(batches: Iterator[pa.RecordBatch], words: list[str], near: int) -> Iterator[pa.RecordBatch]:
    """What one task sends of its arrays of tokens: (a, b, n), a pair once or a few times.

    Tokens are taken SLICE at a time, and at most PENDING pairs are kept to be
    added up, so memory grows with neither the task nor the length of a text.
    """
    size, index = len(words), pa.array(words, pa.string())

    def sent(found: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found // size, pa.int32()), pa.array(found % size, pa.int32()), pa.array(n)], names=["a", "b", "n"])

    pending: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for batch in batches:
        flat, ids, text = numbered(batch.column(0), index)
        for start in range(0, len(flat), SLICE):
            for d in range(1, near + 1):
                a, b = ids[start : max(start, min(start + SLICE, len(ids) - d))], ids[start + d : start + d + SLICE]
                both = (a >= 0) & (b >= 0) & (text[start : start + len(a)] == text[start + d : start + d + len(b)])
                a, b = a[both].astype(np.int64), b[both].astype(np.int64)
                pending.append((np.minimum(a, b) * size + np.maximum(a, b), np.full(len(a), near + 1 - d)))
                held += len(a)
            if held > PENDING:
                pending = [_merged(pending)]
                held = len(pending[0][0])
                if held > PENDING // 2:
                    yield sent(*pending[0])
                    pending, held = [], 0
    if held:
        yield sent(*_merged(pending))


def numbered(lists: pa.Array, index: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The strings of ``lists`` one after the other, their places in ``index`` (-1: none), and the numbers of their lists."""
    flat = lists.flatten()
    ids = np.full(len(flat), -1, np.int32)
    for start in range(0, len(flat), SLICE):
        ids[start : start + SLICE] = pa.compute.fill_null(pa.compute.index_in(flat.slice(start, SLICE), value_set=index), -1).to_numpy(zero_copy_only=False)
    return flat, ids, np.repeat(np.arange(len(lists), dtype=np.int32), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))


def text_vectors(lists: pa.Array, index: pa.Array, weighted: np.ndarray) -> pa.Array:
    """The sums of the rows of ``weighted`` for the words of each list, at length 1; SLICE tokens at a time."""
    width = weighted.shape[1]
    out = np.zeros((len(lists), width), np.float32)
    _, ids, text = numbered(lists, index)
    for start in range(0, len(ids), SLICE):
        some = np.flatnonzero(ids[start : start + SLICE] >= 0) + start
        if len(some):
            rows, first = np.unique(text[some], return_index=True)
            out[rows] += np.add.reduceat(weighted[ids[some]], first, axis=0)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (len(out) + 1) * width, width), pa.int32()), pa.array(out.ravel(), pa.float32()))


def cooccurrences(tokens: DataFrame, words: list[str], near: int = NEAR) -> DataFrame:
    """(a, b, n), a <= b: how near and how often words number a and b stand in the arrays of ``tokens``.

    Words at a distance of d count near + 1 - d.  Tasks add up what they can
    before anything is shuffled, so rows that meet are pairs of words: at most
    half the square of the vocabulary, whatever the number of documents.
    """
    known = tokens.sparkSession.sparkContext.broadcast(words)
    return tokens.mapInArrow(lambda batches: near_pairs(batches, known.value, near), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _product(cells: DataFrame, right: np.ndarray) -> np.ndarray:
    """A sparse symmetric matrix (a, b, value) times a matrix with a row for each word."""
    width = right.shape[1]
    shared = cells.sparkSession.sparkContext.broadcast(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = np.zeros_like(shared.value), np.zeros(len(shared.value), dtype=bool)
        for batch in batches:
            a, b, value = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.argsort(a, kind="stable")
            for start in range(0, len(order), 65_536):  # bounds the gathered rows
                some = order[start : start + 65_536]
                rows, first = np.unique(a[some], return_index=True)
                out[rows] += np.add.reduceat(value[some, None] * shared.value[b[some]], first, axis=0)
                seen[rows] = True
        rows = np.flatnonzero(seen)
        for start in range(0, len(rows), 4096):
            some = rows[start : start + 4096]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(some) + 1) * width, width), pa.int32()), pa.array(out[some].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), flat], names=["a", "v"])

    parts = cells.mapInArrow(run, "a int, v array<double>")
    summed = parts.groupBy("a").agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(width)]).alias("v"))
    table, out = summed.toArrow(), np.zeros_like(right)
    if table.num_rows:
        out[table["a"].to_numpy()] = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    shared.unpersist()
    return out


@dataclass(frozen=True)
class WordVectors:
    """Words, their vectors, and what a word counts in a text."""

    words: list[str]
    vectors: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(docs: DataFrame, text_col: str = "text", dimensions: int = DIMENSIONS, vocabulary: int = VOCABULARY, near: int = NEAR, least: int = LEAST, seed: int = 7) -> WordVectors:
        """Vectors whose products approximate the positive pointwise mutual information of words, over all documents.

        The matrix stays in Spark.  A randomised decomposition multiplies it
        with ROUNDS + 2 thin matrices and solves what is left, a square of
        ``dimensions`` + SPARE, in the driver.  Null and empty texts add
        nothing; without any word that occurs ``least`` times there are no
        vectors.
        """
        tokens = written(docs.select(terms(F.col(text_col)).alias("t")).where(F.size("t") > 0), "tokens", 4)
        counted = tokens.select(F.explode("t").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        top = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(vocabulary).collect()
        words = [r.word for r in top]
        width = min(dimensions + SPARE, len(words))
        if not words:
            return WordVectors([], np.zeros((0, dimensions), np.float32), np.zeros(0))
        share = np.array([r.n for r in top], dtype=np.float64) / sum(r.n for r in top)
        pairs = written(cooccurrences(tokens, words, near), "pairs")
        both = pairs.unionByName(pairs.where("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
        sums = np.zeros(len(words))
        for r in both.groupBy("a").agg(F.sum("n").alias("n")).collect():  # a row for each word
            sums[r.a] = r.n
        margin = docs.sparkSession.createDataFrame(pd.DataFrame({"w": np.arange(len(words), dtype=np.int32), "s": sums}))
        of = lambda c: F.broadcast(margin.select(F.col("w").alias(c), F.col("s").alias(f"s_{c}")))  # noqa: E731  the vocabulary bounds it
        value = F.log(F.col("n") * float(sums.sum()) / (F.col("s_a") * F.col("s_b")))
        cells = written(both.join(of("a"), "a").join(of("b"), "b").select("a", "b", value.alias("value")).where("value > 0"), "cells")
        q = np.random.RandomState(seed).standard_normal((len(words), width))
        for _ in range(ROUNDS + 1):
            q = np.linalg.qr(_product(cells, q))[0]
        strength, turn = np.linalg.eigh(q.T @ _product(cells, q))
        best = np.argsort(-np.abs(strength), kind="stable")[:dimensions]
        found = np.zeros((len(words), dimensions))
        found[:, : len(best)] = (q @ turn[:, best]) * np.sqrt(np.abs(strength[best]))
        weights = COMMON / (COMMON + share)
        middle = (weights * share) @ found  # what all texts have in common tells none apart
        size = np.linalg.norm(middle)
        if size > 1e-12:
            found -= np.outer(found @ (middle / size), middle / size)
        return WordVectors(words, found.astype(np.float32), weights)

    def vector(self, docs: DataFrame, text_col: str = "text", vector_col: str = "embedding") -> DataFrame:
        """``docs`` with the vector of a text: the weighted mean of its words' vectors at length 1, zeros where none is known. A null text counts as empty."""
        shared = docs.sparkSession.sparkContext.broadcast((self.words, self.vectors * self.weights[:, None].astype(np.float32)))

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def means(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            words, weighted = shared.value
            index = pa.array(words, pa.string())
            for lists in batches:
                yield text_vectors(lists, index, weighted)

        return docs.withColumn(vector_col, means(terms(F.coalesce(F.col(text_col), F.lit("")))))

    def encoder(self, text_col: str = "query"):
        """What a search engine takes to make vectors of queries."""
        return lambda queries: self.vector(queries, text_col).select("query_id", "embedding")


# --- ranking ----------------------------------------------------------------------------------------------------
def pair_features(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank, f): what the ranker sees of a hit, as many numbers as FEATURES.

    ``hits``: query_id, doc_id, rank, score, query, content, query_vector,
    doc_vector; null texts count as empty, null vectors as unlike everything.
    """
    both = F.col("query_vector").isNotNull() & F.col("doc_vector").isNotNull()
    lists = hits.select("query_id", "doc_id", "rank", "score", F.array_distinct(terms(F.coalesce("query", F.lit("")))).alias("q"), terms(F.coalesce("query", F.lit(""))).alias("asked"), terms(F.coalesce("content", F.lit(""))).alias("t"), F.when(both, cosine(F.col("query_vector"), F.col("doc_vector"))).otherwise(0.0).alias("dense"))
    pairs = lambda words: F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    two = lambda words: let(pairs(words), lambda p: F.array_distinct(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))))
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    own = Window.partitionBy("query_id")
    asked_pairs, known = two(F.col("asked")), F.col("q")
    values = [
        share(F.col("score"), F.max("score").over(own)),
        1.0 / F.col("rank"),
        F.col("dense"),
        share(F.size(F.array_intersect("q", "t")), F.size("q")),
        share(F.size(F.array_intersect(asked_pairs, two(F.col("t")))), F.size(asked_pairs)),
        F.log1p(F.size("t").cast("double")),
        share(F.size(F.filter("t", lambda w: F.array_contains(known, w))), F.size("t")),
    ]
    return lists.select("query_id", "doc_id", "rank", F.array(*[v.cast("double") for v in values]).alias("f"))


@dataclass(frozen=True)
class PairRanker:
    """Weights of features; a greater sum is a better hit."""

    weights: tuple[float, ...]

    @staticmethod
    def fit(features: DataFrame, qrels: DataFrame, penalty: float = 1.0, rounds: int = 12) -> PairRanker:
        """Logistic regression on pairs of hits of one query with different grades (hits without a judgement have grade 0).

        A query has at most the square of its list's length in pairs.  Newton
        steps: each is one aggregation of a gradient and a Hessian, halved
        while the loss doesn't fall.  Without any pair all weights are 0.
        """
        size = len(FEATURES)
        graded = features.join(qrels.select("query_id", "doc_id", F.col("grade").cast("double").alias("grade")), ["query_id", "doc_id"], "left").select("query_id", "f", F.coalesce("grade", F.lit(0.0)).alias("grade"))
        graded = written(graded, "graded")
        at = lambda c, i: F.get(c, F.lit(i))
        spread = graded.agg(*[F.stddev_pop(at("f", i)).alias(f"s{i}") for i in range(size)]).first()
        scale = np.array([x if x and x > 1e-9 else 1.0 for x in spread])
        good = graded.select("query_id", F.col("f").alias("x"), F.col("grade").alias("gx"))
        bad = graded.select("query_id", F.col("f").alias("y"), F.col("grade").alias("gy"))
        steps = F.array(*[(at("x", i) - at("y", i)) / float(scale[i]) for i in range(size)])
        pairs = written(good.join(bad, "query_id").where("gx > gy").select(steps.alias("d")), "preferences")
        if not pairs.limit(1).count():
            return PairRanker((0.0,) * size)

        def state(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            z = sum((at("d", i) * float(w[i]) for i in range(size)), F.lit(0.0))
            p = 1.0 / (1.0 + F.exp(z))  # the probability of the wrong order
            loss = F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
            upper = [(i, j) for i in range(size) for j in range(i, size)]
            seen = pairs.select("d", p.alias("p"), loss.alias("loss")).agg(F.sum("loss"), *[F.sum(F.col("p") * at("d", i)) for i in range(size)], *[F.sum(F.col("p") * (1 - F.col("p")) * at("d", i) * at("d", j)) for i, j in upper]).first()
            hessian = np.zeros((size, size))
            for (i, j), x in zip(upper, seen[1 + size :], strict=True):
                hessian[i, j] = hessian[j, i] = x
            return seen[0] + penalty / 2 * w @ w, np.array(seen[1 : 1 + size]) - penalty * w, hessian + penalty * np.eye(size)

        w = np.zeros(size)
        loss, slope, curve = state(w)
        for _ in range(rounds):
            step = np.linalg.solve(curve, slope)
            for _ in range(6):
                after = state(w + step)
                if after[0] <= loss:
                    break
                step /= 2
            if loss - after[0] < 1e-6 * max(1.0, abs(loss)):
                break
            w, (loss, slope, curve) = w + step, after
        return PairRanker(tuple(float(x) for x in w / scale))

    def score(self, f: Column) -> Column:
        return sum((F.get(f, F.lit(i)) * w for i, w in enumerate(self.weights)), F.lit(0.0))

    def ranked(self, features: DataFrame, top_k: int | None = None) -> DataFrame:
        """(query_id, doc_id, rank, score): the hits in the order of the ranker, equal ones in their old order."""
        scored = features.select("query_id", "doc_id", F.col("rank").alias("_before"), F.round(self.score(F.col("f")), 9).alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "_before")
        out = scored.withColumn("rank", F.row_number().over(best)).select("query_id", "doc_id", "rank", "score")
        return out if top_k is None else out.where(F.col("rank") <= top_k)
