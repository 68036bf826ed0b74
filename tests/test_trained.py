"""Trained models: counts and products beside brute force, the decomposition beside numpy's, rankings on rows held out."""

import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.operators import trained as L
from corvane.operators.vectors import cosine_top_k
from corvane.plans import queries as search


def test_cooccurrences_are_those_of_brute_force(spark):
    r = np.random.RandomState(3)
    names = [f"w{i}" for i in range(12)]
    texts = [[names[i] for i in r.randint(0, 12, r.randint(0, 40))] for _ in range(50)] + [[], None]
    words = names[:9]  # three words are unknown, and still take a place
    want = Counter()
    for t in texts:
        for i, x in enumerate(t or []):
            for d in range(1, 4):
                if i + d < len(t) and x in words and t[i + d] in words:
                    want[tuple(sorted((words.index(x), words.index(t[i + d]))))] += 4 - d
    rows = spark.createDataFrame([(t,) for t in texts], "t array<string>").repartition(4)
    assert {(x.a, x.b): x.n for x in L.cooccurrences(rows, words, 3).collect()} == dict(want)


def test_tasks_of_many_tokens_bound_their_memory():
    r = np.random.RandomState(5)
    words = [f"w{i}" for i in range(20_000)]
    one = pa.array([words[i] for i in r.randint(0, 20_000, 1_500_000)])  # a long text and short ones
    lists = pa.ListArray.from_arrays(pa.array([0, 600_000, *range(600_300, 1_500_001, 300)], pa.int32()), one)
    tracemalloc.start()
    try:
        total = sum(sum(x.column(2).to_pylist()) for x in L.near_pairs(iter([pa.RecordBatch.from_arrays([lists], names=["t"])]), words, 5))
        vectors = L.text_vectors(lists, pa.array(words), r.rand(20_000, 64).astype(np.float32))
        assert tracemalloc.get_traced_memory()[1] < 350e6
    finally:
        tracemalloc.stop()
    assert total == sum((len(x) - d) * (6 - d) for x in lists for d in range(1, 6))
    assert np.allclose(np.linalg.norm(vectors.flatten().to_numpy().reshape(-1, 64), axis=1), 1, atol=1e-5)


def test_products_and_vectors_are_those_of_the_whole_matrix(spark):
    r = np.random.RandomState(4)
    m = np.triu((r.rand(40, 40) < 0.2) * r.rand(40, 40))
    m = m + m.T
    cells = spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(*np.nonzero(m), strict=True)], "a int, b int, value double").repartition(5)
    right = r.rand(40, 6)
    assert np.allclose(L._product(cells, right), m @ right)
    texts = [" ".join(f"{t}{i}" for i in r.randint(0, 6, 30)) for t in ("apple", "berry") for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate([*texts, "", None, "unseen"])), "doc_id long, text string")
    model = L.WordVectors.fit(docs, dimensions=8, vocabulary=50)
    assert sorted(model.words) == sorted(f"{t}{i}" for t in ("apple", "berry") for i in range(6)) and model.vectors.shape == (12, 8)
    tokens = [t.split() for t in texts]
    n = np.zeros((12, 12))
    for t in tokens:
        ids = [model.words.index(x) for x in t]
        for d in range(1, L.NEAR + 1):
            for a, b in zip(ids, ids[d:], strict=False):
                n[a, b] += L.NEAR + 1 - d
                n[b, a] += (L.NEAR + 1 - d) * (a != b)
    with np.errstate(divide="ignore"):
        ppmi = np.maximum(0, np.log(n * n.sum() / np.outer(n.sum(1), n.sum(1))))
    values, turn = np.linalg.eigh(ppmi)
    best = np.argsort(-np.abs(values))[:8]
    want = turn[:, best] * np.sqrt(np.abs(values[best]))
    share = np.array([sum(t.count(w) for t in tokens) for w in model.words]) / sum(map(len, tokens))
    middle = (L.COMMON / (L.COMMON + share) * share) @ want
    want -= np.outer(want @ middle, middle) / (middle @ middle)
    assert np.allclose(model.vectors @ model.vectors.T, want @ want.T, atol=1e-4)  # signs of columns are free
    rows = {x.doc_id: x.embedding for x in model.vector(docs).collect()}
    assert rows[80] == rows[81] == rows[82] == [0.0] * 8 and np.linalg.norm(rows[0]) == pytest.approx(1, abs=1e-5)
    near = cosine_top_k(model.vector(docs.where("doc_id in (0, 40)")).withColumnRenamed("doc_id", "query_id"), model.vector(docs), 30).collect()
    assert all((x.doc_id < 40) == (x.query_id < 40) for x in near)


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "once")], "doc_id long, text string")
    model = L.WordVectors.fit(docs, dimensions=4)
    assert model.words == [] and {tuple(x.embedding) for x in model.vector(docs).collect()} == {(0.0,) * 4}


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, rank int, score double, query string, content string, query_vector array<double>, doc_vector array<double>")


def test_features(spark):
    rows = [(1, 5, 1, 4.0, "red apple pie", "pie red apple", [1.0, 0.0], [1.0, 0.0]), (1, 6, 2, 2.0, "red apple pie", None, [1.0, 0.0], None), (2, 5, 1, 0.0, "", "", None, None)]
    got = {(x.query_id, x.doc_id): x.f for x in L.pair_features(hits(spark, rows)).collect()}
    assert got[1, 5] == pytest.approx([1, 1, 1, 1, 0.5, np.log(4), 1]) and got[1, 6] == pytest.approx([0.5, 0.5, 0, 0, 0, 0, 0])
    assert got[2, 5] == pytest.approx([0, 1, 0, 0, 0, 0, 0])


def test_the_ranker_learns_what_orders_hits(spark):
    """Grades follow the fifth feature; the rank says nothing. Queries that it hasn't seen are in order."""
    r = np.random.RandomState(6)
    f = r.rand(60, 10, 7)
    rows = [(q, d, d + 1, f[q, d].tolist()) for q in range(60) for d in range(10)]
    features = spark.createDataFrame(rows, "query_id long, doc_id long, rank int, f array<double>")
    qrels = spark.createDataFrame([(q, int(d), 3.0 - k) for q in range(60) for k, d in enumerate(np.argsort(-f[q, :, 4])[:2])], "query_id long, doc_id long, grade double")
    ranker = L.PairRanker.fit(features.where("query_id < 30"), qrels)
    w = np.array(ranker.weights)
    assert np.argmax(w) == 4 and w[4] > 5 * np.abs(np.delete(w, 4)).max()
    first = ranker.ranked(features.where("query_id >= 30"), 1).collect()
    assert len(first) == 30 and np.mean([x.doc_id == np.argmax(f[x.query_id, :, 4]) for x in first]) > 0.8
    # the slope of the penalised loss is zero where it ends
    d = np.array([(f[q, a] - f[q, b]) / f[:30].reshape(-1, 7).std(axis=0) for q in range(30) for ga, a in enumerate(np.argsort(-f[q, :, 4])) for gb, b in enumerate(np.argsort(-f[q, :, 4])) if ga < min(gb, 2)])
    scaled = w * f[:30].reshape(-1, 7).std(axis=0)
    assert np.abs((d / (1 + np.exp(d @ scaled))[:, None]).sum(axis=0) - scaled).max() < 0.05
    same = features.withColumn("f", F.array_repeat(F.lit(1.0), 7))
    assert [x["rank"] for x in L.PairRanker.fit(same, qrels).ranked(same).where("query_id = 0").orderBy("doc_id").collect()] == list(range(1, 11))
    assert L.PairRanker.fit(features, qrels.limit(0)).weights == (0.0,) * 7


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables here")
def test_better_than_bm25_on_items_held_out(spark):
    got = {x.ranking: x for x in search.learned_ranking(spark, "/root/testdata/sf0.01").collect()}
    assert got["learned"].queries == got["bm25"].queries > 5
    assert got["learned"].ndcg > got["bm25"].ndcg + 0.03
    near = search.text_neighbours(spark, "/root/testdata/sf0.01").collect()
    assert len(near) == 10 and sum(x.own == x.lang for x in near) >= 8
