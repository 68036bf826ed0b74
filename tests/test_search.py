"""Index, ranking, fusion, metrics, chunks, and whole search plans."""

import json
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from corvane import cli
from corvane.operators import containment as C
from corvane.operators import lexical as X
from corvane.operators import models as M
from corvane.operators import vectors as V
from corvane.operators.chunks import chunk_documents, chunk_windows, sections
from corvane.operators.fusion import lexical_overlap, reciprocal_rank_fusion, relative_score_fusion, rerank
from corvane.operators.lexical import bm25, build_index, query_terms, suggestions
from corvane.operators.metrics import markdown_table, metric_means, retrieval_metrics, upper_latency
from corvane.operators.pivots import PivotIndex
from corvane.operators.segments import StoredIndex
from corvane.operators.vectors import best_pairs, cosine, cosine_top_k, mean_pooled, normalised
from corvane.plans.responses import respond, route
from corvane.plans.search import SearchEngine, Telemetry, evaluate, instant_answers, rank_web, with_snippets
from corvane.sources.evaluation import evaluation_set

CORPUS = [(1, "The quick brown fox jumps over the lazy dog", "fox"), (2, "Solar panel fields use mirror arrays for solar heating", "solar"), (3, "Cooking pasta takes boiling water", "pasta"), (4, "", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, "doc_id long, content string, title string")


def ask(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")


def hits(index, spark, query, **settings):
    return bm25(index, query_terms(ask(spark, query), "query_id", "query"), **settings).orderBy("rank").collect()


def test_bm25_scores_by_the_formula(spark, docs):
    index = build_index(docs, text_col="content")
    got = hits(index, spark, "solar panel solar", explain=True)
    assert [g.doc_id for g in got] == [2] and got[0].matched_terms == ["panel", "solar"]
    stats = index.corpus_stats.first()
    assert (stats.n_docs, stats.total_terms) == (4, 19) and stats.avg_doc_len == 4.75
    idf = math.log(1 + 3.5 / 1.5)
    norm = 1.5 * (0.25 + 0.75 * 8 / 4.75)
    want = {"solar": idf * 2 * 2.5 / (2 + norm), "panel": idf * 2.5 / (1 + norm)}
    assert got[0].term_contributions == {k: round(v, 4) for k, v in want.items()} and got[0].score == round(sum(want.values()), 4)
    assert hits(index, spark, "") == [] and hits(index, spark, "nowhere") == []


def test_bm25_tf_length_ties_and_removal(spark):
    rows = [(1, "apple pear"), (2, "apple apple apple pear"), (3, "plum " * 3), (4, "apple " + "filler " * 40), (6, "kiwi one"), (5, "kiwi two")]
    index = build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [h.doc_id for h in hits(index, spark, "apple")] == [2, 1, 4]
    assert [h.doc_id for h in hits(index, spark, "kiwi")] == [5, 6]
    assert [h.doc_id for h in hits(index, spark, "apple", top_k=1)] == [2]
    less = index.without(spark.createDataFrame([(2,)], "doc_id long"))
    assert [h.doc_id for h in hits(less, spark, "apple")] == [1, 4]
    more = less.plus(build_index(spark.createDataFrame([(1, "grape"), (9, "apple")], "doc_id long, text string")))
    assert [h.doc_id for h in hits(more, spark, "apple")] == [9, 4]


def test_index_positions_save_and_suggest(spark, docs, tmp_path):
    index = build_index(docs, text_col="content")
    row = index.postings.where("term = 'solar'").first()
    assert (row.term_freq, row.positions, row.doc_len) == (2, [0, 6], 8)
    index.save(str(tmp_path / "index"), buckets=3)
    again = StoredIndex.load(spark, str(tmp_path / "index"))
    assert sorted(r.doc_id for r in again.doc_ids.collect()) == [1, 2, 3, 4] and again.cleared().postings.count() == again.cleared().doc_ids.count() == 0
    assert [h.doc_id for h in hits(again, spark, "fox")] == [1]
    assert [r.term for r in suggestions(again, "so").collect()] == ["solar"] and suggestions(again, " ").count() == 0


def test_cosine(spark):
    rows = [(1, [2.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [0.9, 0.1, 0.0, 0.0]), (4, [0.0, 0.0, 0.0, 0.0]), (5, None)]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(7, [1.0, 0.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    got = cosine_top_k(queries, vectors, 2).orderBy("rank").collect()
    assert [(g.query_id, g.doc_id, g.rank, g.score) for g in got] == [(7, 1, 1, 1.0), (7, 3, 2, 0.9939)]
    assert cosine_top_k(queries, vectors, 50).count() == 4
    assert cosine_top_k(queries.limit(0), vectors, 5).count() == 0
    with pytest.raises(PythonException, match="different sizes"):
        cosine_top_k(queries, vectors.where("doc_id < 3").union(spark.createDataFrame([(9, [1.0])], vectors.schema)), 2).collect()
    pair = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0])], "a array<double>, b array<double>")
    row = pair.select(cosine(F.col("a"), F.col("b")).alias("c"), normalised(F.col("a")).alias("n")).first()
    assert row.c == pytest.approx(1.0) and row.n == [0.6, 0.8]
    pooled = spark.createDataFrame([([[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [1.0, 1.0, 0.0])], "t array<array<double>>, m array<double>")
    assert pooled.select(mean_pooled(F.col("t"), F.col("m")).alias("p")).first().p == pytest.approx([0.6, 0.8])


def test_cosine_tasks_of_many_queries_bound_their_memory():
    r = np.random.RandomState(8)
    rows, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (r.standard_normal((10_000, 16)), r.standard_normal((3000, 16))))
    rows[5000:5050] = rows[:50]  # ties
    tracemalloc.start()
    try:
        query, ids, scores = best_pairs(iter([(np.arange(7000), rows[:7000]), (np.arange(7000, 10_000), rows[7000:])]), q, 3)
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()
    assert len(query) == 9000
    for i in (0, 7, 2999):
        exact = np.round(rows @ q[i], 9)
        want = np.lexsort((np.arange(10_000), -exact))[:3]
        assert ids[query == i].tolist() == want.tolist() and np.array_equal(scores[query == i], exact[want])


def test_cosine_in_blocks_and_batches(spark, monkeypatch):
    """Many query blocks, many Arrow batches in a task, and ties: the same as one multiplication."""
    r = np.random.RandomState(4)
    rows = r.randint(-2, 3, (700, 3)).astype(float)  # many equal directions
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "doc_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(i, rows[i].tolist()) for i in range(40)], "query_id long, embedding array<double>")
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    unit = np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)
    scores = np.round(unit[:40] @ unit.T, 9)
    want = {(q, int(d), k + 1) for q in range(40) for k, d in enumerate(np.lexsort((np.arange(700), -scores[q]))[:6])}
    monkeypatch.setattr(V, "QUERY_BLOCK", 9)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert {(g.query_id, g.doc_id, g["rank"]) for g in cosine_top_k(queries, vectors, 6).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_bm25_in_blocks_and_from_buckets(spark, monkeypatch, tmp_path):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["apple", "pear", "plum", "kiwi", f"w{r.randint(0, 60)}"]) for _ in range(r.randint(0, 30)))) for i in range(200)]
    index = build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    asked = ask(spark, *[" ".join(r.choice(["apple", "plum", f"w{k}"]) for _ in range(4)) for k in range(30)])
    terms = query_terms(asked, "query_id", "query").cache()
    plain = sorted(map(tuple, bm25(index, terms, 7).collect()))
    stored = index.save(str(tmp_path / "index"), buckets=3)
    assert sorted(map(tuple, bm25(stored, terms, 7).collect())) == plain
    plan = bm25(stored, terms, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(query_id") == 1 and "hashpartitioning(query_id#" in plan and "doc_id" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    monkeypatch.setattr(X, "BLOCK_TERMS", 20)
    assert sorted(map(tuple, bm25(stored, terms, 7).collect())) == plain


@pytest.mark.parametrize(("phrase_bytes", "scans"), [(1 << 20, 4), (100, 1000), (1, 0)])
def test_documents_holding(spark, monkeypatch, phrase_bytes, scans):
    """One automaton, many, and joins of windows."""
    monkeypatch.setattr(C, "PHRASE_BYTES", phrase_bytes)
    monkeypatch.setattr(C, "MOST_SCANS", scans)
    r = random.Random(5)
    texts = [" ".join(r.choice("ab") * r.randint(1, 2) for _ in range(r.randint(0, 40))) + r.choice(["", "\n", " é"]) for _ in range(60)] + [None, "", "ab"]
    items = [t[a : a + n] for t in texts[:40] for a, n in [(r.randint(0, 10), r.randint(0, 30))]] + ["", "a", "b a", None, "no such text at all, ever, in any of them"]
    monkeypatch.setattr(C, "BLOCK_ITEMS", 7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = C.documents_holding(docs, spark.createDataFrame(list(enumerate(items)), "query_id long, text string")).collect()
    assert sorted((g.doc_id, g.query_id) for g in got) == [(i, k) for i, t in enumerate(texts) for k, x in enumerate(items) if t is not None and x is not None and x in t]
    long = C.documents_holding(docs, spark.createDataFrame([(1, texts[3][2:])], "query_id long, text string"))
    assert long.count() == sum(t is not None and texts[3][2:] in t for t in texts)
    assert C.documents_holding(docs, docs.limit(0).withColumnRenamed("doc_id", "query_id")).count() == 0


def _list(spark, *rows):
    return spark.createDataFrame([(1, d, s, i + 1) for i, (d, s) in enumerate(rows)], "query_id long, doc_id long, score double, rank int")


def test_fusion(spark):
    a, b = _list(spark, (1, 9.0), (2, 5.0), (3, 1.0)), _list(spark, (2, 0.9), (4, 0.1))
    got = reciprocal_rank_fusion(a, b).orderBy("rank").collect()
    assert [(g.doc_id, g.score) for g in got] == [(2, round(0.5 / 62 + 0.5 / 61, 5)), (1, round(0.5 / 61, 5)), (4, round(0.5 / 62, 5)), (3, round(0.5 / 63, 5))]
    assert (got[0].bm25_rank, got[0].dense_rank, got[1].dense_rank) == (2, 1, None)
    swapped = reciprocal_rank_fusion(b, a).orderBy("rank").collect()
    assert [g.doc_id for g in swapped] == [g.doc_id for g in got]
    relative = relative_score_fusion(a, b).orderBy("rank").collect()
    assert [(g.doc_id, g.score) for g in relative] == [(2, 0.75), (1, 0.5), (3, 0.0), (4, 0.0)]
    assert [(g.doc_id, g.score) for g in relative_score_fusion(_list(spark, (1, 2.0)), b.limit(0)).collect()] == [(1, 0.5)]


def test_rerank_keeps_ties_in_order(spark):
    df = spark.createDataFrame([(1, 5, 1, "fox", "no"), (1, 6, 2, "fox", "a fox"), (1, 7, 3, "fox", "nothing")], "query_id long, doc_id long, rank int, query string, content string")
    assert [r.doc_id for r in rerank(df, lexical_overlap).orderBy("rank").collect()] == [6, 5, 7]
    assert [r.doc_id for r in rerank(df, None, top_k=2).orderBy("rank").collect()] == [5, 6]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 11, 3.0), (1, 13, 1.0), (1, 12, 0.0), (3, 5, 1.0)], "query_id long, doc_id long, grade double")
    got = {r.query_id: r for r in retrieval_metrics(ranked, qrels, 2).collect()}
    assert set(got) == {1, 3}
    assert got[1].ndcg == round((7 / math.log2(3)) / (7 + 1 / math.log2(3)), 4)
    assert (got[1].reciprocal_rank, got[1].precision, got[1].recall) == (0.5, 0.5, 0.5)
    assert (got[3].ndcg, got[3].reciprocal_rank, got[3].precision, got[3].recall) == (0.0, 0.0, 0.0, 0.0)
    perfect = retrieval_metrics(spark.createDataFrame([(1, 11, 1), (1, 13, 2)], ranked.schema), qrels, 2).where("query_id = 1").first()
    assert perfect.ndcg == 1.0
    assert metric_means(retrieval_metrics(ranked, qrels, 2)).first().queries == 2
    six = spark.createDataFrame([(i % 2, float(i)) for i in (3, 1, 6, 2, 5, 4)] + [(0, None)], "k int, v double")
    assert upper_latency(six, "v").first().v == 6.0 and {(r.k, r.v) for r in upper_latency(six, "v", ["k"], 0.5).collect()} == {(0, 4.0), (1, 3.0)}
    hundred = spark.range(1, 101).select(F.floor((F.col("id") + 1) / 2).cast("double").alias("v"))  # every value twice
    assert upper_latency(hundred, "v").first().v == 48.0
    ordered = markdown_table(spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "s string, n long").orderBy(F.desc("n")), ["s"]).collect()
    assert [r.line for r in ordered] == ["| s |", "|---|", "| c |", "| b |", "| a |"]
    assert [r.line for r in markdown_table(spark.createDataFrame([("a", 1)], "s string, n long"), ["s", "n"]).collect()] == ["| s | n |", "|---|---|", "| a | 1 |"]


def test_windows_cover_every_word(spark):
    rows = [(n, " ".join(f"w{i}" for i in range(n))) for n in (0, 1, 300, 301, 560, 589, 590, 1000)] + [(5000, None)]
    chunks = chunk_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {n: sorted((c.chunk_index, c.token_count) for c in chunks if c.doc_id == n) for n, _ in rows}
    assert by[0] == [] and by[5000] == [] and by[1] == [(0, 1)] and by[300] == [(0, 300)] and by[301] == [(0, 300), (1, 41)]
    assert by[560] == [(0, 300), (1, 300), (2, 40)] and by[1000] == [(0, 300), (1, 300), (2, 300), (3, 220)]
    assert {w for c in chunks if c.doc_id == 1000 for w in c.content.split()} == set(rows[7][1].split())


MARKDOWN = """intro words here
# One
alpha beta
## Two
```
# not a heading
```
gamma
# Three
delta
"""


def test_chunks_carry_their_headings(spark):
    df = spark.createDataFrame([(1, MARKDOWN, "guide.md"), (2, "", "x"), (3, None, None)], "doc_id long, text string, title string")
    got = chunk_documents(df, title_col="title").orderBy("chunk_index").collect()
    assert [(c.headings, c.start_line, c.end_line) for c in got] == [(["guide.md"], 1, 1), (["One"], 2, 3), (["One", "Two"], 4, 8), (["Three"], 9, 10)]
    assert got[0].content == "guide.md\n\nintro words here" and got[2].content.endswith("gamma") and got[1].token_count == 4
    bare = chunk_documents(df.where("doc_id = 1")).orderBy("chunk_index").collect()
    assert [c.headings for c in bare] == [[], ["One"], ["One", "Two"], ["One", "Three"]]
    long = spark.createDataFrame([(1, "# H\n" + "w " * 100)], "doc_id long, text string")
    assert [c.token_count for c in chunk_documents(long, most=50, least=10, overlap=40).orderBy("chunk_index").collect()][:2] == [50, 50]


def test_headings_of_every_depth_like_a_plain_stack(spark):
    r = random.Random(9)
    rows = []
    for i in range(30):
        lines = ["start"] + [("#" * r.randint(1, 6) + f" h{k}") if r.random() < 0.6 else f"text {k}" for k in range(r.randint(0, 40))]
        rows.append((i, "\n".join(lines), r.choice([None, "", "T"])))
    got = {(s.doc_id, s.start_line): s.headings for s in sections(spark.createDataFrame(rows, "doc_id long, text string, title string"), title_col="title").collect()}
    want = {}
    for i, text, title in rows:
        stack, less = ([title], 1) if title else ([], 0)
        want[i, 1] = list(stack)
        for n, line in enumerate(text.split("\n")[1:], 2):
            if line.startswith("#"):
                stack = [*stack[: max(len(line.split()[0]) - less, 0)], line.split()[1]]
                want[i, n] = list(stack)
    assert got == want


def test_engine_modes(spark, docs):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "doc_id long, embedding array<double>")
    encode = lambda asked: asked.select("query_id", F.array(F.lit(0.0), F.lit(1.0)).alias("embedding"))
    engine = SearchEngine.of(docs, vectors, encode, lexical_overlap)
    asked = ask(spark, "solar panels", "fox")
    for mode in ("bm25", "dense", "hybrid", "relative"):
        got = engine.search(asked, mode, 2).where("query_id = 0").orderBy("rank").collect()
        assert got[0].doc_id == 2 and got[0].title == "solar" and got[0].provenance.mode == mode
    assert engine.without(spark.createDataFrame([(2,)], "doc_id long")).search(asked, "bm25", 2).where("query_id = 0").count() == 0
    assert engine.plus(spark.createDataFrame([(8, "fox fox fox")], "doc_id long, content string")).search(asked, "bm25", 1).where("query_id = 1").first().doc_id == 8
    stats = engine.stats().first()
    assert (stats.total_docs, stats.total_vectors, stats.vocabulary_size) == (4, 3, 18)
    assert '<mark class="highlight">fox</mark>' in with_snippets(engine.search(asked, "bm25", 1)).where("query_id = 1").first().snippet
    with pytest.raises(ValueError, match="mode"):
        engine.search(asked, "other")
    plain = SearchEngine.of(docs)
    assert plain.search(asked, "hybrid", 1).where("query_id = 1").first().doc_id == 1
    with pytest.raises(ValueError, match="dense"):
        plain.search(asked, "dense")
    qrels = spark.createDataFrame([(0, 2, 3.0), (1, 1, 3.0)], "query_id long, doc_id long, grade double")
    rows = evaluate(engine, asked, qrels).rows
    assert [r["strategy"] for r in rows] == ["bm25", "dense", "hybrid", "hybrid reranked"] and rows[0]["ndcg"] == 1.0
    (timed,) = evaluate(plain, asked, qrels, timed=True).rows
    assert timed["p95_latency_ms"] >= timed["mean_latency_ms"] > 0 and timed["precision_at_1"] == 1.0


def test_the_evaluation_set(spark):
    docs, queries, judged = evaluation_set(spark)
    rows = evaluate(SearchEngine.of(docs, scorer=lexical_overlap), queries, judged).rows
    assert (docs.count(), queries.count(), judged.count()) == (6, 6, 6) and rows[0]["queries"] == 6 and rows[0]["reciprocal_rank"] > 0.9


class FakeTokenizer:
    """Stands for a tokenizer: words are numbered by their length, cut and padded to four."""

    def encode_batch(self, texts):
        class Encoding:
            def __init__(self, text):
                words = (" ".join(text) if isinstance(text, tuple) else text).split()[:4]
                self.ids = [len(w) for w in words] + [0] * (4 - len(words))
                self.attention_mask = [1] * len(words) + [0] * (4 - len(words))
                self.type_ids = [0, 1, 1, 1]

        return [Encoding(t) for t in texts]


def fake_encoder():
    tokenizer = FakeTokenizer()

    def encode(texts):
        fed = M.model_inputs(tokenizer.encode_batch(texts), ["input_ids", "token_type_ids"], False)
        assert not fed["token_type_ids"].any()
        hidden = np.stack([fed["input_ids"], np.ones_like(fed["input_ids"])], axis=2).astype(np.float32)
        return M.pooled(hidden, fed["attention_mask"])

    return encode


def fake_scorer():
    return lambda pairs: np.array([float(len(set(q.split()) & set(t.split()))) for q, t in pairs])


def test_encoders_and_scorers_see_batches(spark, docs):
    many = fake_encoder()
    assert M.encode_batch(many, [], 7).shape == (0, 7) and M.predict(fake_scorer(), []) == []
    got = M.encode_batch(many, ["abc"] * 150 + ["ab abcd"])
    assert got.shape == (151, 2) and got.dtype == np.float32 and np.allclose(np.linalg.norm(got, axis=1), 1) and np.allclose(got[0], np.array([3, 1]) / 10**0.5)
    assert np.allclose(got[150], np.array([3, 1]) / 10**0.5)  # the mean of lengths 2 and 4, padding left out
    assert M.predict(fake_scorer(), [("a b", "b a"), ("a", "c")]) == [0.8808, 0.5]
    typed = M.model_inputs(FakeTokenizer().encode_batch([("a", "b")]), ["token_type_ids"], True)
    assert typed["token_type_ids"].tolist() == [[0, 1, 1, 1]]
    vectors = M.with_vectors(docs, fake_encoder, dimensions=2).select("doc_id", "embedding").where("doc_id < 4")
    engine = SearchEngine.of(docs, vectors, lambda asked: asked.select("query_id", M.encoder(fake_encoder, 2)(F.col("query")).alias("embedding")), M.scorer(fake_scorer))
    best = engine.search(ask(spark, "lazy dog fox"), "hybrid", 1).first()
    assert best.doc_id == 1 and best.score == round(1 / (1 + math.exp(-3)), 4)
    nulls = spark.createDataFrame([(None,), ("a",)], "x string").select(M.encoder(fake_encoder, 2)(F.col("x")).alias("v")).collect()
    assert nulls[0].v is None and len(nulls[1].v) == 2


def test_requests_go_where_they_belong(spark, docs):
    assert [route(*x) for x in (("images", "local"), ("local", "web"), ("all", "local"), ("tech", "hybrid"), ("news",))] == ["images", "local", "local", "all", "news"]
    engine = SearchEngine.of(docs, scorer=lexical_overlap)
    got = {r.query_id: json.loads(r.response) for r in respond(ask(spark, " fox ", "  "), "local", "web", 2, engine=engine).collect()}
    assert got[0]["query"] == "fox" and got[0]["category"] == "local" and got[0]["mode"] == "hybrid" and got[0]["total_hits"] == 1
    assert got[0]["hits"][0]["type"] == "local" and got[0]["hits"][0]["title"] == "fox" and '<mark class="highlight">fox</mark>' in got[0]["hits"][0]["snippet"]
    assert got[1] == {"query": "", "category": "local", "mode": "hybrid", "total_hits": 0, "hits": [], "instant_answer": None, "ads_blocked_count": 0, "trackers_purged_count": 0}
    with pytest.raises(ValueError, match="engine"):
        respond(ask(spark, "x"), "local")
    pages = spark.createDataFrame([(0, 'm="{&quot;murl&quot;:&quot;https://i.org/a.png&quot;}"', "q")], "query_id long, html string, query string")
    (image,) = respond(ask(spark, "q"), "images", sources={"images": pages}).collect()
    assert json.loads(image.response)["hits"][0]["image_url"] == "https://i.org/a.png" and json.loads(image.response)["trackers_purged_count"] == 1
    web = spark.createDataFrame([(0, '<li class="b_algo"><h2><a href="https://e.org/?utm_source=x">A fox</a></h2><p>the fox</p></li>')], "query_id long, html string")
    (answer,) = respond(ask(spark, "fox 2+2"), sources={"web": web}).collect()
    read = json.loads(answer.response)
    assert read["total_hits"] == 1 and read["hits"][0]["url"] == "https://e.org/" and read["trackers_purged_count"] == 1 and read["hits"][0]["snippet"] == 'the <mark class="highlight">fox</mark>'


def test_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("the quick fox\n")
    store = ["--store", str(tmp_path / "store")]
    assert cli.main([*store, "index", str(tmp_path / "in")]).count() == 1
    assert cli.main([*store, "search", "fox"]).first().title == "a.md"
    assert [r.term for r in cli.main([*store, "suggest", "qu"]).collect()] == ["quick"]
    assert cli.main([*store, "stats"]).first().total_chunks == 1
    spark.createDataFrame([(0, "fox")], "query_id long, query string").write.parquet(str(tmp_path / "q"))
    spark.createDataFrame([(0, 0, 1.0)], "query_id long, doc_id long, grade double").write.parquet(str(tmp_path / "r"))
    assert cli.main([*store, "evaluate", str(tmp_path / "q"), str(tmp_path / "r")]).first().ndcg == 1.0
    assert "indexed_files" in capsys.readouterr().out


def test_web_ranking_pins_the_direct_card(spark):
    schema = "query_id long, position int, title string, url string, display_url string, domain string, snippet string, trackers int, blocked boolean"
    results = spark.createDataFrame([(0, 0, "t", "u", "d", "d", "nothing", 0, False), (0, 1, "t", "u2", "d", "d", "a fox", 0, False), (0, 2, "t", "u3", "d", "d", "fox", 0, True)], schema)
    direct = results.where("position = 0").select("query_id", "title", F.lit("home").alias("url"), "display_url", "domain", "snippet")
    got = rank_web(results, ask(spark, "fox"), direct).orderBy("rank").collect()
    assert [g.url for g in got] == ["home", "u2", "u"]
    assert [g.url for g in rank_web(results, ask(spark, "fox"), scorer=None).orderBy("rank").collect()] == ["u", "u2"]
    answers = {r.query_id: r for r in instant_answers(ask(spark, "2+2", "fox"), direct.withColumn("query_id", F.lit(1))).collect()}
    assert answers[0].title == "4" and answers[0].source == "Instant Math" and answers[1].kind == "website"


def test_upper_latency_narrows_large_groups(spark):
    """Groups over the window's size, with ties, one value, nulls, and a null key."""
    rng = random.Random(3)
    rows = [("many", rng.random() ** 9 * 1e6) for _ in range(6000)] + [("ties", float(rng.randint(0, 3))) for _ in range(3000)] + [("one", 5.0)] * 2000 + [(None, float(i)) for i in range(1500)] + [("few", 1.0), ("few", None), ("few", float("nan"))]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(4)
    for share in (0.0, 0.5, 0.95, 1.0):
        want = {}
        for k in {k for k, _ in rows}:
            own = sorted(v for q, v in rows if q == k and v is not None and v == v)
            want[k] = own[min(len(own) - 1, int(len(own) * share))]
        assert {r.k: r.v for r in upper_latency(frame, "v", ["k"], share, window_values=100).collect()} == want
    assert upper_latency(frame.limit(0), "v", ["k"]).count() == 0


def test_pivots_skip_and_lose_nothing(spark):
    """Clustered vectors with a hot cluster, ties, zero and null vectors; a zero query: the rows of a full scan, most pairs skipped."""
    r = np.random.RandomState(7)
    middle = r.randn(30, 16) * 3
    rows = [(i, (middle[i % 30 if i % 3 else 0] + 0.25 * r.randn(16)).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[i][1]) for i in range(20)] + [(4000, [0.0] * 16), (4001, None)]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(i, rows[i * 37][1]) for i in range(40)] + [(50, [0.0] * 16), (51, None), (52, (-middle[3]).tolist())], "query_id long, embedding array<double>")
    report = {}
    index = PivotIndex.build(vectors)
    order = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "rank", "score").collect()))
    assert order(index.search(queries, 5, report=report)) == order(cosine_top_k(queries, vectors, 5))
    assert report["pairs"] < 0.25 * report["all"]
    assert order(index.search(queries, 4000)) == order(cosine_top_k(queries, vectors, 4000))
    assert index.search(queries.limit(0), 5).count() == 0 and PivotIndex.build(vectors.limit(0)).search(queries, 5).count() == 0
    assert PivotIndex.build(vectors.where("doc_id = 4000")).search(queries, 5).count() == 42


def test_completions_of_many_prefixes(spark):
    r = random.Random(11)
    vocabulary = [("".join(r.choice("abé") for _ in range(r.randint(1, 12))), r.randint(1, 5)) for _ in range(800)]
    vocabulary = list(dict(vocabulary).items())
    known = spark.createDataFrame(vocabulary, "term string, df long")
    asked = ["a", "ab", "AB ", "b" * 5, "abab", "é", "zz", "", " ", None, "aabbaabbab", *[t for t, _ in vocabulary[:30]], *[t + "a" for t, _ in vocabulary[:10]]]
    frame = spark.createDataFrame(list(enumerate(asked)), "rank long, prefix string").withColumnRenamed("rank", "id")
    table = X.completions(known, 3, 6)
    assert table.groupBy("prefix").count().where("count > 3").count() == 0
    got = sorted((g.id, g["rank"], g.term, g.df) for g in X.completed(table, frame, known, top_k=3, longest=6).collect())
    want = []
    for i, prefix in enumerate(asked):
        clean = (prefix or "").strip(" ").lower()
        own = sorted(((-n, t) for t, n in vocabulary if clean and t.startswith(clean)))[:3]
        want += [(i, k + 1, t, -n) for k, (n, t) in enumerate(own)]
    assert got == sorted(want)


def test_telemetry_of_the_stages(spark, docs):
    """Rows and times of every stage, noted by the one action; the same hits as without."""
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "doc_id long, embedding array<double>")
    engine = SearchEngine.of(docs, vectors, lambda asked: asked.select("query_id", F.array(F.lit(0.0), F.lit(1.0)).alias("embedding")), lexical_overlap)
    noted = Telemetry()
    asked = ask(spark, "solar panel", "fox")
    plain = sorted(map(str, engine.search(asked, "hybrid", 2).collect()))
    assert sorted(map(str, engine.search(asked, "hybrid", 2, telemetry=noted).collect())) == plain
    seen = noted.provenance()
    assert {k: v["rows"] for k, v in seen.items()} == {"lexical": 2, "dense": 6, "fusion": 6, "reranking": 4}
    assert all(0 <= v["first_ms"] <= v["last_ms"] for v in seen.values()) and seen["lexical"]["first_ms"] <= seen["reranking"]["last_ms"]
    assert {r.stage for r in noted.table(spark).collect()} == set(seen)
    empty = Telemetry()
    assert engine.search(asked.limit(0), "bm25", 2, reranked=False, telemetry=empty).count() == 0
