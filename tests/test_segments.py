"""The stored index: top-k under upper bounds, segments, removed ids, merging, versions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.operators import segments as S
from corvane.operators.lexical import bm25, bm25_work, build_index, idf, query_terms
from corvane.operators.segments import StoredIndex


def _rows(seed, n, first=0):
    """Documents in which one word is everywhere, some are common, and most are rare."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    return [(first + i, "everywhere " * rng.randint(1, 3) + " ".join(words[min(int(rng.expovariate(0.02)), 399)] for _ in range(rng.randint(0, 60)))) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{min(int(rng.expovariate(0.02)), 420)}" for _ in range(rng.randint(1, 8))) + (" everywhere" if i % 2 else "")) for i in range(40)]
    return query_terms(spark.createDataFrame([*rows, (40, "everywhere"), (41, "nowhere"), (42, "")], "query_id long, text string"), stemming=False)


def _hits(index, asked, k):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in bm25(index, asked, k).collect())


def _index(spark, rows):
    return build_index(_frame(spark, rows), stemming=False, positions=False)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 8)


@pytest.mark.parametrize("k", [1, 7, 900])
def test_bounds_change_no_result(spark, asked, tmp_path, small_blocks, k):
    """The same hits as the plan that sums everything, for a term in every document too; a stored index reads less."""
    plain = _index(spark, _rows(3, 800))
    stored = plain.save(str(tmp_path / "index"), buckets=2)
    assert _hits(stored, asked, k) == _hits(plain, asked, k)
    work = {r.query_id: (r.postings, r.read) for r in bm25_work(stored, asked, k).collect()}
    df = {r.term: r.df for r in plain.vocabulary.collect()}
    held = {}
    for r in asked.collect():
        held[r.query_id] = held.get(r.query_id, 0) + df.get(r.term, 0)
    assert {q: n for q, (n, _) in work.items()} == {q: n for q, n in held.items() if n} and work[40][0] == 800
    assert all(read <= n for n, read in work.values())
    if k == 1:
        assert sum(read for _, read in work.values()) < 0.9 * sum(n for n, _ in work.values())


def test_scores_of_ties_and_explanations(spark, tmp_path):
    rows = [(i, "same words here") for i in range(50)] + [(50, "same"), (51, "")]
    plain = _index(spark, rows)
    stored = plain.save(str(tmp_path / "index"), buckets=3)
    question = query_terms(spark.createDataFrame([(1, "same words")], "query_id long, text string"), stemming=False)
    assert _hits(stored, question, 5) == _hits(plain, question, 5)
    why = lambda index: sorted((r.doc_id, tuple(r.matched_terms), tuple(sorted(r.term_contributions.items()))) for r in bm25(index, question, 5, explain=True).collect())
    assert why(stored) == why(plain) and len(why(stored)) == 5


def test_updates_beside_an_index_made_anew(spark, asked, tmp_path, small_blocks):
    """Documents replaced, added, removed, removed and added again: statistics, vocabulary, postings and hits."""
    rows = dict(_rows(3, 300))
    index = _index(spark, list(rows.items())).save(str(tmp_path / "index"), buckets=4)
    new = dict(_rows(4, 60, 280))
    gone = [5, 290, 291, 9999]
    back = {5: "w1 w2 everywhere", 1000: "w1"}
    for text, removed in ((new, []), ({}, gone), (back, [])):
        if removed:
            index = index.without(spark.createDataFrame([(i,) for i in removed], "doc_id long"))
            rows = {i: t for i, t in rows.items() if i not in removed}
        else:
            index = index.plus(_index(spark, list(text.items())))
            rows |= text
    anew = _index(spark, list(rows.items()))
    for made in (index, index.merged(), index.merged(100), index.commit()):
        assert made.corpus_stats.first() == anew.corpus_stats.first()
        order = lambda df: sorted(map(tuple, df.collect()))
        assert order(made.vocabulary.select("term", "df")) == order(anew.vocabulary.select("term", "df"))
        assert order(made.postings.select("term", "doc_id", "term_freq", "doc_len")) == order(anew.postings.select("term", "doc_id", "term_freq", "doc_len"))
        assert _hits(made, asked, 10) == _hits(anew, asked, 10)
    assert len(index.segments) == 3 and len(index.merged(100).segments) == 1 and index.merged(100).parts[0] != index.parts[0]
    assert index.without(_frame(spark, list(rows.items()))).doc_ids.count() == 0 and index.cleared().postings.count() == 0


def test_an_update_writes_only_its_own(spark, tmp_path):
    path = tmp_path / "index"
    index = _index(spark, _rows(3, 300)).save(str(path), buckets=4)
    before = {p: p.stat().st_mtime_ns for p in path.rglob("*") if p.is_file()}
    more = index.plus(_index(spark, [(7, "new words")])).without(spark.createDataFrame([(8,)], "doc_id long")).commit()
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    new = [p for p in path.rglob("*.parquet") if p not in before]
    assert {p.relative_to(path).parts[0] for p in new} == {"segments", "removed"}
    segment = next(p for p in (path / "segments").iterdir() if f"segments/{p.name}" == more.segments[1])
    assert len(list((segment / "rows").glob("*.parquet"))) == 1  # one bucket
    assert StoredIndex.load(spark, str(path)).parts == more.parts and StoredIndex.load(spark, str(path), 1).parts == index.parts


def test_no_posting_moves_before_the_top_k(spark, asked, tmp_path):
    """Of two segments: the rows are read as buckets and grouped without an exchange; of the other part only ids move."""
    index = _index(spark, _rows(3, 300)).save(str(tmp_path / "index"), buckets=4).plus(_index(spark, _rows(5, 40, 290)))
    weights = asked.select("query_id", "term", F.lit(1.0).alias("idf"))
    plan = index.best(weights, 20.0, 5, 1.5, 0.75)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if " Exchange" in line]
    assert "Bucketed: true" in plan and len(exchanges) >= 1
    for line in exchanges:
        assert "hashpartitioning(bucket" in line or "hashpartitioning(term" in line or "SinglePartition" in line
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "hashpartitioning(bucket" in line:  # below it stand the ids of the later part alone
            assert any("[doc_id#" in x and "FileScan" in x for x in lines[i : i + 4])


def test_two_writers_and_segments_that_were_merged(spark, tmp_path):
    path = str(tmp_path / "index")
    index = _index(spark, [(1, "one"), (2, "two")]).save(path)
    a, b = index.plus(_index(spark, [(3, "three")])), index.plus(_index(spark, [(2, "again")]))
    a.commit()
    both = b.commit()
    assert sorted(r.doc_id for r in both.doc_ids.collect()) == [1, 2, 3] and len(both.parts) == 3
    x, y = both.merged(100), both.merged(100)
    x.commit()
    with pytest.raises(RuntimeError, match="no longer there"):
        y.commit()
    assert len(StoredIndex.load(spark, path).parts) == 1


def test_an_index_is_made_of_one_row_of_each_document(spark):
    rows = [(1, "connect connected; connecting wires"), (2, None), (3, ""), (1, "wired connections wire"), (4, "the of"), (5, "Wires wires lone")]
    index = build_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.doc_len) for r in index.words.collect()) == [(1, 7), (2, 0), (3, 0), (4, 0), (5, 3)]
    stored = index.stored()
    want = {("connect", 1, 4, 7), ("wire", 1, 3, 7), ("wire", 5, 2, 3), ("lone", 5, 1, 3)}
    for made in (index, stored):
        got = made.postings.collect()
        assert {(r.term, r.doc_id, r.term_freq, r.doc_len) for r in got} == want
        assert sorted((r.term, r.positions) for r in got if r.doc_id == 5) == [("lone", [2]), ("wire", [0, 1])]
        assert sorted((r.doc_id, r.doc_len) for r in made.doc_stats.collect()) == [(1, 7), (2, 0), (3, 0), (4, 0), (5, 3)]


@pytest.mark.parametrize("k", [1, 3, 64])
@pytest.mark.parametrize("tiles", [(1024, 4096, 1 << 20), (7, 128, 50)])
def test_many_queries_are_answered_together(spark, tmp_path, monkeypatch, k, tiles):
    """A bucket with copies, removed and empty documents: the hits of every query alone, without a call for each."""
    for name, value in zip(("TILE_QUERIES", "TILE_DOCUMENTS", "ADDED"), tiles, strict=True):
        monkeypatch.setattr(S, name, value)
    rng = random.Random(6)
    rows = _rows(3, 500)
    rows += [(500 + i, text) for i, (_, text) in enumerate(rows[:90])] + [(600 + i, rows[7][1]) for i in range(100)] + [(800, "")]
    index = _index(spark, rows).save(str(tmp_path / "index"), buckets=1)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.02)), 420)}" for _ in range(rng.randint(1, 8))) + (" everywhere" if i % 2 else "") for i in range(97)]
    terms = query_terms(spark.createDataFrame([*enumerate(texts), (97, "everywhere"), (98, "nowhere"), (99, rows[7][1])], "query_id long, text string"), stemming=False)
    n, average = index.corpus_stats.select("n_docs", "avg_doc_len").first()
    weights = terms.join(index.vocabulary, "term").select("query_id", "term", idf(F.col("df"), F.lit(n)).alias("idf")).where("idf > 0").toArrow()
    asked, held = S.Asked.of(weights, average, 1.5, 0.75), index._rows(index.segments[0])
    bucket_rows = held.where(F.col("term").isin("", *weights.column("term").to_pylist())).toArrow()
    dead = pa.table({"doc_id": pa.array([7, 11, 603], pa.int64())})
    bucket = S.Bucket(bucket_rows, dead.column("doc_id").to_numpy(), asked)
    alone = [(asked.ids[q].as_py(), d, v) for q in range(len(asked.ids)) for d, v in zip(*bucket.best(q, k)[:2], strict=True)]
    calls = []
    monkeypatch.setattr(S.Bucket, "best", lambda *_: calls.append(1))
    shared = type("Shared", (), {"value": asked})
    found = S._searched(shared, k, False)(bucket_rows, dead).to_pylist()
    assert not calls
    totals = {(r["query_id"], r["doc_id"]): r["total"] for r in found}
    assert len(found) == len(totals) and totals == pytest.approx({(q, d): v for q, d, v in alone}, abs=2e-9)
    assert not {7, 11, 603} & {r["doc_id"] for r in found}


def test_a_bucket_for_each_core_is_enough(spark, tmp_path):
    """What every query costs in a bucket, however small it is, doesn't grow with the shuffle partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        index = _index(spark, [(i, "one word") for i in range(64 * 256)]).save(str(tmp_path / "index"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert index._layouts[index.segments[0]]["buckets"] <= 2 * spark.sparkContext.defaultParallelism
