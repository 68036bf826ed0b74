"""The registered queries beside their SQL, and the pipeline's stages beside plain Python, on the smallest tables."""

import math
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from corvane.llm import queries
from tests.llm.test_join import components
from tests.llm.test_models import plain_hits
from tests.llm.test_native import _line_dedup_plain

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")


def plain(x):
    if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(float(x), 6) if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else str(x)


def rows(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_beside_its_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, str(SMALL)).toPandas(), duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", ["op4_toxicity", "op7_quality"])
def test_scores_have_every_row(spark, duck, name):
    got = queries.QUERIES[name](spark, str(SMALL)).toPandas()
    assert sorted(got.doc_id) == [i for (i,) in duck.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]
    assert got.score.between(0, 1).all() and set(got.predicted) <= {0, 1} and got.held_out.any() and not got.held_out.all()


LARGE = Path("/root/testdata/sf0.1")


def area(scored):
    """The area under the ROC curve of (score, label), ties counted half."""
    good, bad = [s for s, y in scored if y], [s for s, y in scored if not y]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


@pytest.mark.skipif(not LARGE.exists(), reason="no test tables here")
@pytest.mark.parametrize(("name", "label", "accuracy"), [("op4_toxicity", "toxic", 0.97), ("op7_quality", "quality", 0.98)])
def test_held_out_rows_of_the_tables(spark, name, label, accuracy):
    """Rows whose labels were not learned from: some 800 of 3,980."""
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect() if r[label] is not None}
    held = [r for r in queries.QUERIES[name](spark, str(LARGE)).collect() if r.held_out and r.doc_id in truth]
    assert len(held) > 700 and area([(r.score, truth[r.doc_id]) for r in held]) > 0.97
    assert sum(r.predicted == truth[r.doc_id] for r in held) > accuracy * len(held)


def article(source):
    """The blocks of the article element, read with the standard parser."""
    from html.parser import HTMLParser

    blocks, depth, piece = [], 0, []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            nonlocal depth
            if tag in ("article", "h1", "p", "br"):
                blocks.append("".join(piece))
                piece.clear()
            depth += tag == "article"

        def handle_endtag(self, tag):
            nonlocal depth
            if tag in ("article", "h1", "p"):
                blocks.append("".join(piece))
                piece.clear()
            depth -= tag == "article"

        def handle_data(self, data):
            if depth:
                piece.append(data)

    Reader().feed(source)
    return " ".join(" ".join(b.split()) for b in blocks if b.strip())


def test_main_texts_are_the_articles(spark, duck):
    got = {r.page_id: r for r in queries.QUERIES["op8_main_text"](spark, str(SMALL)).collect()}
    want = {i: article(source) for i, source in duck.execute("SELECT page_id, html FROM pages").fetchall()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) > 0 for r in got.values())


#: Licence lines that the documents hold, and the family of each.
LICENCES = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl", "All rights reserved.": "unknown", "Released under the MIT License.": "mit",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache-2.0",
}


def test_licences_of_the_documents(spark, duck):
    got = {r.doc_id: r for r in queries.QUERIES["op10_license_scan"](spark, str(SMALL)).collect()}
    for i, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        lines = (text or "").split("\n")
        found = [LICENCES[x.strip()] for x in lines if x.strip() in LICENCES]
        assert (got[i].n_paragraphs, got[i].n_licenses, got[i].families) == (len(lines), len(found), ",".join(sorted(set(found))))


def test_pipeline_stages_beside_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near_duplicates", "contamination", "mix"]
    before = {r.doc_id: r for r in docs.collect()}
    kept = stages["quality"](spark, docs, str(SMALL))
    good = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and len(ids & good) >= 0.9 * len(good)  # 87 labels to learn from
    assert all(r == before[r.doc_id] for r in kept.collect())
    source = [(r.doc_id, r.text) for r in docs.collect()]
    lines = stages["lines"](spark, docs, str(SMALL))
    assert sorted((r.doc_id, r.text) for r in lines.collect()) == [(i, t) for i, _, _, t in _line_dedup_plain(source)]
    assert lines.columns == docs.columns and all(r.n_chars == len(r.text) for r in lines.collect())
    near = stages["near_duplicates"](spark, docs, str(SMALL))
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(components(source, 5, 80, 100).values()))
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r.doc_id: r.text for r in stages["contamination"](spark, docs, str(SMALL)).collect()}
    for i, t in source:
        hit = plain_hits(t, items)[1]
        assert (clean[i] == t) == (hit == 0)
    assert sum(clean[i] != t for i, t in source) > 0
    mixed = stages["mix"](spark, docs, str(SMALL))
    assert mixed.columns == [*docs.columns, "repeats"]
    taken = {r.doc_id: r.taken // r.size for r in queries.QUERIES["op5_mix_sources"](spark, str(SMALL)).collect() if r.taken}  # beside SQL above
    assert {r.doc_id: r.repeats for r in mixed.collect()} == taken


def test_pipeline_runs_all_stages(spark):
    out = corpus_pipeline.run(spark, str(SMALL))
    assert out.columns == [*corpus_pipeline.COLUMNS, "repeats"]
    assert 0 < out.count() < 200 and out.where("repeats < 1 or repeats > 2").count() == 0
