"""Decontamination, classifiers, extraction and scans: brute force, round trips and held-out accuracy."""

import html
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import decontamination as D
from corvane.llm import html_extraction as H
from corvane.llm import license_scan as L
from corvane.llm.fm_index import FMIndex, suffix_array
from corvane.llm.html_blocks import parse
from corvane.llm.quality import N_STATISTICS, fit_quality, pooled, quality_filter, quality_scores, statistics, statistics_table
from corvane.llm.toxicity import fit_toxicity, ftrl, toxicity_scores


def test_suffix_array_and_search_like_brute_force():
    r = np.random.RandomState(3)
    for size, words in ((1, 1), (40, 2), (300, 3), (2000, 30)):
        seq = r.randint(0, words + 1, size)
        seq[r.randint(0, size, 3)] = 0
        seq = np.append(np.tile(seq, 2), 0)
        gaps = np.cumsum(seq == 0)
        spelled = [tuple((0, gaps[k]) if seq[k] == 0 else (1, seq[k]) for k in range(i, len(seq))) for i in range(len(seq))]
        if size <= 300:
            assert suffix_array(seq).tolist() == sorted(range(len(seq)), key=lambda i: spelled[i])
        index = FMIndex(seq, words, sample_every=5)
        for length in (1, 2, 4):
            patterns = r.randint(1, words + 1, (30, length))
            found = {int(p): sorted(index.locate(np.arange(a, b)).tolist()) for p, a, b in zip(*index.search(patterns), strict=True)}
            for p, pattern in enumerate(patterns):
                want = [i for i in range(len(seq) - length + 1) if (seq[i : i + length] == pattern).all()]
                assert found.get(p, []) == want


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(text, items, window=10):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words, hit, names = WORD.findall(lower(text)), set(), set()
    for name, item in items:
        w = WORD.findall(lower(item))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[k : k + n]:
                    hit |= set(range(i, i + n))
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


def test_decontamination_like_brute_force(spark, monkeypatch):
    r = random.Random(6)
    made = lambda k: [r.choice("abc") + r.choice(["", "é", "1", "B"]) for _ in range(k)]
    items = [(i, " ".join(made(r.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(90, None), (91, " -- "), (None, "zz")]
    docs = []
    for i in range(60):
        text = made(r.randint(0, 40))
        if r.random() < 0.6:
            text += r.choice(items[:12])[1].upper().split() + made(5)
        docs.append((i, r.choice([" ", ", ", "\n"]).join(text)))
    docs += [(60, None), (61, ""), (62, items[5][1]), (62, items[5][1])]
    monkeypatch.setattr(D, "SHARD_WORDS", 50)  # many shards, and documents cut by them
    monkeypatch.setattr(D, "BLOCK_BYTES", 60)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit("old"))
    got = D.decontaminate(df.coalesce(2), spark.createDataFrame(items, "item_id long, text string"), rewrite=False).collect()
    assert len(got) == len(docs)
    want = {i: plain_hits(t, [x for x in items if x[0] is not None]) for i, t in docs}
    assert {g.doc_id: (g.n_words, g.n_hit, g["items"]) for g in got} == want
    assert all(sum(s.last - s.first + 1 for s in g.spans) == g.n_hit for g in got)


def test_decontamination_cuts_spans(spark):
    passage = " ".join(f"word{i}" for i in range(14))
    docs = spark.createDataFrame([(1, f"Before É. {passage.upper()}! after"), (2, "clean"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in D.decontaminate(docs, spark.createDataFrame([(5, passage)], "item_id long, text string")).collect()}
    assert (got[1].text, got[1].n_hit, got[1]["items"]) == ("Before É. ! after", 14, ["5"])
    assert got[2].text == "clean" and got[3].text is None and got[3].n_words == 0
    assert D.decontaminate(docs.limit(0), docs.limit(0), item_id="doc_id").count() == 0


def made_documents(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(r.choice("bcdfgl") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(20, 120))]
        good, toxic = r.random() < 0.7, r.random() < 0.2
        if toxic:
            for _ in range(r.randint(2, 5)):
                words.insert(r.randrange(len(words)), r.choice(["vile", "grumbler", "Rotter"]))
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, int(good), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def made(spark):
    rows = made_documents(1200, 1)
    extra = [(5000, None), (5001, ""), (5002, "x " * 20000), (None, "no id")]
    docs = spark.createDataFrame([r[:2] for r in rows] + extra, "doc_id long, text string").withColumn("score", F.lit(9)).withColumn("id", F.lit("x"))
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(None, 1, 1), (7777, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: (q, t) for i, _, q, t in rows}


def test_quality_on_held_out_rows(made):
    docs, labels, truth = made
    got = quality_scores(docs, labels, learn=F.col("doc_id") % 4 != 2).collect()
    assert len(got) == 1204 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id in truth and r.doc_id % 4 == 2]
    assert sum((r.score >= 0.7) == bool(truth[r.doc_id][0]) for r in held) > 0.97 * len(held)
    kept = quality_filter(docs, labels)
    assert kept.columns == docs.columns and 700 < kept.count() < 1000


def test_quality_without_labels_or_rows(made):
    docs, labels, _ = made
    assert {r.score for r in quality_scores(docs.limit(3), labels.limit(0)).collect()} == {0.5}
    assert quality_scores(docs.limit(0), labels).count() == 0
    one_class = labels.where("quality = 1")
    assert all(r.score > 0.9 for r in quality_scores(docs.where("doc_id < 50"), one_class).collect())


def test_statistics_do_not_depend_on_neighbours():
    texts = [None, "", "A b!", "é\nx y x", "| a | b |", "THE END"]
    whole = statistics(pa.array(texts))
    assert whole.shape == (6, N_STATISTICS) and not whole[:2].any()
    for i, t in enumerate(texts):
        assert np.allclose(statistics(pa.array([t], pa.string()))[0], whole[i])


def test_pooled_means_rise():
    got = pooled(np.array([1.0, 1, 2, 1]), np.array([1.0, 0, 1, 1]))
    assert got.tolist() == [0.5, 0.5, 0.5, 1.0]


def test_model_is_fitted_on_all_partitions(spark, made):
    docs, labels, _ = made
    table = statistics_table(docs, "doc_id", "text")
    a, b = fit_quality(table.repartition(7), labels), fit_quality(table.coalesce(1), labels)
    assert np.allclose(a.weights, b.weights, atol=1e-6)


def test_toxicity_on_held_out_rows(made):
    docs, labels, truth = made
    got = toxicity_scores(docs, labels, learn=F.col("doc_id") % 5 != 0).collect()
    assert len(got) == 1204 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id in truth and r.doc_id % 5 == 0]
    assert sum((r.score >= 0.5) == bool(truth[r.doc_id][1]) for r in held) > 0.97 * len(held)
    model = fit_toxicity(docs, labels)
    assert len(model.index) < 2000
    again = fit_toxicity(docs.repartition(6), labels)
    assert sorted(model.index) == sorted(again.index) and model.bias == again.bias


def test_toxicity_without_labels(made):
    docs, labels, _ = made
    assert {r.score for r in toxicity_scores(docs.limit(3), labels.limit(0)).collect()} == {0.5}
    assert toxicity_scores(docs.limit(0), labels).count() == 0


def test_ftrl_leaves_noise_at_zero():
    r = np.random.RandomState(0)
    examples = [np.unique(np.append(r.randint(100, 20000, 60), [5] if i % 4 == 0 else [])).astype(np.int64) for i in range(800)]
    weights, bias = ftrl(examples, [float(i % 4 == 0) for i in range(800)])
    assert weights[5] > 1 and bias < 0 and np.count_nonzero(weights) < 3000


def test_blocks_of_unruly_markup():
    page = parse("<body><p>a<p>b <b>c</b>d<br>e<li>x<li>y &amp; z<div>t<!-- no --><script>var a='</p>'</script>u</div><style>s</style> &lt;k&gt; <a href='/?a>b'>l</a> 1 < 2")
    assert [b.text for b in page.blocks] == ["a", "b cd", "e", "x", "y & z", "t", "u", "<k> l 1 < 2"]
    assert parse("").blocks == [] and parse("<p>open <b").blocks[0].text == "open"
    assert [b.text for b in parse("<head><title>T</title></head>body&nbsp; text").blocks] == ["body text"]


@pytest.fixture(scope="module")
def crf():
    return H.trained_model()


def test_extraction_on_pages_that_were_not_seen(crf):
    maker = H._Maker(4321)
    wrong = total = 0
    for _ in range(150):
        page, labels = H.labelled_page(maker.page())
        got = crf.decode([crf.emissions(page)])[0]
        wrong += int((got != np.array(labels)).sum())
        total += len(labels)
    assert wrong < 0.02 * total


def test_viterbi_like_brute_force(crf):
    r = np.random.RandomState(2)
    scores = [r.normal(0, 2, n) for n in (0, 1, 2, 5, 8)]
    for emit, got in zip(scores, crf.decode(scores), strict=True):
        best = max(np.ndindex(*[2] * len(emit)), key=lambda y: (crf.start[y[0]] if len(y) else 0) + sum(e * k for e, k in zip(emit, y, strict=True)) + sum(crf.pair[a, b] for a, b in zip(y[:-1], y[1:], strict=True)))
        assert tuple(got) == tuple(best)


def test_extracted_text_is_whole(spark, crf):
    article = ["A headline of some words here.", "First &amp; long paragraph with quite a few words in it, and more.", "Second paragraph,\n  with   blanks and a <b>bold</b> word that goes on for a while."]
    page = f"<html><head><title>No</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy it now.</div><article><h1>{article[0]}</h1><p>{article[1]}</p><p>{article[2]}</p></article><div id='comments'><p>I disagree with all of this, says a reader.</p></div><footer>&copy; Us</footer></body></html>"
    rows = [(1, "u", page, "old"), (2, None, None, "old"), (3, "u", "", "old"), (1, "u", page, "old")]
    got = sorted(H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model=crf).collect(), key=lambda r: r.page_id)
    want = " ".join(" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in article)
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0)]
    assert H.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string"), model=crf).count() == 0


def classified(text):
    """(class, probability) of one paragraph."""
    _, found = L.trained_model().classify(pa.array([text]))
    return (L.CLASSES[found[0][2]], found[0][3]) if found else ("none", 1.0)


#: Sentences in wordings that no frame and no template has.
UNSEEN = {
    "This document is made available under the terms of the MIT licence.": "mit",
    "You can use and share this collection of recipes under CC BY-SA 4.0.": "cc-by-sa",
    "The font files in this folder come with the Apache License 2.0.": "apache-2.0",
    "Our code is open source (BSD 3-Clause License).": "bsd",
    "Everything here may be copied under the GNU General Public License, version 2.": "gpl",
    "Feel free to reuse these maps under the Creative Commons Attribution 4.0 International License.": "cc-by",
    "The parser falls under the Mozilla Public License, version 2.0.": "mpl",
    "For the scripts the GNU Affero General Public License, version 3 holds.": "agpl",
    "This plugin ships with the Eclipse Public License v1.0.": "epl",
    "The authors chose the GNU Lesser General Public License for this library.": "lgpl",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.": "isc",
    "We place this work into the public domain and give up all rights.": "public-domain",
    "Licensed under the terms of the Frobozz Community License, version 2.": "unknown",
    "This tool is distributed under the Grue Software License Agreement.": "unknown",
    "Made available under the Open Database License.": "unknown",
    "The train to the coast leaves at noon.": "none",
    "He renewed the license for his boat in the spring.": "none",
    "The new law was published under the old government.": "none",
}


def test_licences_in_wordings_that_were_not_seen():
    wrong = {text: (classified(text)[0], want) for text, want in UNSEEN.items() if classified(text)[0] != want}
    assert len(wrong) <= 2, wrong
    templates = {t for x in (*L.TEMPLATES.values(), L.FRAMES, L.UNKNOWN, L.NONE) for t in x}
    assert not templates & set(UNSEEN)


def test_licence_probabilities_are_honest_on_frames_and_names_that_were_not_seen():
    """Examples of held-out frames and names with another seed than the temperature was fitted on."""
    model, seen = L.trained_model(), L.examples(99, 40, held_out=True)
    at, of = model.known(*L.ngrams(pa.array([t for t, _ in seen]))[:2])
    z = model.logits(at, of, len(seen)) / model.temperature
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = p.argmax(axis=1) == np.array([c for _, c in seen])
    assert right.mean() > 0.78
    sure = p.max(axis=1)
    gaps = [abs(right[some].mean() - sure[some].mean()) * some.sum() for low in np.arange(0, 1, 0.1) if (some := (sure >= low) & (sure < low + 0.1 + (low > 0.85))).any()]
    assert sum(gaps) / len(seen) < 0.07  # expected calibration error


def test_license_scan(spark):
    rows = [(1, "intro\nReleased under the MIT License.\n\nmore"), (2, "plain words of a text\n"), (3, None), (4, ""), (5, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.\nReleased under the Artistic License 2.0."), (1, "intro\nReleased under the MIT License.\n\nmore")]
    got = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("licenses", F.lit(0))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and {k: r.n_paragraphs for k, r in by.items()} == {1: 4, 2: 2, 3: 1, 4: 1, 5: 3}
    assert [(x.paragraph, x.family, x.confirmed) for x in by[1].licenses] == [(1, "mit", True)]
    assert [(x.family, x.confirmed) for x in by[5].licenses] == [("cc-by-nc", True), ("apache-2.0", True), ("unknown", False)]
    assert by[2].licenses == by[3].licenses == by[4].licenses == []
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_paragraphs_of_a_column_are_those_of_its_rows():
    model = L.trained_model()
    texts = ["a\n\nb", "", None, "\n", "Released under the MIT License.\nx\n", "y"]
    lines, found = model.classify(pa.array(texts))
    assert lines.tolist() == [len((t or "").split("\n")) for t in texts]
    assert [(row, p) for row, p, *_ in found] == [(4, 0)]


ARTICLES = [
    ("<article><h1>T</h1><p>Text of ours: © mark. The river runs past the town and on to the sea, where it ends.</p></article>", "T Text of ours: © mark. The river runs past the town and on to the sea, where it ends."),
    ("<article><p>In 2020 25 30 people came, 45% of 100 in 1999.</p><p>©2020</p><p>Short</p><ul><li><a>linked item</a></li></ul></article>", "In 2020 25 30 people came, 45% of 100 in 1999. ©2020 Short linked item"),
    ("<p>Just text &eacute;</p>", "Just text é"),
    ("Bare words only", "Bare words only"),
    ("<html><body><nav><a href=x>Home</a></nav><article><p>Short one.</p></article><footer>© 2020 Us. All rights reserved.</footer></body></html>", "Short one."),
    ("<body><div class='content'><p>Copyright law says © is a sign.</p><p>© 2021 is how notices begin, and this paragraph goes on about them for quite a while, since it is part of the article and no notice at all.</p></div><div class=footer>&copy; Someone 2020</div></body>", "Copyright law says © is a sign. © 2021 is how notices begin, and this paragraph goes on about them for quite a while, since it is part of the article and no notice at all."),
    ("<div class='ad'>Buy now</div>", ""),
    ("<nav><ul><li><a>Home</a></li></ul></nav>", ""),
]


@pytest.mark.parametrize(("source", "text"), ARTICLES)
def test_articles_stay_whole(source, text):
    """Signs, figures, short lines and links in an article, and pages that are nothing but a text."""
    assert H.main_texts(H.trained_model(), [source]) == [text]


def test_the_quality_filter_keeps_rows_as_they_are(spark):
    """Null, empty and very long texts, repeated rows, clashing names, and no rows at all."""
    good, bad = "The old river ran past the town, and people walked beside it in the evening. ", "click here $$$ !!! buy now "
    rows = [(i, good * (1 + i % 4) if i % 2 else bad * (1 + i % 4), "a", 1) for i in range(120)]
    rows += [(200, good * 4000, "b", 2), (201, good * 3, "c", 3), (201, good * 3, "c", 3), (202, bad * 3, None, None), (202, bad * 3, None, None), (203, None, "d", 4), (204, "", "d", 4), (None, good * 3, "e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, stats int").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    got = [tuple(r) for r in quality_filter(docs, labels).collect()]
    assert set(got) <= set(rows) and quality_filter(docs.limit(0), labels).count() == 0
    for row in set(got):
        assert got.count(row) == rows.count(row)
    assert got.count(rows[121]) == 2 and got.count(rows[123]) == 0 and rows[-1] in got
    assert (rows[125] in got) == (rows[126] in got)
