"""Cases that every operator and stage must bear: nulls, ties, repeats, clashing names, empty tables, very long texts."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import decontamination as D
from corvane.llm import ngram_join as J
from corvane.llm.exact_dedup import exact_dedup, kept_documents
from corvane.llm.html_blocks import parse
from corvane.llm.html_extraction import extract_main_text
from corvane.llm.license_scan import scan_licenses
from corvane.llm.line_dedup import line_dedup
from corvane.llm.mixing import mix_to_targets, mixed_documents, source_targets
from corvane.llm.quality import quality_filter, quality_scores
from corvane.llm.toxicity import fit_toxicity, toxicity_scores

ROOT = Path(__file__).resolve().parents[2]
SMALL = Path("/root/testdata/sf0.001")
#: Names that some operator uses inside, in more than one case.
NAMES = "_id _ID id h y at tag key fp row _row part place source_ _source _whole _last _text _html _gone _changed _tag text_ paragraphs rep n one two u v leader block tokens h_ stats score kept component_id repeated _slot _block _bitmap".split()
LINE = "a line that is long enough to count for all"


def crowded(docs):
    """The documents with a column of every name that may clash."""
    for i, name in enumerate(dict.fromkeys(x.lower() for x in NAMES)):
        if name not in [c.lower() for c in docs.columns]:
            docs = docs.withColumn(name if i % 2 else name.upper(), F.lit(i))
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{LINE}\nwords of their own {i} and {i * 7}\nshared words stand here too", "en", f"s{i % 3}", 5) for i in range(30)]
    rows += [(30, None, None, None, None), (31, "", "en", "s1", 0), (None, "null id", "en", "s1", 7), (None, None, None, None, None), (3, rows[3][1], "en", "s0", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(30)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "shared words stand here too"), (None, "x"), (2, None), (3, "")], "item_id long, text string")


OPERATORS = {
    "line_dedup": lambda d, labels, items: line_dedup(d),
    "exact_dedup": lambda d, labels, items: exact_dedup(d),
    "decontaminate": lambda d, labels, items: D.decontaminate(d, items),
    "toxicity": lambda d, labels, items: toxicity_scores(d, labels),
    "mix": lambda d, labels, items: mix_to_targets(d),
    "mixed": lambda d, labels, items: mixed_documents(d),
    "ngram": lambda d, labels, items: J.ngram_components(d),
    "one_of_each": lambda d, labels, items: J.one_of_each(d),
    "quality": lambda d, labels, items: quality_scores(d, labels),
    "quality_filter": lambda d, labels, items: quality_filter(d, labels),
    "html": lambda d, labels, items: extract_main_text(d, "text"),
    "licenses": lambda d, labels, items: scan_licenses(d),
    "kept": lambda d, labels, items: kept_documents(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_names_change_nothing(docs, labels, items, name):
    run = OPERATORS[name]
    plain, full = run(docs, labels, items), run(crowded(docs), labels, items)
    shared = [c for c in plain.columns if c in full.columns]
    assert shared == plain.columns or {c.lower() for c in plain.columns} <= {c.lower() for c in full.columns}
    order = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*plain.columns).collect())))
    assert order(plain) == order(full)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables_give_empty_results(docs, labels, items, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0), items.limit(0)).count() == 0


def test_very_long_texts(spark, labels, items):
    """Texts of 200,000 words, of one line of a megabyte, of 50,000 lines, and of one long word."""
    words = " ".join(f"w{i % 5000} x{i}" for i in range(100_000))
    lines = "\n".join(LINE if i % 2 else f"own line number {i} of the long text" for i in range(50_000))
    rows = [(1, words), (2, words + " more"), (3, lines), (4, "y" * 1_000_000), (5, LINE), (6, LINE), (7, "Released under the MIT License.\n" + "z\n" * 30_000 + "shared words stand here too")]
    long = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    dropped = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup(long).collect()}
    assert dropped[3] == (50_000, 25_000) and dropped[6] == (1, 0) and dropped[5] == (1, 1) and dropped[7][0] == 30_002
    linked = {r.doc_id: (r.n_shingles, r.component_id) for r in J.ngram_components(long).collect()}
    assert linked[1] == (199_996, 1) and linked[2] == (199_997, 1) and linked[6][1] == 5 and linked[4] == (1, 4)
    assert {r.doc_id: r.n_hit for r in D.decontaminate(long, items, rewrite=False).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 5}
    assert {r.doc_id: r.size for r in mix_to_targets(long).collect()}[1] == 200_000
    assert sorted((r.doc_id, r.group_size) for r in exact_dedup(long).collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 2), (7, 1)]
    found = {r.doc_id: (r.n_paragraphs, [(x.paragraph, x.family) for x in r.licenses]) for r in scan_licenses(long).collect()}
    assert found[7] == (30_002, [(0, "mit")]) and found[3] == (50_000, [])
    for scores in (toxicity_scores, quality_scores):
        assert all(0 <= r.score <= 1 for r in scores(long, labels).collect())


def test_long_and_broken_pages_take_time_in_proportion():
    n = 100_000
    for source in ("<div>x" * n, "<b>" * n + "<hr>" * n, "<div>" * n + "</span>" * n, "<li><ul>" + "<div>" * n + "<li></li>" * n, "<p>" + "<b>" * n + "x" + "<div>y" * n, "<!" * n, '<a "' * n, "<table><tr><td>" * n):
        parse(source)  # minutes, if any of these were quadratic
    assert [b.text for b in parse("<div class='a'>" * 3 + "x").blocks] == ["x"]
    assert parse("<div class='a'><p class='a'>x").names_above(1) == ["t:p", "t:div", "c:a"]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_bear_nulls_repeats_and_empty_tables(spark, docs, stage):
    if not SMALL.exists():
        pytest.skip("no test tables here")
    run = dict(corpus_pipeline.STAGES)[stage]
    columns = list(corpus_pipeline.COLUMNS) + (["repeats"] if stage == "mix" else [])
    for frame in (docs, docs.limit(0), crowded(docs)):
        out = run(spark, frame, str(SMALL))
        assert out.columns == columns
        n, ids = frame.count(), {r.doc_id for r in frame.select("doc_id").collect()}
        rows = out.collect()
        assert len(rows) <= n and {r.doc_id for r in rows} <= ids
        if stage in ("lines", "contamination"):
            assert len(rows) == n
        if stage in ("near_duplicates", "contamination", "mix"):
            assert all(r.text is None or r.doc_id is None or "words of their own" in r.text or r.text == "" for r in rows)


def test_decontamination_in_several_passes(spark, monkeypatch):
    """A benchmark that takes many passes gives what one pass does; no pass holds more than its bound."""
    rows = [(i, " ".join(f"t{(i * 3 + k) % 97}" for k in range(60))) for i in range(40)] + [(40, None), (41, "")]
    asked = [(i, " ".join(f"t{(i * 5 + k) % 97}" for k in range(12))) for i in range(50)] + [(99, "no such words")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")
    result = lambda: sorted((r.doc_id, r.text, r.n_words, r.n_hit, tuple(r["items"]), tuple(r.spans)) for r in D.decontaminate(docs, items).collect())
    once = result()
    monkeypatch.setattr(D, "BLOCK_BYTES", 100)
    monkeypatch.setattr(D, "PASS_BYTES", 300)
    passes = list(D.benchmark_passes(items, "item_id", "text", 10))
    assert len(passes) > 5 and all(sum(len(b.ids) for b in p) <= 12 for p in passes) and sum(len(b.ids) for p in passes for b in p) == 51
    assert result() == once and sum(x[3] for x in once) > 100


def test_passes_shuffle_only_what_they_hit(spark, monkeypatch):
    """Few of many documents are hit: the join gets these, and hardly any others. Long items are cut, short ones aren't."""
    monkeypatch.setattr(D, "BLOCK_BYTES", 200)
    monkeypatch.setattr(D, "PASS_BYTES", 400)
    long_item = " ".join(f"É{i}x" for i in range(300))
    pieces = list(D.item_pieces(long_item, 10))
    windows = lambda text: [tuple(text.split()[i : i + 10]) for i in range(len(text.split()) - 9)]
    assert max(len(x.encode()) for x in pieces) < 200 and [w for x in pieces for w in windows(x)] == windows(long_item)
    assert list(D.item_pieces("short one", 10)) == ["short one"] and list(D.item_pieces("-" * 500, 10)) == []
    docs = spark.createDataFrame([(i, f"own words {i} " + (" ".join(long_item.split()[i % 280 : i % 280 + 15]) if i % 100 == 7 else "and no others")) for i in range(2000)], "doc_id long, text string")
    asked, seen, split = spark.createDataFrame([(1, long_item)], "item_id long, text string"), [], D._split
    monkeypatch.setattr(D, "_split", lambda *x: seen.append(split(*x)) or seen[-1])
    got = D.decontaminate(docs, asked).collect()
    assert len(got) == 2000 and {r.doc_id for r in got if r.n_hit} == set(range(7, 2000, 100)) and all(r["items"] == (["1"] if r.doc_id % 100 == 7 else []) for r in got)
    assert all(r.n_words == (18 if r.doc_id % 100 == 7 else 6) for r in got)
    few, clean = seen[0]
    assert 20 <= few.count() < 40 and few.count() + clean.count() == 2000


def test_token_groups_are_opened_only_if_their_bound_reaches():
    """Forty clusters of near copies in one block: all links are found, and most groups stay shut."""
    r = np.random.RandomState(3)
    sets, cluster = [], []
    for c in range(40):
        base = np.unique(r.randint(0, 2**62, 120, dtype=np.int64).astype(np.uint64))
        for _ in range(int(r.choice([1, 3, 12, 30]))):
            gone = r.permutation(len(base))[: r.randint(0, 9)]
            sets.append(np.sort(np.concatenate([np.delete(base, gone), r.randint(0, 2**62, r.randint(0, 5), dtype=np.int64).astype(np.uint64)])))
            cluster.append(c)
    near = J.TokenGroups(sets, (80, 100))
    near.tie_all()
    label = {int(near.order[k]): int(near.label[k]) for k in range(len(sets))}
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    assert all((label[i] == label[j]) == (root[i] == root[j]) for i in range(len(sets)) for j in range(i))
    assert near.groups < len(sets) / 6  # a group holds several sets
    assert near.asked > 5 * near.opened > 0


def test_a_join_reports_its_groups(spark):
    rows = [(i, " ".join(f"c{i // 25}w{k}" for k in range(40)) + f" own{i}") for i in range(500)]
    report = {}
    got = {r.doc_id: r.component_id for r in J.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), report=report).collect()}
    assert got == {i: i // 25 * 25 for i, _ in rows}
    assert report["asked"] > 3 * report["opened"] > 0


def test_fractional_repeats_are_a_bound_of_the_source(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000)], "source string, source_size long")
    assert {r.source: r.target for r in source_targets(sizes, most_repeats=1.5, share=5.0).collect()} == {"a": 150.0, "b": 1500.0}
    docs = spark.createDataFrame([(i, "w " * 10, "a") for i in range(200)] + [(1000 + i, "w " * 10, "b") for i in range(2000)], "doc_id long, text string, source string")
    taken = {}
    for r in mix_to_targets(docs, most_repeats=1.5, share=5.0).collect():
        assert r.repeats in (1, 2)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert abs(taken["a"] - 3000) <= 10 and abs(taken["b"] - 30000) <= 10


def test_places_of_sources_over_many_partitions(spark):
    names = [f"n{i:03d}" for i in range(300)]
    sizes = spark.createDataFrame([(x, 1000) for x in [*names, None, "É", "z"]], "source string, source_size long").repartition(7)
    got = {r.source: r.target for r in source_targets(sizes, share=0.01).collect()}
    order = [*names, "z", "É", None]
    level = 0.01 * 1000 * len(order) / sum((5.0, 2.0, 1.0)[i % 3] for i in range(len(order)))
    assert all(abs(got[x] - (5.0, 2.0, 1.0)[i % 3] * level) < 1e-5 for i, x in enumerate(order))


def test_the_training_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, ("bad " if i % 4 == 0 else "good ") * 200) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    from corvane.llm.toxicity import _sample

    rows = _sample(docs, labels, "doc_id", "text", "toxic", 16_000, 100_000).collect()
    assert 50_000 < sum(len(r.text) for r in rows) <= 100_000
    model = fit_toxicity(docs, labels, sample_bytes=100_000)
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in model.score_documents(docs).collect())


SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
from corvane.llm.exact_dedup import exact_dedup
from corvane.llm.line_dedup import line_dedup
docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
print(exact_dedup(docs).count(), line_dedup(docs).count())
if sys.argv[2] == "stop":
    spark.stop()
"""


@pytest.mark.parametrize("end", ["stop", "exit"])
def test_no_table_outlives_its_session(tmp_path, end):
    """Neither after spark.stop() nor where the process just ends."""
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path), end], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "2 2" in done.stdout, done.stderr[-2000:]
    assert not [p for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".")]
