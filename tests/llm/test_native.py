"""Exact dedup, line dedup, mixing and revisits: small cases, and plain Python beside them."""

import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corvane.llm.exact_dedup import exact_dedup, kept_documents, possible_repeats
from corvane.llm.line_dedup import line_dedup
from corvane.llm.mixing import mix_to_targets, mixed_documents, source_targets
from corvane.scratch import join_groups
from corvane.llm.warc import canonical_url, page_records, resolve_revisits

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_exact_dedup_groups_nulls_and_repeats(spark):
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "é\n"), (7, "a "), (2, "a"), (None, "c"), (None, "b")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id or -1, r.group_size, r.kept) for r in exact_dedup(frame(spark, rows)).collect())
    assert got == [(-1, -1, 1, True), (-1, 3, 2, False), (1, 2, 3, False), (2, 2, 3, False), (2, 2, 3, True), (3, 3, 2, True), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True), (7, 7, 1, True)]
    sha = {r.doc_id: r.text_sha256 for r in exact_dedup(frame(spark, rows)).collect()}
    assert sha[6] == hashlib.sha256("é\n".encode()).hexdigest()


def test_exact_dedup_empty_table_and_clashing_names(spark):
    assert exact_dedup(frame(spark, [])).count() == 0
    rows = [(1, "a", "x", 1, True), (2, "a", "y", 2, False)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, fp string, id int, kept boolean"))
    assert sorted((r.doc_id, r.kept) for r in got.collect()) == [(1, False), (2, True)]
    assert [r.doc_id for r in kept_documents(spark.createDataFrame([*rows, rows[1]], "doc_id long, text string, fp string, id int, kept boolean")).collect()] == [2]


def test_bloom_filter_never_misses_a_repeat(spark):
    rows = [(f"k{i}",) for i in range(3000)] + [(f"k{i}",) for i in range(0, 3000, 7)]
    tested = possible_repeats(spark.createDataFrame(rows, "fp string"), "fp")
    by = defaultdict(set)
    for r in tested.collect():
        by[r.fp].add(r.repeated)
    counts = Counter(x for (x,) in rows)
    assert all(by[k] == {True} for k, n in counts.items() if n > 1)
    assert sum(by[k] == {True} for k, n in counts.items() if n == 1) < 60
    full = possible_repeats(spark.createDataFrame(rows, "fp string"), "fp", round_slots=100)  # several rounds
    assert {(r.fp, r.repeated) for r in full.collect()} == {(k, n > 1) for k, n in counts.items()}


def test_exact_dedup_with_a_normaliser(spark):
    got = exact_dedup(frame(spark, [(1, "A"), (2, "a")]), normalise=F.lower)
    assert sorted((r.doc_id, r.kept) for r in got.collect()) == [(1, False), (2, True)]


def _line_dedup_plain(rows):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and i != max(j for j in holders[key(x)] if j is not None))]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup_like_plain_python(spark):
    r = random.Random(3)
    pool = [f"{'Line' if k % 2 else 'Zeile É'} {k} with enough characters in it" for k in range(12)] + ["short", "", "  "]
    rows = []
    for i in range(60):
        text = "\n".join(r.choice([x, x.upper() if r.random() < 0.2 else x, f"\t{x} "]) for x in r.choices(pool, k=r.randint(0, 8)))
        rows.append((i, text))
    rows += [(60, None), (61, ""), (62, "a\n"), (63, "\n".join([pool[0]] * 400)), (None, pool[1])]
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.n_lines, x.n_dropped, x.text) for x in line_dedup(frame(spark, rows)).collect())
    assert got == _line_dedup_plain(rows)
    assert sum(x[2] for x in got) > 20


def test_line_dedup_passes_columns_and_repeats(spark):
    line = "a line that is long enough to count"
    rows = [(1, line, 7, "k"), (2, line, 8, "k"), (3, line, 9, "k"), (1, line, 7, "k")]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string, pos int, key string"))
    assert got.columns == ["doc_id", "text", "pos", "key", "n_lines", "n_dropped"]
    assert sorted((x.doc_id, x.text, x.pos) for x in got.collect()) == [(1, "", 7), (1, "", 7), (2, "", 8), (3, line, 9)]
    assert line_dedup(frame(spark, [])).count() == 0


def test_source_targets_fill_up_and_reshare(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 90)], "source string, source_size long")
    got = {r.source: r.target for r in source_targets(sizes).collect()}
    # budget 2400; weights a 5, b 2, c 1, null 5; a stops at 20, null at 180; b and c share 2200 as 2:1
    assert got == {"a": 20.0, None: 180.0, "b": 1466.666667, "c": 733.333333}
    only = spark.createDataFrame([("a", 0)], "source string, source_size long")
    assert [r.target for r in source_targets(only).collect()] == [0.0]


def test_mix_takes_near_the_targets(spark):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), None, r.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mix_to_targets(docs).collect()
    assert len(got) == 900
    taken, target = Counter(), {}
    for x in got:
        assert x.taken in (0, x.size, 2 * x.size)
        taken[x.source] += x.taken
        target[x.source] = x.target
    assert all(abs(taken[s] - target[s]) <= 30 for s in target)
    assert sorted((x.doc_id, x.taken) for x in mix_to_targets(docs.repartition(7)).collect()) == sorted((x.doc_id, x.taken) for x in got)
    kept = mixed_documents(docs.withColumn("h", F.lit(1)).withColumn("repeats", F.lit("x")))
    assert kept.columns == [*docs.columns, "h", "repeats"] and {x.doc_id for x in kept.collect()} >= {x.doc_id for x in got if x.taken}


def test_mix_of_nothing_and_of_nulls(spark):
    assert mix_to_targets(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, None, None, None, None), (1, "a b", None, None, 0), (1, "a b", None, None, 0)]
    assert sorted(x.size for x in mix_to_targets(spark.createDataFrame(rows, DOCS)).collect()) == [0, 2, 2]


def test_join_groups_with_one_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 1500).cast("string"))).alias("k"), F.col("id").alias("v"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top")).where("n > 1")
    plain = rows.join(groups, "k").select("k", "v", "n", "top")
    got = join_groups(rows, groups, "k", "n")
    assert got.columns == ["k", "v", "n", "top"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_canonical_urls(spark):
    cases = {
        "HTTP://User@WWW.Example.com:80": "example.com/",
        "https://example.com:8443/A?b=2&utm_source=x&a=1#top": "example.com:8443/A?a=1&b=2",
        "//example.com/x?ref=y": "example.com/x",
        " https://m.example.com/p/ ": "m.example.com/p/",
        "  ": None,
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string").select("url", canonical_url(F.col("url")).alias("c"))
    assert {r.url: r.c for r in df.collect()} == cases


RECORD = "record_id long, kind string, url string, at long, etag string, last_modified string, headers map<string,string>, payload_digest string"


def test_revisits_take_the_latest_earlier_response(spark):
    rows = [
        (1, "response", "http://e.org/a", 100, "x", "m1", {"ETag": "x", "Content-Type": "t", "Date": "d1"}, "p1"),
        (2, "response", "https://www.e.org/a#f", 200, "y", "m2", {"ETag": "y", "Age": "3"}, "p2"),
        (3, "response", "http://e.org/a", 200, "y", "m2", None, "p3"),
        (10, "revisit", "http://e.org/a", 150, "W/x", None, {"Date": "d9", "Content-Length": "0", "Cache-Control": None}, None),
        (11, "revisit", "http://e.org/a", 200, "z", "m1", {}, None),
        (12, "revisit", "http://e.org/a", 99_999_999, None, "m2", {"VARY": "v"}, None),
        (13, "revisit", "http://e.org/a", 100, "x", None, None, None),
        (14, "revisit", "http://e.org/b", 500, "x", None, None, None),
        (15, "revisit", None, 500, "x", None, None, None),
        (16, "revisit", "http://e.org/a", 300, None, None, None, None),
        (17, "metadata", "http://e.org/a", 300, None, None, None, None),
        (18, "revisit", "http://e.org/a", None, "x", None, None, None),
    ]
    got = {r.record_id: r for r in resolve_revisits(spark.createDataFrame(rows, RECORD).withColumn("_bucket", F.lit(1)), bucket_seconds=40).collect()}
    assert {k: (r.response_id, r.status, r.payload_digest) for k, r in got.items()} == {
        10: (1, "resolved", "p1"), 11: (1, "mismatch", None), 12: (3, "resolved", "p3"), 13: (None, "no_response", None),
        14: (None, "no_response", None), 15: (None, "no_response", None), 16: (3, "unverified", None), 18: (None, "no_response", None),
    }
    assert got[10].headers == {"etag": "x", "content-type": "t", "date": "d9", "cache-control": None}
    assert got[12].headers == {"vary": "v"}


def test_revisits_like_a_plain_scan(spark):
    r = random.Random(8)
    rows = [(i, r.choice(["response", "revisit"]), f"http://h/{r.choice('aaaab')}", r.randint(0, 5000), r.choice("xy"), None, None, f"p{i}") for i in range(400)]
    got = {x.record_id: x.response_id for x in resolve_revisits(spark.createDataFrame(rows, RECORD), bucket_seconds=100).collect()}
    want = {}
    for i, kind, url, at, *_ in rows:
        if kind == "revisit":
            want[i] = max(((t, j) for j, k, u, t, *_ in rows if k == "response" and u == url and t < at), default=(0, None))[1]
    assert got == want
    assert resolve_revisits(page_records(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
