"""Payload parsers, files, the store, and streaming ingestion."""

import struct

import pytest
from pyspark.sql import functions as F

from corvane.sources import payloads as P
from corvane.sources.commits import CommitLog, Conflict
from corvane.sources.files import list_directory, read_directory
from corvane.sources.store import Store, chunk_numbers, ingest_totals
from corvane.streaming.ingest import stream_directory

ITEM = '<li class="b_algo" x><h2><a href="{href}" h="1">{title}</a></h2><p>{text}</p></li>'
PAGE = "".join([
    ITEM.format(href="https://e.org/a/?utm_source=x&amp;id=1", title="A &amp; <b>B</b>", text="first <i>snippet</i>"),
    '<li class="b_algo"><div class="b_ad"></div><h2><a href="https://e.org/b">x</a></h2></li>',
    ITEM.format(href="https://e.org/c", title="Promoted post", text=""),
    ITEM.format(href="https://doubleclick.net/c", title="C", text=""),
    '<li class="b_algo">no link</li>',
    ITEM.format(href="https://www.amazon.com/p", title="Phone $19.99", text="cheap"),
])


def test_result_pages(spark):
    got = P.web_results(spark.createDataFrame([(1, PAGE), (2, None)], "query_id long, html string"))
    rows = got.orderBy("position").collect()
    assert [(r.position, r.blocked) for r in rows] == [(0, False), (1, True), (2, True), (3, True), (5, False)]
    assert (rows[0].title, rows[0].url, rows[0].display_url, rows[0].snippet, rows[0].trackers) == ("A & B", "https://e.org/a/?id=1", "e.org > a", "first snippet", 1)
    assert P.blocking_counts(got).first().asDict() == {"query_id": 1, "organic": 2, "ads_blocked": 3, "trackers_stripped": 1}
    wiki = '{"query": {"search": [{"title": "Red fox", "snippet": "a <b>fox</b>"}]}}'
    fallback = P.encyclopedia_results(spark.createDataFrame([(1, wiki), (3, wiki)], "query_id long, json string"))
    both = P.with_fallback(got.where(~F.col("blocked")), fallback, 3).orderBy("query_id", "position").collect()
    assert [(r.query_id, r.title) for r in both] == [(1, "A & B"), (1, "Phone $19.99"), (1, "Red fox - Wikipedia"), (3, "Red fox - Wikipedia")]
    assert both[2].url == "https://en.wikipedia.org/wiki/Red_fox" and both[2].snippet == "a fox"


def test_shops(spark):
    pages = spark.createDataFrame([(1, PAGE)], "query_id long, html string")
    catalog = spark.createDataFrame([(1, '{"products": [{"title": "Red mug", "price": 4.5, "rating": 4.1}]}')], "query_id long, json string")
    got = P.shopping_results(P.catalog_products(catalog), P.shop_results(pages), top_k=9).orderBy("position").collect()
    assert (got[0].store, got[0].price, got[0].url, got[0].rating) == ("Verified Store", "$4.50", "https://www.google.com/search?q=Red%20mug+buy+online", 4.1)
    assert (got[-1].store, got[-1].price) == ("Amazon", "$19.99") and got[1].store == "E.org" and got[1].price == "Check Store"


def test_images_and_videos(spark):
    item = 'm="{&quot;murl&quot;:&quot;https://i.org/a.png?ref=1&quot;,&quot;t&quot;:&quot;A&quot;,&quot;purl&quot;:&quot;https://p.org/x&quot;,&quot;w&quot;:10,&quot;h&quot;:0}" m="{&quot;murl&quot;:&quot;ftp://x&quot;}" m="{broken}"'
    (got,) = P.image_results(spark.createDataFrame([(1, "q", item)], "query_id long, query string, html string")).collect()
    assert (got.title, got.image_url, got.thumb_url, got.source_url, got.domain, got.width, got.height) == ("A", "https://i.org/a.png", "https://i.org/a.png", "https://p.org/x", "p.org", 10, None)
    one = '"videoId":"{}","x":1,"title":{{"runs":[{{"text":"{}"'
    html = "".join(one.format(i, t) for i, t in (("abcdefghijk", "First"), ("short", "No"), ("abcdefghijk", "Again"), ("ABCDEFGHIJK", "Second &amp; last")))
    videos = P.video_results(spark.createDataFrame([(1, html)], "query_id long, html string")).orderBy("position").collect()
    assert [(v.position, v.title) for v in videos] == [(0, "First"), (1, "Second & last")]
    titles = P.video_titles(spark.createDataFrame([(1, '<div class="mc_vtvc_title" title="a b">')], "query_id long, html string")).collect()
    assert titles[0].url.endswith("q=a%20b")


def test_news_and_suggestions(spark):
    feed = """<rss><channel><item><title>Big - thing - Paper</title><link>https://n.org/a?utm_source=r</link><pubDate>Mon</pubDate><description>&lt;b&gt;Hi&lt;/b&gt; you</description></item>
    <item><title>Plain</title><link>https://n.org/b</link><source url="https://s.org">Src</source></item></channel></rss>"""
    got = P.news_results(spark.createDataFrame([(1, feed)], "query_id long, xml string")).orderBy("position").collect()
    assert [(g.title, g.url, g.source, g.source_url, g.snippet) for g in got] == [("Big - thing", "https://n.org/a", "Paper", "", "Hi you"), ("Plain", "https://n.org/b", "Src", "https://s.org", "")]
    lists = P.suggestion_lists(spark.createDataFrame([(1, '["q", ["a", "b"]]'), (2, "{}")], "query_id long, json string")).collect()
    assert [r.suggestion for r in lists] == ["a", "b"]
    card = P.summary_card(spark.createDataFrame([(1, '{"type": "standard", "title": "T", "extract": "E"}'), (2, '{"type": "x", "extract": "E"}')], "query_id long, json string")).collect()
    assert [(c.title, c.extract) for c in card] == [("T", "E")]


def test_page_cards_and_addresses(spark):
    pages = spark.createDataFrame([(1, "https://e.org/a", '<TITLE> A &amp; b</TITLE><meta name="description" content="D &lt;">'), (2, "https://f.org", "<p>")], "page_id long, url string, html string")
    got = P.page_card(pages).orderBy("page_id").collect()
    assert (got[0].title, got[0].snippet, got[1].title) == ("A & b", "D <", "f.org") and got[1].snippet.startswith("Direct destination website for https://f.org.")
    asked = P.address_queries(spark.createDataFrame([("e.org",), ("two words",)], "query string")).collect()
    assert [(r.query, r.url) for r in asked] == [("e.org", "https://e.org")]


def test_image_bytes(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + struct.pack(">II", 256, 128) + b"rest"
    rows = [(1, png), (2, b"\xff\xd8\xff.."), (3, b"RIFF\x00\x00\x00\x00WEBP"), (4, None)]
    got = P.image_info(spark.createDataFrame(rows, "id long, content binary")).orderBy("id").collect()
    assert (got[0].format, got[0].width, got[0].height, got[0].aspect_ratio) == ("PNG", 256, 128, "2.0:1")
    assert [(g.format, g.width, g.aspect_ratio) for g in got[1:]] == [("JPEG", 800, "4:3"), ("WEBP", 800, "4:3"), ("JPEG", 800, "4:3")]
    uri = spark.createDataFrame(rows[:1], "id long, content binary").select(P.data_uri(F.lit("PNG"), F.col("content")).alias("u"), P.reverse_search_links(F.lit("http://a/b c")).alias("l")).first()
    assert uri.u.startswith("data:image/png;base64,iVBOR") and uri.l["tineye"] == "https://tineye.com/search?url=http%3A//a/b%20c"
    html = "murl&quot;:&quot;https://i.org/1.png&quot; t&quot;:&quot;One&quot; murl&quot;:&quot;https://j.org/2.png&quot;"
    found = P.visual_matches(spark.createDataFrame([(1, html)], "query_id long, html string")).orderBy("position").collect()
    assert [(m.title, m.domain) for m in found] == [("One", "i.org"), ("Visual Match 2", "j.org")]


RECORDS = """<html><a class="result__a" href="/before">before</a><div class="results"><div class="result x"><h2><a rel='n' class='result__a' href="https://e.org/?a=1&amp;b=2">One <b>&amp; only</b></a></h2> no
<a class="result__snippet y" href="/z">its <i>text</i></a> after</div><div class=result><a class="result__snippet">no title</a></div>
<DIV CLASS="result"><A HREF=/three CLASS=result__a>Three</A><!-- <div class="result"> --></DIV><div class="result"><a class="result__a">no url</a></div></div>"""


def test_record_pages(spark):
    got = P.record_results(spark.createDataFrame([(1, RECORDS), (2, None), (3, "")], "query_id long, html string")).orderBy("position").collect()
    assert [(g.query_id, g.position, g.title, g.url, g.snippet) for g in got] == [(1, 0, "One & only", "https://e.org/?a=1&b=2", "its text"), (1, 1, "Three", "/three", "")]


def test_lost_files_and_totals(spark, tmp_path):
    root = tmp_path / "in"
    _folder(root)
    store = Store(spark, str(tmp_path / "store"))
    listed = list_directory(spark, str(root)).unionByName(spark.createDataFrame([("file:/gone.md",)], "file_path string"))
    statuses = store.ingest(read_directory(spark, str(root), skip_unreadable=True), listed=listed)
    assert ingest_totals(statuses).first().asDict() == {"indexed_files": 2, "skipped_files": 1, "total_chunks_created": 2, "errors": 1}
    assert ingest_totals(statuses.limit(0)).first().errors == 0


def test_store_appends_and_compacts(spark, tmp_path):
    """A write brings new files and touches no old one; the last version counts; a removed document can come back."""
    store = Store(spark, str(tmp_path / "store"))
    row = lambda i, text: (f"p{i}", f"p{i}.md", text, len(text), text)
    files = lambda *rows: spark.createDataFrame(list(rows), "file_path string, file_name string, file_hash string, file_size long, text string")
    store.ingest(files(*[row(i, f"text {i}") for i in range(5)]))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    store.ingest(files(row(1, "other words here")))
    store.delete(spark.createDataFrame([("p2",), ("p9",)], "file_path string"))
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    shown = lambda: sorted((c.file_path, c.content.split("\n")[-1]) for c in store.read().chunks.collect())
    assert shown() == [("p0", "text 0"), ("p1", "other words here"), ("p3", "text 3"), ("p4", "text 4")]
    store.compact()
    assert shown() == [("p0", "text 0"), ("p1", "other words here"), ("p3", "text 3"), ("p4", "text 4")] and store.stats().first().total_documents == 4
    assert store.ingest(files(row(2, "text 2"))).first().status == "indexed" and store.stats().first().total_documents == 5


def _folder(path):
    (path / "notes").mkdir(parents=True)
    (path / ".git").mkdir()
    (path / "a.md").write_text("# Title\n\nalpha beta\n")
    (path / "notes" / "b.txt").write_bytes(b"gamma \xff delta")
    (path / "notes" / "empty.txt").write_text("")
    (path / "notes" / "blank.md").write_text("  \n")
    (path / "notes" / "c.db").write_text("no")
    (path / ".git" / "d.md").write_text("no")


def test_store_ingests_what_is_new(spark, tmp_path):
    root = tmp_path / "in"
    _folder(root)
    store = Store(spark, str(tmp_path / "store"))
    files = read_directory(spark, str(root))
    assert sorted(r.file_name for r in files.collect()) == ["a.md", "b.txt", "blank.md"]  # Spark leaves out files without a byte
    status = {r.file_path.rsplit("/", 1)[1]: (r.status, r.chunks) for r in store.ingest(files).collect()}
    assert status == {"a.md": ("indexed", 1), "b.txt": ("indexed", 1), "blank.md": ("skipped", 0)}
    assert {r.status for r in store.ingest(read_directory(spark, str(root))).collect()} == {"skipped"}
    assert store.stats().first().total_documents == 2
    (root / "a.md").write_text("# Title\n\nchanged\n")
    vectors = lambda chunks: chunks.select("chunk_id", F.array(F.lit(1.0).cast("float")).alias("embedding"))
    assert store.ingest(read_directory(spark, str(root)), vectors).where("status = 'indexed'").count() == 1
    assert [r.file_name for r in store.rehydrate().collect()] == ["a.md"]
    numbered = chunk_numbers(store.read().chunks).orderBy("doc_id").collect()
    assert [r.doc_id for r in numbered] == [0, 1]
    path = store.read().documents.where("file_name = 'b.txt'").first().file_path
    assert store.document(path).count() == 1
    store.delete(spark.createDataFrame([(path,)], "file_path string"))
    assert [r.file_name for r in store.read().documents.collect()] == ["a.md"]


def test_streaming_ingestion(spark, tmp_path):
    root = tmp_path / "in"
    _folder(root)
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        stream_directory(spark, str(root), store, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sorted(r.file_name for r in store.read().documents.collect()) == ["a.md", "b.txt"]
    (root / "e.md").write_text("epsilon")
    stream_directory(spark, str(root), store, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sorted(r.file_name for r in store.read().documents.collect()) == ["a.md", "b.txt", "e.md"]


FILES = "file_path string, file_name string, file_hash string, file_size long, text string"


def _files(spark, *rows):
    return spark.createDataFrame([(p, p, text, len(text), text) for p, text in rows], FILES)


def _shown(store, version=None):
    return sorted((c.file_path, c.content.split("\n")[-1]) for c in store.read(version).chunks.collect())


def test_store_takes_hash_and_chunks_from_one_row(spark, tmp_path):
    """Paths that occur twice with different contents, dealt over partitions."""
    store = Store(spark, str(tmp_path / "store"))
    rows = [(f"p{i}", f"{word} {i}") for i in range(100) for word in ("first", "second")]
    assert store.ingest(_files(spark, *rows).repartition(7)).where("status = 'indexed'").count() == 100
    hashes = {d.file_path: d.file_hash for d in store.read().documents.collect()}
    assert _shown(store) == sorted(hashes.items()) and set(hashes.values()) == {f"second {i}" for i in range(100)}


def test_store_write_that_dies_is_never_seen(spark, tmp_path, monkeypatch):
    """Killed before each table, and before the commit; the folders it leaves go with the vacuum."""
    store = Store(spark, str(tmp_path / "store"))
    store.ingest(_files(spark, ("a", "alpha"), ("b", "beta")))
    version = store.log.latest().number

    class Killed(Exception):
        pass

    made, left = Store._made, 0
    for dies in ("chunks", "vectors", "documents", "commit"):

        def step(self, table, rows, dies=dies):
            if table == dies:
                raise Killed
            return made(self, table, rows)

        def commit(self, folders, dies=dies):
            raise Killed

        with monkeypatch.context() as m:
            m.setattr(Store, "_made", step)
            m.setattr(Store, "_commit", commit)
            with pytest.raises(Killed):
                store.ingest(_files(spark, ("a", "changed"), ("c", "gamma")), lambda chunks: chunks.select("chunk_id", F.array(F.lit(1.0).cast("float")).alias("embedding")))
        assert store.log.latest().number == version and _shown(store) == [("a", "alpha"), ("b", "beta")]
        left += {"chunks": 0, "vectors": 1, "documents": 2, "commit": 3}[dies]
    assert store.vacuum() == [] and len(store.vacuum(older_than=0)) == left
    store.ingest(_files(spark, ("a", "changed"), ("c", "gamma")))
    assert _shown(store) == [("a", "changed"), ("b", "beta"), ("c", "gamma")]


def test_store_two_writers(spark, tmp_path):
    """Both begin on one version; one commit is taken first, the other goes on top of it."""
    from concurrent.futures import ThreadPoolExecutor

    store = Store(spark, str(tmp_path / "store"))
    store.ingest(_files(spark, ("a", "alpha")))
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda rows: Store(spark, store.path).ingest(_files(spark, *rows)), [[("b", "beta"), ("x", "one")], [("c", "gamma"), ("x", "two")]]))
    got = dict(_shown(store))
    assert got.keys() == {"a", "b", "c", "x"} and got["x"] in ("one", "two") and store.log.latest().number == 3
    assert {d.file_path: d.file_hash for d in store.read().documents.collect()}["x"] == got["x"]


def test_commits_of_one_number(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    base = log.latest()
    assert base.number == 0 and log.put(base, {"t": ["t/1"]}).number == 1
    with pytest.raises(Conflict):
        log.put(base, {"t": ["t/2"]})
    assert log.latest().tables == {"t": ["t/1"]} and log.numbers() == [1]
    taken = []

    def step(tables):  # another writer is first, once
        if not taken:
            taken.append(log.put(log.latest(), {"t": [*tables["t"], "t/3"]}))
        return {"t": [*tables["t"], "t/4"]}

    assert log.change(step).tables == {"t": ["t/1", "t/3", "t/4"]} and log.latest().number == 3
    assert not [x for x in (tmp_path / "log" / "_versions").iterdir() if x.name.startswith("_")]


def test_store_compaction_beside_a_writer_and_pinned_versions(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    for word in ("one", "two"):
        store.ingest(_files(spark, ("a", word), ("b", f"{word} b")))
    store.delete(spark.createDataFrame([("b",)], "file_path string"))
    old = store.log.latest().number
    pinned, change = store.log.pin(old), CommitLog.change

    def late(self, step, tries=100):  # a write is committed between the compaction's files and its swap
        monkeypatch.setattr(CommitLog, "change", change)
        Store(spark, store.path).ingest(_files(spark, ("c", "late")))
        return change(self, step, tries)

    monkeypatch.setattr(CommitLog, "change", late)
    assert [len(x) for x in store.compact().tables.values()] == [2, 2, 1]
    assert _shown(store) == [("a", "two"), ("c", "late")] and _shown(store, old) == [("a", "two")]
    store.vacuum(older_than=0)
    assert _shown(store, old) == [("a", "two")] and _shown(store, 1) == [] if 1 in store.log.numbers() else store.log.numbers() == [old, old + 2]
    store.log.unpin(pinned)
    assert store.vacuum(older_than=0) and _shown(store) == [("a", "two"), ("c", "late")] and store.log.numbers() == [old + 2]


def test_store_reads_only_the_partitions_of_a_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), parts=64)
    store.ingest(_files(spark, *[(f"p{i}", f"text {i}") for i in range(200)]))
    plan = store.document("p7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and store.document("p7").first().file_hash == "text 7"
    assert store.document("none").count() == 0
