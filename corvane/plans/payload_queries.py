"""Registered queries of parsers, tools, chunks, stores and responses, and SQL written beside them by hand.

Payloads are made of the tables' own columns, one for each row or group of
rows, in the markup that the parsers read; every query covers its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import TOKEN, highlight, stem, token_offsets, unescape_html
from corvane.functions.tools import DATA, LENGTH, WEIGHT, conversion
from corvane.functions.url import clean_url, display_url, domain, is_address
from corvane.operators.chunks import chunk_documents
from corvane.operators.images import image_neighbours as neighbours
from corvane.operators.images import png
from corvane.operators.metrics import markdown_table, upper_latency
from corvane.operators.models import pooled, scorer, with_vectors
from corvane.operators.vectors import mean_pooled
from corvane.plans.responses import respond
from corvane.plans.search import instant_answers, rank_web
from corvane.scratch import files_of, new_folder
from corvane.sources import payloads as P
from corvane.sources.files import read_directory
from corvane.sources.store import Store, chunk_numbers, ingest_totals


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts: Column | str) -> Column:
    """The parts one after the other: strings as they are, columns as text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _grouped(rows: DataFrame, key: Column, order: str, item: Column, name: str, before: str = "", after: str = "") -> DataFrame:
    """(query_id, name): the items of each group in order, as one payload."""
    items = rows.select(key.cast("long").alias("query_id"), F.struct(F.col(order).alias("at"), item.alias("item")).alias("x")).groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return items.select("query_id", F.concat(F.lit(before), F.array_join(F.transform("xs", lambda x: x["item"]), ""), F.lit(after)).alias(name))


# --- addresses --------------------------------------------------------------------------------------------------
def _raw_url(page: Column, url: Column) -> Column:
    coded = F.regexp_replace(F.translate(F.base64(F.encode(url, "utf-8")), "+/", "-_"), "=+$", "")
    kinds = [
        _text("https://www.bing.com/ck/a?!&p=1&u=a1", coded, "&ntb=1"), _text("//duckduckgo.com/l/?uddg=", F.url_encode(url), "&rut=x"), _text("https://www.google.com/url?q=", F.url_encode(url), "&sa=U"),
        _text("https://googleadservices.com/pagead?x=", page, "&ref=2"), _text("  ", F.regexp_replace(url, "[?#].*", ""), "?gclid=abc&amp;id=", page, "&amp;FBCLID=1 "), _text("https://shop.doubleclick.net/c/", page), url,
    ]
    out = kinds[-1]
    for i, kind in enumerate(kinds[:-1]):
        out = F.when(page % 7 == i, kind).otherwise(out)
    return out


def url_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses behind redirects of three kinds, of adverts, with references and blanks."""
    cleaned = _table(spark, sf_dir, "pages").select("page_id", clean_url(_raw_url(F.col("page_id"), F.col("url"))).alias("u"))
    return cleaned.select("page_id", "u.*", domain(F.col("u.clean_url")).alias("domain"), display_url(F.col("u.clean_url")).alias("display_url"))


def address_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, url = F.col("page_id"), F.col("url")
    host = F.regexp_extract(url, "//([^/?#]*)", 1)
    kinds = [host, url, _text(" ", host, ":8080/a b "), _text("words of ", host), _text("-", host), _text(host, "."), _text("a_b.", host)]
    asked = kinds[-1]
    for i, kind in enumerate(kinds[:-1]):
        asked = F.when(page % 7 == i, kind).otherwise(asked)
    named = _table(spark, sf_dir, "pages").select("page_id", asked.alias("query"))
    found = P.address_queries(named).select("page_id", "url")
    return named.select("page_id", is_address(F.col("query")).alias("is_address")).join(found, "page_id", "left")


# --- result pages -----------------------------------------------------------------------------------------------
def _result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, url = F.col("page_id"), F.regexp_replace("url", "[?#].*", "")
    link = _text(url, "?utm_medium=web&amp;no=", page)
    organic = _text('<li class="b_algo" data-id="', page, '"><h2 class="t"><a target="_blank" href="', link, '">Page &amp; <strong>', page, '</strong></a></h2><div><p class="s">Snippet of <b>page</b> ', page, " &lt;about&gt; ", F.regexp_extract("html", 'lang="([a-z]+)"', 1), "</p></div></li>")
    item = F.when(page % 7 == 3, _text('<li class="b_algo"><div class="b_ad"></div><h2><a href="', url, '">Offer ', page, "</a></h2><p>x</p></li>"))
    item = item.when(page % 7 == 5, _text('<li class="b_algo"><h2><a h="1" href="', url, '">Promoted post ', page, "</a></h2><p>y</p></li>"))
    item = item.when(page % 7 == 6, _text('<li class="b_algo"><p>no link ', page, "</p></li>")).when(page % 11 == 4, _text('<li class="b_algo"><h2><a href="https://doubleclick.net/', page, '">Click ', page, "</a></h2></li>"))
    return _grouped(_table(spark, sf_dir, "pages"), F.floor(page / 10), "page_id", item.otherwise(organic), "html", "<html><body><ol>", "</ol></body></html>")


def _encyclopedia(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.expr("array(struct(concat('Red fox ', n) AS title, 'a <b>fox</b>' AS snippet), struct('C/D é' AS title, 'second' AS snippet))")
    groups = _table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 10).cast("long").alias("query_id")).distinct()
    return groups.withColumn("n", F.col("query_id").cast("string")).select("query_id", F.to_json(F.struct(F.struct(hits.alias("search")).alias("query"))).alias("json"))


def serp_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.web_results(_result_pages(spark, sf_dir))


def serp_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.blocking_counts(serp_results(spark, sf_dir))


def serp_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organic results, and those of an encyclopedia for queries with fewer than five."""
    organic = serp_results(spark, sf_dir).where(~F.col("blocked"))
    return P.with_fallback(organic, P.encyclopedia_results(_encyclopedia(spark, sf_dir)), 5, most=5).select("query_id", "position", "title", "url", "snippet")


def _addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct cards for the queries of even number."""
    pages = _table(spark, sf_dir, "pages").where((F.col("page_id") % 20) == 0)  # the first page of each even query
    return P.page_card(pages).select(F.floor(F.col("page_id") / 10).cast("long").alias("query_id"), "title", "url", "display_url", "domain", "snippet")


def web_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = serp_results(spark, sf_dir)
    queries = results.select("query_id").distinct().withColumn("query", _text("page ", F.col("query_id") * 10, " about ", F.col("query_id")))
    return rank_web(results, queries, _addressed(spark, sf_dir), top_k=6).select("query_id", "rank", "url", "score", "direct")


def record_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, url = F.col("page_id"), F.regexp_replace("url", "[?#].*", "")
    link = F.when(page % 5 == 2, "").otherwise(_text('<a rel="nofollow" class="result__a" href="', url, "?a=1&amp;b=", page, '">Title <b>', page, "</b> &amp; more</a>"))
    quote = F.when(page % 3 == 1, "").otherwise(_text("<a class='x result__snippet' href='/y'>Text of <b>", page, "</b></a>"))
    item = _text('<div class="result results_links"><h2>', link, "</h2>outside ", quote, "</div>\n")
    pages = _grouped(_table(spark, sf_dir, "pages"), F.floor(page / 10), "page_id", item, "html", '<!DOCTYPE html><a class="result__a" href="/no">before</a><div class="results">', "</div>")
    return P.record_results(pages)


def image_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, url = F.col("page_id"), F.regexp_replace("url", "#.*", "")
    address = F.when(page % 4 == 3, _text("ftp://img.example/", page)).otherwise(_text("https://img.example/", page, ".png?ref=1"))
    named = F.when(page % 3 == 0, "").otherwise(_text("Image ", page, " &amp;lt;x&amp;gt;"))
    item = _text('<a class="iusc" m="{&quot;murl&quot;:&quot;', address, "&quot;,&quot;t&quot;:&quot;", named, "&quot;,&quot;desc&quot;:&quot;", F.when(page % 6 == 0, "described").otherwise(""), "&quot;,&quot;purl&quot;:&quot;", url, "&quot;,&quot;w&quot;:", page % 5 * 100, ",&quot;h&quot;:", page + 1, '}"></a>')
    pages = _grouped(_table(spark, sf_dir, "pages"), F.floor(page / 10), "page_id", item, "html").withColumn("query", _text("q", F.col("query_id")))
    return P.image_results(pages, top_k=5).withColumn("width", F.coalesce("width", F.lit(0)))  # null is no width


def media_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of pages in fives, three or four of each with an address, and those of a media library where there are three."""
    page, table = F.col("page_id"), _table(spark, sf_dir, "pages")
    address = F.when(page % 4 == 3, "ftp://no.example").otherwise(_text("https://img.example/", page, ".png"))
    item = _text('<a m="{&quot;murl&quot;:&quot;', address, "&quot;,&quot;t&quot;:&quot;Image ", page, "&quot;,&quot;w&quot;:1,&quot;h&quot;:2}\"></a>")
    pages = _grouped(table, F.floor(page / 5), "page_id", item, "html").withColumn("query", F.lit("q"))
    file = lambda n, info: _text('"', n, '":{"title":"File:Media ', n, " of ", F.col("query_id"), '.jpg"', info, "}")
    info = _text(',"imageinfo":[{"url":"https://media.example/', F.col("query_id"), '.jpg","descriptionurl":"https://media.example/about/', F.col("query_id"), '","width":640,"height":', F.col("query_id"), "}]")
    media = pages.select("query_id", _text('{"query":{"pages":{', file("9", info), ",", file("5", F.lit("")), ",", file("7", F.lit(',"imageinfo":[{}]')), "}}}").alias("json"))
    found = P.with_fallback(P.image_results(pages), P.media_results(media), 4)
    none = {c: F.coalesce(c, F.lit(0)) for c in ("width", "height")}
    return found.withColumns(none).select("query_id", "title", "image_url", "thumb_url", "source_url", "domain", "width", "height")


def video_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos, those of a plain page where there are fewer than four."""
    page = F.col("page_id")
    same = page - F.when(page % 4 == 1, 1).otherwise(0)
    name = F.when(page % 20 > 13, "short").otherwise(F.substring(F.md5(same.cast("string")), 1, 11))
    item = _text('{"videoId":"', name, '","x":1,"title":{"runs":[{"text":"Video &amp; ', page, '"}]}}\n')
    pages = _table(spark, sf_dir, "pages")
    videos = P.video_results(_grouped(pages, F.floor(page / 10), "page_id", item, "html"), top_k=6)
    plain = P.video_titles(_grouped(pages, F.floor(page / 10), "page_id", _text('<div class="mc_vtvc_title" x="1" title="Plain ', page, '/é"></div>'), "html"))
    return P.with_fallback(videos, plain, 4, most=3).select("query_id", "title", "url", "platform")


def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, url = F.col("page_id"), F.regexp_replace("url", "[?#].*", "")
    title = F.when(page % 3 == 0, _text("Plain headline ", page)).otherwise(_text("Head - line ", page, " - Paper ", page % 5))
    source = F.when(page % 3 == 0, _text('<source url="https://s', page % 4, '.example">Source &amp;amp; ', page % 4, "</source>")).otherwise("")
    item = _text("<item><title>", title, "</title><link>", url, "?utm_source=rss&amp;n=", page, "</link><pubDate>Mon, ", page % 28 + 1, " Jan</pubDate><description>&lt;a href='x'&gt;News&lt;/a&gt; of ", page, " &amp;amp; more</description>", source, "</item>\n")
    return _grouped(_table(spark, sf_dir, "pages"), F.floor(page / 10), "page_id", item, "xml", "<rss><channel><title>Feed</title>", "</channel></rss>")


def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.news_results(_feeds(spark, sf_dir), top_k=8)


def json_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole JSON answers of the news category; every third query is blank."""
    feeds = _feeds(spark, sf_dir)
    queries = feeds.select("query_id", F.when(F.col("query_id") % 3 == 0, "  ").otherwise(_text(" news ", F.col("query_id"))).alias("query"))
    answers = respond(queries, "news", "hybrid", 4, {"news": feeds})
    pick = lambda path: F.get_json_object("response", path)
    return answers.select("query_id", pick("$.query").alias("query"), pick("$.category").alias("category"), pick("$.total_hits").cast("long").alias("total_hits"), F.coalesce(pick("$.hits[0].title"), F.lit("")).alias("first_title"), F.coalesce(pick("$.hits[3].url"), F.lit("")).alias("last_url"))


def web_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers of the web: ranked hits with marks, counts of adverts and trackers, and an instant answer."""
    pages = _result_pages(spark, sf_dir)
    queries = pages.select("query_id", F.when(F.col("query_id") % 4 == 1, _text(F.col("query_id"), " km to m")).otherwise(_text("page about ", F.col("query_id"))).alias("query"))
    answers = respond(queries, "all", "hybrid", 3, {"web": pages})
    pick = lambda path: F.coalesce(F.get_json_object("response", path), F.lit(""))
    return answers.select("query_id", pick("$.mode").alias("mode"), pick("$.total_hits").cast("long").alias("total_hits"), pick("$.ads_blocked_count").cast("long").alias("ads"), pick("$.trackers_purged_count").cast("long").alias("trackers"), pick("$.instant_answer.title").alias("answer"), pick("$.hits[0].url").alias("first_url"), pick("$.hits[0].snippet").alias("first_snippet"))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    product = F.struct(F.col("p_name").alias("title"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")).alias("brand"), F.col("p_retailprice").alias("price"), F.col("p_type").alias("description"), (F.col("p_size") / 10).alias("rating"))
    groups = _table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 20).cast("long").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", product.alias("p")))).alias("ps"))
    return groups.select("query_id", F.to_json(F.struct(F.transform(F.slice("ps", F.lit(1), F.lit(5)), lambda x: x["p"]).alias("products"))).alias("json"))


def shopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five products of a catalogue for each query, and shop links after them."""
    key = F.col("p_partkey")
    shop = F.element_at(F.array(*[F.lit(x) for x in ("www.amazon.com", "shop.example", "www.bestbuy.com", "ebay.example", "www.walmart.com", "target.example", "www.Books.example", "newegg.com", "bhphotovideo.example")]), (key % 9 + 1).cast("int"))
    item = _text('<li class="b_algo"><h2><a href="https://', shop, "/p?utm_source=x&amp;id=", key, '">', F.col("p_name"), F.when(key % 4 == 0, _text(" $", F.format_string("%.2f", "p_retailprice"))).otherwise(""), "</a></h2><p>", F.when(key % 4 == 1, _text("now $", F.col("p_size"), " only")).otherwise("cheap"), "</p></li>")
    shops = _grouped(_table(spark, sf_dir, "part"), F.floor(key / 20), "p_partkey", item, "html")
    return P.shopping_results(P.catalog_products(_catalog(spark, sf_dir)), P.shop_results(shops), top_k=17).drop("thumb_url")


def suggestion_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions that a service has sent, eight at most."""
    groups = _table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 50).alias("query_id")).agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    sent = groups.select("query_id", F.concat(F.lit('["q", '), F.to_json("names"), F.lit(', {"x": 1}]')).alias("json"))
    return P.suggestion_lists(sent)


def summary_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    kind = F.when(key % 4 == 0, "disambiguation").when(key % 4 == 1, "description").otherwise("standard")
    body = F.struct(kind.alias("type"), F.col("n_name").alias("title"), F.when(key % 5 == 2, "").otherwise(_text('About "', F.col("n_name"), '"')).alias("extract"), F.struct(F.struct(_text("https://en.wikipedia.org/wiki/", F.col("n_name")).alias("page")).alias("desktop")).alias("content_urls"))
    return P.summary_card(_table(spark, sf_dir, "nation").select(key.alias("query_id"), F.to_json(body).alias("json")))


def visual_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    item = _text("<a m='{murl&quot;:&quot;https://m", page % 7, ".example/", page, ".jpg&quot;,&quot;", F.when(page % 10 < 6, _text("t&quot;:&quot;Match ", page, "&quot;")).otherwise(""), "}'></a>")
    return P.visual_matches(_grouped(_table(spark, sf_dir, "pages"), F.floor(page / 20), "page_id", item, "html"))


def card_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    meta = F.when(page % 3 == 0, _text('<META charset="x" name="description" lang="en" content=" Described &lt;', page, '&gt; ">')).when(page % 3 == 1, _text("<meta property='og:description' data-x content='Open ", page, "'>")).otherwise("")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.concat(meta, "html").alias("html"))
    return P.page_card(pages).select("page_id", "snippet", "display_url")


def image_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of images: format, size and links."""
    key, number = F.col("p_partkey"), lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(F.col("p_size") * 10), number(key + 1), F.lit("0806000000"))
    content = F.when(key % 4 == 0, png).when(key % 4 == 1, "524946460000000057454250").when(key % 4 == 2, "FFD8FFE0").otherwise("89504E470D0A1A0A00")
    images = P.image_info(_table(spark, sf_dir, "part").select("p_partkey", F.unhex(content).alias("content")))
    links = P.reverse_search_links(_text("https://img.example/a b/", key, "?x=1"))
    return images.select("p_partkey", "format", "width", "height", "aspect_ratio", "size_kb", P.data_uri(F.col("format"), F.col("content")).alias("data_uri"), *[F.element_at(links, k).alias(k) for k in P.REVERSE_SEARCH])


# --- tools ------------------------------------------------------------------------------------------------------
def tool_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    kinds = [_text(size, " km to miles"), _text(size, " C to F"), _text(size, " mb in KB"), _text(size, "% of ", key), _text("(", size, " + 2) * 3 - 7 / 2"), _text("words about ", size), _text("sqrt(", size, ") + 2^3"), _text(size, " fahrenheit to celsius")]
    asked = kinds[-1]
    for i, kind in enumerate(kinds[:-1]):
        asked = F.when(key % 8 == i, kind).otherwise(asked)
    queries = _table(spark, sf_dir, "part").select(key.alias("query_id"), asked.alias("query"))
    summaries = _table(spark, sf_dir, "part").where(key % 2 == 1).select(key.alias("query_id"), F.col("p_name").alias("title"), F.col("p_type").alias("extract"), F.lit("https://e.example").alias("url"))
    return instant_answers(queries, summaries=summaries).select("query_id", "title", "extract", "url", "source", "kind")


_FAMILIES = {"length": list(LENGTH), "weight": list(WEIGHT), "data": list(DATA)}


def unit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit into every other one of its family, over and over, in the sizes of the parts."""
    key, size = F.col("p_partkey"), F.col("p_size")
    parts = _table(spark, sf_dir, "part")
    out = []
    for family, units in _FAMILIES.items():
        names, n = F.array(*[F.lit(x) for x in units]), len(units)
        source, target = F.element_at(names, (key % n + 1).cast("int")), F.element_at(names, (F.floor(key / n) % n + 1).cast("int"))
        asked = _text(size, ".5 ", source, F.when(key % 2 == 0, " to ").otherwise(" in "), target)
        out.append(parts.select("p_partkey", F.lit(family).alias("family"), conversion(asked)["result"].alias("result")))
    return out[0].unionByName(out[1]).unionByName(out[2])


# --- texts ------------------------------------------------------------------------------------------------------
def unescaped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    raw = _text("&#", page % 26 + 65, ";&#x", F.hex(page % 26 + 97), "; &Eacute;&eacute; &#128512;&#x000041; &#38;lt; &amp;amp; &lt &nosuch; &copy;", page, " & x&#0;")
    return _table(spark, sf_dir, "pages").select("page_id", unescape_html(raw).alias("text"))


def marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents with some words marked; words of one letter aren't."""
    terms = F.array(*[F.lit(x) for x in ("THE", "de", "a", "sta-te", "src")])
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(highlight(F.coalesce("text", F.lit("")), terms)).alias("marked_md5"))


def token_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_offsets(_table(spark, sf_dir, "documents"), "doc_id", "text", stemming=False)
    return found.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.sum("position").alias("positions"), F.sum("start_char").alias("starts"), F.sum("end_char").alias("ends"), F.sum(F.char_length("raw")).alias("letters"))


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of all conversations, and their stems."""
    words = _table(spark, sf_dir, "conversations").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TOKEN), F.lit(0)))).alias("word")).distinct()
    return words.withColumn("stem", stem(F.col("word")))


def _sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""), " ")
    text = _text("Intro ", F.col("lang"), "\n# ", F.col("source"), "\n", body, "\n## Part ", F.col("doc_id"), "\n", body, "\n```\n# no heading\n```\n#### Deep\nlast words\n# End  \n\nof ", F.col("doc_id"))
    return _table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.when(F.col("doc_id") % 2 == 0, _text("Title ", F.col("lang"))).alias("title"))


def heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunk_documents(_sectioned(spark, sf_dir), title_col="title")
    return cut.select("doc_id", "chunk_index", F.array_join("headings", " > ").alias("headings"), "start_line", "end_line", "token_count", F.md5("content").alias("content_md5"))


# --- files and stores -------------------------------------------------------------------------------------------
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text file for each nation, written and found again, with hash and size."""
    root = new_folder(spark, "files")
    lines = _table(spark, sf_dir, "nation").select("n_nationkey", _text(F.col("n_name"), " é ", F.col("n_regionkey")).alias("line"))
    lines.write.partitionBy("n_nationkey").text(root)
    return read_directory(spark, root).select("file_hash", "file_size", F.regexp_replace("text", "\n$", "").alias("text"))


#: Stores in the shared folder, by application and tables, and the statuses of their second round.
_STORES: dict[tuple, tuple[Store, DataFrame]] = {}


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[Store, DataFrame]:
    """A store after two rounds: all documents, then those of which some have changed, one path that can't be read, and some deleted. Made once a session."""
    key = (spark.sparkContext.applicationId, files_of(spark, f"{sf_dir}/documents.parquet"))
    if key not in _STORES:
        _STORES[key] = _two_rounds(spark, sf_dir)
    return _STORES[key]


def _two_rounds(spark: SparkSession, sf_dir: str) -> tuple[Store, DataFrame]:
    store = Store(spark, new_folder(spark, "store"))
    docs = _table(spark, sf_dir, "documents")
    path = _text("corpus/", F.col("source"), "/", F.col("doc_id"), ".md")
    named = lambda text: docs.select(path.alias("file_path"), _text(F.col("doc_id"), ".md").alias("file_name"), F.sha2(text, 256).alias("file_hash"), F.octet_length(text).cast("long").alias("file_size"), text.alias("text"))
    text = F.coalesce("text", F.lit(""))
    vectors = lambda chunks: chunks.select("chunk_id", F.array(F.char_length("content").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    store.ingest(named(text), vectors)
    changed = F.when(F.col("doc_id") % 10 == 0, F.concat(text, F.lit(" and more words"))).otherwise(text)
    files = named(changed)
    lost = spark.createDataFrame([("corpus/lost.md",)], "file_path string")
    statuses = store.ingest(files, vectors, listed=files.select("file_path").unionByName(lost))
    store.delete(docs.where(F.col("doc_id") % 17 == 0).select(path.alias("file_path")))
    return store, statuses


def store_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store holds of each document: chunks, their words, and vectors."""
    store, _ = _ingested(spark, sf_dir)
    back = store.rehydrate().join(store.read().chunks.select("chunk_id", "token_count"), "chunk_id")
    return back.groupBy("file_path").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("words"), F.min("start_line").alias("first_line"), F.max("headings").alias("headings"), F.round(F.sum(F.col("embedding")[0].cast("double")), 1).alias("vector_sum"))


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of every chunk of the store, in the order of paths and chunks."""
    store, _ = _ingested(spark, sf_dir)
    return chunk_numbers(store.read().chunks).select("file_path", "chunk_index", "doc_id")


def store_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of the second round, and what the store counts after it."""
    store, statuses = _ingested(spark, sf_dir)
    return ingest_totals(statuses).crossJoin(store.stats())  # one row each


def stored_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents looked up by their paths: one that has changed, one deleted, one never stored."""
    store, _ = _ingested(spark, sf_dir)
    docs = _table(spark, sf_dir, "documents")
    paths = [r.path for r in docs.where(F.col("doc_id").isin(20, 34, 7)).select(_text("corpus/", F.col("source"), "/", F.col("doc_id"), ".md").alias("path")).orderBy("path").collect()]
    found = [store.document(path) for path in [*paths, "corpus/none.md"]]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("file_path", "file_hash", "file_size")


def image_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts share each sample hash of an image made of their brand and type."""
    content = F.concat(F.lit(b"\x89PNG"), F.col("p_brand").cast("binary"), F.col("p_type").cast("binary"))
    images = P.image_info(_table(spark, sf_dir, "part").select("p_brand", "p_type", content.alias("content")))
    return images.groupBy("sample_hash").agg(F.count("*").alias("parts"), F.min("p_brand").alias("brand"), F.min("p_type").alias("type")).drop("sample_hash")


@F.pandas_udf(T.BinaryType())
def _picture(levels: pd.Series, scale: pd.Series) -> pd.Series:
    """A PNG file of 9 x 8 levels, each ``scale`` pixels wide and high; filter and colours go by the scale."""
    out = []
    for some, k in zip(levels, scale, strict=True):
        big = np.kron(np.asarray(some).reshape(8, 9), np.ones((k, k), dtype=int))
        out.append(png(np.repeat(big[:, :, None], 3, axis=2) if k == 2 else big, k % 3))
    return pd.Series(out, index=levels.index, dtype=object)


def image_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of all vectors, and each again in another size and with one area inverted: equal and near hashes."""
    whole = _table(spark, sf_dir, "embeddings").where((F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))
    level = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(128 + 512 * x.cast("double")).cast("double"))).cast("int")
    first = whole.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: level(F.get("embedding", i % 64))).alias("p"))
    inverted = F.transform("p", lambda x, i: F.when(i == F.col("vec_id") % 72, 255 - x).otherwise(x))
    both = first.select((2 * F.col("vec_id")).alias("image_id"), "p", F.lit(1).alias("scale")).unionByName(first.select((2 * F.col("vec_id") + 1).alias("image_id"), inverted.alias("p"), (2 + F.col("vec_id") % 3).cast("int").alias("scale")))
    return neighbours(both.select("image_id", _picture(F.col("p"), F.col("scale")).alias("content")), 4)


# --- numbers ----------------------------------------------------------------------------------------------------
def value_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upper_latency(_table(spark, sf_dir, "events"), "value", ["event_type"])


def nation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_table(_table(spark, sf_dir, "nation").orderBy(F.desc("n_nationkey")), ["n_nationkey", "n_name"])


def pooled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label, two of three vectors counted, at length 1."""
    rows = _table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", F.when(F.col("vec_id") % 3 == 0, 0.0).otherwise(1.0).alias("mask"))
    packed = rows.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding", "mask"))).alias("xs"))
    pooled = packed.select("label", mean_pooled(F.transform("xs", lambda x: x["embedding"]), F.transform("xs", lambda x: x["mask"])).alias("v"))
    return pooled.select("label", F.posexplode("v").alias("dim", "value")).withColumn("value", F.round("value", 5))


def _load_encoder():
    """A model of two numbers, for the interface: the letters and the words of a text, one token each."""

    def encode(texts: list[str]) -> np.ndarray:
        hidden = np.array([[[len(t), 0.0], [0.0, 1.0 + len(t.split())], [9.0, 9.0]] for t in texts], dtype=np.float32)
        return pooled(hidden, np.tile([1, 1, 0], (len(texts), 1)))

    return encode


def _load_scorer():
    return lambda pairs: np.array([(len(q) - len(t)) / 4 for q, t in pairs])


def encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of whole texts by a model that each worker loads once."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ").alias("content"))
    vectors = with_vectors(docs, _load_encoder, dimensions=2)
    return vectors.select("doc_id", *[F.round(F.col("embedding")[i].cast("double"), 3).alias(f"v{i}") for i in range(2)])


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of pairs by a model that each worker loads once."""
    return _table(spark, sf_dir, "part").select("p_partkey", scorer(_load_scorer)(F.col("p_name"), F.col("p_type")).alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "url_hops": url_hops, "address_queries": address_queries, "serp_results": serp_results, "serp_counts": serp_counts, "serp_with_fallback": serp_with_fallback, "web_ranking": web_ranking,
    "record_results": record_results, "image_cards": image_cards, "media_images": media_images, "video_cards": video_cards, "news_items": news_items, "json_responses": json_responses, "web_responses": web_responses, "shopping": shopping,
    "suggestion_lists": suggestion_lists, "summary_cards": summary_cards, "visual_matches": visual_matches, "card_descriptions": card_descriptions, "image_bytes": image_bytes,
    "tool_answers": tool_answers, "unit_table": unit_table, "unescaped_titles": unescaped_titles, "marked_texts": marked_texts, "token_places": token_places, "conversation_stems": stems, "heading_chunks": heading_chunks,
    "file_scan": file_scan, "store_chunks": store_chunks, "store_totals": store_totals, "chunk_ids": chunk_ids, "stored_document": stored_document, "image_samples": image_samples, "image_neighbours": image_neighbours, "encoded_texts": encoded_texts, "pair_scores": pair_scores, "value_p95": value_p95, "nation_table": nation_table, "pooled_labels": pooled_labels,
}
