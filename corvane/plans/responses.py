"""One call for a batch of queries: dispatch by category, and the answer of each query as JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import highlight, stripped, terms
from corvane.operators.fusion import lexical_overlap
from corvane.plans.search import Scorer, SearchEngine, instant_answers, rank_web, with_snippets
from corvane.sources import payloads as P

PAYLOAD_CATEGORIES = ("images", "videos", "news", "shopping")
#: Results below which a fallback is asked, and how many of it are taken.
LEAST_WEB, LEAST_VIDEOS, LEAST_IMAGES, FALLBACK_WEB = 3, 4, 4, 5


def route(category: str = "all", mode: str = "web") -> str:
    """Where a request goes: images, videos, news, shopping, local, or all (the web), whatever else is asked for."""
    if category in PAYLOAD_CATEGORIES:
        return category
    return "local" if "local" in (category, mode) else "all"


def _packed(hits: DataFrame, kind: str, order: str, fields: list[Column | str]) -> DataFrame:
    """(query_id, hits): the hits of each query in order, as structs."""
    one = F.struct(F.lit(kind).alias("type"), *fields)
    listed = hits.select("query_id", F.col(order).alias("at"), one.alias("hit")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "hit"))).alias("hits"))
    return listed.select("query_id", F.transform("hits", lambda x: x["hit"]).alias("hits"))


def _payload_hits(category: str, sources: Mapping[str, DataFrame], top_k: int) -> DataFrame:
    if category == "images":
        found = P.image_results(sources["images"], top_k=2 * top_k)
        if "media" in sources:
            found = P.with_fallback(found, P.media_results(sources["media"]), LEAST_IMAGES)
            found = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("position"))).where(F.col("n") <= 2 * top_k)
        return _packed(found, "image", "position", ["title", "image_url", "thumb_url", "source_url", "domain", "width", "height"])
    if category == "videos":
        found = P.video_results(sources["videos"], top_k=top_k)
        if "video_titles" in sources:
            found = P.with_fallback(found, P.video_titles(sources["video_titles"]), LEAST_VIDEOS)
            found = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("position"))).where(F.col("n") <= top_k)
        return _packed(found, "video", "position", ["title", "url", "thumb_url", "platform", "duration", "channel"])
    if category == "news":
        return _packed(P.news_results(sources["news"], top_k=top_k), "news", "position", ["title", "url", "source", "source_url", "pub_date", "snippet"])
    found = P.shopping_results(P.catalog_products(sources["catalog"]), P.shop_results(sources["shops"]), top_k=top_k)
    return _packed(found, "shopping", "position", ["title", "url", "store", "price", "snippet", "domain", "thumb_url", "rating"])


def respond(queries: DataFrame, category: str = "all", mode: str = "web", top_k: int = 15, sources: Mapping[str, DataFrame] | None = None, engine: SearchEngine | None = None, scorer: Scorer | None = lexical_overlap, reranked: bool = True) -> DataFrame:
    """(query_id, response): the JSON answer of every query (query_id, query).

    ``sources``: the payloads that the caller has fetched, by name: images
    (query_id, query, html), media (json), videos and video_titles (html), news (xml),
    catalog (json), shops (html), web (html), encyclopedia (json), and for
    instant answers direct (cards of page_card by query_id) and summaries
    (summary_card).  ``engine`` answers local requests.  A blank query has no
    hits.
    """
    sources, where = sources or {}, route(category, mode)
    asked = queries.select("query_id", stripped(F.coalesce("query", F.lit(""))).alias("query"))
    some = asked.where("query <> ''")
    zero = F.lit(0).cast("long")
    extra: dict[str, Column] = {"instant_answer": F.lit(None).cast("string"), "ads_blocked_count": zero, "trackers_purged_count": zero}
    if where in PAYLOAD_CATEGORIES:
        found = _payload_hits(where, sources, top_k)
        extra["trackers_purged_count"] = F.size("hits").cast("long")
    elif where == "local":
        if engine is None:
            raise ValueError("local requests need an engine")
        hits = with_snippets(engine.search(some, "hybrid", top_k, reranked=reranked))
        found = _packed(hits, "local", "rank", ["doc_id", "rank", "score", "title", F.lit("#").alias("url"), F.col("title").alias("display_url"), F.lit("local").alias("domain"), "snippet", "content", "provenance"])
    else:
        found, extra = _web(some, sources, scorer if reranked else None, top_k)
    joined = asked.join(found, "query_id", "left")
    hits = F.when(F.col("query") != "", F.col("hits"))
    whole = joined.withColumn("hits", F.coalesce(hits, F.array().cast(found.schema["hits"].dataType)))
    shown = F.struct("query", F.lit(where).alias("category"), F.lit({"local": "hybrid", "all": "web"}.get(where)).cast("string").alias("mode"), F.size("hits").cast("long").alias("total_hits"), "hits", *[value.alias(name) for name, value in extra.items()])
    return whole.select("query_id", F.to_json(shown, {"ignoreNullFields": "false"}).alias("response"))


def _web(queries: DataFrame, sources: Mapping[str, DataFrame], scorer: Scorer | None, top_k: int) -> tuple[DataFrame, dict[str, Column]]:
    """(query_id, hits, answer, ads, trackers) of the web, and the fields of the answer that they give."""
    results = P.web_results(sources["web"])
    counts = P.blocking_counts(results)
    organic = results.where(~F.col("blocked"))
    if "encyclopedia" in sources:
        organic = P.with_fallback(organic, P.encyclopedia_results(sources["encyclopedia"]), LEAST_WEB, most=FALLBACK_WEB)
    ranked = rank_web(organic, queries, sources.get("direct"), scorer, top_k).join(queries, "query_id")
    marked = ranked.withColumn("snippet", highlight(F.col("snippet"), terms(F.col("query"))))
    provenance = F.struct(F.col("score").alias("rerank_score"), "domain", F.col("url").alias("clean_url")).alias("provenance")
    hits = _packed(marked, "web", "rank", ["rank", "score", "title", "url", "display_url", "domain", "snippet", F.col("trackers").alias("trackers_purged"), F.lit(True).alias("is_organic"), provenance])
    answers = instant_answers(queries, sources.get("direct"), sources.get("summaries"))
    one = answers.select("query_id", F.struct("title", "extract", "url", "source", F.col("kind").alias("answer_type")).alias("answer"))
    table = queries.select("query_id").join(hits, "query_id", "left").join(one, "query_id", "left").join(counts, "query_id", "left")
    return table, {"instant_answer": F.col("answer"), "ads_blocked_count": F.coalesce("ads_blocked", F.lit(0)).cast("long"), "trackers_purged_count": F.coalesce("trackers_stripped", F.lit(0)).cast("long")}
