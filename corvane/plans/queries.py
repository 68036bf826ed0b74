"""The registered queries over the driver's tables, and SQL written beside them by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import exploded_tokens, snippet, stem, strip_tags, terms, unescape_html, word_count
from corvane.functions.tools import conversion, formula, percentage
from corvane.functions.url import clean_url, display_url, domain, is_sponsored
from corvane.operators.chunks import chunk_windows
from corvane.operators.containment import documents_holding
from corvane.operators.fusion import lexical_overlap, reciprocal_rank_fusion, relative_score_fusion
from corvane.operators.lexical import bm25, bm25_work, build_index, completed, completions, idf, query_terms, suggestions
from corvane.operators.metrics import metric_means, retrieval_metrics
from corvane.operators.pivots import PivotIndex
from corvane.operators.segments import StoredIndex
from corvane.operators.trained import PairRanker, WordVectors, pair_features
from corvane.operators.vectors import cosine_top_k
from corvane.plans import payload_queries, payload_sql
from corvane.plans.payload_sql import STOP, escaped, marked
from corvane.plans.search import SearchEngine, Telemetry
from corvane.scratch import files_of, written
from corvane.sources import evaluation
from corvane.sources.payloads import page_card


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Indices stored in the shared folder, by application, table (as its files are now) and stemming.
_STORED: dict[tuple, StoredIndex] = {}


def _index(spark: SparkSession, sf_dir: str, stemming: bool = False) -> StoredIndex:
    """The index of the documents: built and stored once in a session, and used by all queries after that."""
    key = (spark.sparkContext.applicationId, sf_dir, stemming, files_of(spark, f"{sf_dir}/documents.parquet"))
    if key not in _STORED:
        _STORED[key] = build_index(_table(spark, sf_dir, "documents"), stemming=stemming, positions=False).stored()
    return _STORED[key]


def _items(spark: SparkSession, sf_dir: str, stemming: bool = False) -> DataFrame:
    return query_terms(_table(spark, sf_dir, "benchmark"), "item_id", "text", stemming=stemming)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return items.join(_vectors(spark, sf_dir), F.col("query_id") == F.col("doc_id")).select("query_id", "embedding")


def token_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the hundred commonest tokens."""
    tokens = exploded_tokens(_table(spark, sf_dir, "documents"), "doc_id", "text", stemming=False)
    return tokens.groupBy(F.col("normalized").alias("term")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(100)


def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lengths = docs.select("lang", F.size(terms(F.col("text"))).alias("n"))
    return lengths.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("total_terms"), F.round(F.avg("n"), 4).alias("avg_doc_len"))


def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return index.vocabulary.crossJoin(F.broadcast(index.corpus_stats.select("n_docs"))).select("term", "df", F.round(idf(F.col("df"), F.col("n_docs")), 4).alias("idf"))


def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(_index(spark, sf_dir), _items(spark, sf_dir), 10)


def bm25_stemmed_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(_index(spark, sf_dir, True), _items(spark, sf_dir, True), 10)


def bm25_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = bm25(_index(spark, sf_dir), _items(spark, sf_dir), 3, explain=True)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("term_contributions")), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"]))), " ")
    return hits.select("query_id", "doc_id", "rank", F.array_join("matched_terms", " ").alias("matched"), shown.alias("contributions"))


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = exploded_tokens(_table(spark, sf_dir, "documents"), "doc_id", "text", stemming=False).select(F.col("normalized").alias("word")).distinct()
    return words.withColumn("stem", stem(F.col("word")))


def conversation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").where(F.col("role") == "user").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), "text")
    return bm25(_index(spark, sf_dir), query_terms(turns, "query_id", "text", stemming=False), 3)


def cosine_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    asked = vectors.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "embedding")
    return cosine_top_k(asked, vectors, 5)


def pivot_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cosine_top5 finds, by an index that skips clusters."""
    vectors = _vectors(spark, sf_dir)
    asked = vectors.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "embedding")
    return PivotIndex.build(vectors).search(asked, 5)


def neighbour_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the nearest ten vectors (itself among them) share a query vector's label."""
    vectors = _vectors(spark, sf_dir)
    asked = vectors.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "embedding")
    labels = vectors.select("doc_id", "label")
    hits = cosine_top_k(asked, vectors, 10).join(labels, "doc_id")
    own = labels.select(F.col("doc_id").alias("query_id"), F.col("label").alias("own"))
    return hits.join(own, "query_id").groupBy("query_id").agg(F.sum((F.col("label") == F.col("own")).cast("int")).alias("same_label"))


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return bm25(_index(spark, sf_dir), _items(spark, sf_dir), 30), cosine_top_k(_item_vectors(spark, sf_dir), _vectors(spark, sf_dir), 30)


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reciprocal_rank_fusion(*_lists(spark, sf_dir), top_k=10)
    return out.select("query_id", "doc_id", "rank", "score", F.coalesce("bm25_rank", F.lit(0)).alias("bm25_rank"), F.coalesce("dense_rank", F.lit(0)).alias("dense_rank"))


def hybrid_rsf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_score_fusion(*_lists(spark, sf_dir), top_k=10).select("query_id", "doc_id", "rank", "score")


def _judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item's text: grade 2 if labelled of good quality, else 1."""
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    held = documents_holding(_table(spark, sf_dir, "documents"), items)
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    return held.join(labels, "doc_id", "left").select("query_id", "doc_id", (1 + F.coalesce("quality", F.lit(0))).cast("double").alias("grade"))


def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_metrics(bm25(_index(spark, sf_dir), _items(spark, sf_dir), 20), _judgements(spark, sf_dir), 10)


def retrieval_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_means(retrieval_quality(spark, sf_dir))


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_windows(_table(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "token_count", F.md5("content").alias("content_md5"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marked snippet of the best document of every item."""
    best = bm25(_index(spark, sf_dir), _items(spark, sf_dir), 1)
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    joined = best.join(items, "query_id").join(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return joined.select("query_id", "doc_id", snippet(F.col("text"), terms(F.col("query"))).alias("snippet"))


def clean_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _table(spark, sf_dir, "pages").select("page_id", clean_url(F.col("url")).alias("u"))
    return cleaned.select("page_id", "u.clean_url", "u.trackers_removed", "u.is_ad", domain(F.col("u.clean_url")).alias("domain"), display_url(F.col("u.clean_url")).alias("display_url"))


def trackers_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _table(spark, sf_dir, "pages").select(clean_url(F.col("url")).alias("u"))
    return cleaned.groupBy(domain(F.col("u.clean_url")).alias("domain")).agg(F.count("*").alias("pages"), F.sum("u.trackers_removed").alias("trackers"), F.sum(F.col("u.is_ad").cast("int")).alias("ads"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_card(_table(spark, sf_dir, "pages")).select("page_id", "title", "domain", "snippet")


def page_text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    text = unescape_html(strip_tags(F.col("html")))
    return pages.select("page_id", F.char_length(text).alias("chars"), word_count(text).alias("words"), F.regexp_count("html", F.lit('class="ad"')).alias("ads"), is_sponsored(F.col("url"), F.col("html")).alias("sponsored"))


def new_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns whose content is new: no earlier turn has the same hash."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    first = turns.groupBy("sha256").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    return turns.join(first, "sha256").where(F.struct("conv_id", "turn") == F.col("first")).select("conv_id", "turn", "sha256")


def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(" km to miles")).alias("q"))
    return asked.select("p_partkey", conversion(F.col("q"))["result"].alias("result"))


def percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("15% of "), F.format_string("%.2f", F.col("o_totalprice"))).alias("q"))
    return asked.select("o_orderkey", percentage(F.col("q"))["result"].alias("result"))


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("sqrt(16) * ("), F.col("p_size").cast("string"), F.lit(" + 2^3) / 7")).alias("q"))
    return asked.select("p_partkey", formula(F.col("q"))["result"].alias("result"))


def prefix_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggestions(_index(spark, sf_dir), "th")


def _engine(spark: SparkSession, sf_dir: str) -> SearchEngine:
    """All documents with titles, their index and vectors, and the stand-in scorer."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.concat_ws(" ", "source", "lang").alias("title"))
    vectors = _vectors(spark, sf_dir).select("doc_id", "embedding")
    return SearchEngine(docs, _index(spark, sf_dir), vectors, lambda asked: asked.join(_item_vectors(spark, sf_dir), "query_id").select("query_id", "embedding"), lexical_overlap, stemming=False)


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan: fused, reranked by the stand-in scorer, with titles; the three best of every item."""
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _engine(spark, sf_dir).search(asked, "hybrid", 3).select("query_id", "rank", "doc_id", "score", "title", F.col("provenance.first_score").alias("fused_score"))


def search_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that each stage of hybrid_search hands on, as noted while it ran."""
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    noted = Telemetry()
    _engine(spark, sf_dir).search(asked, "hybrid", 3, telemetry=noted).write.format("noop").mode("overwrite").save()
    return noted.table(spark).select("stage", "rows")


def completion_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of the first three letters of all part names, and of their first words and what follows them."""
    names = _table(spark, sf_dir, "part").select("p_name")
    asked = names.select(F.explode(F.array(F.left("p_name", F.lit(3)), F.split("p_name", " ")[0])).alias("prefix")).distinct()
    known = _index(spark, sf_dir).vocabulary
    return completed(completions(known), asked, known)


def search_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings that the index holds of each item's terms, and whether the search for the best ten reads no more than these."""
    work = bm25_work(_index(spark, sf_dir), _items(spark, sf_dir), 10)
    return work.select("query_id", "postings", (F.col("read") <= F.col("postings")).alias("within"))


def index_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary after every seventh document has gone and every fifth has been replaced."""
    docs = _table(spark, sf_dir, "documents")
    less = _index(spark, sf_dir).without(docs.where(F.col("doc_id") % 7 == 0))
    new = docs.where((F.col("doc_id") % 5 == 1) & (F.col("doc_id") % 7 != 0)).select("doc_id", F.concat_ws(" ", F.lit("Replaced"), "lang", "source").alias("text"))
    return less.plus(build_index(new, stemming=False, positions=False)).vocabulary


def indexed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that the index has, after some have gone and all of another index have been cleared."""
    index = _index(spark, sf_dir)
    less = index.without(_table(spark, sf_dir, "documents").where(F.col("doc_id") % 3 == 0))
    return less.doc_ids.unionByName(index.cleared().doc_ids)


def unfiltered_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of the conversations with stopwords, unstemmed."""
    turns = _table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    return build_index(turns, "id", "text", stopwords=(), stemming=False, positions=False).vocabulary


def term_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each term stands in the benchmark items, and their lengths."""
    postings = build_index(_table(spark, sf_dir, "benchmark"), "item_id", "text", stemming=False).postings
    return postings.select("term", F.col("doc_id").alias("item_id"), "term_freq", "doc_len", F.array_join(F.transform("positions", lambda x: x.cast("string")), " ").alias("positions"))


def engine_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's fusion of scores; the ten best."""
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _engine(spark, sf_dir).ranked(asked, "relative").where("rank <= 10").select("query_id", "doc_id", "rank", "score")


def engine_without_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hybrid search gives where there are no vectors, no encoder and no scorer: the lexical hits."""
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.lit(None).cast("string").alias("title"))
    return SearchEngine(docs, _index(spark, sf_dir), stemming=False).search(asked, "hybrid", 3).select("query_id", "rank", "doc_id", "score", "title", F.md5("content").alias("content_md5"))


#: Word vectors of the documents, by application and table (as its files are now).
_VECTORS: dict[tuple, WordVectors] = {}


def _word_vectors(spark: SparkSession, sf_dir: str) -> WordVectors:
    """The word vectors of the documents: fitted once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, files_of(spark, f"{sf_dir}/documents.parquet"))
    if key not in _VECTORS:
        _VECTORS[key] = WordVectors.fit(_table(spark, sf_dir, "documents"))
    return _VECTORS[key]


def learned_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of BM25 and of a ranker, for five words from the middle of each item, on items that the ranker hasn't learned from.

    It learns from those whose CRC-32 of the id is even, and is judged on the others.
    """
    pieces = F.split("text", " ")
    five = F.array_join(F.slice(pieces, F.greatest(F.lit(1), F.floor(F.size(pieces) / 2).cast("int") - 1), F.lit(5)), " ")
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), five.alias("query"))
    model, docs = _word_vectors(spark, sf_dir), _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    hits = written(bm25(_index(spark, sf_dir), query_terms(items, "query_id", "query", stemming=False), 20), "hits")
    asked = model.vector(items, "query", "query_vector")
    found = model.vector(hits.join(docs, "doc_id"), "content", "doc_vector").join(asked, "query_id")
    features = written(pair_features(found), "features")
    judged = written(_judgements(spark, sf_dir), "judged")
    learned = F.crc32(F.col("query_id").cast("string").cast("binary")) % 2 == 0
    ranker = PairRanker.fit(features.where(learned), judged.where(learned))
    means = lambda name, ranked: metric_means(retrieval_metrics(ranked.where(~learned), judged.where(~learned), 10)).select(F.lit(name).alias("ranking"), "*")
    return means("bm25", hits).unionByName(means("learned", ranker.ranked(features.where(~learned))))


def text_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every hundredth document beside that of its nearest other document, by trained vectors of whole texts."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    vectors = written(_word_vectors(spark, sf_dir).vector(docs).select("doc_id", "lang", "embedding"), "vectors")
    asked = vectors.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "embedding")
    near = cosine_top_k(asked, vectors, 2).where(F.col("query_id") != F.col("doc_id"))
    first = near.groupBy("query_id").agg(F.min(F.struct("rank", "doc_id", "score")).alias("n")).select("query_id", "n.doc_id", "n.score")
    own = vectors.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("own"))
    return first.join(vectors.select("doc_id", "lang"), "doc_id").join(own, "query_id").select("query_id", "doc_id", "score", "own", "lang")


def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation set of six documents and six queries, ranked by BM25."""
    docs, queries, judged = evaluation.evaluation_set(spark)
    engine = SearchEngine.of(docs, stemming=False)
    return retrieval_metrics(engine.search(queries, "bm25", 5, reranked=False), judged, 5)


def event_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user and type: keep-first by an order."""
    order = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    ranked = _table(spark, sf_dir, "events").withColumn("n", F.row_number().over(order)).where("n = 1")
    return ranked.select("user_id", "event_type", "event_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "token_frequencies": token_frequencies,
    "corpus_statistics": corpus_statistics,
    "term_idf": term_idf,
    "bm25_top10": bm25_top10,
    "bm25_stemmed_top10": bm25_stemmed_top10,
    "bm25_explained": bm25_explained,
    "stems": stems,
    "conversation_search": conversation_search,
    "cosine_top5": cosine_top5,
    "pivot_top5": pivot_top5,
    "neighbour_labels": neighbour_labels,
    "hybrid_rrf": hybrid_rrf,
    "hybrid_rsf": hybrid_rsf,
    "hybrid_search": hybrid_search,
    "retrieval_quality": retrieval_quality,
    "retrieval_means": retrieval_means,
    "chunk_table": chunk_table,
    "snippets": snippets,
    "clean_urls": clean_urls,
    "trackers_by_domain": trackers_by_domain,
    "page_titles": page_titles,
    "page_text_sizes": page_text_sizes,
    "new_turns": new_turns,
    "unit_conversions": unit_conversions,
    "percentages": percentages,
    "formulas": formulas,
    "prefix_suggestions": prefix_suggestions,
    "learned_ranking": learned_ranking,
    "text_neighbours": text_neighbours,
    "latest_events": event_sources,
    "search_stages": search_stages,
    "completion_lists": completion_lists,
    "search_work": search_work,
    "indexed_ids": indexed_ids,
    "index_updates": index_updates,
    "evaluation_metrics": evaluation_metrics,
    "unfiltered_terms": unfiltered_terms,
    "term_positions": term_positions,
    "engine_relative": engine_relative,
    "engine_without_vectors": engine_without_vectors,
    **payload_queries.QUERIES,
}

_PATTERN = "'[a-zA-Z0-9]+(?:[_\\-][a-zA-Z0-9]+)*'"


def _tokens(name: str, table: str, key: str, where: str = "true") -> str:
    return f"{name} AS (SELECT id, term FROM (SELECT {key} AS id, lower(unnest(regexp_extract_all(coalesce(text, ''), {_PATTERN}))) AS term FROM {table} WHERE {where}) WHERE term NOT IN ({STOP}))"


_BM25 = """
tf AS (SELECT term, id, count(*) AS tf FROM doc_tok GROUP BY ALL),
len AS (SELECT d.doc_id AS id, count(t.term) AS dl FROM documents d LEFT JOIN doc_tok t ON t.id = d.doc_id GROUP BY 1),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
ask AS (SELECT DISTINCT id AS query_id, term FROM query_tok),
part AS (
  SELECT query_id, tf.id AS doc_id, tf.term,
         ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS part
  FROM ask JOIN tf USING (term) JOIN df USING (term) JOIN len ON len.id = tf.id, corpus),
total AS (SELECT query_id, doc_id, round(sum(part), 9) AS total FROM part GROUP BY ALL),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, doc_id) AS rank FROM total)"""
_SEARCH = f"WITH {_tokens('doc_tok', 'documents', 'doc_id')}, {_tokens('query_tok', 'benchmark', 'item_id')},{_BM25}"
_DENSE = """,
asked AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON vec_id = item_id),
cosine AS (
  SELECT query_id, vec_id AS doc_id, round(list_dot_product(q, v) / sqrt(list_dot_product(q, q) * list_dot_product(v, v)), 9) AS total
  FROM asked, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, doc_id) AS rank FROM cosine)"""
_NEAREST = """
WITH vec AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
near AS (
  SELECT a.vec_id AS query_id, a.label AS own, b.vec_id AS doc_id, b.label, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 9) AS total
  FROM vec a, vec b WHERE a.vec_id % 100 = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, doc_id) AS rank FROM near)
"""
_QUALITY = """,
judged AS (
  SELECT item_id AS query_id, d.doc_id, 1.0 + coalesce(l.quality, 0) AS grade
  FROM documents d JOIN benchmark b ON contains(d.text, b.text) LEFT JOIN labels l ON l.doc_id = d.doc_id),
ideal AS (
  SELECT query_id, sum(CASE WHEN r <= 10 THEN (2 ** grade - 1) / log2(r + 1) ELSE 0 END) AS ideal, count(*) AS relevant
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS r FROM judged) GROUP BY query_id),
found AS (
  SELECT query_id, sum(CASE WHEN rank <= 10 THEN (2 ** grade - 1) / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (rank <= 10) AS hits, min(rank) AS first
  FROM judged JOIN lexical USING (query_id, doc_id) WHERE rank <= 20 GROUP BY query_id),
quality AS (
  SELECT query_id, round(coalesce(dcg / ideal, 0), 4) AS ndcg, round(coalesce(1.0 / first, 0), 4) AS reciprocal_rank,
         round(coalesce(hits / 10.0, 0), 4) AS precision, round(coalesce(hits / relevant, 0), 4) AS recall
  FROM ideal LEFT JOIN found USING (query_id))"""

# Porter's conditions, spelled out once more for the oracle.
_V = "'^(?:[aeiou]|[^aeiou][^aeiouy]*[aeiouy])'"
_M0 = "'^(?:[aeiou]|[^aeiou][^aeiouy]*[aeiouy])[aeiou]*[^aeiou]'"
_M1 = "'^(?:[aeiou]|[^aeiou][^aeiouy]*[aeiouy])[aeiou]*[^aeiou][^aeiouy]*[aeiouy][aeiou]*[^aeiou]'"
_ONE = "'^(?:[aeiou]|[^aeiou][^aeiouy]*[aeiouy])[aeiou]*[^aeiou][^aeiouy]*(?:[aeiouy][aeiou]*)?$'"
_CVC = "'^(?:[aeiou]+[^aeiou][^aeiouy]*|[^aeiou][^aeiouy]*)(?:[aeiouy][aeiou]*[^aeiou][^aeiouy]*)*[aeiouy][^aeiouwxy]$'"
_STEMS = f"""
one AS MATERIALIZED (SELECT word, CASE WHEN word LIKE '%sses' OR word LIKE '%ies' THEN word[:-3] WHEN word LIKE '%s' AND word NOT LIKE '%ss' THEN word[:-2] ELSE word END AS s FROM vocabulary WHERE length(word) > 2),
cut AS MATERIALIZED (
  SELECT word, s, CASE WHEN s LIKE '%eed' THEN NULL WHEN s LIKE '%ed' AND regexp_matches(s[:-3], {_V}) THEN s[:-3]
                       WHEN s LIKE '%ing' AND s NOT LIKE '%ed' AND regexp_matches(s[:-4], {_V}) THEN s[:-4] END AS t FROM one),
two AS MATERIALIZED (
  SELECT word, CASE
    WHEN s LIKE '%eed' THEN CASE WHEN regexp_matches(s[:-4], {_M0}) THEN s[:-2] ELSE s END
    WHEN t IS NULL THEN s
    WHEN t LIKE '%at' OR t LIKE '%bl' OR t LIKE '%iz' THEN t || 'e'
    WHEN length(t) > 1 AND t[-1] = t[-2] AND t[-1] NOT IN ('a', 'e', 'i', 'o', 'u', 'y', 'l', 's', 'z') THEN t[:-2]
    WHEN regexp_matches(t, {_ONE}) AND regexp_matches(t, {_CVC}) THEN t || 'e'
    ELSE t END AS s FROM cut),
three AS MATERIALIZED (SELECT word, CASE WHEN s LIKE '%y' AND regexp_matches(s[:-2], {_V}) THEN s[:-2] || 'i' ELSE s END AS s FROM two),
rule(step, ord, suffix, new) AS MATERIALIZED (VALUES
  (2, 1, 'ational', 'ate'), (2, 2, 'tional', 'tion'), (2, 3, 'enci', 'ence'), (2, 4, 'anci', 'ance'), (2, 5, 'izer', 'ize'), (2, 6, 'abli', 'able'), (2, 7, 'alli', 'al'),
  (2, 8, 'entli', 'ent'), (2, 9, 'eli', 'e'), (2, 10, 'ousli', 'ous'), (2, 11, 'ization', 'ize'), (2, 12, 'ation', 'ate'), (2, 13, 'ator', 'ate'), (2, 14, 'alism', 'al'),
  (2, 15, 'iveness', 'ive'), (2, 16, 'fulness', 'ful'), (2, 17, 'ousness', 'ous'), (2, 18, 'aliti', 'al'), (2, 19, 'iviti', 'ive'), (2, 20, 'biliti', 'ble'),
  (3, 1, 'icate', 'ic'), (3, 2, 'ative', ''), (3, 3, 'alize', 'al'), (3, 4, 'iciti', 'ic'), (3, 5, 'ical', 'ic'), (3, 6, 'ful', ''), (3, 7, 'ness', ''),
  (4, 1, 'al', ''), (4, 2, 'ance', ''), (4, 3, 'ence', ''), (4, 4, 'er', ''), (4, 5, 'ic', ''), (4, 6, 'able', ''), (4, 7, 'ible', ''), (4, 8, 'ant', ''), (4, 9, 'ement', ''),
  (4, 10, 'ment', ''), (4, 11, 'ent', ''), (4, 12, 'ou', ''), (4, 13, 'ism', ''), (4, 14, 'ate', ''), (4, 15, 'iti', ''), (4, 16, 'ous', ''), (4, 17, 'ive', ''), (4, 18, 'ize', ''), (4, 19, 'ion', '')),
fit2 AS MATERIALIZED (SELECT word, arg_min(suffix, ord) AS x, arg_min(new, ord) AS new FROM (SELECT word, right(s, k) AS suffix FROM three, range(1, 8) AS size(k)) JOIN rule USING (suffix) WHERE step = 2 GROUP BY word),
hit2 AS MATERIALIZED (SELECT word, s, x, new FROM three LEFT JOIN fit2 USING (word)),
four AS MATERIALIZED (SELECT word, CASE WHEN x IS NOT NULL AND regexp_matches(left(s, length(s) - length(x)), {_M0}) THEN left(s, length(s) - length(x)) || new ELSE s END AS s FROM hit2),
fit3 AS MATERIALIZED (SELECT word, arg_min(suffix, ord) AS x, arg_min(new, ord) AS new FROM (SELECT word, right(s, k) AS suffix FROM four, range(1, 8) AS size(k)) JOIN rule USING (suffix) WHERE step = 3 GROUP BY word),
hit3 AS MATERIALIZED (SELECT word, s, x, new FROM four LEFT JOIN fit3 USING (word)),
five AS MATERIALIZED (SELECT word, CASE WHEN x IS NOT NULL AND regexp_matches(left(s, length(s) - length(x)), {_M0}) THEN left(s, length(s) - length(x)) || new ELSE s END AS s FROM hit3),
fit4 AS MATERIALIZED (SELECT word, arg_min(suffix, ord) AS x FROM (SELECT word, right(s, k) AS suffix FROM five, range(1, 8) AS size(k)) JOIN rule USING (suffix) WHERE step = 4 GROUP BY word),
hit4 AS MATERIALIZED (SELECT word, s, x FROM five LEFT JOIN fit4 USING (word)),
six AS MATERIALIZED (
  SELECT word, CASE WHEN x IS NOT NULL AND regexp_matches(left(s, length(s) - length(x)), {_M1}) AND (x <> 'ion' OR s LIKE '%sion' OR s LIKE '%tion')
                    THEN left(s, length(s) - length(x)) ELSE s END AS s FROM hit4),
seven AS MATERIALIZED (SELECT word, CASE WHEN s LIKE '%e' AND (regexp_matches(s[:-2], {_M1}) OR (regexp_matches(s[:-2], {_ONE}) AND NOT regexp_matches(s[:-2], {_CVC}))) THEN s[:-2] ELSE s END AS s FROM six),
stemmed AS MATERIALIZED (
  SELECT word, CASE WHEN s LIKE '%ll' AND regexp_matches(s, {_M1}) THEN s[:-2] ELSE s END AS stem FROM seven
  UNION ALL SELECT word, word FROM vocabulary WHERE length(word) <= 2)"""
_HOST = "CASE WHEN u.host = '' THEN 'web' ELSE u.host END"
_URLS = r"""
WITH part AS (
  SELECT page_id, trim(url) AS url, regexp_extract(trim(url), '^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$', ['scheme', 'host', 'path', 'query', 'fragment']) AS u FROM pages),
pieces AS (SELECT *, [x FOR x IN string_split(u.query, '&') IF x <> ''] AS p FROM part),
kept AS (SELECT *, [x FOR x IN p IF lower(string_split(x, '=')[1]) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'msclkid', 'ref', 'ref_src', 'source')] AS k FROM pieces),
cleaned AS (
  SELECT page_id, u,
         CASE WHEN u.scheme = '' THEN '' ELSE lower(u.scheme) || ':' END || CASE WHEN u.host = '' THEN '' ELSE '//' || u.host END || u.path
         || CASE WHEN len(k) = 0 THEN '' ELSE '?' || array_to_string(k, '&') END || CASE WHEN u.fragment = '' THEN '' ELSE '#' || u.fragment END AS clean_url,
         (len(p) - len(k))::INT AS trackers_removed
  FROM kept)
"""
_TITLE = "trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '<[^>]+>', '', 'g'))"
_REFERENCES = """replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"""

_RRF = """,
fused AS (
  SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.rank, 0) AS bm25_rank, coalesce(b.rank, 0) AS dense_rank,
         round(coalesce(0.5 / (60 + a.rank), 0) + coalesce(0.5 / (60 + b.rank), 0), 9) AS total
  FROM (SELECT * FROM lexical WHERE rank <= 30) a FULL JOIN (SELECT * FROM dense WHERE rank <= 30) b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, doc_id) AS rank FROM fused)"""
_NOT_WORD = r"[^\pL\pM\p{Nd}\p{Pc}]+"
_LITERAL = "(VALUES " + ", ".join(f"({i}, '{text.replace(chr(39), chr(39) * 2)}')" for i, text, _ in evaluation.DOCUMENTS) + ") AS d(doc_id, text)"
_ASKED = "(VALUES " + ", ".join(f"({i}, '{text}', {doc})" for i, (text, doc) in enumerate(evaluation.QUERIES)) + ") AS q(item_id, text, wanted)"

SQL: dict[str, str] = {
    "token_frequencies": f"WITH {_tokens('tok', 'documents', 'doc_id')} SELECT term, count(*) AS n FROM tok GROUP BY term ORDER BY n DESC, term LIMIT 100",
    "corpus_statistics": f"""
WITH {_tokens('tok', 'documents', 'doc_id')}, len AS (SELECT id, count(*) AS n FROM tok GROUP BY id)
SELECT lang, count(*) AS n_docs, sum(coalesce(n, 0))::BIGINT AS total_terms, round(avg(coalesce(n, 0)), 4) AS avg_doc_len FROM documents LEFT JOIN len ON id = doc_id GROUP BY lang""",
    "term_idf": f"""
WITH {_tokens('tok', 'documents', 'doc_id')}, df AS (SELECT term, count(DISTINCT id) AS df FROM tok GROUP BY term)
SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 4) AS idf FROM df, (SELECT count(*) AS n FROM documents)""",
    "bm25_top10": f"{_SEARCH} SELECT query_id, doc_id, rank, round(total, 4) AS score FROM lexical WHERE rank <= 10",
    "bm25_stemmed_top10": f"""
WITH {_tokens('doc_word', 'documents', 'doc_id')}, {_tokens('query_word', 'benchmark', 'item_id')},
vocabulary AS MATERIALIZED (SELECT DISTINCT term AS word FROM (SELECT term FROM doc_word UNION ALL SELECT term FROM query_word)),{_STEMS},
doc_tok AS (SELECT id, stem AS term FROM doc_word JOIN stemmed ON word = term), query_tok AS (SELECT id, stem AS term FROM query_word JOIN stemmed ON word = term),{_BM25}
SELECT query_id, doc_id, rank, round(total, 4) AS score FROM lexical WHERE rank <= 10""",
    "bm25_explained": f"""{_SEARCH}
SELECT query_id, doc_id, rank, string_agg(term, ' ' ORDER BY term) AS matched, string_agg(term || '=' || printf('%.4f', round(part, 4)), ' ' ORDER BY term) AS contributions
FROM lexical JOIN part USING (query_id, doc_id) WHERE rank <= 3 GROUP BY query_id, doc_id, rank""",
    "stems": f"WITH {_tokens('tok', 'documents', 'doc_id')}, vocabulary AS MATERIALIZED (SELECT DISTINCT term AS word FROM tok),{_STEMS} SELECT word, stem FROM stemmed",
    "conversation_search": f"""
WITH {_tokens('doc_tok', 'documents', 'doc_id')}, {_tokens('query_tok', 'conversations', "conv_id || ':' || turn", "role = 'user'")},{_BM25}
SELECT query_id, doc_id, rank, round(total, 4) AS score FROM lexical WHERE rank <= 3""",
    "cosine_top5": f"{_NEAREST} SELECT query_id, doc_id, rank, round(total, 4) AS score FROM best WHERE rank <= 5",
    "neighbour_labels": f"{_NEAREST} SELECT query_id, count(*) FILTER (label = own) AS same_label FROM best WHERE rank <= 10 GROUP BY query_id",
    "hybrid_rrf": f"{_SEARCH}{_DENSE}{_RRF} SELECT query_id, doc_id, rank, round(total, 5) AS score, bm25_rank, dense_rank FROM best WHERE rank <= 10",
    "hybrid_search": f"""{_SEARCH}{_DENSE}{_RRF},
own AS (SELECT query_id, list(term) AS terms FROM ask GROUP BY query_id), held AS (SELECT id, list(DISTINCT term) AS terms FROM doc_tok GROUP BY id),
pool AS (
  SELECT b.query_id, b.doc_id, b.rank AS place, round(b.total, 5) AS fused_score, concat_ws(' ', d.source, d.lang) AS title,
         CASE WHEN o.terms IS NULL THEN 0.0 ELSE len(list_intersect(o.terms, coalesce(h.terms, []))) / len(o.terms) END AS share
  FROM best b JOIN documents d ON d.doc_id = b.doc_id LEFT JOIN own o ON o.query_id = b.query_id LEFT JOIN held h ON h.id = b.doc_id WHERE b.rank <= 30),
scored AS (SELECT *, round(1 / (1 + exp(4 - 8.0 * share)), 4) AS score FROM pool)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS rank, doc_id, score, title, fused_score FROM scored QUALIFY rank <= 3""",
    "snippets": f"""{_SEARCH},
best AS (SELECT query_id, doc_id FROM lexical WHERE rank = 1),
own AS (SELECT id AS query_id, list(DISTINCT term) FILTER (length(term) > 1) AS terms, string_agg(term, '|') FILTER (length(term) > 1) AS p FROM query_tok GROUP BY id),
cut AS (SELECT query_id, doc_id, text, terms, p, [x FOR x IN regexp_split_to_array(text, '\\s+') IF x <> ''] AS w FROM best JOIN own USING (query_id) JOIN documents USING (doc_id)),
hit AS (SELECT *, [list_contains(terms, lower(regexp_replace(x, '{_NOT_WORD}', '', 'g')))::INT FOR x IN w] AS h FROM cut),
start AS (SELECT query_id, doc_id, unnest(range(0, greatest(len(w) - 40, 0) + 1, 5)) AS i, h FROM hit),
place AS (SELECT query_id, arg_min(i, struct_pack(a := -list_sum(h[i + 1:i + 40]), b := i)) AS i FROM start GROUP BY query_id),
body AS (
  SELECT query_id, doc_id, p, CASE WHEN len(w) <= 40 THEN text ELSE CASE WHEN i > 0 THEN '...' ELSE '' END || array_to_string(w[i + 1:i + 40], ' ') || CASE WHEN i + 40 < len(w) THEN '...' ELSE '' END END AS s FROM hit JOIN place USING (query_id)),
plain AS (SELECT query_id, doc_id, p, {escaped('s')} AS e FROM body)
SELECT query_id, doc_id, {marked('e', 'p')} AS snippet FROM plain""",
    "hybrid_rsf": f"""{_SEARCH}{_DENSE},
a AS (SELECT query_id, doc_id, round(total, 4) AS s, max(round(total, 4)) OVER q AS hi, min(round(total, 4)) OVER q AS lo FROM lexical WHERE rank <= 30 WINDOW q AS (PARTITION BY query_id)),
b AS (SELECT query_id, doc_id, round(total, 4) AS s, max(round(total, 4)) OVER q AS hi, min(round(total, 4)) OVER q AS lo FROM dense WHERE rank <= 30 WINDOW q AS (PARTITION BY query_id)),
fused AS (
  SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id,
         round(0.5 * coalesce(CASE WHEN b.hi > b.lo THEN (b.s - b.lo) / (b.hi - b.lo) ELSE 1 END * (b.s IS NOT NULL)::INT, 0)
             + 0.5 * coalesce(CASE WHEN a.hi > a.lo THEN (a.s - a.lo) / (a.hi - a.lo) ELSE 1 END * (a.s IS NOT NULL)::INT, 0), 9) AS total
  FROM a FULL JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, doc_id) AS rank FROM fused)
SELECT query_id, doc_id, rank, round(total, 4) AS score FROM best WHERE rank <= 10""",
    "retrieval_quality": f"{_SEARCH}{_QUALITY} SELECT * FROM quality",
    "retrieval_means": f"""{_SEARCH}{_QUALITY}
SELECT count(*) AS queries, round(avg(ndcg), 4) AS ndcg, round(avg(reciprocal_rank), 4) AS reciprocal_rank, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall FROM quality""",
    "chunk_table": r"""
WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '\s+') IF x <> ''] AS w FROM documents),
start AS (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 300 THEN [0] ELSE [i FOR i IN range(0, len(w), 260) IF i = 0 OR len(w) - i >= 30] END) AS i FROM w WHERE len(w) > 0),
cut AS (SELECT doc_id, i // 260 AS chunk_index, w[i + 1:i + 300] AS c FROM start)
SELECT doc_id, chunk_index, len(c) AS token_count, md5(array_to_string(c, ' ')) AS content_md5 FROM cut""",
    "clean_urls": f"{_URLS} SELECT page_id, clean_url, trackers_removed, false AS is_ad, {_HOST} AS domain, {_HOST} || CASE WHEN trim(u.path, '/') = '' THEN '' ELSE ' > ' || trim(u.path, '/') END AS display_url FROM cleaned",
    "trackers_by_domain": f"{_URLS} SELECT {_HOST} AS domain, count(*) AS pages, sum(trackers_removed)::BIGINT AS trackers, 0 AS ads FROM cleaned GROUP BY 1",
    "page_titles": f"""
SELECT page_id, coalesce(nullif({_REFERENCES.format(_TITLE)}, ''), regexp_extract(url, '//([^/?#]*)', 1)) AS title, regexp_extract(url, '//([^/?#]*)', 1) AS domain,
       'Direct destination website for ' || url || '. Click to open.' AS snippet FROM pages""",
    "page_text_sizes": rf"""
WITH t AS (SELECT page_id, url, html, {_REFERENCES.format("trim(regexp_replace(html, '<[^>]+>', '', 'g'))")} AS text FROM pages)
SELECT page_id, length(text) AS chars, len([x FOR x IN regexp_split_to_array(text, '\s+') IF x <> '']) AS words, len(regexp_extract_all(html, 'class="ad"')) AS ads,
       regexp_matches(lower(url || ' ' || html), 'sponsored|advertisement|ad •|promoted|partner content|featured ad') AS sponsored FROM t""",
    "new_turns": """
SELECT conv_id, turn, sha256 FROM (SELECT conv_id, turn, sha256(coalesce(text, '')) AS sha256 FROM conversations) QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY conv_id, turn) = 1""",
    "unit_conversions": "SELECT p_partkey, format('{:g}', p_size * 1000.0::DOUBLE / 1609.344) || ' miles' AS result FROM part",
    "percentages": "SELECT o_orderkey, format('{:g}', 0.15::DOUBLE * printf('%.2f', o_totalprice)::DOUBLE) AS result FROM orders",
    "formulas": "SELECT p_partkey, format('{:g}', round(4 * (p_size + 8) / 7.0::DOUBLE, 8)) AS result FROM part",
    "prefix_suggestions": f"WITH {_tokens('tok', 'documents', 'doc_id')} SELECT term, count(DISTINCT id) AS df FROM tok WHERE starts_with(term, 'th') GROUP BY term ORDER BY df DESC, term LIMIT 8",
    "conversation_stems": f"WITH vocabulary AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), {_PATTERN})) AS word FROM conversations),{_STEMS} SELECT word, stem FROM stemmed",
    "unfiltered_terms": f"""
SELECT term, count(*) AS df FROM (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(coalesce(text, '')), {_PATTERN})) AS term FROM conversations) GROUP BY term""",
    "term_positions": f"""
WITH each AS (SELECT item_id, unnest(regexp_extract_all(text, {_PATTERN})) AS raw, generate_subscripts(regexp_extract_all(text, {_PATTERN}), 1) AS i FROM benchmark),
kept AS (SELECT item_id, lower(raw) AS term, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS position, count(*) OVER (PARTITION BY item_id) AS doc_len FROM each WHERE lower(raw) NOT IN ({STOP}))
SELECT term, item_id, count(*) AS term_freq, max(doc_len) AS doc_len, string_agg(position::VARCHAR, ' ' ORDER BY position) AS positions FROM kept GROUP BY term, item_id""",
    "engine_without_vectors": f"""{_SEARCH}
SELECT query_id, rank, l.doc_id, round(total, 4) AS score, 'Doc ' || l.doc_id AS title, md5(coalesce(text, '')) AS content_md5 FROM lexical l JOIN documents d ON d.doc_id = l.doc_id WHERE rank <= 3""",
    "search_stages": f"""{_SEARCH}{_DENSE}{_RRF}
SELECT 'lexical' AS stage, count(*) AS rows FROM lexical WHERE rank <= 30 UNION ALL SELECT 'dense', count(*) FROM dense WHERE rank <= 30
UNION ALL SELECT 'fusion', count(*) FROM best WHERE rank <= 30 UNION ALL SELECT 'reranking', count(*) FROM best WHERE rank <= 3""",
    "completion_lists": f"""
WITH {_tokens('tok', 'documents', 'doc_id')}, df AS (SELECT term, count(DISTINCT id) AS df FROM tok GROUP BY term),
asked AS (SELECT p_name[:3] AS prefix FROM part UNION SELECT string_split(p_name, ' ')[1] FROM part),
met AS (SELECT prefix, term, df, row_number() OVER (PARTITION BY prefix ORDER BY df DESC, term) AS rank FROM asked JOIN df ON starts_with(term, lower(trim(prefix))) WHERE trim(prefix) <> '')
SELECT prefix, rank, term, df FROM met WHERE rank <= 8""",
    "search_work": f"""{_SEARCH}
SELECT query_id, sum(df)::BIGINT AS postings, true AS within FROM (SELECT DISTINCT id AS query_id, term FROM query_tok) JOIN df USING (term) GROUP BY query_id""",
    "indexed_ids": "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0",
    "index_updates": f"""
WITH now AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'Replaced ' || lang || ' ' || source ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0), {_tokens('tok', 'now', 'doc_id')}
SELECT term, count(DISTINCT id) AS df FROM tok GROUP BY term""",
    "evaluation_metrics": f"""
WITH documents AS (SELECT * FROM {_LITERAL}), benchmark AS (SELECT * FROM {_ASKED}), {_tokens('doc_tok', 'documents', 'doc_id')}, {_tokens('query_tok', 'benchmark', 'item_id')},{_BM25},
found AS (SELECT query_id, rank FROM lexical JOIN benchmark ON item_id = query_id AND wanted = doc_id WHERE rank <= 5)
SELECT item_id AS query_id, round(coalesce(1 / log2(rank + 1), 0), 4) AS ndcg, round(coalesce(1.0 / rank, 0), 4) AS reciprocal_rank, CASE WHEN rank IS NULL THEN 0.0 ELSE 0.2 END AS precision, CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END AS recall
FROM benchmark LEFT JOIN found ON item_id = query_id""",
    "latest_events": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    **payload_sql.SQL,
}

SQL["pivot_top5"] = SQL["cosine_top5"]  # skipping loses nothing
SQL["engine_relative"] = SQL["hybrid_rsf"]  # the engine must give what the operator gives
