"""Search plans: batches of queries against an index, in every mode, down to hits with their provenance."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import snippet, terms
from corvane.functions.tools import instant_tool
from corvane.operators.fusion import lexical_overlap, reciprocal_rank_fusion, relative_score_fusion, rerank
from corvane.operators.lexical import LexicalIndex, bm25, build_index, query_terms, suggestions
from corvane.operators.metrics import metric_means, retrieval_metrics, upper_latency
from corvane.operators.segments import StoredIndex
from corvane.operators.vectors import cosine_top_k
from corvane.scratch import unused

MODES = ("bm25", "dense", "hybrid", "relative")
POOL = 30

#: Makes (query_id, embedding) from (query_id, query).
Encoder = Callable[[DataFrame], DataFrame]
#: Makes a score from the columns query and text.
Scorer = Callable[[Column, Column], Column]


class Telemetry:
    """Rows and times of the stages of a search, noted while it runs: no job of their own.

    Every stage counts the rows that it hands on, and when the first and the
    last of them did so; what is noted is there once the hits have been written
    or collected.
    """

    def __init__(self) -> None:
        self.stages: dict[str, Observation] = {}

    def noted(self, stage: str, rows: DataFrame) -> DataFrame:
        """``rows``, which the stage of this name gives."""
        (now,) = unused(rows.columns, "_now")
        self.stages[stage] = Observation(f"{stage} {uuid.uuid4().hex}")
        timed = rows.withColumn(now, F.reflect(F.lit("java.lang.System"), F.lit("currentTimeMillis")).cast("long"))
        return timed.observe(self.stages[stage], F.count(F.lit(1)).alias("rows"), F.min(now).alias("first"), F.max(now).alias("last")).drop(now)

    def provenance(self) -> dict[str, dict[str, float]]:
        """For each stage the rows, and milliseconds from the first row of all to its first and last (None without rows)."""
        seen = {stage: o.get for stage, o in self.stages.items()}
        began = min((x["first"] for x in seen.values() if x["first"] is not None), default=0)
        since = lambda t: None if t is None else t - began
        return {stage: {"rows": x["rows"], "first_ms": since(x["first"]), "last_ms": since(x["last"])} for stage, x in seen.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """(stage, rows, first_ms, last_ms)."""
        return spark.createDataFrame([(stage, x["rows"], x["first_ms"], x["last_ms"]) for stage, x in self.provenance().items()], "stage string, rows long, first_ms long, last_ms long")


@dataclass(frozen=True)
class SearchEngine:
    """documents(doc_id, title, content), their index, and optionally vectors(doc_id, embedding), an encoder and a scorer.

    Where the encoder or the vectors are missing, dense lists are left out of
    every mode; where the scorer is missing, nothing is reranked.
    """

    documents: DataFrame
    index: LexicalIndex | StoredIndex
    vectors: DataFrame | None = None
    encoder: Encoder | None = None
    scorer: Scorer | None = None
    stemming: bool = True

    @staticmethod
    def of(documents: DataFrame, vectors: DataFrame | None = None, encoder: Encoder | None = None, scorer: Scorer | None = None, stemming: bool = True) -> SearchEngine:
        """An engine over documents(doc_id, content[, title])."""
        named = documents if "title" in documents.columns else documents.withColumn("title", F.lit(None).cast("string"))
        return SearchEngine(named, build_index(named, "doc_id", "content", stemming=stemming), vectors, encoder, scorer, stemming)

    def plus(self, documents: DataFrame, vectors: DataFrame | None = None) -> SearchEngine:
        """The engine with more documents; those with known ids are replaced."""
        other = SearchEngine.of(documents, vectors, stemming=self.stemming)
        old = self.documents.join(documents.select("doc_id"), "doc_id", "left_anti")
        both = self.vectors
        if vectors is not None:
            both = vectors if both is None else both.join(vectors.select("doc_id"), "doc_id", "left_anti").unionByName(vectors)
        return SearchEngine(old.unionByName(other.documents, allowMissingColumns=True), self.index.plus(other.index), both, self.encoder, self.scorer, self.stemming)

    def without(self, removed: DataFrame) -> SearchEngine:
        """The engine without the documents whose doc_id is in ``removed``."""
        vectors = self.vectors.join(removed.select("doc_id"), "doc_id", "left_anti") if self.vectors is not None else None
        return SearchEngine(self.documents.join(removed.select("doc_id"), "doc_id", "left_anti"), self.index.without(removed), vectors, self.encoder, self.scorer, self.stemming)

    def ranked(self, queries: DataFrame, mode: str = "hybrid", pool: int = POOL, telemetry: Telemetry | None = None) -> DataFrame:
        """query_id, doc_id, rank, score and the scores and ranks of both lists, where the mode has them."""
        noted = telemetry.noted if telemetry is not None else lambda _, rows: rows
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        lexical = dense = None
        if mode != "dense":
            lexical = noted("lexical", bm25(self.index, query_terms(queries, "query_id", "query", stemming=self.stemming), pool))
        if mode != "bm25" and self.encoder is not None and self.vectors is not None:
            dense = noted("dense", cosine_top_k(self.encoder(queries.select("query_id", "query")), self.vectors, pool))
        if lexical is None and dense is None:
            raise ValueError("dense search needs vectors and an encoder")
        if lexical is not None and dense is not None:
            return noted("fusion", (relative_score_fusion if mode == "relative" else reciprocal_rank_fusion)(lexical, dense, top_k=pool))
        return lexical if lexical is not None else dense

    def search(self, queries: DataFrame, mode: str = "hybrid", top_k: int = 10, pool: int = POOL, reranked: bool = True, telemetry: Telemetry | None = None) -> DataFrame:
        """query_id, rank, doc_id, score, title, content, provenance for the queries (query_id, query).

        Only the pool is reranked, and only then cut to ``top_k``.
        ``telemetry`` notes what each stage hands on, and when.
        """
        ranked = self.ranked(queries, mode, max(pool, top_k), telemetry)
        kept = self.documents.select("doc_id", F.coalesce("title", F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))).alias("title"), F.coalesce("content", F.lit("")).alias("content"))
        hits = ranked.join(kept, "doc_id", "left").join(queries.select("query_id", "query"), "query_id")
        again = rerank(hits, self.scorer if reranked else None, top_k=top_k)
        if telemetry is not None:
            again = telemetry.noted("hits" if self.scorer is None or not reranked else "reranking", again)
        extra = [c for c in ("bm25_score", "bm25_rank", "dense_score", "dense_rank", "rerank_score") if c in again.columns]
        score = F.col("rerank_score") if "rerank_score" in again.columns else F.col("score")
        return again.select("query_id", "rank", "doc_id", score.alias("score"), "title", "content", F.struct(F.lit(mode).alias("mode"), F.col("score").alias("first_score"), *extra).alias("provenance"), "query")

    def stats(self) -> DataFrame:
        """total_docs, avg_doc_length, vocabulary_size, total_vectors."""
        counts = self.index.corpus_stats.select(F.col("n_docs").alias("total_docs"), F.round("avg_doc_len", 1).alias("avg_doc_length"))
        sizes = self.index.vocabulary.agg(F.count("*").alias("vocabulary_size"))
        vectors = self.vectors.agg(F.count("*").alias("total_vectors")) if self.vectors is not None else counts.select(F.lit(0).cast("long").alias("total_vectors"))
        return counts.crossJoin(sizes).crossJoin(vectors)  # one row each

    def suggest(self, prefix: str, top_k: int = 8) -> DataFrame:
        return suggestions(self.index, prefix, top_k)


def with_snippets(hits: DataFrame, window: int = 40) -> DataFrame:
    """Hits with ``snippet``: the best window of the content, the query's terms marked."""
    return hits.withColumn("snippet", snippet(F.col("content"), terms(F.col("query")), window))


def rank_web(results: DataFrame, queries: DataFrame, direct: DataFrame | None = None, scorer: Scorer | None = lexical_overlap, top_k: int = 15) -> DataFrame:
    """Organic results of web_results, reranked by their snippets; a direct card of the query's own address comes first.

    Without a scorer results keep their order in the page.
    """
    organic = results.where(~F.col("blocked")).select("query_id", "position", "title", "url", "display_url", "domain", "snippet", "trackers", F.lit(False).alias("direct"))
    if direct is not None:
        organic = organic.unionByName(direct.select("query_id", F.lit(-1).alias("position"), "title", "url", "display_url", "domain", "snippet", F.lit(0).alias("trackers"), F.lit(True).alias("direct")))
    joined = organic.join(queries.select("query_id", "query"), "query_id")
    scored = joined.withColumn("score", F.when(F.col("direct"), 1.0).otherwise(scorer(F.col("query"), F.col("snippet")) if scorer else F.lit(0.0)))
    best = Window.partitionBy("query_id").orderBy(F.desc("direct"), F.desc("score"), "position")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).drop("query", "position")


def instant_answers(queries: DataFrame, direct: DataFrame | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """query_id, title, extract, url, source, kind: a tool's answer, else the page at an address, else a summary."""
    tool = queries.select("query_id", instant_tool(F.col("query")).alias("t")).where("t is not null")
    answers = [tool.select("query_id", F.lit(0).alias("_order"), F.col("t.result").alias("title"), F.col("t.display").alias("extract"), F.lit("#calculator").alias("url"), F.concat(F.lit("Instant "), F.initcap("t.kind")).alias("source"), F.col("t.kind").alias("kind"))]
    if direct is not None:
        answers.append(direct.select("query_id", F.lit(1).alias("_order"), "title", F.col("snippet").alias("extract"), "url", F.lit("Direct Live Website").alias("source"), F.lit("website").alias("kind")))
    if summaries is not None:
        answers.append(summaries.select("query_id", F.lit(2).alias("_order"), "title", "extract", "url", F.lit("Wikipedia Instant Answer").alias("source"), F.lit("summary").alias("kind")))
    every = answers[0]
    for more in answers[1:]:
        every = every.unionByName(more)
    first = Window.partitionBy("query_id").orderBy("_order")
    return every.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_order")


@dataclass
class Evaluation:
    """Means of the metrics and seconds for each strategy."""

    rows: list[dict] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows)


def evaluate(engine: SearchEngine, queries: DataFrame, qrels: DataFrame, k: int = 5, timed: bool = False) -> Evaluation:
    """Every strategy that the engine supports over judged queries: the means of the metrics, and seconds of one pass over all.

    ``timed``: run every query by itself as well, for mean_latency_ms and
    p95_latency_ms; for evaluation sets of some dozens of queries.
    """
    out = Evaluation()
    dense = engine.encoder is not None and engine.vectors is not None
    for name, mode, again in (("bm25", "bm25", False), ("dense", "dense", False), ("hybrid", "hybrid", False), ("hybrid reranked", "hybrid", True)):
        if (mode != "bm25" and not dense) or (again and engine.scorer is None):
            continue
        began = time.perf_counter()
        found = engine.search(queries, mode, k, reranked=again)
        means = metric_means(retrieval_metrics(found, qrels, k)).first().asDict()
        first = metric_means(retrieval_metrics(found, qrels, 1)).first()["precision"]
        row = {"strategy": name, **means, "precision_at_1": first, "seconds": round(time.perf_counter() - began, 3)}
        if timed:
            spark, each = queries.sparkSession, []
            for asked in queries.toLocalIterator():
                began = time.perf_counter()
                engine.search(spark.createDataFrame([asked], queries.schema), mode, k, reranked=again).collect()
                each.append((1000 * (time.perf_counter() - began),))
            times = spark.createDataFrame(each, "ms double")
            row |= {"mean_latency_ms": round(sum(x for (x,) in each) / len(each), 2), "p95_latency_ms": round(upper_latency(times, "ms").first()["ms"], 2)}
        out.rows.append(row)
    return out
