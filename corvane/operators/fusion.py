"""Fusion of two ranked lists, and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import terms

RRF_K = 60


def _both(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    a = lexical.select("query_id", "doc_id", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    b = dense.select("query_id", "doc_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    return a.join(b, ["query_id", "doc_id"], "full_outer")


def _ranked(fused: DataFrame, places: int, top_k: int, columns: list[str]) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("total"), "doc_id")
    ranked = fused.withColumn("total", F.round("total", 9)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
    return ranked.select("query_id", "doc_id", "rank", F.round("total", places).alias("score"), *columns)


def reciprocal_rank_fusion(lexical: DataFrame, dense: DataFrame, k: int = RRF_K, lexical_weight: float = 0.5, dense_weight: float = 0.5, top_k: int = 50) -> DataFrame:
    """Weights over (k + rank), summed over the lists a document is in; 5 places. Scores and ranks of both lists are kept."""
    part = lambda w, rank: F.coalesce(F.lit(w) / (k + F.col(rank)), F.lit(0.0))
    fused = _both(lexical, dense).withColumn("total", part(lexical_weight, "bm25_rank") + part(dense_weight, "dense_rank"))
    return _ranked(fused, 5, top_k, ["bm25_score", "bm25_rank", "dense_score", "dense_rank"])


def relative_score_fusion(lexical: DataFrame, dense: DataFrame, alpha: float = 0.5, top_k: int = 50) -> DataFrame:
    """alpha x dense + (1 - alpha) x lexical, each list's scores stretched to 0..1 (1 if all are equal); 4 places."""

    def stretched(df: DataFrame) -> DataFrame:
        every = Window.partitionBy("query_id")
        low, high = F.min("score").over(every), F.max("score").over(every)
        return df.withColumn("part", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))

    a = stretched(lexical).select("query_id", "doc_id", F.col("score").alias("bm25_score"), F.col("part").alias("_a"))
    b = stretched(dense).select("query_id", "doc_id", F.col("score").alias("dense_score"), F.col("part").alias("_b"))
    fused = a.join(b, ["query_id", "doc_id"], "full_outer").withColumn("total", alpha * F.coalesce("_b", F.lit(0.0)) + (1 - alpha) * F.coalesce("_a", F.lit(0.0)))
    return _ranked(fused, 4, top_k, ["bm25_score", "dense_score"])


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def lexical_overlap(query: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder, no substitute for one: a sigmoid of the share of the query's terms in the text."""
    asked = F.array_distinct(terms(query))
    share = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, terms(text))) / F.size(asked)).otherwise(0.0)
    return F.round(sigmoid(share * 8 - 4), 4)


def rerank(hits: DataFrame, score: Callable[[Column, Column], Column] | None, query_col: str = "query", text_col: str = "content", top_k: int | None = None) -> DataFrame:
    """Hits ranked anew by ``score(query, text)``, equal ones in their old order; unchanged without a scorer."""
    if score is None:
        return hits if top_k is None else hits.where(F.col("rank") <= top_k)
    scored = hits.withColumn("rerank_score", score(F.col(query_col), F.col(text_col)))
    best = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    ranked = scored.withColumn("rank", F.row_number().over(best))
    return ranked if top_k is None else ranked.where(F.col("rank") <= top_k)
