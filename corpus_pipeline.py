"""A corpus pipeline of five operators, each over all that the one before kept.

Every stage takes documents with null ids, texts, languages and sources,
repeated rows, texts of any length, tables without rows, and columns beside
those of documents (which it drops, whatever their names).  What a stage does
with nulls and repeats is said below; a stage without rows returns none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.decontamination import decontaminate
from corvane.llm.line_dedup import line_dedup
from corvane.llm.mixing import mixed_documents
from corvane.llm.ngram_join import one_of_each
from corvane.llm.quality import quality_filter
from corvane.scratch import discard, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars counts the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, unchanged; those it rejects go.

    Null and empty texts are scored like any other; repeated rows share their fate.
    """
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that recur in others. A null text becomes empty; repeated rows count as one document."""
    return _columns(line_dedup(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8), the one with the least id.

    Documents without words or id are no copies and stay; of repeated rows one stays.
    """
    return one_of_each(docs).select(*COLUMNS)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the passages of the benchmark cut from its text. A null text stays null."""
    return _columns(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, and how often (repeats, 1 or 2). Null is a source of its own; repeated rows are taken alike."""
    return mixed_documents(docs).select(*COLUMNS, "repeats")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("contamination", contamination), ("mix", mix)]

#: SQL can't express the classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read again, and its own tables go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, staged(spark, lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
