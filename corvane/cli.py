"""python -m corvane.cli index|search|suggest|stats|evaluate ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.fusion import lexical_overlap
from corvane.plans.search import SearchEngine, evaluate, with_snippets
from corvane.sources.files import list_directory, read_directory, read_file
from corvane.sources.store import Store, chunk_numbers, ingest_totals


def engine_of(store: Store) -> SearchEngine:
    """An engine over the chunks of a store."""
    numbered = chunk_numbers(store.read().chunks)
    return SearchEngine.of(numbered.select("doc_id", "content", F.element_at(F.split("file_path", "/"), -1).alias("title")), scorer=lexical_overlap)


def main(arguments: list[str] | None = None) -> DataFrame:
    parser = argparse.ArgumentParser(prog="corvane")
    parser.add_argument("--store", default="corvane-store")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("path")
    index.add_argument("--file", action="store_true")
    index.add_argument("--flat", action="store_true")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--mode", default="bm25")
    search.add_argument("--top-k", type=int, default=10)
    search.add_argument("--no-rerank", action="store_true")
    commands.add_parser("suggest").add_argument("prefix")
    commands.add_parser("stats")
    judged = commands.add_parser("evaluate")
    judged.add_argument("queries", help="Parquet of query_id, query")
    judged.add_argument("qrels", help="Parquet of query_id, doc_id, grade")
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("corvane").getOrCreate()
    store = Store(spark, args.store)
    match args.command:
        case "index":
            if args.file:
                out = store.ingest(read_file(spark, args.path))
            else:
                out = store.ingest(read_directory(spark, args.path, not args.flat, skip_unreadable=True), listed=list_directory(spark, args.path, not args.flat))
            ingest_totals(out).show()
        case "search":
            asked = spark.createDataFrame([(0, args.query)], "query_id long, query string")
            out = with_snippets(engine_of(store).search(asked, args.mode, args.top_k, reranked=not args.no_rerank)).select("rank", "doc_id", "score", "title", "snippet").orderBy("rank")
        case "suggest":
            out = engine_of(store).suggest(args.prefix)
        case "stats":
            out = store.stats()
        case _:
            out = evaluate(engine_of(store), spark.read.parquet(args.queries), spark.read.parquet(args.qrels)).table(spark)
    out.show(50, truncate=100)
    return out


if __name__ == "__main__":
    main()
