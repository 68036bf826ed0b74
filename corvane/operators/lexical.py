"""The inverted index as DataFrames, and BM25 over batches of queries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import STOPWORDS, exploded_tokens, stem, terms
from corvane.scratch import join_groups, new_folder, unused, written

K1, B = 1.5, 0.75
#: Rows (query, term) that are broadcast at once; more queries are answered in blocks.
BLOCK_TERMS = 500_000


@dataclass(frozen=True)
class LexicalIndex:
    """postings(term, doc_id, term_freq, doc_len[, positions]), doc_stats(doc_id, doc_len), and optionally vocabulary(term, df).

    A plan, not yet stored; ``save`` and ``stored`` write it.  ``words`` has
    one row of each document, (doc_id, doc_len, terms, freqs[, places]), with
    its terms before ``stemming``; where there is one, that is what is stored.
    """

    postings: DataFrame
    doc_stats: DataFrame
    counted: DataFrame | None = field(default=None)
    words: DataFrame | None = field(default=None)
    stemming: bool = field(default=False)

    @property
    def corpus_stats(self) -> DataFrame:
        """n_docs, total_terms, avg_doc_len (0 if empty)."""
        return self.doc_stats.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_terms"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_doc_len"))

    @property
    def vocabulary(self) -> DataFrame:
        """(term, df): the documents of each term."""
        return self.counted if self.counted is not None else self.postings.groupBy("term").agg(F.count("*").alias("df"))

    @property
    def doc_ids(self) -> DataFrame:
        """(doc_id): the indexed documents."""
        return self.doc_stats.select("doc_id")

    def cleared(self) -> LexicalIndex:
        """The index without any document."""
        return LexicalIndex(self.postings.where(F.lit(False)), self.doc_stats.where(F.lit(False)))

    def without(self, removed: DataFrame, id_col: str = "doc_id") -> LexicalIndex:
        """The index without the documents whose ids are in ``removed``."""
        gone = removed.select(F.col(id_col).alias("doc_id")).distinct()
        return LexicalIndex(self.postings.join(gone, "doc_id", "left_anti"), self.doc_stats.join(gone, "doc_id", "left_anti"))

    def plus(self, added: LexicalIndex) -> LexicalIndex:
        """The index with the documents of another; those in both are taken from the other."""
        rest = self.without(added.doc_stats)
        return LexicalIndex(rest.postings.unionByName(added.postings), rest.doc_stats.unionByName(added.doc_stats))

    def save(self, path: str, buckets: int | None = None):
        """Write as the only segment of a stored index (``segments.StoredIndex``), and return that."""
        from corvane.operators.segments import StoredIndex

        return StoredIndex.create(self, path, buckets)

    def stored(self):
        """The index written to the shared folder, for all queries of this session."""
        return self.save(new_folder(self.postings.sparkSession, "index"))

    def frequencies(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df), of the terms wanted."""
        return self.vocabulary if terms is None else self.vocabulary.join(terms.select("term").distinct(), "term", "left_semi")

    def postings_of(self, terms: DataFrame | None = None) -> DataFrame:
        """The postings of the terms wanted."""
        return self.postings if terms is None else self.postings.join(terms.select("term").distinct(), "term", "left_semi")

    def best(self, weights: DataFrame, average: float, top_k: int, k1: float, b: float) -> DataFrame:
        """(query_id, doc_id, total) of all documents that hold a term. ``weights``: one block of (query_id, term, idf)."""
        live = self.postings.select("term", "doc_id", "term_freq", "doc_len")
        return live.join(F.broadcast(weights), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(term_part(F.lit(average), k1, b)), 9).alias("total"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stopwords: Iterable[str] = STOPWORDS, stemming: bool = True, positions: bool = True) -> LexicalIndex:
    """Index ``docs``, read once. Documents without tokens count in the statistics with length 0.

    ``positions`` keeps where a term stands; scoring doesn't need it.  A task
    counts the tokens of each document, and what is written is one row of a
    document; only rows that share an id meet in a shuffle.
    """
    renamed = docs.select(F.col(id_col).alias("doc_id"), terms(F.col(text_col), stopwords).alias("t"))
    kind = renamed.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, doc_len bigint, terms array<string>, freqs array<int>" + (", places array<array<int>>" if positions else "")
    words = written(renamed.mapInArrow(lambda batches: _counted(batches, positions), columns), "words")
    words = _of_one_row(words, positions)
    stats = words.select("doc_id", "doc_len")
    each = F.arrays_zip(F.col("terms").alias("term"), F.col("freqs").alias("term_freq"), *([F.col("places").alias("positions")] if positions else []))
    found = words.select("doc_id", "doc_len", F.inline(each))
    if stemming:
        vocabulary = found.groupBy("term").agg(F.count("*").alias("n")).withColumn("stem", stem(F.col("term")))
        merged = join_groups(found, vocabulary, "term", "n").groupBy(F.col("stem").alias("term"), "doc_id")
        found = merged.agg(F.sum("term_freq").cast("int").alias("term_freq"), F.max("doc_len").alias("doc_len"), *([F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")] if positions else []))
    return LexicalIndex(found.select("doc_id", "term", "term_freq", *(["positions"] if positions else []), "doc_len"), stats, words=words, stemming=stemming)


#: Tokens that a task counts at once; a document with more is counted by itself.
COUNTED_TOKENS = 250_000


def _counted(batches: Iterator[pa.RecordBatch], positions: bool) -> Iterator[pa.RecordBatch]:
    """From (doc_id, t): doc_id, doc_len, terms (each once), freqs and, if wanted, where each term stands."""
    for batch in batches:
        lists = batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = 0
        while first < len(batch):
            ends = np.cumsum(sizes[first:])
            last = first + max(1, int(np.searchsorted(ends, COUNTED_TOKENS, side="right")))
            own = sizes[first:last]
            begins = np.cumsum(own) - own
            coded = lists.slice(first, last - first).flatten().dictionary_encode()
            codes, n_terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
            keys = np.repeat(np.arange(len(own)), own) * n_terms + codes
            order = np.argsort(keys, kind="stable")
            found, at, freqs = np.unique(keys[order], return_index=True, return_counts=True)
            cuts = pa.array(np.searchsorted(found, np.arange(len(own) + 1) * n_terms), pa.int32())
            named = coded.dictionary.take(pa.array(found % n_terms))
            out = [batch.column(0).slice(first, last - first), pa.array(own), pa.ListArray.from_arrays(cuts, named), pa.ListArray.from_arrays(cuts, pa.array(freqs.astype(np.int32)))]
            if positions:
                stands = (order - np.repeat(begins, own)[order]).astype(np.int32)
                each = pa.ListArray.from_arrays(pa.array(np.append(at, len(order)), pa.int32()), pa.array(stands))
                out.append(pa.ListArray.from_arrays(cuts, each))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "doc_len", "terms", "freqs", "places"][: len(out)])
            first = last


def _of_one_row(words: DataFrame, positions: bool) -> DataFrame:
    """``words`` with one row of each id: rows that share an id become one document."""
    again = written(words.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("repeated")), "repeated")
    if not again.limit(1).count():
        return words
    same = F.col("doc_id").eqNullSafe(F.col("repeated"))
    shared = words.join(again, same, "left_semi")
    each = F.arrays_zip("terms", "freqs", *(["places"] if positions else []))
    places = [F.sort_array(F.flatten(F.collect_list("w.places"))).alias("places")] if positions else []
    entries = shared.select("doc_id", F.explode(each).alias("w")).groupBy("doc_id", F.col("w.terms").alias("terms")).agg(F.sum("w.freqs").cast("int").alias("freqs"), *places)
    lists = entries.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("terms", "freqs", *(["places"] if positions else [])))).alias("w"))
    lengths = shared.groupBy("doc_id").agg(F.sum("doc_len").alias("doc_len")).withColumnRenamed("doc_id", "own")
    merged = lengths.join(lists, F.col("own").eqNullSafe(F.col("doc_id")), "left").select(F.col("own").alias("doc_id"), "doc_len", *[F.coalesce(f"w.{c}", F.array().cast(words.schema[c].dataType)).alias(c) for c in words.columns[2:]])
    return written(words.join(again, same, "left_anti").unionByName(merged), "words")


def idf(df: Column, n_docs: Column) -> Column:
    """ln(1 + (N - n + 0.5) / (n + 0.5)), never negative, 0 for n = 0."""
    return F.when(df > 0, F.greatest(F.lit(0.0), F.log1p((n_docs - df + 0.5) / (df + 0.5)))).otherwise(0.0)


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text", stopwords: Iterable[str] = STOPWORDS, stemming: bool = True) -> DataFrame:
    """(query_id, term): the distinct terms of each query."""
    renamed = queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("text"))
    return exploded_tokens(renamed, "query_id", "text", stopwords, stemming).select("query_id", F.col("stemmed").alias("term")).distinct()


def term_part(average: Column, k1: float = K1, b: float = B) -> Column:
    """What a posting adds to a score: of the columns idf, term_freq and doc_len."""
    tf = F.col("term_freq")
    return F.col("idf") * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("doc_len") / average))


def term_weights(index, terms: DataFrame) -> tuple[DataFrame, float]:
    """(query_id, term, idf) of the asked terms (query_id, term) that the index holds, written; the average length (1 if it is 0)."""
    n, average = index.corpus_stats.select("n_docs", "avg_doc_len").first()
    weighted = terms.join(index.frequencies(terms), "term").select("query_id", "term", idf(F.col("df"), F.lit(n)).alias("idf"))
    return written(weighted.where("idf > 0"), "weights"), average or 1.0


def _blocks(weights: DataFrame) -> list[DataFrame]:
    blocks = max(1, -(-weights.count() // BLOCK_TERMS))
    return [weights if blocks == 1 else weights.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) for k in range(blocks)]


def bm25(index, terms: DataFrame, top_k: int = 50, k1: float = K1, b: float = B, explain: bool = False) -> DataFrame:
    """query_id, doc_id, rank, score (4 places): the best ``top_k`` documents of every query; ties go to the least doc_id.

    ``index``: a LexicalIndex or a StoredIndex.  ``terms``: (query_id, term).
    With ``explain`` there are also matched_terms (sorted) and
    term_contributions (a map, 4 places).

    The weights of the asked terms go to the postings in blocks of about
    BLOCK_TERMS rows.  A stored index skips what can't reach the best
    ``top_k`` and every bucket sends those of each query; explanations are
    worked out for the hits alone.
    """
    weights, average = term_weights(index, terms)
    best = Window.partitionBy("query_id").orderBy(F.desc("total"), "doc_id")
    totals = reduce(DataFrame.union, [index.best(own, average, top_k, k1, b) for own in _blocks(weights)])
    ranked = totals.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
    columns = ["query_id", "doc_id", "rank", F.round("total", 4).alias("score")]
    if not explain:
        return ranked.select(*columns)
    kept = written(ranked, "ranked")
    live = index.postings_of(weights).join(F.broadcast(kept.select("doc_id").distinct()), "doc_id", "left_semi") if kept.count() <= BLOCK_TERMS else index.postings_of(weights)
    parts = kept.join(weights, "query_id").join(live, ["doc_id", "term"]).select("query_id", "doc_id", "term", F.round(term_part(F.lit(average), k1, b), 4).alias("part"))
    why = parts.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list("term")).alias("matched_terms"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "part")))).alias("term_contributions"))
    return kept.join(why, ["query_id", "doc_id"]).select(*columns, "matched_terms", "term_contributions")


def bm25_work(index, terms: DataFrame, top_k: int = 50, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, postings, read): what a stored index holds of each query's terms, and how much of it the search reads."""
    weights, average = term_weights(index, terms)
    each = reduce(DataFrame.union, [index.best(own, average, top_k, k1, b, report=True) for own in _blocks(weights)])
    return each.groupBy("query_id").agg(F.sum("doc_id").alias("postings"), F.sum("total").cast("long").alias("read"))


def suggestions(index, prefix: str, top_k: int = 8) -> DataFrame:
    """(term, df): the commonest terms that begin with ``prefix``; none for a blank prefix."""
    clean = prefix.strip().lower()
    return index.vocabulary.where(F.col("term").startswith(clean) if clean else F.lit(False)).orderBy(F.desc("df"), "term").limit(top_k)


#: Letters of the longest prefixes that a table of completions lists.
LONGEST = 8


def completions(vocabulary: DataFrame, top_k: int = 8, longest: int = LONGEST) -> DataFrame:
    """(prefix, rank, term, df): the commonest ``top_k`` terms of every prefix of up to ``longest`` letters, ties in the order of terms.

    The best of a prefix are among the best of the prefixes one letter longer
    and the term that it is itself, so each level is made of the one before:
    what moves is ``top_k`` rows of a prefix, not all terms.
    """
    best = Window.partitionBy("prefix").orderBy(F.desc("df"), "term")
    top = lambda rows: rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
    terms = vocabulary.select("term", "df").where("term <> ''")
    levels = [written(top(terms.where(F.char_length("term") >= longest).select(F.left("term", F.lit(longest)).alias("prefix"), "term", "df")), "completions")]
    for n in range(longest - 1, 0, -1):
        own = terms.where(F.char_length("term") == n).select(F.col("term").alias("prefix"), "term", "df")
        shorter = levels[-1].select(F.left("prefix", F.lit(n)).alias("prefix"), "term", "df")
        levels.append(written(top(shorter.unionByName(own)), "completions"))
    return reduce(DataFrame.unionByName, levels).select("prefix", "rank", "term", "df")


def completed(table: DataFrame, asked: DataFrame, vocabulary: DataFrame, prefix_col: str = "prefix", top_k: int = 8, longest: int = LONGEST) -> DataFrame:
    """The columns of ``asked`` with rank, term and df: completions of many prefixes at once, none for blank ones.

    ``table``: completions of ``vocabulary`` with the same settings.  Prefixes
    are trimmed and lower-cased.  An equi-join answers those of up to
    ``longest`` letters; longer ones meet the terms that share their beginning.
    """
    clean, begin, term, df = unused([*asked.columns, "rank", "term", "df"], "_clean", "_begin", "_term", "_df")
    named = asked.withColumn(clean, F.lower(F.trim(F.col(prefix_col)))).where(F.length(clean) > 0)
    short = named.where(F.char_length(clean) <= longest).join(table.withColumnRenamed("prefix", begin), F.col(clean) == F.col(begin))
    terms = vocabulary.where(F.char_length("term") > longest).select(F.left("term", F.lit(longest)).alias(begin), F.col("term").alias(term), F.col("df").alias(df))
    wanted = named.where(F.char_length(clean) > longest).select(clean).distinct()
    met = wanted.join(terms, (F.left(clean, F.lit(longest)) == F.col(begin)) & F.startswith(F.col(term), F.col(clean)))
    best = Window.partitionBy(clean).orderBy(F.desc(df), term)
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).select(F.col(clean).alias(begin), "rank", F.col(term).alias("term"), F.col(df).alias("df"))
    long = named.where(F.char_length(clean) > longest).join(ranked, F.col(clean) == F.col(begin))
    columns = [*asked.columns, "rank", "term", "df"]
    return short.select(columns).unionByName(long.select(columns))
