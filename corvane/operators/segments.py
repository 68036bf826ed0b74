"""A stored lexical index: segments that never change, removed ids, and top-k search under upper bounds.

A segment holds documents in buckets of bounded size.  Of each bucket and term
there is one row: the places of the documents in the bucket, the frequencies,
and for each block of postings its greatest frequency and its least document
length, which bound what any posting of the block can add to a score.

A search takes each bucket by itself: the terms of a query from the greatest
bound to the least.  Once what the remaining terms can add is less than the
k-th best score so far, no new document can enter; from then on only the
documents that can still reach the k-th score are looked up, in the blocks
that have a chance (MaxScore).  Buckets are stored as they are grouped, so no
posting moves; every bucket sends the best k of each query.

Many queries at once are answered together: their weights, as a matrix, are
multiplied with the bucket's commonest terms (BLAS), the other terms are added
posting by posting, and these sums of single precision only say which
documents can be among the best k; those are then summed in double precision.

An update writes a segment of the new documents or a list of removed ids.  A
document of a segment counts unless a later part has its id.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import let, stem
from corvane.operators.lexical import LexicalIndex
from corvane.scratch import at_end
from corvane.sources.commits import CommitLog

#: Most documents in a bucket, on average, and postings in a block.
BUCKET_DOCUMENTS, BLOCK = 8192, 128
#: So many queries are answered together, if each asks for so few hits.
MANY, FEW_HITS = 64, 64
#: Queries and documents whose scores are worked out at once, groups of documents that are bounded, and postings added at once.
TILE_QUERIES, TILE_DOCUMENTS, GROUPS, ADDED = 1024, 4096, 128, 1 << 18
#: Of all pairs of a query and a document, the share that must hold a term for it to go into the matrix; terms there at most.
DENSE_SHARE, DENSE_TERMS = 0.003, 1024
#: How far below the k-th score a bound must be: more than sums of doubles differ by their order.
MARGIN = 1e-6
ROWS = "bucket int, term string, ids array<bigint>, lens array<int>, places array<int>, freqs array<int>, tops array<int>, lows array<int>, positions array<array<int>>"


_NUMBERS: dict[int, list[int]] = {1: [0]}


def bucket_numbers(spark: SparkSession, n: int) -> list[int]:
    """``n`` integers that Spark's hash deals to ``n`` different partitions, so that each file has one bucket."""
    if n in _NUMBERS:
        return _NUMBERS[n]
    some = spark.range(24 * n + 64).select(F.col("id").cast("int").alias("v")).select("v", F.pmod(F.hash("v"), F.lit(n)).alias("p"))
    found = {r.p: r.v for r in some.groupBy("p").agg(F.min("v").alias("v")).collect()}
    free = iter(range(-1, -n - 1, -1))
    return _NUMBERS.setdefault(n, [found[p] if p in found else next(free) for p in range(n)])


@dataclasses.dataclass(frozen=True)
class Asked:
    """Queries and the weights of their terms, as tasks need them."""

    ids: pa.Array
    names: pa.Array
    #: The terms of query q, as numbers in ``names``, and their weights: those from begin[q] to begin[q + 1].
    begin: np.ndarray
    codes: np.ndarray
    idf: np.ndarray
    average: float
    k1: float
    b: float

    @staticmethod
    def of(weights: pa.Table, average: float, k1: float, b: float) -> Asked:
        """From rows (query_id, term, idf)."""
        ids, names = (weights.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "term"))
        query = ids.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(query, kind="stable")
        begin = np.searchsorted(query[order], np.arange(len(ids.dictionary) + 1))
        return Asked(ids.dictionary, names.dictionary, begin, names.indices.to_numpy(zero_copy_only=False)[order], weights.column("idf").to_numpy()[order], average, k1, b)

    @cached_property
    def terms(self) -> list[list[tuple[str, float]]]:
        """The terms of each query with their weights."""
        names, codes, idf = self.names.to_pylist(), self.codes.tolist(), self.idf.tolist()
        return [[(names[codes[i]], idf[i]) for i in range(a, z)] for a, z in zip(self.begin[:-1], self.begin[1:], strict=True)]


class Bucket:
    """One bucket's rows for the asked terms."""

    def __init__(self, rows: pa.Table, dead: np.ndarray, asked: Asked):
        rows = rows.combine_chunks()
        terms = rows.column("term").chunk(0)
        head = pc.index(terms, "").as_py()
        flat, cuts = {}, {}
        for name in ("ids", "lens", "places", "freqs", "tops", "lows"):  # nulls take no room between the offsets
            column = rows.column(name).chunk(0)
            flat[name], cuts[name] = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        own = lambda name, i: flat[name][cuts[name][i] : cuts[name][i + 1]]
        self.ids = own("ids", head)
        self.norm = asked.k1 * (1 - asked.b + asked.b * own("lens", head) / asked.average)
        self.start = np.zeros(len(self.ids))
        if len(dead):
            self.start[np.isin(self.ids, dead)] = -np.inf  # no sum lifts a dead document
        flat["places"] = flat["places"].astype(np.intp)
        self.asked, self.flat, self.cuts = asked, flat, cuts
        self.lists = np.delete(np.arange(len(terms)), head)
        self.names = terms.take(pa.array(self.lists))
        self.sizes, self.places, self.freqs = np.diff(cuts["places"])[self.lists], *(flat[x][cuts[x][0] : cuts[x][-1]] for x in ("places", "freqs"))

    @cached_property
    def row(self) -> dict[str, list]:
        """Of each term: places, frequencies, bounds of blocks, the greatest of them, and room for the parts."""
        flat, cuts, asked = self.flat, self.cuts, self.asked
        bounds = flat["tops"] * (asked.k1 + 1) / (flat["tops"] + asked.k1 * (1 - asked.b + asked.b * flat["lows"] / asked.average))
        most = np.maximum.reduceat(bounds, cuts["tops"][self.lists]) if len(self.lists) else []
        own = lambda values, name, i: values[cuts[name][i] : cuts[name][i + 1]]
        return {
            name: [own(flat["places"], "places", i), own(flat["freqs"], "freqs", i), own(bounds, "tops", i), float(bound), None]
            for name, i, bound in zip(self.names.to_pylist(), self.lists, most, strict=True)
        }

    def _part(self, places: np.ndarray, freqs: np.ndarray) -> np.ndarray:
        return freqs * (self.asked.k1 + 1) / (freqs + self.norm[places])

    def _parts(self, row: list) -> np.ndarray:
        """The parts of a whole list; kept for the next query that reads it whole."""
        if row[4] is None:
            row[4] = self._part(row[0], row[1])
        return row[4]

    def best(self, query: int, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(ids, totals) of the best ``k`` documents of a query, postings of its terms, and postings read."""
        lists = [(idf * row[3], idf, row) for term, idf in self.asked.terms[query] if (row := self.row.get(term)) is not None]
        lists.sort(key=lambda x: -x[0])
        rest = [0.0] * (len(lists) + 1)
        for j in range(len(lists) - 1, -1, -1):
            rest[j] = rest[j + 1] + lists[j][0]
        total = self.start.copy()
        held, read, kth, left, again = sum(len(x[2][0]) for x in lists), 0, -np.inf, None, np.inf
        for j, (_, idf, row) in enumerate(lists):
            places = row[0]
            if left is None:
                total[places] += idf * self._parts(row)
                read += len(places)
                # worth a look if much is left to read, and the bounds have halved since the last look
                if rest[j + 1] < again and held - read > len(total) // 2 and rest[j + 1] < total.max():
                    again, kth = rest[j + 1] / 2, _kth(total, k)
                    if rest[j + 1] < kth - MARGIN:
                        left = np.flatnonzero(total + rest[j + 1] >= kth - MARGIN)
                continue
            at = np.searchsorted(places, left)
            block = np.minimum(at, len(places) - 1) // BLOCK
            # a document is looked up if the bound of its block, and of the terms after this one, can still lift it
            there = total[left] + idf * row[2][block] + rest[j + 1] >= kth - MARGIN
            left, at, block = left[there], at[there], block[there]
            read += int(np.minimum(BLOCK, len(places) - np.unique(block) * BLOCK).sum())
            hit = at < len(places)
            hit[hit] = places[at[hit]] == left[hit]
            total[left[hit]] += idf * self._part(left[hit], row[1][at[hit]])
            kth = max(kth, _kth(total[left], k))
            left = left[total[left] + rest[j + 1] >= kth - MARGIN]
        if left is None:
            left = np.flatnonzero(total >= max(_kth(total, k) - MARGIN, np.nextafter(0, 1)))
        values = np.round(total[left], 9)
        order = np.lexsort((self.ids[left], -values))[:k]
        return self.ids[left[order]], values[order], held, read


class Together:
    """One bucket and all queries, their scores worked out in tiles of queries and documents."""

    def __init__(self, bucket: Bucket):
        asked = self.asked = bucket.asked
        self.bucket, self.places, n, rows = bucket, bucket.places, len(bucket.ids), len(bucket.sizes)
        self.parts = bucket._part(self.places, bucket.freqs)
        self.parts[np.isneginf(bucket.start)[self.places]] = 0  # a document without a score is no hit
        self.keys = np.repeat(np.arange(rows) * n, bucket.sizes) + self.places
        # the asked terms that the bucket holds: query, row of the bucket, weight
        row = np.full(len(asked.names), -1)
        row[pc.index_in(bucket.names, asked.names).to_numpy(zero_copy_only=False)] = np.arange(rows)
        row, query = row[asked.codes], np.repeat(np.arange(len(asked.ids)), np.diff(asked.begin))
        held = row >= 0
        self.query, self.row, self.idf = query[held], row[held], asked.idf[held]
        self.begin = np.searchsorted(self.query, np.arange(len(asked.ids) + 1))
        pairs = np.bincount(self.row, minlength=rows) * bucket.sizes
        dense = np.argsort(-pairs, kind="stable")[:DENSE_TERMS]
        self.dense = dense[pairs[dense] > DENSE_SHARE * n * len(asked.ids)]
        self.column = np.full(rows, -1)
        self.column[self.dense] = np.arange(len(self.dense))

    def best(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query numbers, ids, totals) of the best ``k`` documents of every query."""
        n_queries, n_docs = len(self.asked.ids), len(self.bucket.ids)
        # sums of n products that aren't negative are off by a share of n + 3 roundings at most, here and in the k-th
        self.slack = 1 - 2.5 * (np.diff(self.begin) + 8) * 2.0**-24
        self.floor = np.zeros(n_queries)
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * -(-n_queries // TILE_QUERIES)
        step = GROUPS * -(-min(n_docs, TILE_DOCUMENTS) // GROUPS)
        scores = np.empty((min(n_queries, TILE_QUERIES), step), np.float32)
        for low in range(0, n_docs, step):
            high = min(low + step, n_docs)
            ends = np.searchsorted(self.keys, np.arange(len(self.column))[:, None] * n_docs + [low, high])
            matrix = np.zeros((len(self.dense), step), np.float32)
            for c, r in enumerate(self.dense):
                own = slice(*ends[r])
                matrix[c, self.places[own] - low] = self.parts[own]
            for tile, first in enumerate(range(0, n_queries, TILE_QUERIES)):
                last = min(first + TILE_QUERIES, n_queries)
                found = self._able(scores[: last - first], matrix, ends, low, first, last, k)
                kept[tile] = self._kept(kept[tile], *found, first, last, k)
        query, places, totals = (np.concatenate(x) for x in zip(*kept, strict=True))
        return query, self.bucket.ids[places], totals

    def _able(self, scores: np.ndarray, matrix: np.ndarray, ends: np.ndarray, low: int, first: int, last: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query numbers, places): the documents of a tile that can be among the best ``k``."""
        own = slice(self.begin[first], self.begin[last])
        query, row, idf = self.query[own] - first, self.row[own], self.idf[own].astype(np.float32)
        column = self.column[row]
        common, rare = column >= 0, column < 0
        weights = np.zeros((last - first, len(matrix)), np.float32)
        np.add.at(weights, (query[common], column[common]), idf[common])
        np.matmul(weights, matrix, out=scores)
        query, row, idf = query[rare], row[rare], idf[rare]
        counts, flat = ends[row, 1] - ends[row, 0], scores.reshape(-1)
        total = np.cumsum(counts)
        a = 0
        while a < len(counts):
            before = total[a] - counts[a]
            z = max(a + 1, int(np.searchsorted(total, before + ADDED, side="right")))
            size = counts[a:z]
            at = np.repeat(ends[row[a:z], 0] - (total[a:z] - size - before), size) + np.arange(total[z - 1] - before)
            cells = np.repeat(query[a:z] * scores.shape[1] - low, size) + self.places[at]
            np.add.at(flat, cells, np.repeat(idf[a:z], size) * self.parts[at].astype(np.float32))
            a = z
        floor = self.floor[first:last]
        parted = scores.reshape(len(scores), -1, GROUPS)  # document j * GROUPS + g is in group g
        most = parted.max(axis=1)
        # k groups reach the k-th of their maxima, so k documents do
        np.maximum(floor, np.partition(most, GROUPS - k, axis=1)[:, GROUPS - k] * self.slack[first:last] - MARGIN, out=floor)
        query, group = np.nonzero((most >= floor[:, None]) & (most > 0))
        cells = parted[query, :, group]
        i, j = np.nonzero((cells >= floor[query][:, None]) & (cells > 0))
        return query[i] + first, low + j * GROUPS + group[i]

    def _totals(self, query: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The scores of pairs in double precision, rounded as ranks need them."""
        n_docs, out = len(self.bucket.ids), np.zeros(len(query))
        sizes = self.begin[query + 1] - self.begin[query]
        total = np.cumsum(sizes)
        a = 0
        while a < len(query):
            before = total[a] - sizes[a]
            z = max(a + 1, int(np.searchsorted(total, before + ADDED, side="right")))
            size = sizes[a:z]
            entry = np.repeat(self.begin[query[a:z]] - (total[a:z] - size - before), size) + np.arange(total[z - 1] - before)
            key = self.row[entry] * n_docs + np.repeat(places[a:z], size)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            part = np.where(self.keys[at] == key, self.idf[entry] * self.parts[at], 0.0)
            out[a:z] = np.bincount(np.repeat(np.arange(z - a), size), part, minlength=z - a)
            a = z
        return np.round(out, 9)

    def _kept(self, kept: tuple, query: np.ndarray, places: np.ndarray, first: int, last: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best ``k`` of each query of a tile, of those kept and new ones; raises the floor."""
        query, places, totals = (np.concatenate(x) for x in zip(kept, (query, places, self._totals(query, places)), strict=True))
        order = np.lexsort((self.bucket.ids[places], -totals, query))
        query, places, totals = query[order], places[order], totals[order]
        begin = np.searchsorted(query, np.arange(first, last + 1))
        best = np.arange(len(query)) - begin[query - first] < k
        full = np.flatnonzero(np.diff(begin) >= k)
        kth = totals[begin[full] + k - 1]
        self.floor[first + full] = np.maximum(self.floor[first + full], kth * self.slack[first + full] - MARGIN)
        return query[best], places[best], totals[best]


def _by_document(index: LexicalIndex, docs: DataFrame) -> DataFrame:
    """One row of each document, (doc_id, doc_len, terms, freqs[, places]), of an index that has only postings."""
    with_positions = "positions" in index.postings.columns
    entry = F.struct("term", "term_freq", *(["positions"] if with_positions else []))
    lists = index.postings.groupBy("doc_id").agg(F.collect_list(entry).alias("w"))
    columns = [("w.term", "terms", "array<string>"), ("w.term_freq", "freqs", "array<int>"), *([("w.positions", "places", "array<array<int>>")] if with_positions else [])]
    return docs.join(lists, "doc_id", "left").select("doc_id", "doc_len", *[F.coalesce(F.col(c).cast(kind), F.array().cast(kind)).alias(to) for c, to, kind in columns])


def _summed(entries: Column, same: Column, with_positions: bool) -> Column:
    """Entries in the order of places, those of one place (``same`` at most) as one."""

    def merged(p: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            group = F.filter(F.slice(p, i + 1, same.cast("int")), lambda y: y["place"] == x["place"])
            freq = F.aggregate(group, F.lit(0), lambda total, y: total + y["term_freq"])
            stands = [F.sort_array(F.flatten(F.transform(group, lambda y: y["positions"]))).alias("positions")] if with_positions else []
            return F.struct(x["place"].alias("place"), freq.alias("term_freq"), x["doc_len"].alias("doc_len"), x["doc_id"].alias("doc_id"), *stands)

        first = F.filter(F.transform(p, lambda x, i: F.when((i == 0) | (F.get(p, i - 1)["place"] != x["place"]), one(x, i))), lambda x: x.isNotNull())
        return first

    return let(entries, merged)


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _searched(shared, k: int, report: bool) -> Callable[..., pa.Table]:
    """For the rows of one bucket, and the dead ids: (query_id, doc_id, total), or with ``report`` (query_id, postings, postings read)."""

    def run(rows: pa.Table, dead: pa.Table | None = None) -> pa.Table:
        asked: Asked = shared.value
        query, ids, totals = [], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(rows):
            bucket = Bucket(rows, dead.column("doc_id").to_numpy() if dead is not None else np.zeros(0, np.int64), asked)
            if not report and len(asked.ids) >= MANY and k <= FEW_HITS:
                query, found, values = Together(bucket).best(k)
                return pa.table([asked.ids.take(pa.array(query)), pa.array(found, pa.int64()), pa.array(values)], names=["query_id", "doc_id", "total"])
            for q in range(len(asked.terms)):
                found, values, held, read = bucket.best(q, k)
                if report:
                    found, values = np.array([held]), np.array([float(read)])
                query += [q] * len(found)
                ids.append(found)
                totals.append(values)
        of = asked.ids.take(pa.array(query, pa.int64()))
        return pa.table([of, pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(totals))], names=["query_id", "doc_id", "total"])

    return run


@dataclasses.dataclass(frozen=True)
class StoredIndex:
    """Parts (segments and lists of removed ids, oldest first) below a folder. Updates give a new index; ``commit`` publishes it."""

    spark: SparkSession
    path: str
    parts: tuple[str, ...]
    base: tuple[str, ...] = ()

    @staticmethod
    def create(index: LexicalIndex, path: str, buckets: int | None = None) -> StoredIndex:
        """Write ``index`` as the only segment at ``path`` and commit it."""
        spark = index.postings.sparkSession
        empty = StoredIndex(spark, path.rstrip("/"), ())
        made = empty._segment(index, buckets)
        CommitLog(spark, empty.path).change(lambda tables: {"parts": [made]})
        return StoredIndex(spark, empty.path, (made,), (made,))

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> StoredIndex:
        """The index committed last at ``path``, or the one of a version."""
        log = CommitLog(spark, path)
        parts = tuple((log.latest() if version is None else log.at(version)).tables.get("parts", []))
        return StoredIndex(spark, path.rstrip("/"), parts, parts)

    def commit(self) -> StoredIndex:
        """Publish this index's new parts, after those that others have published since it was loaded."""

        def step(tables: dict[str, list[str]]) -> dict[str, list[str]]:
            now = tables.get("parts", [])
            gone = [x for x in self.base if x not in self.parts]
            if any(x not in now for x in gone):
                raise RuntimeError("the segments that this index has merged are no longer there")
            if not gone:
                return {"parts": [*now, *[x for x in self.parts if x not in self.base]]}
            return {"parts": [*self.parts, *[x for x in now if x not in self.base]]}

        parts = tuple(CommitLog(self.spark, self.path).change(step).tables["parts"])
        return StoredIndex(self.spark, self.path, parts, parts)

    def _segment(self, index: LexicalIndex, buckets: int | None = None) -> str:
        """Write a segment: rows by bucket and term, documents, totals, vocabulary."""
        spark = self.spark
        name = CommitLog(spark, self.path).new_folder("segments")
        folder = f"{self.path}/{name}"
        seen = Observation()
        stats = index.doc_stats.select("doc_id", F.col("doc_len").cast("int").alias("doc_len"))
        stats.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).cast("long").alias("total")).write.parquet(f"{folder}/docs")
        n_docs, total = seen.get["n"], seen.get["total"]
        # buckets for all cores, but no more than that: each has work to do for every query
        n = buckets or max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, -(-n_docs // 256)), -(-n_docs // BUCKET_DOCUMENTS))
        numbers = F.array(*[F.lit(v) for v in bucket_numbers(spark, n)])
        words = index.words if index.words is not None else _by_document(index, spark.read.parquet(f"{folder}/docs"))
        with_positions = "places" in words.columns
        # the only shuffle: whole documents to their buckets; all that follows stays in the bucket's partition
        dealt = words.withColumn("bucket", F.get(numbers, F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))).repartition(n, "bucket")
        placed = dealt.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id")) - 1)
        # each document is also an entry of the term '', which lists the ids and lengths of the bucket
        named, counts = F.concat(F.array(F.lit("")), "terms").alias("term"), F.concat(F.array(F.lit(0)), "freqs").alias("term_freq")
        stands = [F.concat(F.array(F.array().cast("array<int>")), "places").alias("positions")] if with_positions else []
        each = placed.select("bucket", "place", F.col("doc_len").cast("int").alias("doc_len"), F.col("doc_id").cast("long").alias("doc_id"), F.inline(F.arrays_zip(named, counts, *stands)))
        entry = F.struct("place", "term_freq", "doc_len", F.when(F.col("term") == "", F.col("doc_id")).alias("doc_id"), *(["positions"] if with_positions else []))
        lists = each.groupBy("bucket", "term").agg(F.sort_array(F.collect_list(entry)).alias("p"))
        if index.stemming:
            stems = lists.select("bucket", stem(F.col("term")).alias("term"), "p").groupBy("bucket", "term").agg(F.flatten(F.collect_list("p")).alias("p"), F.count("*").alias("same"))
            lists = stems.select("bucket", "term", F.when(F.col("same") == 1, F.col("p")).otherwise(_summed(F.sort_array("p"), F.col("same"), with_positions)).alias("p"))
        head = F.col("term") == ""
        every = lambda what, column: F.when(~head, F.transform(F.sequence(F.lit(1), F.size("p"), F.lit(BLOCK)), lambda i: what(F.slice(F.col(column), i, BLOCK))))
        both = lists.select(
            "bucket", "term", F.when(head, F.col("p.doc_id")).alias("ids"), F.when(head, F.col("p.doc_len")).alias("lens"), F.when(~head, F.col("p.place")).alias("places"), F.when(~head, F.col("p.term_freq")).alias("freqs"),
            every(F.array_max, "p.term_freq").alias("tops"), every(F.array_min, "p.doc_len").alias("lows"), (F.when(~head, F.col("p.positions")) if with_positions else F.lit(None).cast("array<array<int>>")).alias("positions"),
        )
        table = self._table(name)
        both.write.bucketBy(n, "bucket").sortBy("bucket", "term").option("path", f"{folder}/rows").saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")  # the files stay
        self._lists(spark.read.schema(ROWS).parquet(f"{folder}/rows")).groupBy("term").agg(F.sum(F.size("places")).cast("long").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/vocabulary")
        CommitLog(spark, folder).write("layout.json", {"buckets": n, "n_docs": n_docs, "total_terms": total})
        return name

    @staticmethod
    def _table(name: str) -> str:
        return f"corvane_{name.rpartition('=')[2]}"

    @staticmethod
    def _lists(rows: DataFrame) -> DataFrame:
        return rows.where("term <> ''")

    @cached_property
    def _layouts(self) -> dict[str, dict[str, int]]:
        """buckets, n_docs and total_terms of each segment."""
        return {x: CommitLog(self.spark, f"{self.path}/{x}").read("layout.json") for x in self.segments}

    @property
    def segments(self) -> list[str]:
        return [x for x in self.parts if x.startswith("segments/")]

    def _rows(self, segment: str) -> DataFrame:
        """The rows of a segment, known to Spark as the buckets that they are stored in. One table a segment, gone with the session."""
        name = self._table(segment)
        if not self.spark.catalog.tableExists(name):
            columns = ROWS.replace("bigint", "BIGINT")
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{self.path}/{segment}/rows') CLUSTERED BY (bucket) SORTED BY (bucket, term) INTO {self._layouts[segment]["buckets"]} BUCKETS")
            at_end(self.spark, lambda: self.spark.sql(f"DROP TABLE IF EXISTS {name}"))
        return self.spark.table(name)

    def _dead(self, segment: str) -> DataFrame | None:
        """(doc_id) of all parts after a segment; None if there are none."""
        later = self.parts[self.parts.index(segment) + 1 :]
        tables = [self.spark.read.parquet(f"{self.path}/{x}/docs" if x.startswith("segments/") else f"{self.path}/{x}").select("doc_id") for x in later]
        return reduce(DataFrame.union, tables) if tables else None

    def _union(self, of: Callable[[str], DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.union, [of(x) for x in self.segments]) if self.segments else self.spark.createDataFrame([], schema)

    @property
    def doc_stats(self) -> DataFrame:
        """(doc_id, doc_len) of the documents that count."""

        def live(segment: str) -> DataFrame:
            docs, dead = self.spark.read.parquet(f"{self.path}/{segment}/docs"), self._dead(segment)
            return (docs if dead is None else docs.join(dead, "doc_id", "left_anti")).select("doc_id", F.col("doc_len").cast("long").alias("doc_len"))

        return self._union(live, "doc_id long, doc_len long")

    @property
    def doc_ids(self) -> DataFrame:
        return self.doc_stats.select("doc_id")

    @property
    def corpus_stats(self) -> DataFrame:
        """n_docs, total_terms, avg_doc_len (0 if empty); from what the segments say if no document of theirs is dead."""
        if len(self.parts) == len(self.segments) <= 1:
            n, total = ((x := self._layouts[self.segments[0]])["n_docs"], x["total_terms"]) if self.segments else (0, 0)
            return self.spark.createDataFrame([(n, total, total / n if n else 0.0)], "n_docs long, total_terms long, avg_doc_len double")
        return LexicalIndex.corpus_stats.fget(self)

    def postings_of(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, doc_id, term_freq, doc_len, positions or null) of the documents that count; ``terms``: (term) of those wanted."""

        def live(segment: str) -> DataFrame:
            rows, dead = self._rows(segment), self._dead(segment)
            heads = rows.where("term = ''").select("bucket", F.col("ids").alias("of"), F.col("lens").alias("sizes"))
            lists = self._lists(rows) if terms is None else self._lists(rows).join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
            # ids and lengths are looked up before rows multiply, so the bucket's arrays aren't copied for each posting
            own = lambda column: F.transform("places", lambda p: F.get(F.col(column), p))
            zipped = F.arrays_zip(own("of").alias("doc_id"), F.col("freqs").alias("term_freq"), own("sizes").alias("doc_len"), F.coalesce("positions", F.transform("places", lambda _: F.lit(None).cast("array<int>"))).alias("positions"))
            out = lists.join(heads, "bucket").select("term", F.inline(zipped)).withColumn("doc_len", F.col("doc_len").cast("long"))
            return out if dead is None else out.join(dead, "doc_id", "left_anti").select(out.columns)

        return self._union(live, "term string, doc_id long, term_freq int, doc_len long, positions array<int>")

    @property
    def postings(self) -> DataFrame:
        return self.postings_of()

    @property
    def vocabulary(self) -> DataFrame:
        """(term, df); segments that later parts take documents from are counted anew."""
        return self.frequencies()

    def frequencies(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df) of the documents that count, for the terms wanted."""

        def of(segment: str) -> DataFrame:
            if self._dead(segment) is None:
                known = self.spark.read.parquet(f"{self.path}/{segment}/vocabulary")
                return known if terms is None else known.join(terms.select("term").distinct(), "term", "left_semi")
            rows = self._rows(segment)
            dead = rows.where("term = ''").select("bucket", F.posexplode("ids").alias("place", "doc_id")).join(self._dead(segment), "doc_id", "left_semi").select("bucket", "place")
            lists = self._lists(rows) if terms is None else self._lists(rows).join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
            return lists.select("bucket", "term", F.explode("places").alias("place")).join(dead, ["bucket", "place"], "left_anti").groupBy("term").agg(F.count("*").alias("df"))

        every = self._union(of, "term string, df long")
        return every if len(self.segments) < 2 else every.groupBy("term").agg(F.sum("df").alias("df"))

    def cleared(self) -> StoredIndex:
        """The index without any document."""
        return dataclasses.replace(self, parts=())

    def without(self, removed: DataFrame, id_col: str = "doc_id") -> StoredIndex:
        """The index without the documents whose ids are in ``removed``: a list of ids is written, nothing else."""
        name = CommitLog(self.spark, self.path).new_folder("removed")
        removed.select(F.col(id_col).cast("long").alias("doc_id")).distinct().write.parquet(f"{self.path}/{name}")
        return dataclasses.replace(self, parts=(*self.parts, name))

    def plus(self, added: LexicalIndex) -> StoredIndex:
        """The index with the documents of another; those in both are taken from the other. One segment is written, nothing else."""
        return dataclasses.replace(self, parts=(*self.parts, self._segment(added)))

    def merged(self, factor: int = 2) -> StoredIndex:
        """The newest segments as one, from the oldest on that is at most ``factor`` times as large as all after it.

        So sizes fall geometrically from one segment to the next, and their
        number stays below the logarithm of the index.
        """
        sizes = [self._layouts[x]["total_terms"] for x in self.segments]
        first = next((i for i in range(len(sizes)) if i + 1 < len(sizes) and sizes[i] <= factor * sum(sizes[i + 1 :])), None)
        if first is None:
            if len(self.segments) == 1 and len(self.parts) > 1 and self.doc_ids.count() * factor < self._layouts[self.segments[0]]["n_docs"]:
                first = 0  # most of it is dead
            else:
                return self
        at = self.parts.index(self.segments[first])
        tail = dataclasses.replace(self, parts=self.parts[at:])
        made = self._segment(LexicalIndex(tail.postings, tail.doc_stats))
        # ids removed by the tail may stand in older segments
        removed = [x for x in tail.parts if x.startswith("removed/")] if at else []
        return dataclasses.replace(self, parts=(*self.parts[:at], *removed, made))

    def stored(self) -> StoredIndex:
        return self

    def best(self, weights: DataFrame, average: float, top_k: int, k1: float, b: float, report: bool = False) -> DataFrame:
        """(query_id, doc_id, total): the best ``top_k`` of every query and bucket. ``weights``: one block of (query_id, term, idf)."""
        kind = weights.schema["query_id"].dataType.simpleString()
        shared = self.spark.sparkContext.broadcast(Asked.of(weights.select("query_id", "term", "idf").toArrow(), average, k1, b))
        terms = F.broadcast(weights.select("term").distinct().union(self.spark.createDataFrame([("",)], "term string")))
        schema = f"query_id {kind}, doc_id bigint, total double"

        def of(segment: str) -> DataFrame:
            rows = self._rows(segment).join(terms, "term", "left_semi").select("bucket", "term", "ids", "lens", "places", "freqs", "tops", "lows").groupBy("bucket")
            dead = self._dead(segment)
            if dead is None:
                search = _searched(shared, top_k, report)
                return rows.applyInArrow(lambda table: search(table), schema)
            n = self._layouts[segment]["buckets"]
            dealt = dead.withColumn("bucket", F.get(F.array(*[F.lit(v) for v in bucket_numbers(self.spark, n)]), F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")))
            return rows.cogroup(dealt.groupBy("bucket")).applyInArrow(_searched(shared, top_k, report), schema)

        return self._union(of, schema)
