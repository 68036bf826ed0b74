"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of one partition, of about SHARD_BYTES (cut
where it has more than SHARD_WORDS words, with an overlap that no window
outgrows).  Its words are
numbered, its suffixes sorted, and the windows of the benchmark found by
backward search; occurrences are located from sampled suffix positions and
merged into spans of words.

The benchmark is broadcast in blocks.  Up to PASS_BYTES of it take one pass
over the documents.  A larger one takes several: each broadcasts its blocks,
writes the few documents it hits with their spans, and frees the blocks; in
the end the spans of each document are merged and cut.  Documents that no
pass hits aren't shuffled: a Bloom filter of the rows that are hit keeps them
out of the join.  Items larger than a block are cut into pieces that overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import words as W
from corvane.llm.fm_index import FMIndex
from corvane.llm.shared import Bloom, bounded_batches, tidy
from corvane.scratch import unused, written

WINDOW = 10
SHARD_BYTES = 8 << 20
SHARD_WORDS = 2_000_000
#: A word of a text before A-Z are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Benchmark text of one block, and of one pass: what is broadcast at once. A block takes about 5 bytes for each byte of text.
BLOCK_BYTES = 4 << 20
PASS_BYTES = 16 << 20
#: Windows searched, and occurrences located, at once.
SEARCH_ROWS = 1 << 16
LOCATE_ROWS = 1 << 20
ADDED = {"n_words": T.LongType(), "n_hit": T.LongType(), "items": T.ArrayType(T.StringType()), "spans": T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))}


class Block:
    """The words of some benchmark items, and by length the places where their windows begin and the item of each."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        data, offsets = W.text_bytes(pa.array(texts, pa.large_string()))
        data = W.LOWER[data]
        starts, ends, counts = W.word_bounds(data, offsets, W.ALNUM)
        self.ids = ids
        self.hashes = W.word_hashes(data, starts, ends)
        length = np.minimum(counts, window)
        n = np.where(counts > 0, counts - length + 1, 0)
        item = np.repeat(np.arange(len(counts), dtype=np.int32), n)
        at = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(counts) - counts, n)
        self.by_length = {int(x): (at[length[item] == x].astype(np.int32), item[length[item] == x]) for x in np.unique(length[n > 0])}


def item_pieces(text: str, window: int) -> Iterator[str]:
    """The text, or pieces of less than a block's size that share ``window`` - 1 words with the next: all its windows, each in one piece."""
    if len(text.encode()) < BLOCK_BYTES:
        yield text
        return
    words, begin = WORD.findall(text), 0
    while begin < len(words):
        end, size = begin, 0
        while end < len(words) and (size < BLOCK_BYTES // 2 or end - begin < window):
            size += len(words[end].encode()) + 1
            end += 1
        yield " ".join(words[begin:end])
        if end == len(words):
            return
        begin = end - window + 1


def benchmark_passes(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[list[Block]]:
    """The blocks of each pass, of bounded size together, read partition by partition. Items without id or text are left out."""
    blocks: list[Block] = []
    ids: list[str] = []
    texts: list[str] = []
    size = taken = 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).toLocalIterator():
        for piece in item_pieces(text, window):
            ids.append(item)
            texts.append(piece)
            size += len(piece.encode())
            if size >= BLOCK_BYTES:
                blocks.append(Block(ids, texts, window))
                taken, size, ids, texts = taken + size, 0, [], []
                if taken >= PASS_BYTES:
                    yield blocks
                    blocks, taken = [], 0
    if ids:
        blocks.append(Block(ids, texts, window))
    if blocks:
        yield blocks


def search_shard(hashes: np.ndarray, rows: np.ndarray, blocks: list[Block], covered: np.ndarray, at: int, items: dict[int, set[str]]) -> None:
    """Mark the hit words of one shard in ``covered`` (a difference array) and collect the items of each row."""
    known, number = np.unique(hashes, return_inverse=True)
    cut = np.flatnonzero(rows[1:] != rows[:-1]) + 1
    seq = np.zeros(len(number) + len(cut) + 1, dtype=np.int64)
    place = np.arange(len(number))
    place += np.searchsorted(cut, place, "right")  # one separator for each row before
    seq[place] = number + 1
    word_of = np.zeros(len(seq), dtype=np.int64)
    word_of[place] = np.arange(len(number))
    index = FMIndex(seq, len(known))
    for block in blocks:
        word = np.searchsorted(known, block.hashes)
        word[word == len(known)] = 0
        strange = np.concatenate([[0], np.cumsum(known[word] != block.hashes)])
        for length, (begins, owners) in block.by_length.items():
            there = np.flatnonzero(strange[begins + length] == strange[begins])  # windows of words that the shard has
            for some in np.split(there, range(SEARCH_ROWS, len(there), SEARCH_ROWS)):
                if len(some):
                    _mark(index, word[begins[some][:, None] + np.arange(length)] + 1, owners[some], block.ids, rows, word_of, covered, at, items)


def _mark(index: FMIndex, patterns: np.ndarray, owners: np.ndarray, ids: list[str], rows: np.ndarray, word_of: np.ndarray, covered: np.ndarray, at: int, items: dict[int, set[str]]) -> None:
    """Search ``patterns`` and mark the words of their occurrences."""
    pattern, low, high = index.search(patterns)
    counts = high - low
    ends = np.cumsum(counts)
    for first in range(0, int(ends[-1]) if len(ends) else 0, LOCATE_ROWS):
        flat = np.arange(first, min(first + LOCATE_ROWS, int(ends[-1])))
        of = np.searchsorted(ends, flat, "right")
        position = word_of[index.locate(low[of] + flat - (ends[of] - counts[of]))]
        np.add.at(covered, at + position, 1)
        np.add.at(covered, at + position + patterns.shape[1], -1)
        for row, owner in np.unique(np.stack([rows[position], owners[pattern[of]]]), axis=1).T.tolist():
            items.setdefault(row, set()).add(ids[owner])


def find_spans(column: pa.Array, blocks: list[Block], window: int) -> tuple[np.ndarray, list[list[str]], list[list[tuple[int, int]]]]:
    """(words, items, spans of hit words as first and last word) of each row."""
    data, offsets = W.text_bytes(column)
    data = W.LOWER[data]
    starts, ends, counts = W.word_bounds(data, offsets, W.ALNUM)
    hashes = W.word_hashes(data, starts, ends)
    rows = np.repeat(np.arange(len(counts)), counts)
    covered = np.zeros(len(hashes) + 1, dtype=np.int64)
    items: dict[int, set[str]] = {}
    for first in range(0, len(hashes), SHARD_WORDS):
        last = min(len(hashes), first + SHARD_WORDS + window - 1)
        search_shard(hashes[first:last], rows[first:last], blocks, covered, first, items)
    hit = np.cumsum(covered[:-1]) > 0
    spans: list[list[tuple[int, int]]] = [[] for _ in counts]
    if hit.any():
        base = np.cumsum(counts) - counts
        begin = hit.copy()
        begin[1:] &= ~hit[:-1] | (rows[1:] != rows[:-1])
        end = hit.copy()
        end[:-1] &= ~hit[1:] | (rows[1:] != rows[:-1])
        for a, b in zip(np.flatnonzero(begin).tolist(), np.flatnonzero(end).tolist(), strict=True):
            spans[rows[a]].append((a - int(base[rows[a]]), b - int(base[rows[a]])))
    return counts, [sorted(items.get(i, ())) for i in range(len(counts))], spans


def find_in_shards(batches: Iterator[pa.RecordBatch], at: int, blocks: list[Block], window: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[list[str]], list[list[tuple[int, int]]]]]:
    """Each batch with what find_spans gives for its column ``at``, worked out for a shard of batches at once."""
    shard: list[pa.RecordBatch] = []

    def searched() -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[list[str]], list[list[tuple[int, int]]]]]:
        counts, items, spans = find_spans(pa.concat_arrays([b.column(at) for b in shard]), blocks, window)
        first = 0
        for batch in shard:
            own = slice(first, first := first + len(batch))
            yield batch, counts[own], items[own], spans[own]

    for batch in batches:
        shard.append(batch)
        if sum(b.column(at).nbytes for b in shard) >= SHARD_BYTES:
            yield from searched()
            shard = []
    if shard:
        yield from searched()


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(column: pa.Array, spans: list[list[tuple[int, int]]]) -> pa.Array:
    """The texts with the spans of words cut out, and what stands between their words."""
    data, offsets = W.text_bytes(column)
    starts, ends, counts = W.word_bounds(W.LOWER[data], offsets, W.ALNUM)
    base = np.cumsum(counts) - counts
    out = column.to_pylist()
    for i, own in enumerate(spans):
        if own:
            raw, keep, at = out[i].encode(), [], 0
            for a, b in own:
                keep.append(raw[at : int(starts[base[i] + a] - offsets[i])])
                at = int(ends[base[i] + b] - offsets[i])
            out[i] = b"".join([*keep, raw[at:]]).decode()
    return pa.array(out, pa.string()).cast(column.type)


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _result(batch: pa.RecordBatch, at: int, counts: np.ndarray, items: list[list[str]], spans: list[list[tuple[int, int]]], rewrite: bool) -> pa.RecordBatch:
    columns = list(batch.columns)
    if rewrite and any(spans):
        columns[at] = _without(batch.column(at), spans)
    n_hit = [sum(b - a + 1 for a, b in x) for x in spans]
    runs = [[{"first": a, "last": b} for a, b in x] for x in spans]
    added = [pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(runs, SPANS)]
    return pa.RecordBatch.from_arrays([*columns, *added], names=[*batch.schema.names, *ADDED])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, rewrite: bool = True) -> DataFrame:
    """``docs`` and n_words, n_hit (long), items (sorted strings), spans (first and last word of each removed run).

    Words are runs of digits, letters and all non-ASCII characters, with A-Z
    lower-cased.  An item's windows are its runs of ``window`` words, or all
    its words if it has fewer; words inside any occurrence of a window are hit
    and, with ``rewrite``, cut from the text together with what stands between
    them.  Null texts have no words and stay null; texts of any length are
    searched whole.  Items without text, words or id match nothing.  Repeated
    rows get the same results.  Columns with the names of those added are
    replaced; all others pass through, whatever their names.  Empty tables
    give empty results, or no hits.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    gone = {c.lower() for c in ADDED}
    kept = docs.select(*[docs[c] for c in docs.columns if c.lower() not in gone])
    at = kept.columns.index(text_col)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(k, v) for k, v in ADDED.items()]])
    passes = benchmark_passes(benchmark, item_id, item_text, window)
    blocks, more = next(passes, []), next(passes, None)
    if more is None:
        shared = spark.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, counts, items, spans in find_in_shards(batches, at, shared.value, window):
                yield _result(batch, at, counts, items, spans, rewrite)

        return kept.mapInArrow(tidy(run), schema)
    (row,) = unused(kept.columns, "_row")
    numbered = written(kept.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = []
    while blocks:
        found.append(_hits(numbered.select(row, text_col), spark.sparkContext.broadcast(blocks), window))
        blocks, more = more, next(passes, None)
    return _merged(numbered, reduce(DataFrame.union, found), row, at, schema, rewrite)


def _hits(texts: DataFrame, shared, window: int) -> DataFrame:
    """(row, items, spans) of the documents that one pass hits, written; frees the broadcast blocks."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("items", ADDED["items"]), T.StructField("spans", ADDED["spans"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, items, spans in find_in_shards(batches, 1, shared.value, window):
            some = [i for i, x in enumerate(spans) if x]
            runs = [[{"first": a, "last": b} for a, b in spans[i]] for i in some]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int64())), pa.array([items[i] for i in some], pa.list_(pa.string())), pa.array(runs, SPANS)], names=["row", "items", "spans"])

    out = written(texts.mapInArrow(tidy(run), schema), "hits")
    shared.destroy()
    return out


def _split(numbered: DataFrame, every: DataFrame, row: str, one: str, maybe: str) -> tuple[DataFrame, DataFrame]:
    """The documents that may be among the hit ones, and those that are not."""
    tested = Bloom(every, one).flagged(numbered, F.col(row), maybe)
    return tested.where(maybe).drop(maybe), tested.where(~F.col(maybe)).drop(maybe)


def _merged(numbered: DataFrame, hits: DataFrame, row: str, at: int, schema: T.StructType, rewrite: bool) -> DataFrame:
    """The numbered documents with what all passes found in them. Only those that a Bloom filter of the hit rows holds are joined; the rest pass straight through."""
    one, items, spans, maybe = unused(numbered.columns, "_one", "_items", "_spans", "_maybe")
    every = hits.groupBy(F.col("row").alias(one)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(items), F.flatten(F.collect_list("spans")).alias(spans))
    every = written(every, "merged")
    few, clean = _split(numbered, every, row, one, maybe)
    joined = few.join(every, F.col(row) == F.col(one), "left").drop(row, one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [merged_spans([(s["first"], s["last"]) for s in x or ()]) for x in batch.column(len(batch.columns) - 1).to_pylist()]
            names = [x or [] for x in batch.column(len(batch.columns) - 2).to_pylist()]
            yield _result(batch.select(batch.schema.names[:-2]), at, _counts(batch, at), names, found, rewrite)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _result(batch, at, _counts(batch, at), [[]] * len(batch), [[]] * len(batch), rewrite)

    return joined.mapInArrow(tidy(run), schema).union(clean.drop(row).mapInArrow(tidy(untouched), schema))


def _counts(batch: pa.RecordBatch, at: int) -> np.ndarray:
    """The words of each text."""
    data, offsets = W.text_bytes(batch.column(at))
    return W.word_bounds(W.LOWER[data], offsets, W.ALNUM)[2]
