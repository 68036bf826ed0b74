"""Removal of passages that an earlier document has too, by super-k-mers.

A window is ``window`` consecutive words.  Its minimiser is the least hash of
the n-grams in it, so equal windows of any two documents have the same one.
Consecutive windows that share a minimiser travel as one packed string:

1. Of every document only its minimisers move, summed in the task first; those
   of two documents or more become a Bloom filter of bounded size.  (Where it
   is too full to tell, more strings travel, and nothing else changes.)
2. Strings whose minimiser it holds are written.  Equal strings of one
   minimiser become one row with the least and the greatest id, summed in the
   task first, so copies don't meet anywhere.
3. Minimisers are dealt into buckets of bounded size.  In a bucket, the words
   are numbered exactly, windows are sorted by rank doubling, and each gets the
   least id that it starts in.  A minimiser with more strings than a bucket
   may hold goes window by window through a sum by the window's MD5 instead.
4. The owners of windows go back to the strings' places; what is covered by a
   window of an earlier owner is cut out of the documents that a second Bloom
   filter takes for changed.  The others pass straight through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import words as W
from corvane.llm.shared import Bloom, bounded_batches, tidy
from corvane.scratch import SPLITS_PER_FILE, discard, join_groups, staged, unused, written

WINDOW = 50
#: Words of the n-grams whose least hash is the minimiser.
NGRAM = 12
#: Most windows in one packed string.
MOST_WINDOWS = 64
#: Bytes of packed strings in one bucket, and of one minimiser before it goes window by window.
BUCKET_BYTES, HOT_BYTES = 8 << 20, 2 << 20
ADDED = {"n_words": T.LongType(), "n_removed": T.LongType()}


def window_minimisers(hashes: np.ndarray, window: int, ngram: int) -> np.ndarray:
    """The least n-gram hash in every run of ``window`` words; windows across rows are among them."""
    value = W.window_hashes(hashes, ngram)
    wide, done = window - ngram + 1, 1
    while 2 * done <= wide:
        value = np.minimum(value[: len(value) - done], value[done:])
        done *= 2
    if done < wide:
        value = np.minimum(value[: len(value) - (wide - done)], value[wide - done :])
    return value


def super_kmers(hashes: np.ndarray, counts: np.ndarray, window: int, ngram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word in the batch, windows, minimiser) of the runs of windows with one minimiser."""
    if len(hashes) < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    rows = np.repeat(np.arange(len(counts)), counts)
    value = window_minimisers(hashes, window, ngram)
    inside = rows[: len(value)] == rows[window - 1 :]
    begins = inside.copy()
    begins[1:] &= (value[1:] != value[:-1]) | (rows[1 : len(value)] != rows[: len(value) - 1]) | ~inside[:-1]
    place = np.arange(len(value))
    since = place - np.maximum.accumulate(np.where(begins, place, 0))
    begins |= inside & (since % MOST_WINDOWS == 0) & (since > 0)
    first = np.flatnonzero(begins)
    number = np.cumsum(begins)[inside] - 1
    return rows[first], first, np.bincount(number, minlength=len(first)), value[first].view(np.int64)


def _batch_words(column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, words of each row, word hashes)."""
    data, offsets = W.text_bytes(column)
    starts, ends, counts = W.word_bounds(data, offsets, W.NON_BLANK)
    return data, starts, ends, counts, W.word_hashes(data, starts, ends)


def _packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """The words first .. first + size - 1 joined by one space, for each entry."""
    widths = ends - starts + 1
    place = np.concatenate([[0], np.cumsum(widths)])
    blank = np.ones(len(data) + 1, dtype=bool)  # one byte after each word is kept, as a space
    blank[:-1] = ~W.NON_BLANK[data]
    keep = ~blank
    keep[ends] = True
    padded = np.append(data, np.uint8(32))
    if np.any(starts[1:] == ends[:-1]):  # texts that touch: no blank between their words
        pieces = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        joined = b" ".join(pieces)
    else:
        padded[blank] = 32
        joined = padded[keep].tobytes()
    return pa.array([joined[a:b] for a, b in zip(place[first].tolist(), (place[first + size] - 1).tolist(), strict=True)], pa.binary())


def document_minimisers(docs: DataFrame, window: int, ngram: int) -> DataFrame:
    """(minimiser, id): distinct within each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, _, counts, hashes = _batch_words(batch.column(1))
            row, _, _, value = super_kmers(hashes, counts, window, ngram)
            pairs = np.unique(np.stack([row, value]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1], pa.int64()), batch.column(0).take(pa.array(pairs[0]))], names=["minimiser", "id"])

    return docs.select("id", "text").mapInArrow(tidy(run), f"minimiser bigint, id {docs.schema['id'].dataType.simpleString()}")


def packed_strings(docs: DataFrame, window: int, ngram: int) -> DataFrame:
    """(id, tag, at, minimiser, packed): every string of windows, and the word of the document that it begins with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends, counts, hashes = _batch_words(batch.column(2))
            row, first, windows, value = super_kmers(hashes, counts, window, ngram)
            of = pa.array(row, pa.int64())
            base = np.cumsum(counts) - counts
            packed = _packed(data, starts, ends, first, windows + window - 1) if len(row) else pa.array([], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(first - base[row], pa.int64()), pa.array(value, pa.int64()), packed], names=["id", "tag", "at", "minimiser", "packed"])

    return docs.select("id", "tag", "text").mapInArrow(tidy(run), f"id {docs.schema['id'].dataType.simpleString()}, tag bigint, at bigint, minimiser bigint, packed binary")


def window_ranks(packed: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the window's word sequence, string, place in the string) of all windows of packed strings.

    Words are numbered by a dictionary, then pieces of 2, 4, 8 ... words by
    sorting pairs of numbers, so equal numbers mean equal words.
    """
    parts = pc.split_pattern(packed.cast(pa.large_string()), " ")
    counts = np.diff(parts.offsets.to_numpy()).astype(np.int64)
    rank = parts.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    own = np.repeat(np.arange(len(counts)), counts)
    done = 1
    while done < window:
        step = min(done, window - done)  # the last two pieces overlap
        pairs = rank[: len(rank) - step] * np.int64(len(rank) + 1) + rank[step:]
        rank = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        done += step
    inside = np.flatnonzero(own[: len(rank)] == own[window - 1 :])
    return rank[inside], own[inside], inside - (np.cumsum(counts) - counts)[own[inside]]


def bucket_owners(window: int):
    """For the strings of one bucket: runs of windows with one owner, where that is less than the string's greatest id."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = lambda name: table.column(name).chunk(0) if table.column(name).num_chunks else table.column(name).combine_chunks()
        number, own, at = window_ranks(column("packed"), window)
        least, most = column("least").to_numpy(zero_copy_only=False), column("most").to_numpy(zero_copy_only=False)
        # equal windows stand together, the least id first: it owns them all
        order = np.lexsort((least[own], number))
        head = np.ones(len(order), dtype=bool)
        head[1:] = number[order[1:]] != number[order[:-1]]
        owner = np.empty(len(order), dtype=least.dtype)
        owner[order] = least[own[order]][np.flatnonzero(head)][np.cumsum(head) - 1]
        taken = owner < most[own]
        begin = taken.copy()
        begin[1:] &= ~taken[:-1] | (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(begin)
        size = np.bincount(np.cumsum(begin)[taken] - 1, minlength=len(first)) if len(first) else first
        return pa.table([column("string").take(pa.array(own[first])), pa.array(at[first], pa.int64()), pa.array(at[first] + size - 1, pa.int64()), pa.array(owner[first], table.schema.field("least").type)], names=["string", "first", "last", "owner"])

    return run


def windows_by_digest(strings: DataFrame, window: int) -> DataFrame:
    """Like bucket_owners, for strings of hot minimisers: every window by itself, its least id a sum over all tasks."""
    kind = strings.schema["least"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            string, place, digest = [], [], []
            for i, packed in enumerate(batch.column(1).to_pylist()):
                words = packed.split(b" ")
                for at in range(len(words) - window + 1):
                    string.append(i)
                    place.append(at)
                    digest.append(hashlib.md5(b" ".join(words[at : at + window])).digest())
            of = pa.array(string, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array(place, pa.int64()), pa.array(digest, pa.binary()), batch.column(2).take(of), batch.column(3).take(of)], names=["string", "first", "digest", "least", "most"])

    windows = written(strings.select("string", "packed", "least", "most").mapInArrow(tidy(run), f"string binary, first bigint, digest binary, least {kind}, most {kind}"), "windows")
    owners = written(windows.groupBy("digest").agg(F.min("least").alias("owner"), F.count("*").alias("n")), "owners")
    found = join_groups(windows, owners, "digest", "n").where(F.col("owner") < F.col("most"))
    return found.select("string", "first", F.col("first").alias("last"), "owner")


def repeated_spans(docs: DataFrame, window: int = WINDOW, ngram: int = NGRAM, bucket_bytes: int = BUCKET_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(id, tag, spans): first and last word of the pieces that windows of documents with a smaller id cover. ``docs``: (id, tag, text)."""
    counted = document_minimisers(docs, window, ngram).groupBy("minimiser").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    shared = written(counted.where(F.col("least") < F.col("most")).select("minimiser"), "shared")
    flagged = Bloom(shared, "minimiser").flagged(packed_strings(docs, window, ngram), F.col("minimiser"), "maybe").where("maybe")
    places = written(flagged.select("id", "tag", "at", "minimiser", "packed", F.unhex(F.md5("packed")).alias("string")), "strings", SPLITS_PER_FILE)
    strings = places.groupBy("minimiser", "string").agg(F.first("packed").alias("packed"), F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"))
    strings = written(strings, "distinct")
    sizes = written(strings.groupBy("minimiser").agg(F.sum(F.octet_length("packed")).alias("size"), F.min("least").alias("low"), F.max("most").alias("high")).where(F.col("low") < F.col("high")), "sizes")
    hot, total = F.col("size") > hot_bytes, sizes.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    sized = join_groups(strings, sizes.select("minimiser", "size"), "minimiser", "size")
    kind = docs.schema["id"].dataType.simpleString()
    dealt = sized.where(~hot).withColumn("bucket", F.pmod(F.xxhash64("minimiser"), F.lit(buckets))).groupBy("bucket")
    owners = dealt.applyInArrow(bucket_owners(window), f"string binary, first bigint, last bigint, owner {kind}")
    if sizes.where(hot).limit(1).count():
        owners = owners.unionByName(windows_by_digest(sized.where(hot), window))
    ranges = written(owners.groupBy("string").agg(F.collect_list(F.struct("first", "last", "owner")).alias("owned"), F.count("*").alias("n")), "owned")
    discard(shared)
    back = join_groups(places.select("id", "tag", "at", "string"), ranges, "string", "n")
    own = F.filter("owned", lambda x: x["owner"] < F.col("id"))
    spans = F.transform(own, lambda x: F.struct((F.col("at") + x["first"]).alias("first"), (F.col("at") + x["last"] + window - 1).alias("last")))
    cut = back.select("id", "tag", F.explode(spans).alias("span"))
    return cut.groupBy("id", "tag").agg(F.collect_set("span").alias("spans"))


def _rewritten(column: pa.Array, spans: list[list[dict] | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts of the words that are left, joined by one space; words; words removed)."""
    out, n_words, n_removed = [], np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    for i, text in enumerate(column.cast(pa.large_binary())):
        words = text.as_buffer().to_pybytes().split() if text.is_valid else []
        n_words[i] = len(words)
        if spans[i]:
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edge, [s["first"] for s in spans[i]], 1)
            np.add.at(edge, [s["last"] + 1 for s in spans[i]], -1)
            left = np.flatnonzero(np.cumsum(edge[:-1]) <= 0)
            n_removed[i] = len(words) - len(left)
            words = [words[k] for k in left.tolist()]
        out.append(b" ".join(words))
    return pa.array(out, pa.large_binary()).cast(pa.large_string()).cast(column.type), n_words, n_removed


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, ngram: int = NGRAM) -> DataFrame:
    """All columns of ``docs``, the text without repeated passages, and n_words and n_removed (long).

    Words are runs of anything but blanks, unchanged.  A word goes if a window
    of ``window`` words covers it whose words also start in a document with a
    smaller id; windows are those of the input.  What is left is joined by one
    space.  A null or empty text has no words and becomes empty.  Documents
    with the same id are one document: none of them loses to another; rows
    with a null id neither lose nor take words.  Repeated rows get the same
    results.  Texts of any length are read whole.  Columns n_words and
    n_removed of the input are replaced; others pass through, whatever their
    names.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if not 1 <= ngram <= window:
        raise ValueError("an n-gram has at least one word and no more than a window")
    gone = {c.lower() for c in ADDED}
    kept = docs.select(*[docs[c] for c in docs.columns if c.lower() not in gone])
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    slim = docs.select(F.col(id_col).alias("id"), tag.alias("tag"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    one, mark, spans, changed = unused([*kept.columns, *ADDED], "_id", "_tag", "_spans", "_changed")
    found = staged(spark, lambda: repeated_spans(slim, window, ngram).select(F.col("id").alias(one), F.col("tag").alias(mark), F.col("spans").alias(spans)), "spans")
    tested = Bloom(found, mark).flagged(kept, tag, changed)
    joined = tested.where(changed).drop(changed).join(found, (F.col(id_col) == F.col(one)) & (tag == F.col(mark)), "left").drop(one, mark)
    whole = joined.unionByName(tested.where(~F.col(changed)).drop(changed).withColumn(spans, F.lit(None).cast(found.schema[spans].dataType)))
    at = [c.lower() for c in kept.columns].index(text_col.lower())
    schema = T.StructType([*kept.schema.fields, *[T.StructField(k, v) for k, v in ADDED.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at], n_words, n_removed = _rewritten(batch.column(at), columns.pop().to_pylist())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words), pa.array(n_removed)], names=schema.names)

    return whole.mapInArrow(tidy(run), schema)
