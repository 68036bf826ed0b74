"""Stretches of repeated words in every document: found, listed, and collapsed to their first period.

Each text is worked through whole where it is read.  A run of ``least`` words
or more consists of words that short repeated n-grams cover, so the words of a
batch that no repeated n-gram of their document covers are put aside with one
sort of hashes.  What is left of a document, its stretches, goes through the
factorisation and Main's algorithm (``runs``) with exact words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import words as W
from corvane.llm.runs import Run, maximal_runs
from corvane.llm.shared import BLANKS, bounded_batches, tidy

#: Least words of a run.
LEAST_WORDS = 12
RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
ADDED = {"n_words": T.LongType(), "runs": T.ArrayType(RUN)}
_RUNS = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))


def repetitive_stretches(hashes: np.ndarray, counts: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, end) of the words, longest pieces first to last, outside which no run of ``least`` words has a word.

    In a run of L >= max(least, 2 q) words all n-grams of its first L - q
    words stand again q words later.  With n = least / 2 there is one at
    least (L - q >= least - q for small q, and >= q otherwise), and together
    they cover the run and show where it ends.
    """
    width = max(1, least // 2)
    rows = np.repeat(np.arange(len(counts)), counts)
    if len(hashes) < least:
        return []
    own = W.window_hashes(hashes, width)
    full = np.flatnonzero(rows[: len(own)] == rows[width - 1 :])
    key = W.mix(own[full] ^ W.mix(rows[full].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = np.zeros(len(key) + 1, dtype=bool)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    again = full[order[same[1:] | same[:-1]]]
    covered = np.zeros(len(hashes) + 1, dtype=np.int32)
    covered[: len(hashes)] += np.bincount(again, minlength=len(hashes)).astype(np.int32)
    covered -= np.bincount(again + width, minlength=len(hashes) + 1).astype(np.int32)
    inside = np.cumsum(covered[:-1]) > 0
    turn = np.ones(len(hashes) + 1, dtype=bool)
    turn[1:-1] = (inside[1:] != inside[:-1]) | (rows[1:] != rows[:-1])
    edges = np.flatnonzero(turn)
    return [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if inside[a] and b - a >= least]


def find_runs(column: pa.Array, least: int = LEAST_WORDS) -> tuple[np.ndarray, dict[int, list[Run]]]:
    """The number of words of each text, and its runs as (start, length, period) if it has any."""
    data, offsets = W.text_bytes(column)
    starts, ends, counts = W.word_bounds(data, offsets, W.NON_BLANK)
    base = np.cumsum(counts) - counts
    found: dict[int, list[Run]] = {}
    raw = data.tobytes()
    for first, end in repetitive_stretches(W.word_hashes(data, starts, ends), counts, least):
        numbers: dict[bytes, int] = {}
        words = [numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts[first:end].tolist(), ends[first:end].tolist(), strict=True)]
        row = int(np.searchsorted(base, first, "right")) - 1
        while not counts[row]:  # empty texts before it begin at the same word
            row -= 1
        runs = maximal_runs(words, least)
        if runs:
            found.setdefault(row, []).extend((first - int(base[row]) + a, n, p) for a, n, p in runs)
    return counts, found


def collapsed(text: bytes, runs: list[Run]) -> bytes:
    """The words joined by one space, of each run only the first period."""
    words = text.split()  # bytes: at ASCII blanks
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, n, period in runs:
        gone[start + period] += 1
        gone[start + n] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) <= 0).tolist())


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with collapsed texts, and n_words (long) and runs (start, length, period), by start, then period.

    Words are runs of anything but blanks.  A run is a stretch of words with
    the smallest period q, at least ``least`` and 2 q words, that no
    neighbouring word extends; of its words those after the first q go.  The
    text becomes the words kept, joined by one space.  A null or empty text has no words and becomes empty.  Texts of
    any length are searched whole, in memory in proportion to the longest.
    Repeated rows get the same results.  Columns n_words and runs of the input
    are replaced; others pass through, whatever their names.  An empty table
    gives an empty result.  Nothing shuffles.
    """
    bounded_batches(docs.sparkSession)
    gone = {c.lower() for c in ADDED}
    kept = docs.select(*[docs[c] for c in docs.columns if c.lower() not in gone])
    at = [c.lower() for c in kept.columns].index(text_col.lower())
    schema = T.StructType([*kept.schema.fields, *[T.StructField(k, v) for k, v in ADDED.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            counts, found = find_runs(texts, least)
            joined = [collapsed(t.as_buffer().to_pybytes() if t.is_valid else b"", found.get(i, [])) for i, t in enumerate(texts.cast(pa.large_binary()))]
            runs = [[{"start": a, "length": n, "period": p} for a, n, p in found.get(i, ())] for i in range(len(batch))]
            columns = list(batch.columns)
            columns[at] = pa.array(joined, pa.large_binary()).cast(pa.large_string()).cast(texts.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(runs, _RUNS)], names=[*batch.schema.names, *ADDED])

    return kept.mapInArrow(tidy(run), schema)


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    clean = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, r"[\x20\x09-\x0D]+", -1))


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` in which the texts of every tenth document, by the CRC-32 of its id, become periodic from some word on.

    With h the CRC-32 of the decimal id and g = h / 10, word i from a = g mod n
    on becomes word a + (i - a) mod p of the n words, p = 1 + (n - a) / (3 + g mod 8).
    Texts of other rows, those with null ids and those without words stay.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = words_of(F.col(text_col))
    n = F.size(words).cast("long")
    g = F.floor(h / 10)

    def planted(x: Column) -> Column:
        size, a = F.size(x["words"]), x["a"]
        period = (1 + F.floor((size - a) / (3 + x["g"] % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.get(x["words"], F.when(i < a, i).otherwise(a + (i - a) % period))), " ")

    once = F.array(F.struct(words.alias("words"), (g % F.greatest(n, F.lit(1))).cast("int").alias("a"), g.alias("g")))  # a text is split once
    changed = F.coalesce((h % 10 == 0) & (F.length(F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(BLANKS))) > 0), F.lit(False))
    return docs.withColumn(text_col, F.when(changed, F.get(F.transform(once, planted), F.lit(0))).otherwise(F.col(text_col)))
