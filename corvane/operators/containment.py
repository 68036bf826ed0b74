"""Which documents hold which texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import words
from corvane.scratch import written

#: Words of a window that documents and items are matched by.
WINDOW = 8
#: Bytes of phrases in one automaton (some fifty times as many in a task), and automata before documents are joined instead.
PHRASE_BYTES, MOST_SCANS = 2 << 20, 4
#: Items without a window that are compared with every document at once.
BLOCK_ITEMS = 10_000


def _hashes(all_words: Column) -> Column:
    return F.transform(all_words, lambda w: F.xxhash64(w))


def _windows(hashes: Column, width: int) -> Column:
    """The hashes of all runs of ``width`` words, from the hashes of the words."""
    n = F.size(hashes)
    starts = F.when(n >= width, F.sequence(F.lit(1), n - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, F.lit(width))))


def _scanned(texts: DataFrame, phrases: list[tuple[object, str]], schema: T.StructType) -> DataFrame:
    """(id, item): one scan of the texts (id, text) with an automaton of all phrases (item, wanted)."""
    numbers: dict[str, list[int]] = {}
    for i, (_, wanted) in enumerate(phrases):
        numbers.setdefault(wanted, []).append(i)
    shared = texts.sparkSession.sparkContext.broadcast((numbers, pa.array([item for item, _ in phrases])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, items = shared.value
        machine = ahocorasick.Automaton()
        for wanted, own in known.items():
            if wanted:
                machine.add_word(wanted, own)
        machine.make_automaton()
        everywhere = known.get("", [])
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1)):
                held = set(everywhere)
                if len(machine):
                    for _, own in machine.iter(text.as_py()):
                        held.update(own)
                rows += [i] * len(held)
                found += sorted(held)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), items.take(pa.array(found, pa.int64()))], names=["id", "item"])

    return texts.mapInArrow(run, schema)


def documents_holding(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "query_id", item_text: str = "text") -> DataFrame:
    """(id, item): the documents whose text contains an item's text, letter for letter.

    Up to MOST_SCANS blocks of items, of PHRASE_BYTES each, become automata
    (Aho and Corasick), and a scan of the documents finds all items of one.

    More items are joined: the inner words of an item stand in such a document
    as whole words, in a run.  So documents are joined with items on a run of up to WINDOW of them,
    and the pairs that this gives are compared.  Items of fewer than three
    words have no inner word; they are compared with all documents, in blocks.
    Null texts hold nothing and are held by nothing; an empty item is in every
    text that isn't null.
    """
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = written(items.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text).alias("wanted"), words(F.col(item_text)).alias("w")), "items")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("wanted")), F.lit(0)), F.count("*")).first()
    if max(size[0], size[1] * 8) <= MOST_SCANS * PHRASE_BYTES:
        schema = T.StructType([texts.schema["id"], asked.schema["item"]])
        blocks: list[list[tuple[object, str]]] = [[]]
        taken = 0
        for item, wanted in asked.select("item", "wanted").collect():  # of a size just checked
            if taken > PHRASE_BYTES:
                blocks.append([])
                taken = 0
            blocks[-1].append((item, wanted))
            taken += len(wanted.encode())
        scans = [_scanned(texts, block, schema) for block in blocks if block]
        found = reduce(DataFrame.union, scans) if scans else texts.sparkSession.createDataFrame([], schema)
        return found.distinct().select(F.col("id").alias(id_col), F.col("item").alias(item_col))
    inner = asked.where("size(w) > 2").select("item", "wanted", F.slice("w", F.lit(2), F.least(F.size("w") - 2, F.lit(WINDOW))).alias("w"))
    keyed = inner.select("item", "wanted", F.size("w").alias("width"), F.xxhash64(_hashes(F.col("w"))).alias("key"))
    found = []
    split = texts.select("id", _hashes(words(F.col("text"))).alias("h"))
    for (width,) in keyed.select("width").distinct().orderBy("width").collect():  # at most WINDOW
        own = keyed.where(F.col("width") == width)
        maybe = split.select("id", F.explode(F.array_distinct(_windows(F.col("h"), width))).alias("key")).join(own.select("key", "item", "wanted"), "key")
        found.append(maybe.select("id", "item", "wanted"))
    out = []
    if found:
        pairs = reduce(DataFrame.union, found).distinct()
        out.append(pairs.join(texts, "id").where(F.contains("text", "wanted")).select("id", "item").distinct())
    short = asked.where("size(w) <= 2").select("item", "wanted")
    blocks = -(-short.count() // BLOCK_ITEMS)
    for k in range(blocks):
        block = short.where(F.pmod(F.xxhash64("item", "wanted"), F.lit(blocks)) == k)
        out.append(texts.join(F.broadcast(block), F.contains("text", "wanted")).select("id", "item").distinct())
    if not out:
        out.append(texts.join(keyed, F.lit(False)).select("id", "item"))
    return reduce(DataFrame.union, out).distinct().select(F.col("id").alias(id_col), F.col("item").alias(item_col))
