"""Exact de-duplication with a two-pass Bloom filter, in DataFrame functions only.

Pass one gives every row a slot of SLOT_BITS bits, a short hash of its text's
fingerprint, and counts the rows of each slot, summed in every task before
anything moves; what moves of a row that occurs once is its slot and a count.
The slots of two or more rows become a Bloom filter.  Pass two tests each row
against it: a row that the filter doesn't hold occurs once and passes straight
through; only the others, with fingerprint and id, shuffle.

The filter holds slots of repeats, so its size grows with the repeats and not
with the rows.  Where they don't fit into one filter of the largest size, the
slots are dealt into rounds, and each round tests the rows of its slots with a
filter of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import BITMAP_BITS, BITS_PER_KEY, MOST_BITMAPS, Bloom
from corvane.scratch import SPLITS_PER_FILE, join_groups, unused, written

#: Of n rows, about n / 2**SLOT_BITS share a slot by chance: one in a hundred of ten billion.
SLOT_BITS = 40
#: Repeated slots of one round: what the largest Bloom filter holds.
ROUND_SLOTS = MOST_BITMAPS * BITMAP_BITS // BITS_PER_KEY


def possible_repeats(rows: DataFrame, fingerprint: str, round_slots: int = ROUND_SLOTS) -> DataFrame:
    """``rows`` with a boolean ``repeated``: false only where the fingerprint occurs in one row."""
    value, n = unused([*rows.columns, "repeated"], "_slot", "_n")
    slot = F.shiftrightunsigned(F.xxhash64(F.col(fingerprint)), 64 - SLOT_BITS)
    twice = written(rows.groupBy(slot.alias(value)).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(value), "slots")
    rounds = max(1, -(-twice.count() // round_slots))
    tested = []
    for k in range(rounds):
        own = lambda df, s: df if rounds == 1 else df.where(F.pmod(s, F.lit(rounds)) == k)  # noqa: B023, E731
        tested.append(Bloom(own(twice, F.col(value)), value).flagged(own(rows, slot), slot, "repeated"))
    return reduce(DataFrame.union, tested)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts (after ``normalise``, if given) are the
    same; a null text counts as empty.  Of a group the row with the largest id
    stays; a null id is smaller than any other, so keep_id is null only in
    groups whose ids are all null.  Of repeated rows (same id and text) one
    stays.  Texts of any length become a hash where they are read.  An empty
    table gives an empty result.  Other columns are ignored, whatever their
    names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalise(text) if normalise else text, 256)).alias("fp"), F.monotonically_increasing_id().alias("row"))
    rows = written(hashed, "fingerprints", SPLITS_PER_FILE)
    tested = possible_repeats(rows, "fp")
    alone = tested.where(~F.col("repeated")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "fp")
    maybe = written(tested.where("repeated").drop("repeated"), "repeats", SPLITS_PER_FILE)
    groups = written(maybe.groupBy("fp").agg(F.max(F.struct("id", "row")).alias("last"), F.count("*").alias("group_size")), "groups")
    found = join_groups(maybe, groups, "fp", "group_size")
    grouped = found.select("id", F.col("last.id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "fp")
    return alone.unionByName(grouped).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("fp")).alias("text_sha256"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of equal texts, all columns, whatever their names.

    Of repeated rows (same id and text) one stays; it may be any of them.
    """
    one, sha = unused(docs.columns, "_id", "_sha")
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias(one), F.col("text_sha256").alias(sha))
    own = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    return docs.join(kept, docs[id_col].eqNullSafe(F.col(one)) & (own == F.col(sha)), "left_semi").dropDuplicates([id_col, text_col])
