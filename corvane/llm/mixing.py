"""Mixing sources to target weights with nested hash-threshold histograms.

Every document has a fixed hash.  A source is taken whole as often as its
target allows, and once more for the documents whose hash lies under the
source's threshold.  The threshold is found from histograms: words summed by
source and the top bits of the hash, then by the next bits inside the bucket
where the budget ends, and so on.  No documents are sorted or collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.scratch import SPLITS_PER_FILE, unused, written

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
LEVEL_BITS = 12
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2.0
#: Most sources whose table (five numbers each) is broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def hash60(id_column: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(id_column.cast("string"), F.lit("null"))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _places(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``place``: the number of sources before each, in code-point order, null last.

    Sources are sorted over all partitions; a row's place is its place in its
    partition and the rows of the partitions before, so no task has them all.
    """
    ordered = written(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ordered.join(F.broadcast(before), part == F.col("part")).select(*sizes.columns, (F.col("before") + within).alias("place"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_repeats: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size) -> with target: ``share`` of all sizes split by weight, at most ``most_repeats`` times each size, the excess reshared.

    Sources are put in code-point order, null last, and take the weights in
    turn.  A source below its cap gets weight x level.  The level rises in
    steps, each one sum over the sources: those whose share exceeds their cap
    stop there, and what they leave is shared by the rest, until none exceeds.
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    base = written(_places(sizes).select("source", "source_size", turn.alias("weight"), (F.col("source_size") * float(most_repeats)).alias("cap")), "weights")
    level = 0.0
    budget = (base.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:
        full = F.col("weight") * level > F.col("cap")
        spent, open_weight = base.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if not open_weight:
            level = float("inf")
            break
        risen = (budget - spent) / open_weight
        if risen <= level:
            break
        level = risen
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return base.select("source", "source_size", F.round(target, 6).alias("target"))


def source_bounds(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_repeats: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target, whole, last) from (source, size, h): how often each source is taken whole, and the last hash that is taken once more."""
    sources = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most_repeats), "sources")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    budgets = sources.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    # the bucket in which each source's budget ends: its prefix of the hash, and the words before it
    edge = budgets.where("budget > 0").select(F.col("source").alias("_s"), F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_before"), F.col("budget").alias("_budget"))
    few = sources.count() <= BROADCAST_SOURCES
    shift = HASH_BITS
    while shift > 0:
        inside = sized.join(F.broadcast(edge) if few else edge, sized["source"].eqNullSafe(F.col("_s")) & (F.shiftright("h", shift) == F.col("_prefix")))
        shift -= LEVEL_BITS
        bars = inside.groupBy("_s", "_before", "_budget", F.shiftright("h", shift).alias("_prefix")).agg(F.sum("size").alias("words"))
        order = Window.partitionBy("_s").orderBy("_prefix")
        running = bars.withColumn("upto", F.col("_before") + F.sum("words").over(order))
        over = running.where(F.col("upto") > F.col("_budget"))
        edge = over.groupBy("_s", "_budget").agg(F.min(F.struct("_prefix", (F.col("upto") - F.col("words")).alias("_before"), "upto")).alias("e")).select("_s", F.col("e._prefix").alias("_prefix"), F.col("e._before").alias("_before"), "_budget", F.col("e.upto").alias("_upto"))
        if shift:
            edge = written(edge.drop("_upto"), "edge")
    last = F.when(F.col("_upto") - F.col("_budget") < F.col("_budget") - F.col("_before"), F.col("_prefix")).otherwise(F.col("_prefix") - 1)
    bounds = written(edge.select("_s", last.alias("_last")), "bounds")
    table = budgets.join(F.broadcast(bounds) if few else bounds, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "whole", F.coalesce("_last", F.lit(-1).cast("long")).alias("last"))
    return F.broadcast(table) if few else table


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), hash60(F.col(id_col)).alias("h")), "sized", SPLITS_PER_FILE)


def mix_to_targets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """id, source, size, source_size, target, repeats (int), taken: how often the mix takes each row of ``docs``.

    Size is the number of words (null and empty text: 0).  Null is a source of
    its own, and comes last.  Rows with the same id and source are taken
    alike.  A null id hashes like any other value.  Sources without words have
    target 0.  An empty table gives an empty result.  Other columns are ignored.
    ``settings``: weights, share and most_repeats, as source_targets has them.
    most_repeats bounds what a source gives, in multiples of its size; where it
    isn't whole, the documents of a source at its cap are taken either the
    whole number below it or the one above, so that together they give it.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    bounds = source_bounds(sized, **settings).withColumnRenamed("source", "_source")
    joined = sized.join(bounds, sized["source"].eqNullSafe(F.col("_source")))
    repeats = (F.col("whole") + (F.col("h") <= F.col("last")).cast("int")).alias("repeats")
    return joined.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", repeats).withColumn("taken", F.col("size") * F.col("repeats"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with a column repeats (1 or more). Texts don't shuffle.

    Nulls, repeated rows, empty tables and ``settings`` as in mix_to_targets;
    a column repeats of the input is replaced, all others pass through,
    whatever their names.
    """
    of, whole, last = unused([*docs.columns, "repeats"], "_source", "_whole", "_last")
    bounds = source_bounds(_sized(docs, id_col, text_col, source_col), **settings)
    table = bounds.select(F.col("source").alias(of), F.col("whole").alias(whole), F.col("last").alias(last))
    joined = docs.join(table, docs[source_col].eqNullSafe(F.col(of)))
    repeats = F.col(whole) + (hash60(docs[id_col]) <= F.col(last)).cast("int")
    return joined.withColumn("repeats", repeats).where("repeats > 0").drop(of, whole, last)
