"""Retrieval metrics over ranked lists and graded judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.scratch import join_groups, unused, written


def gain(grade: Column, rank: Column) -> Column:
    """(2^grade - 1) / log2(rank + 1) for positive grades, else 0."""
    return F.when(grade > 0, (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)).otherwise(0.0)


def retrieval_metrics(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row per judged query: ndcg, precision, recall at ``k`` and reciprocal_rank (no cut), 4 places.

    ``ranked``: query_id, doc_id, rank.  ``qrels``: query_id, doc_id, grade;
    documents with a positive grade are relevant.  Judged queries without hits
    have zeros; hits of unjudged queries are ignored.
    """
    judged = qrels.select("query_id", "doc_id", F.col("grade").cast("double").alias("grade"))
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    ideal = judged.withColumn("r", F.row_number().over(order)).groupBy("query_id").agg(
        F.sum(F.when(F.col("r") <= k, gain(F.col("grade"), F.col("r"))).otherwise(0.0)).alias("ideal"), F.sum((F.col("grade") > 0).cast("int")).alias("relevant")
    )
    found = ranked.select("query_id", "doc_id", "rank").join(judged, ["query_id", "doc_id"])
    within = F.col("rank") <= k
    hits = found.groupBy("query_id").agg(
        F.sum(F.when(within, gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(within & (F.col("grade") > 0), 1).otherwise(0)).alias("hits"),
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"),
    )
    both = ideal.join(hits, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(
        "query_id",
        F.round(F.when(F.col("ideal") > 0, zero(F.col("dcg") / F.col("ideal"))).otherwise(0.0), 4).alias("ndcg"),
        F.round(zero(1 / F.col("first")), 4).alias("reciprocal_rank"),
        F.round(zero(F.col("hits") / k) if k > 0 else F.lit(0.0), 4).alias("precision"),
        F.round(F.when(F.col("relevant") > 0, zero(F.col("hits") / F.col("relevant"))).otherwise(0.0), 4).alias("recall"),
    )


def metric_means(per_query: DataFrame) -> DataFrame:
    """The means of all metrics over the queries."""
    return per_query.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 4).alias(c) for c in ("ndcg", "reciprocal_rank", "precision", "recall")])


#: Values of a group that may meet in one window, and shares at which a round of a selection cuts a group.
WINDOW_VALUES, CUTS = 10_000, 200


def upper_latency(rows: DataFrame, value_col: str, by: list[str] | None = None, share: float = 0.95, window_values: int = WINDOW_VALUES) -> DataFrame:
    """(by..., value): element int(n x share) of the sorted values of each group, counted from 0: the p95 of the evaluation tables.

    A selection: a group of more than ``window_values`` values is cut at
    quantiles that the tasks sketch and merge, what lies below the cut is
    counted exactly, and only what lies between the cuts beside the wanted
    rank stays for the next round, about a sixtieth.  Values are counted
    before they are ordered, so at most ``window_values`` distinct ones of a
    group meet in one task.  Nulls and NaN are left out.
    """
    keys = by or []
    key, at, low, high, before, n, cuts, lower, upper, less, held, many, upto = unused([*rows.columns], *"_key _at _low _high _before _n _cuts _lower _upper _less _held _many _upto".split())
    v, col = F.col(value_col), F.col
    named = rows.where(v.isNotNull() & ~F.isnan(v.cast("double"))).select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias(key) if keys else F.lit("").alias(key), *keys, value_col)
    values = named.select(key, value_col)
    first = named.groupBy(key).agg(*[F.first(k).alias(k) for k in keys], F.count("*").alias(n), F.min(value_col).alias(low), F.max(value_col).alias(high))
    state = written(first.withColumns({before: F.lit(0).cast("long"), at: F.least(col(n) - 1, F.floor(col(n) * share))}), "ranks")
    inside = (v >= col(low)) & (v <= col(high))
    wide = (col(n) > window_values) & (col(low) < col(high))
    while state.where(wide).limit(1).count():
        spans = state.where(wide)
        left = join_groups(values, spans.select(key, low, high, n), key, n).where(inside)
        sketched = left.groupBy(key).agg(F.percentile_approx(value_col, [i / CUTS for i in range(CUTS + 1)], 10_000).alias(cuts))
        place = F.floor((col(at) - col(before)) * CUTS / col(n)).cast("int")
        bounds = {lower: F.when(place > 1, F.get(cuts, place - 1)).otherwise(col(low)), upper: F.when(place + 2 < CUTS, F.get(cuts, place + 2)).otherwise(col(high))}
        cut = written(spans.join(sketched, key).withColumns(bounds).drop(cuts), "cuts")
        inner = (v >= col(lower)) & (v <= col(upper))
        counted = join_groups(values, cut.select(key, low, high, n, lower, upper), key, n).where(inside).groupBy(key).agg(F.sum((v < col(lower)).cast("long")).alias(less), F.sum(inner.cast("long")).alias(held))
        # where the sketch missed the rank or cut nothing off, the group goes to the last step as it is
        sure = (col(before) + col(less) <= col(at)) & (col(at) < col(before) + col(less) + col(held)) & (col(held) < col(n))
        narrowed = cut.join(counted, key).select(key, *keys, F.when(sure, col(held)).otherwise(0).alias(n), F.when(sure, col(lower)).otherwise(col(low)).alias(low), F.when(sure, col(upper)).otherwise(col(high)).alias(high), F.when(sure, col(before) + col(less)).otherwise(col(before)).alias(before), at)
        state = written(state.where(~wide).select(narrowed.columns).unionByName(narrowed), "ranks")
    last = join_groups(values, state.drop(*keys), key, n).where(inside).groupBy(key, value_col, before, at).agg(F.count("*").alias(many))
    ordered = last.withColumn(upto, col(before) + F.sum(many).over(Window.partitionBy(key).orderBy(value_col)))
    hit = ordered.where((col(upto) > col(at)) & (col(upto) - col(many) <= col(at))).select(key, value_col)
    return hit.join(state.select(key, *keys), key).select(*keys, value_col)


def markdown_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): a header, a rule, and a line for each row, in the order of the rows; for small result tables."""
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "i long, line string")
    body = rows.select((F.monotonically_increasing_id() + 2).alias("i"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |")).alias("line"))
    return head.unionByName(body).orderBy("i").select("line")
