"""Chunks of documents: sections under headings, and overlapping windows of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import words

MAX_WORDS, MIN_WORDS, OVERLAP = 300, 30, 40
HEADING = r"^(#{1,6})\s+(.*)$"


def windows(all_words: Column, most: int = MAX_WORDS, least: int = MIN_WORDS, overlap: int = OVERLAP) -> Column:
    """ARRAY<ARRAY<STRING>>: the whole text if it fits, else windows of ``most`` words that overlap, without a short tail."""
    n = F.size(all_words)
    step = most - overlap
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda i: (i == 0) | (n - i >= least))
    cut = F.transform(starts, lambda i: F.slice(all_words, i + 1, F.lit(most)))
    return F.when(n == 0, F.array().cast("array<array<string>>")).when(n <= most, F.array(all_words)).otherwise(cut)


def chunk_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_WORDS, least: int = MIN_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_index, content, token_count) for texts without headings."""
    cut = docs.select(id_col, words(F.col(text_col)).alias("w")).select(id_col, F.posexplode(windows(F.col("w"), most, least, overlap)).alias("chunk_index", "w"))
    return cut.select(id_col, "chunk_index", F.array_join("w", " ").alias("content"), F.size("w").alias("token_count"))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """(id, start_line, end_line, headings, text): runs of lines under their headings.

    Headings are lines of one to six # outside code fences; the first line of
    a document opens a section but no heading of its own.  A heading of level
    n keeps the first n - 1 headings above it (n without a title).
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\r\n?|[\x0B\x0C\x1C-\x1E\x85  ]", "\n")
    parts = F.split(text, "\n", -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    title = F.col(title_col) if title_col else F.lit(None).cast("string")
    each = docs.select(F.col(id_col), title.alias("title"), F.posexplode(whole).alias("i", "line"))
    bare = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    up_to = Window.partitionBy(id_col).orderBy("i")
    marked = each.withColumns({"bare": bare, "fence": F.startswith(bare, F.lit("```"))}).withColumn("open", F.sum(F.col("fence").cast("int")).over(up_to) % 2 == 1)
    opens = marked.withColumn("head", (F.col("i") > 0) & ~F.col("fence") & ~F.col("open") & F.col("bare").rlike(HEADING))
    named = opens.withColumns({"section": F.sum(F.col("head").cast("int")).over(up_to), "level": F.when(F.col("head"), F.char_length(F.regexp_extract("bare", HEADING, 1))), "name": F.when(F.col("head"), F.regexp_replace(F.regexp_extract("bare", HEADING, 2), r"(?U)^\s+|\s+$", ""))})
    joined = named.groupBy(id_col, "title", "section").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"),
        (F.min("i") + 1).alias("start_line"), (F.max("i") + 1).alias("end_line"), F.max("level").alias("level"), F.max("name").alias("name"),
    )
    stripped_sections = joined.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    return _stacked(stripped_sections, id_col).where("text <> ''").select(id_col, "start_line", "end_line", "headings", "text")


def _stacked(parts: DataFrame, id_col: str) -> DataFrame:
    """``parts`` (title, section, level, name) with ``headings``: the headings above and of each section.

    A heading of level n stands at place min(places before it, n - 1) + 1, the
    title (if there is one) at place 1 of a document.  So its place is a
    running minimum, and the heading at a place is the last one that stood
    there: nothing is folded, and a document of many headings costs no more
    for each.
    """
    up_to = Window.partitionBy(id_col).orderBy("section")
    titled = F.coalesce(F.col("title") != "", F.lit(False)).cast("int")
    head = F.col("level").isNotNull()
    order = F.sum(head.cast("int")).over(up_to)  # headings so far
    least = F.min(F.when(head, F.greatest(F.col("level") - titled, F.lit(0)) + 1 - F.col("order"))).over(up_to)
    placed = parts.withColumn("order", order).withColumn("place", F.col("order") + F.least(titled, F.coalesce(least, titled)))
    at = lambda k: F.last(F.when(head & (F.col("place") == k), F.col("name")), ignorenulls=True).over(up_to)
    first = F.coalesce(at(1), F.when(titled == 1, F.col("title")))
    return placed.withColumn("headings", F.slice(F.array(first, *[at(k) for k in range(2, 8)]), F.lit(1), F.col("place").cast("int")))


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None, most: int = MAX_WORDS, least: int = MIN_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_index, content, headings, start_line, end_line, token_count).

    A section that fits stays as it is; a longer one becomes windows of words.
    The headings, joined by ' > ', stand above the content and don't count.
    """
    parts = sections(docs, id_col, text_col, title_col).withColumn("w", words(F.col("text")))
    pieces = F.when(F.size("w") <= most, F.array(F.struct(F.col("text").alias("body"), F.size("w").alias("n")))).otherwise(F.transform(windows(F.col("w"), most, least, overlap), lambda x: F.struct(F.array_join(x, " ").alias("body"), F.size(x).alias("n"))))
    each = parts.select(id_col, "start_line", "end_line", "headings", F.posexplode(pieces).alias("k", "p"))
    order = Window.partitionBy(id_col).orderBy("start_line", "k")
    prefix = F.when(F.size("headings") > 0, F.concat(F.array_join("headings", " > "), F.lit("\n\n"))).otherwise("")
    content = F.regexp_replace(F.concat(prefix, F.col("p.body")), r"(?U)^\s+|\s+$", "")
    return each.select(id_col, (F.row_number().over(order) - 1).alias("chunk_index"), content.alias("content"), "headings", "start_line", "end_line", F.col("p.n").alias("token_count"))
