"""Corpus-wide line de-duplication, in DataFrame functions only.

Lines are exploded as fixed-size rows (document, position, hash of the
normalised line); the distinct documents of each hash are counted in two
steps, with map-side partial sums, so a line that every document holds costs
each task one row.  The dropped positions go back to the documents, which are
reassembled in the order of their lines.  Only documents that a Bloom filter
takes for changed shuffle with their texts; the rest pass straight through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import BLANKS, Bloom, lower_ascii
from corvane.scratch import SPLITS_PER_FILE, discard, join_groups, unused, written

LEAST_CHARS = 20
LEAST_DOCUMENTS = 3


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """All columns of ``docs`` with the text rewritten, and n_lines and n_dropped (long).

    A key of at least ``least_chars`` code points in at least
    ``least_documents`` documents loses all its lines except those of the
    largest id that holds it.  A null or empty text is one empty line and
    becomes empty.  Rows with the same id count as one document; rows with a
    null id count as one document that is never the largest.  Repeated rows
    all get the same result.  Columns n_lines and n_dropped of the input are
    replaced; other columns pass through, whatever their names.  Texts of any
    length are split where they are read.  An empty table gives an empty
    result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tag"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = slim.select("id", "tag", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    lines = written(keyed.select("id", "tag", "pos", F.unhex(F.md5("key")).alias("key")), "lines", SPLITS_PER_FILE)
    common = lines.select("key", "id").distinct().groupBy("key").agg(F.count("*").alias("documents"), F.max("id").alias("last_id")).where(F.col("documents") >= least_documents)
    common = written(common, "common")
    dropped = join_groups(lines, common, "key", "documents").where(~F.col("id").eqNullSafe(F.col("last_id")))
    of, mark, gone, changed, whole, pieces = unused([*docs.columns, "n_lines", "n_dropped"], "_id", "_tag", "_gone", "_changed", "_whole", "_pieces")
    positions = written(dropped.groupBy(F.col("id").alias(of), F.col("tag").alias(mark)).agg(F.collect_set("pos").alias(gone)), "gone")
    discard(lines, common)
    full = docs.withColumn(whole, F.coalesce(docs[text_col], F.lit("")))
    tag = F.xxhash64(F.col(whole))
    n_lines = F.octet_length(whole) - F.octet_length(F.replace(F.col(whole), F.lit("\n"), F.lit(""))) + 1
    tested = Bloom(positions, mark).flagged(full, tag, changed)
    joined = tested.where(changed).join(positions, F.col(id_col).eqNullSafe(F.col(of)) & (tag == F.col(mark)), "left")
    # the pieces are a column of their own, so that a text is split once and not for every line it keeps
    split = joined.withColumn(pieces, F.when(F.col(gone).isNotNull(), F.split(whole, "\n", -1)))
    left = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col(gone))
    rewritten = F.when(F.col(gone).isNull(), F.col(whole)).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(pieces), i)), "\n"))
    cut = split.withColumns({"n_lines": n_lines.cast("long"), "n_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long"), text_col: rewritten})
    same = tested.where(~F.col(changed)).withColumns({"n_lines": n_lines.cast("long"), "n_dropped": F.lit(0).cast("long"), text_col: F.col(whole)})
    columns = same.drop(whole, changed).columns
    return cut.select(*columns).union(same.select(*columns))
