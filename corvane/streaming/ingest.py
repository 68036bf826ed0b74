"""A stream of files into a store: every micro-batch upserts what is new or has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corvane.sources.files import FILE_SCHEMA, wanted, with_text
from corvane.sources.store import Store


def stream_directory(spark: SparkSession, root: str, store: Store, checkpoint: str, once: bool = True, vectors_of=None) -> StreamingQuery:
    """Follow a folder: files that appear are chunked and stored; ``once`` takes what is there and ends.

    Spark keeps the names of the files that it has seen in the checkpoint;
    the store skips contents that it has, so a batch that is run again after
    a failure changes nothing.
    """
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(root)

    def upsert(batch: DataFrame, _: int) -> None:
        store.ingest(with_text(batch.where(wanted(batch["path"], root))), vectors_of)

    writer = files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
