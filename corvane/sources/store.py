"""A store of documents, chunks and chunk vectors as Parquet tables in versions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.chunks import chunk_documents
from corvane.scratch import discard, written
from corvane.sources.commits import CommitLog, Tables, Version

DOCUMENTS = "file_path string, file_name string, file_hash string, file_size long, indexed_at timestamp"
CHUNKS = "file_path string, chunk_id string, chunk_index int, content string, headings string, start_line int, end_line int, token_count int"
VECTORS = "chunk_id string, embedding array<float>"
#: What the tables have besides: which write a row is of, of documents the write's place in the order of writes and whether they were removed, and the partition.
LOGS = {"documents": f"{DOCUMENTS}, write string, sequence long, gone boolean, part int", "chunks": f"{CHUNKS}, write string, part int", "vectors": f"{VECTORS}, file_path string, write string, part int"}
#: Partitions of every table by a hash of the path, unless the store was made with another number.
PARTS = 16


@dataclass(frozen=True)
class Snapshot:
    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame


class Store:
    """A folder of three tables in versions.

    A write brings data folders of what has changed and commits them at once,
    so a write costs what it brings, one that dies leaves nothing to be seen,
    and a reader has the whole of one version.  Of two writes of one document
    the one that began on the later version counts whole; of two on the same
    version the one with the greater name, for all readers alike.  ``compact``
    writes what counts anew, in one folder a table, and swaps folders in a
    version of its own; ``vacuum`` deletes what no version names any more.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path = spark, path.rstrip("/")
        self.log, self.parts = CommitLog(spark, path), parts

    def _part(self) -> Column:
        """The partition of a path. A small batch of paths then reads its own partitions only."""
        return F.pmod(F.xxhash64("file_path"), F.lit(self.parts)).cast("int").alias("part")

    def _rows(self, table: str, version: Version) -> DataFrame:
        folders = [f"{self.path}/{x}" for x in version.tables.get(table, [])]
        if not folders:
            return self.spark.createDataFrame([], LOGS[table])
        return self.spark.read.schema(f"{LOGS[table]}, folder string").option("basePath", f"{self.path}/{table}").parquet(*folders).drop("folder")

    def _latest(self, version: Version, of: DataFrame | None = None) -> DataFrame:
        """The last entry of every path, removed documents among them; ``of``: (file_path, part) of those wanted."""
        log = self._rows("documents", version)
        if of is not None:
            log = log.join(of, ["part", "file_path"], "left_semi")
        latest = log.groupBy("part", "file_path").agg(F.max_by(F.struct(*log.columns), F.struct("sequence", "write")).alias("d"))
        return latest.select("d.*")

    def read(self, version: int | None = None) -> Snapshot:
        """The documents that are there, or were in a version, with their chunks and vectors; empty tables if there are none."""
        now = self.log.latest() if version is None else self.log.at(version)
        live = self._latest(now).where(~F.col("gone"))
        key = live.select("part", "file_path", "write")
        own = lambda table: self._rows(table, now).join(key, ["part", "file_path", "write"], "left_semi")
        names = lambda schema: [x.split()[0] for x in schema.split(", ")]
        return Snapshot(live.select(*names(DOCUMENTS)), own("chunks").select(*names(CHUNKS)), own("vectors").select(*names(VECTORS)))

    def _made(self, table: str, rows: DataFrame) -> str:
        """A data folder with the rows; their files are sorted into partitions by the path."""
        folder = self.log.new_folder(table)
        columns = [x.split()[0] for x in LOGS[table].split(", ")]
        rows.withColumn("part", self._part()).select(*columns).repartition("part").write.partitionBy("part").parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, made: dict[str, str]) -> Version:
        return self.log.change(lambda tables: {name: tables.get(name, []) + ([made[name]] if name in made else []) for name in LOGS})

    def document(self, file_path: str) -> DataFrame:
        """The document at a path: one partition is read, and the filter reaches its scan."""
        at = self.spark.range(1).select(F.lit(file_path).alias("file_path")).select(self._part()).first().part
        log = self._rows("documents", self.log.latest()).where((F.col("part") == at) & (F.col("file_path") == file_path))
        last = log.groupBy("file_path").agg(F.max_by(F.struct(*log.columns), F.struct("sequence", "write")).alias("d")).select("d.*")
        return last.where(~F.col("gone")).select(*[x.split()[0] for x in DOCUMENTS.split(", ")])

    def delete(self, paths: DataFrame) -> None:
        """Remove documents (and their chunks and vectors) whose file_path is in ``paths``."""
        base = self.log.latest()
        wanted = paths.select("file_path").distinct().select("file_path", self._part())
        gone = self._latest(base, wanted).where(~F.col("gone"))
        marked = gone.withColumns({"indexed_at": F.current_timestamp(), "write": F.lit(uuid.uuid4().hex), "sequence": F.lit(base.number + 1).cast("long"), "gone": F.lit(True)})
        self._commit({"documents": self._made("documents", marked)})

    def ingest(self, files: DataFrame, vectors_of=None, listed: DataFrame | None = None) -> DataFrame:
        """Add or replace files (file_path, file_name, file_hash, file_size, text); returns (file_path, status, chunks).

        Files whose hash is known are skipped, and so are those without text.
        Of a path that occurs several times the row with the greatest hash
        counts.  ``files`` is evaluated once.  ``vectors_of``: makes (chunk_id,
        embedding) from (chunk_id, content).  ``listed``: (file_path) of files
        that should be among ``files``; those that aren't could not be read
        and have the status error.
        """
        base, write = self.log.latest(), uuid.uuid4().hex
        one = files.groupBy("file_path").agg(F.max(F.struct("file_hash", "file_name", "file_size", "text")).alias("f")).select("file_path", self._part(), "f.*")
        known = self._latest(base).where(~F.col("gone")).select("part", "file_path", F.col("file_hash").alias("known_hash"))
        joined = one.join(known, ["part", "file_path"], "left").withColumn("fresh", ~F.coalesce(F.col("file_hash") == F.col("known_hash"), F.lit(False)))
        seen = written(joined.withColumn("text", F.when(F.col("fresh"), F.col("text"))).drop("known_hash", "part"), "seen")
        fresh = seen.where("fresh")
        cut = chunk_documents(fresh, "file_path", "text", "file_name")
        named = cut.select("file_path", F.concat_ws("#", "file_path", "chunk_index").alias("chunk_id"), F.col("chunk_index").cast("int").alias("chunk_index"), "content", F.array_join("headings", " > ").alias("headings"), F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), F.col("token_count").cast("int").alias("token_count"))
        made = {"chunks": self._made("chunks", named.withColumn("write", F.lit(write)))}
        chunks = self._rows("chunks", Version(0, {"chunks": [made["chunks"]]}))
        counts = chunks.groupBy("file_path").agg(F.count("*").alias("chunks"))
        every = seen.select("file_path", F.lit(True).alias("was_read"))
        if listed is not None:
            every = every.unionByName(listed.select("file_path").distinct().join(every, "file_path", "left_anti").withColumn("was_read", F.lit(False)))
        status = F.when(~F.col("was_read"), "error").when(F.col("chunks").isNull(), "skipped").otherwise("indexed")
        out = written(every.join(counts, "file_path", "left").select("file_path", status.alias("status"), F.coalesce("chunks", F.lit(0)).alias("chunks")), "statuses")
        if vectors_of is not None:
            vectors = vectors_of(chunks.select("chunk_id", "content")).join(chunks.select("chunk_id", "file_path"), "chunk_id")
            made["vectors"] = self._made("vectors", vectors.withColumn("write", F.lit(write)))
        indexed = fresh.join(counts, "file_path", "left_semi").select("file_path", "file_name", "file_hash", "file_size", F.current_timestamp().alias("indexed_at"), F.lit(write).alias("write"), F.lit(base.number + 1).cast("long").alias("sequence"), F.lit(False).alias("gone"))
        made["documents"] = self._made("documents", indexed)
        self._commit(made)
        discard(seen)
        return out

    def compact(self) -> Version:
        """Write what counts in new folders, one a table, and swap them in. What others commit meanwhile stays beside them."""
        base = self.log.latest()
        live = self._latest(base).where(~F.col("gone"))
        key = live.select("part", "file_path", "write")
        made = {name: self._made(name, live if name == "documents" else self._rows(name, base).join(key, ["part", "file_path", "write"], "left_semi")) for name in LOGS}

        def swapped(tables: Tables) -> Tables:
            if any(set(base.tables.get(name, [])) - set(tables.get(name, [])) for name in LOGS):
                raise RuntimeError("another compaction has replaced the folders of this one")
            return {name: [made[name], *[x for x in tables.get(name, []) if x not in base.tables.get(name, [])]] for name in LOGS}

        return self.log.change(swapped)

    def vacuum(self, keep: int = 1, older_than: float = 86_400.0) -> list[str]:
        """Delete old versions and the folders of dead or replaced writes; see CommitLog.vacuum."""
        return self.log.vacuum(keep, older_than)

    def rehydrate(self) -> DataFrame:
        """Documents with their chunks and vectors: one row per chunk that has a vector."""
        now = self.read()
        joined = now.documents.join(now.chunks, "file_path").join(now.vectors, "chunk_id")
        return joined.select("chunk_id", "file_path", "file_name", "chunk_index", "content", "headings", "start_line", "end_line", "embedding")

    def stats(self) -> DataFrame:
        """total_documents, total_chunks, total_bytes of text files."""
        now = self.read()
        return now.documents.agg(F.count("*").alias("total_documents"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_bytes")).crossJoin(now.chunks.agg(F.count("*").alias("total_chunks")))


def ingest_totals(statuses: DataFrame) -> DataFrame:
    """One row for the statuses of an ingestion: indexed_files, skipped_files, total_chunks_created, errors."""
    of = lambda name: F.coalesce(F.sum((F.col("status") == name).cast("int")), F.lit(0)).cast("long")
    return statuses.agg(of("indexed").alias("indexed_files"), of("skipped").alias("skipped_files"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("total_chunks_created"), of("error").alias("errors"))


def chunk_numbers(chunks: DataFrame) -> DataFrame:
    """Chunks with a doc_id (long) in the order of path and chunk: equal for equal tables.

    Paths are sorted over all partitions, and the chunks of the partitions
    before are added to the running sum in each, so no task has all paths.
    """
    files = chunks.groupBy("file_path").agg(F.count("*").alias("n"))
    ordered = written(files.orderBy("file_path").withColumn("part", F.spark_partition_id()), "paths")
    parts = ordered.groupBy("part").agg(F.sum("n").alias("all"))  # a row for each partition
    earlier = parts.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    inside = ordered.withColumn("inside", F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = inside.join(F.broadcast(earlier), "part").select("file_path", (F.col("earlier") + F.col("inside")).alias("base"))
    return chunks.join(before, "file_path").withColumn("doc_id", (F.col("base") + F.col("chunk_index")).cast("long")).drop("base")
