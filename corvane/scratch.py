"""Intermediate tables in a shared folder, names that clash with nothing, and joins that bear hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups that are joined by broadcast because they may be hot. Any other group
#: holds less than 1/HOT_GROUPS of the rows, so no task of a shuffle gets more.
HOT_GROUPS = 1024
#: Input splits whose rows go to one file of a table that is much smaller than its input.
SPLITS_PER_FILE = 4


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until it is none of ``taken`` (in any case)."""
    known = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in known:
            name = f"_{name}"
        known.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", found)
        _drop_at_end(spark, found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of the JVM; both outlive the session."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _drop_at_end(spark: SparkSession, folder: str) -> None:
    """Make a folder that is removed before the session stops, or else when its JVM ends."""
    system, where = _hadoop(spark, folder)
    system.mkdirs(where)
    system.deleteOnExit(where)
    stop = spark.stop

    def stop_clean() -> None:
        if spark.sparkContext._jsc is not None:
            system.delete(where, True)
        stop()

    spark.stop = stop_clean


def at_end(spark: SparkSession, do: Callable[[], object]) -> None:
    """Do something before the session stops."""
    stop = spark.stop

    def stop_after() -> None:
        if spark.sparkContext._jsc is not None:
            do()
        stop()

    spark.stop = stop_after


def new_folder(spark: SparkSession, hint: str) -> str:
    """A path in the shared folder for files that go with the session."""
    own = getattr(spark, "_scratch_folder", None)
    if own is None:
        own = spark._scratch_folder = f"{shared_folder(spark)}/corvane-{uuid.uuid4().hex}"
        _drop_at_end(spark, own)
    return f"{own}/{hint}-{uuid.uuid4().hex}"


def files_of(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table: what tells whether it has changed."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}*"))
    return tuple((str(x.getPath()), x.getLen(), x.getModificationTime()) for x in found or [])


def written(df: DataFrame, hint: str = "table", merge: int = 1) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, and outlives executors. Removed with the session.

    ``merge``: for frames without a shuffle, the input splits that one task
    (and file) takes; their rows are much smaller than what they are made of.
    """
    spark = df.sparkSession
    if merge > 1 and "Exchange" not in df._jdf.queryExecution().executedPlan().toString():
        df = df.coalesce(max(1, -(-df.rdd.getNumPartitions() // merge)))
    return _written_at(df, new_folder(spark, hint))


def staged(spark: SparkSession, build: Callable[[], DataFrame], hint: str = "table") -> DataFrame:
    """What ``build`` returns as a written table; the tables that it made on the way are removed."""
    path, outer = new_folder(spark, hint), spark._scratch_folder
    spark._scratch_folder = f"{path}-work"
    try:
        return _written_at(build(), path)
    finally:
        system, where = _hadoop(spark, spark._scratch_folder)
        system.delete(where, True)
        spark._scratch_folder = outer


def _written_at(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go with the write that made them
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of written tables that nothing reads any more."""
    for table in tables:
        system, where = _hadoop(table.sparkSession, table._scratch)
        system.delete(where, True)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per ``key``), whatever share of the rows one key has.

    The HOT_GROUPS heaviest groups (by the column ``weight``) are broadcast, a
    bounded table.  Their rows are spread over all partitions of the shuffle
    join that serves the other keys.  Null keys match nothing.
    """
    values = [c for c in groups.columns if c != key]
    name, cold, slot, hot_name, hot_value, at, found = unused([*rows.columns, *groups.columns], "_key", "_cold", "_slot", "_hot_key", "_hot", "_at", "_found")
    packed = groups.select(F.col(key).alias(name), F.struct(*values).alias(cold), F.lit(0).alias(slot))
    hot = groups.orderBy(F.desc(weight), key).limit(HOT_GROUPS).select(F.col(key).alias(hot_name), F.struct(*values).alias(hot_value))
    spread = F.pmod(F.hash(*rows.columns), F.lit(1 << 20)) + 1
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col(hot_name), "left").withColumn(at, F.when(F.col(hot_value).isNull(), 0).otherwise(spread))
    both = marked.join(packed, (F.col(key) == F.col(name)) & (F.col(at) == F.col(slot)), "left")
    joined = both.withColumn(found, F.coalesce(hot_value, cold)).where(F.col(found).isNotNull())
    return joined.select(*rows.columns, *[F.col(f"{found}.{c}").alias(c) for c in values])
