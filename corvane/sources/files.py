"""Text files of a directory as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File types that are read and folders that are left out.
EXTENSIONS = "md txt markdown py json rst html ts tsx js jsx css sql yaml yml java cpp c h rs go".split()
IGNORED_FOLDERS = ".venv venv env .git .cache __pycache__ node_modules dist build data .pytest_cache .idea .vscode".split()

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def wanted(path: Column, root: str = "") -> Column:
    """Whether a file has one of the types, and no folder below ``root`` is ignored or hidden."""
    inside = F.substring(path, len(root) + 1, F.char_length(path)) if root else path
    folders = F.split(inside, "/")
    above = F.slice(folders, F.lit(1), F.greatest(F.size(folders) - 1, F.lit(0)))
    hidden = F.exists(above, lambda f: f.isin(IGNORED_FOLDERS) | (F.startswith(f, F.lit(".")) & ~f.isin(".", "..")))
    return F.lower(F.regexp_extract(F.element_at(folders, -1), r"[^/]\.([^./]+)$", 1)).isin(EXTENSIONS) & ~hidden


def with_text(files: DataFrame) -> DataFrame:
    """(file_path, file_name, file_hash, file_size, text) from path and content; bytes that aren't UTF-8 become U+FFFD."""
    content = F.coalesce("content", F.lit(b""))
    return files.select(F.col("path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2(content, 256).alias("file_hash"), F.octet_length(content).cast("long").alias("file_size"), F.make_valid_utf8(content.cast("string")).alias("text"))


def _below(files: DataFrame, root: str) -> DataFrame:
    plain = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    return files.where(wanted(plain, "/" + root.split(":")[-1].strip("/")))


def list_directory(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(file_path) of all wanted files below ``root``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return _below(files, root).select(F.col("path").alias("file_path"))


def read_directory(spark: SparkSession, root: str, recursive: bool = True, skip_unreadable: bool = False) -> DataFrame:
    """All wanted files below ``root``. Only the files that pass the filter on their path are read.

    An unreadable file is an error, or left out with ``skip_unreadable``; an
    ingestion that gets list_directory besides reports it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if skip_unreadable:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return with_text(_below(reader.load(root), root))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    return with_text(spark.read.format("binaryFile").load(path))
