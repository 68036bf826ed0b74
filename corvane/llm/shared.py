"""What the operators share: bounded Arrow batches, ASCII lower case, and Bloom filters of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.scratch import unused

#: Most bytes of text in one Arrow batch sent to Python.
BATCH_BYTES = 2 << 20

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).rstrip("bB") or 0) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives back the memory that it has freed.

    Spark uses a worker again for the next task; what the allocators keep for
    themselves would be held beside the memory of the next stage.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. Plain ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: Of a Bloom filter: bits in one of its bitmaps, bits for each key, bits set by each key, and most bitmaps (32 MB, what is broadcast).
BITMAP_BITS = 32768
BITS_PER_KEY = 16
BIT_HASHES = 3
MOST_BITMAPS = 8192


def bit_set(bitmap: Column, position: Column) -> Column:
    """Whether a bit of a bitmap made by bitmap_construct_agg is set."""
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(position, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), F.pmod(position, F.lit(8))).cast("int")) > 0


class Bloom:
    """A blocked Bloom filter of the values of ``key`` in ``keys``, as a table of bitmaps that is broadcast.

    It has at most MOST_BITMAPS bitmaps.  More keys than these hold
    (MOST_BITMAPS * BITMAP_BITS / BITS_PER_KEY, 16.8 million) make it say yes
    too often, but never no to a key it holds.
    """

    def __init__(self, keys: DataFrame, key: str):
        self.blocks = max(1, min(MOST_BITMAPS, -(-keys.count() * BITS_PER_KEY // BITMAP_BITS)))
        block, bits = self._places(F.col(key))
        marked = keys.select(block.alias("block"), F.explode(F.array(*bits)).alias("bit"))
        self.bitmaps = marked.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))

    def _places(self, value: Column) -> tuple[Column, list[Column]]:
        return F.pmod(F.xxhash64(value), F.lit(self.blocks)).cast("int"), [F.pmod(F.xxhash64(value, F.lit(i)), F.lit(BITMAP_BITS)).cast("int") for i in range(BIT_HASHES)]

    def flagged(self, rows: DataFrame, value: Column, flag: str) -> DataFrame:
        """``rows`` with a boolean ``flag``: whether ``value`` may be among the keys. No shuffle."""
        place, bitmap = unused([*rows.columns, flag], "_block", "_bitmap")
        block, bits = self._places(value)
        table = self.bitmaps.select(F.col("block").alias(place), F.col("bitmap").alias(bitmap))
        joined = rows.join(F.broadcast(table), block == F.col(place), "left")
        hit = F.col(bitmap).isNotNull()
        for bit in bits:
            hit = hit & bit_set(F.col(bitmap), bit)
        return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).select(*rows.columns, flag)


def possible_matches(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among ``keys``, and few others."""
    (flag,) = unused(rows.columns, "_maybe")
    return Bloom(keys, key).flagged(rows, F.col(key), flag).where(flag).drop(flag)
