"""Perceptual hashes of PNG images, and the images whose hashes differ in few bits.

Images are decoded where their bytes are read, an Arrow batch at a time; what
is shuffled are 64-bit hashes and ids, never pixels.
"""

from __future__ import annotations

import struct
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.scratch import join_groups, unused, written

#: Fixed values of the PNG format: signature, samples of a pixel by colour type, and the passes of interlaced
#: images as (first column, first row, step of columns, step of rows).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
#: Columns and rows that a picture is shrunk to; neighbours in a row give one bit.
COLUMNS, ROWS = 9, 8
#: Bytes of raw rows that a worker unpacks for one image: small files can claim any size.
MOST_BYTES = 256 << 20
#: Distinct hashes under one key that are compared with each other; beyond it the key is cut finer.
KEY_HASHES = 256


# --- decoding ---------------------------------------------------------------------------------------------------
def unfiltered(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes from rows of differences: (rows, bytes) with the filter of each row; ``step`` bytes to the left neighbour.

    A byte depends on its neighbours to the left, above, and above left, so
    all pixels of a falling diagonal can be had at once.
    """
    height, width = raw.shape[0], raw.shape[1] // step
    diff = raw.reshape(height, width, step).astype(np.int16)
    out = np.zeros((height + 1, width + 1, step), dtype=np.int16)  # a row and a column of zeros before the image
    for t in range(height + width - 1):
        r = np.arange(max(0, t - width + 1), min(height - 1, t) + 1)
        c = t - r
        left, above, corner, kind = out[r + 1, c], out[r, c + 1], out[r, c], kinds[r][:, None]
        guess = left + above - corner
        far = [np.abs(guess - x) for x in (left, above, corner)]
        nearest = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, corner))
        out[r + 1, c + 1] = (diff[r, c] + np.choose(kind, [np.zeros_like(left), left, above, (left + above) >> 1, nearest])) & 255
    return out[1:, 1:].reshape(height, width * step).astype(np.uint8)


def _samples(rows: np.ndarray, width: int, each: int, depth: int) -> np.ndarray:
    """(height, width, each) integers of ``depth`` bits from packed rows."""
    if depth == 16:
        wide = rows.reshape(len(rows), -1, 2).astype(np.int64)
        flat = wide[:, :, 0] * 256 + wide[:, :, 1]
    elif depth == 8:
        flat = rows.astype(np.int64)
    else:
        bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth).astype(np.int64)
        flat = bits @ (1 << np.arange(depth - 1, -1, -1))
    return flat[:, : width * each].reshape(len(rows), width, each)


def decoded(data: bytes | None) -> np.ndarray | None:
    """Grey levels (height, width) from 0 to 255,000 of a PNG file, transparent parts over white; None for anything else.

    All colour types, depths and filters, interlaced or not. Broken files, and
    those whose rows take more than MOST_BYTES, are None.
    """
    if not data or not data.startswith(SIGNATURE):
        return None
    try:
        header, palette, clear, packed, at = None, None, None, [], len(SIGNATURE)
        while at + 8 <= len(data):
            size, name = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + size]
            if name == b"IHDR":
                header = struct.unpack(">IIBBBBB", body)
            elif name == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int64)
            elif name == b"tRNS":
                clear = body
            elif name == b"IDAT":
                packed.append(body)
            elif name == b"IEND":
                break
            at += size + 12
        width, height, depth, colour, _, _, interlaced = header
        each = SAMPLES[colour]
        parts = [p for p in (PASSES if interlaced else [(0, 0, 1, 1)]) if p[0] < width and p[1] < height]
        shapes = [(-(-(height - y) // dy), -(-(width - x) // dx)) for x, y, dx, dy in parts]
        line = lambda w: (w * each * depth + 7) // 8
        total = sum(h * (1 + line(w)) for h, w in shapes)
        if not width or not height or max(total, width * height * each) > MOST_BYTES:
            return None
        stream = np.frombuffer(zlib.decompressobj().decompress(b"".join(packed), total), np.uint8)
        values = np.zeros((height, width, each), dtype=np.int64)
        start = 0
        for (x, y, dx, dy), (h, w) in zip(parts, shapes, strict=True):
            rows = stream[start : start + h * (1 + line(w))].reshape(h, 1 + line(w))
            start += rows.size
            values[y::dy, x::dx] = _samples(unfiltered(rows[:, 1:], rows[:, 0], max(1, each * depth // 8)), w, each, depth)
        return _grey(values, colour, depth, palette, clear)
    except (TypeError, ValueError, KeyError, IndexError, struct.error, zlib.error):
        return None


def _grey(values: np.ndarray, colour: int, depth: int, palette: np.ndarray | None, clear: bytes | None) -> np.ndarray:
    """Luminance x 1000 of samples, over white."""
    top = (1 << depth) - 1
    opaque = np.full(values.shape[:2], 255, dtype=np.int64)
    if colour == 3:
        index = values[:, :, 0]
        if clear:
            table = np.full(max(len(palette), len(clear)), 255, dtype=np.int64)
            table[: len(clear)] = np.frombuffer(clear, np.uint8)
            opaque = table[index]
        rgb = palette[index]
    else:
        if clear and colour in (0, 2):  # one colour that is transparent
            opaque = np.where((values == np.frombuffer(clear, ">u2").astype(np.int64)).all(axis=2), 0, 255)
        scaled = values * 255 // top
        if colour in (4, 6):
            opaque = scaled[:, :, -1]
            scaled = scaled[:, :, :-1]
        rgb = np.repeat(scaled, 3, axis=2) if scaled.shape[2] == 1 else scaled
    light = rgb @ np.array([299, 587, 114])
    return (light * opaque + 255_000 * (255 - opaque)) // 255


def png(levels: np.ndarray, kind: int = 0) -> bytes:
    """A PNG file of 8-bit samples, (height, width) grey or (height, width, 3) coloured, all rows under one filter (0, 1 or 2)."""
    height, width = levels.shape[:2]
    rows = levels.astype(np.uint8).reshape(height, -1)
    step = 1 if levels.ndim == 2 else 3
    before = {0: np.zeros_like(rows), 1: np.pad(rows, ((0, 0), (step, 0)))[:, : rows.shape[1]], 2: np.pad(rows, ((1, 0), (0, 0)))[:height]}[kind]
    body = np.concatenate([np.full((height, 1), kind, np.uint8), rows - before], axis=1).tobytes()
    chunk = lambda name, x: struct.pack(">I", len(x)) + name + x + struct.pack(">I", zlib.crc32(name + x))
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if levels.ndim == 2 else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


# --- hashing ----------------------------------------------------------------------------------------------------
def _shares(size: int, cells: int) -> np.ndarray:
    """(cells, size): how much of each of ``size`` pixels falls into each of ``cells`` equal cells, in parts of 1/cells pixel."""
    pixel, cell = np.arange(size) * cells, np.arange(cells)[:, None] * size
    return np.clip(np.minimum(pixel + cells, cell + size) - np.maximum(pixel, cell), 0, None)


def difference_bits(data: bytes | None) -> int | None:
    """The 64 bits of an image, as a signed integer: the picture is shrunk to 9 x 8 areas, and a bit says if an area is darker than its right neighbour."""
    grey = decoded(data)
    if grey is None:
        return None
    small = _shares(grey.shape[0], ROWS) @ grey @ _shares(grey.shape[1], COLUMNS).T  # integers: equal areas are ties in any size
    bits = (small[:, :-1] < small[:, 1:]).ravel()
    return int(np.packbits(bits).view(">i8")[0])


@F.pandas_udf(T.LongType())
def difference_hash(content: pd.Series) -> pd.Series:
    """The difference hash of PNG bytes as a long; null where there is no image to read."""
    return pd.Series([difference_bits(x) for x in content], index=content.index, dtype="Int64")


def hash_text(bits: Column) -> Column:
    """A hash as sixteen hexadecimal digits."""
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def image_hashes(images: DataFrame, id_col: str = "image_id", content_col: str = "content") -> DataFrame:
    """(id, bits, same): the hash of every image, and the least id that has it. Images that can't be read have nulls in both."""
    own = written(images.select(id_col, difference_hash(F.col(content_col)).alias("bits")), "hashes")
    groups = own.where("bits is not null").groupBy("bits").agg(F.min(id_col).alias("same"), F.count("*").alias("n"))
    joined = join_groups(own, groups, "bits", "n").drop("n")
    return joined.unionByName(own.where("bits is null").withColumn("same", F.lit(None).cast(own.schema[id_col].dataType)))


# --- near hashes ------------------------------------------------------------------------------------------------
def _pieces(bits: list[int], count: int) -> list[int]:
    """Masks that cut the places ``bits`` into ``count`` pieces of about the same size."""
    ends = [len(bits) * i // count for i in range(count + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(ends, ends[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(rows: DataFrame, masks: list[list[int]], name: str, within: Column) -> DataFrame:
    """A row of ``rows`` for each mask of its list (``within``: which one): the number of the mask, and the hash under it."""
    lists = F.array(*[F.array(*[F.lit(_signed(m)) for m in some]) for some in masks])
    return rows.select("*", F.posexplode(F.get(lists, within)).alias(f"{name}_at", f"{name}_mask")).withColumn(f"{name}_bits", F.col("bits").bitwiseAND(F.col(f"{name}_mask"))).drop(f"{name}_mask")


def _first(masks: list[int], at: Column, difference: Column) -> Column:
    """Whether mask number ``at`` is the first of ``masks`` under which nothing differs."""
    earlier = F.slice(F.array(*[F.lit(_signed(m)) for m in masks]), F.lit(1), at)
    return ~F.exists(earlier, lambda m: difference.bitwiseAND(m) == 0)


def near_hashes(hashes: DataFrame, distance: int = 4, bits_col: str = "bits", key_hashes: int = KEY_HASHES) -> DataFrame:
    """(a, b, distance): all pairs a < b of distinct hashes that differ in at most ``distance`` of 64 bits. None is lost.

    The places are cut into distance + 2 blocks; ``distance`` differences
    leave two blocks alike, so pairs meet under a key of two blocks, and are
    kept by the first such key only (no distinct afterwards).  Where more than
    ``key_hashes`` hashes have a key, the rest of their places is cut into
    distance + 1 pieces, one of which must be alike too: the key times that
    piece is the key then.  Nulls are left out.
    """
    if not 0 <= distance <= 14:
        raise ValueError("a distance from 0 to 14")
    blocks = _pieces(list(range(64)), distance + 2)
    keys = [a | b for a, b in combinations(blocks, 2)]
    rest = [_pieces([b for b in range(64) if not key >> b & 1], distance + 1) for key in keys]
    single = hashes.where(F.col(bits_col).isNotNull()).select(F.col(bits_col).alias("bits")).distinct()
    rows = _keyed(single, [keys], "key", F.lit(0))
    sizes = rows.groupBy("key_at", "key_bits").agg(F.count("*").alias("n")).where(F.col("n") > key_hashes)
    hot = written(sizes, "keys")
    by = ["key_at", "key_bits"]
    cool = rows.join(hot.drop("n"), by, "left_anti")
    split = _keyed(rows.join(hot.drop("n"), by), rest, "piece", F.col("key_at"))

    def paired(some: DataFrame, on: list[str]) -> DataFrame:
        left, right = some.withColumnRenamed("bits", "a"), some.withColumnRenamed("bits", "b")
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
        return left.join(right, on).where((F.col("a") < F.col("b")) & near & _first(keys, F.col("key_at"), F.col("a").bitwiseXOR(F.col("b"))))

    differs = F.col("a").bitwiseXOR(F.col("b"))
    finer = paired(split, [*by, "piece_at", "piece_bits"])
    firsts = [F.when(F.col("key_at") == k, _first(rest[k], F.col("piece_at"), differs)) for k in range(len(keys))]
    both = paired(cool, by).select("a", "b").unionByName(finer.where(F.coalesce(*firsts)).select("a", "b"))
    return both.withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).cast("int"))


def image_neighbours(images: DataFrame, distance: int = 4, id_col: str = "image_id", content_col: str = "content") -> DataFrame:
    """(id, hash, same, n_near): of every image its hash in hexadecimal, the least id of equal hash, and how many other hashes are near.

    Images of one hash aren't paired; near_hashes has the pairs of hashes.
    Images that can't be read have nulls, and 0 near ones.
    """
    found = written(image_hashes(images, id_col, content_col), "images")
    pairs = near_hashes(found.where(F.col(id_col) == F.col("same")), distance)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("bits"))
    counts = ends.groupBy("bits").agg(F.count("*").alias("n_near"))
    (name,) = unused([id_col], "hash")
    return found.join(counts, "bits", "left").select(id_col, hash_text(F.col("bits")).alias(name), "same", F.coalesce("n_near", F.lit(0)).alias("n_near"))
