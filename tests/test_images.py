"""Perceptual hashes: decoding beside its own encoder and by hand, near hashes beside brute force."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import images as I


def chunked(head, *parts):
    chunk = lambda name, x: struct.pack(">I", len(x)) + name + x + struct.pack(">I", zlib.crc32(name + x))
    return I.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", *head)) + b"".join(chunk(n, x) for n, x in parts) + chunk(b"IEND", b"")


def filtered(rows, kinds, step):
    """Rows of differences as the format defines them, one byte after the other."""
    out = b""
    for y, kind in enumerate(kinds):
        line = bytearray([kind])
        for x in range(rows.shape[1]):
            a = int(rows[y, x - step]) if x >= step else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - step]) if y and x >= step else 0
            p = a + b - c
            order = sorted((abs(p - v), i, v) for i, v in enumerate((a, b, c)))
            line.append((int(rows[y, x]) - [0, a, b, (a + b) // 2, order[0][2]][kind]) % 256)
        out += bytes(line)
    return out


@pytest.mark.parametrize("step", [1, 3, 4])
def test_all_filters(step):
    rows = np.random.RandomState(step).randint(0, 256, (11, 7 * step)).astype(np.uint8)
    kinds = [0, 1, 2, 3, 4, 4, 3, 2, 1, 0, 4]
    colour = {1: 0, 3: 2, 4: 6}[step]
    data = chunked((7, 11, 8, colour, 0, 0, 0), (b"IDAT", zlib.compress(filtered(rows, kinds, step))))
    pixels = rows.reshape(11, 7, step).astype(int)
    if step == 1:
        want = pixels[:, :, 0] * 1000
    else:
        want = pixels[:, :, :3] @ [299, 587, 114]
    if step == 4:
        want = (want * pixels[:, :, 3] + 255_000 * (255 - pixels[:, :, 3])) // 255
    assert (I.decoded(data) == want).all()


def test_depths_palettes_and_interlacing():
    bits = np.array([[1, 0, 1, 1, 0, 0, 1, 0, 1], [0, 1, 0, 0, 1, 1, 0, 1, 0]])
    raw = b"".join(b"\0" + np.packbits(r).tobytes() for r in bits)
    assert (I.decoded(chunked((9, 2, 1, 0, 0, 0, 0), (b"IDAT", zlib.compress(raw)))) == bits * 255_000).all()
    coloured = chunked((9, 2, 1, 3, 0, 0, 0), (b"PLTE", bytes([10, 10, 10, 20, 20, 20])), (b"tRNS", bytes([0])), (b"IDAT", zlib.compress(raw)))
    assert (I.decoded(coloured) == np.where(bits == 1, 20_000, 255_000)).all()
    deep = np.array([[0, 65535, 256]], dtype=">u2")
    assert I.decoded(chunked((3, 1, 16, 0, 0, 0, 0), (b"IDAT", zlib.compress(b"\0" + deep.tobytes())))).tolist() == [[0, 255_000, 0]]
    levels = np.random.RandomState(1).randint(0, 256, (10, 13))
    passes = b"".join(b"".join(b"\0" + bytes(r.tolist()) for r in levels[y::dy, x::dx]) for x, y, dx, dy in I.PASSES if levels[y::dy, x::dx].size)
    assert (I.decoded(chunked((13, 10, 8, 0, 0, 0, 1), (b"IDAT", zlib.compress(passes)))) == levels * 1000).all()


def test_what_is_no_image(spark, monkeypatch):
    whole = I.png(np.arange(64).reshape(8, 8))
    broken = [None, b"", b"GIF89a", I.SIGNATURE, whole[:40], whole[:-30], chunked((0, 5, 8, 0, 0, 0, 0)), chunked((5, 5, 8, 7, 0, 0, 0)), chunked((2, 2, 8, 0, 0, 0, 0), (b"IDAT", zlib.compress(b"\x09aa\0aa"))), chunked((1 << 30, 1 << 30, 8, 0, 0, 0, 0), (b"IDAT", zlib.compress(b"x")))]
    got = I.image_neighbours(spark.createDataFrame(list(enumerate(broken)), "image_id long, content binary")).collect()
    assert len(got) == len(broken) and {(r.hash, r.same, r.n_near) for r in got} == {(None, None, 0)}
    assert I.image_neighbours(spark.createDataFrame([], "image_id long, content binary")).count() == 0
    monkeypatch.setattr(I, "MOST_BYTES", 60)
    assert I.decoded(whole) is None


def test_resized_and_recoded_images_meet(spark):
    r = np.random.RandomState(5)
    rows = []
    for k in range(30):
        small = r.randint(0, 256, (8, 9))
        big = np.kron(small, np.ones((4, 3), int))
        noisy = np.clip(np.kron(small, np.ones((5, 5), int)) + r.randint(-2, 3, (40, 45)), 0, 255)
        rows += [(4 * k, I.png(small)), (4 * k + 1, I.png(big, 1)), (4 * k + 2, I.png(np.repeat(big[:, :, None], 3, axis=2), 2)), (4 * k + 3, I.png(noisy, 2))]
    got = {x.image_id: x for x in I.image_neighbours(spark.createDataFrame(rows, "image_id long, content binary")).collect()}
    assert len(got) == 120
    for k in range(30):
        assert {got[4 * k + i].same for i in range(3)} == {4 * k}
        other = got[4 * k + 3]
        assert other.same == 4 * k or other.n_near == got[4 * k].n_near == 1


@pytest.mark.parametrize(("distance", "limit"), [(0, 256), (1, 2), (4, 256), (4, 3), (9, 1), (14, 2)])
def test_near_hashes_are_those_of_brute_force(spark, distance, limit):
    """Clusters around few centres, both signs, with keys cut finer and without."""
    r = np.random.RandomState(distance)
    centres = [int(x) for x in r.randint(-(2**62), 2**62, 4)] + [0, -1]
    values = sorted({c ^ I._signed(sum(1 << int(b) for b in r.choice(64, r.randint(0, 9), replace=False))) for c in centres for _ in range(25)})
    want = {(a, b, ((a ^ b) & (1 << 64) - 1).bit_count()) for i, a in enumerate(values) for b in values[i + 1 :]}
    want = {x for x in want if x[2] <= distance}
    rows = spark.createDataFrame([(v,) for v in [*values, *values[:9], None]], "bits long")
    got = [tuple(x) for x in I.near_hashes(rows, distance, key_hashes=limit).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (distance == 0 or want)


def test_a_distance_that_is_none(spark):
    with pytest.raises(ValueError, match="distance"):
        I.near_hashes(spark.createDataFrame([(1,)], "bits long"), 15)
    assert spark.range(1).select(I.hash_text(F.lit(-1)).alias("a"), I.hash_text(F.lit(10)).alias("b")).first() == ("f" * 16, "000000000000000a")
