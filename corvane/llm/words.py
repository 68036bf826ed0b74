"""Vectorised word work on Arrow text columns.

Every Python-side operator of this subpackage reads text as the UTF-8 bytes
of an Arrow column and finds words with table look-ups over the whole column,
so nothing is done per character or per word in Python.

Words are maximal runs of the bytes that a table marks.  Both word
definitions used here treat every byte of a non-ASCII character alike, so
working on bytes gives the same words as working on characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes whose hashes are worked out at once; bounds the scratch memory.
BLOCK_BYTES = 1 << 18


def byte_table(is_word) -> np.ndarray:
    """A 256-entry boolean table of the bytes for which ``is_word`` holds."""
    return np.array([bool(is_word(b)) for b in range(256)])


#: Words as runs of anything but blanks: [^\x20\x09-\x0D]+
NON_BLANK = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words of lower-cased text as [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ : digits, a-z and all non-ASCII.
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Byte table that lower-cases A-Z and nothing else.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)

_RNG = np.random.RandomState(20240611)
_BYTE_CODE = _RNG.randint(1, 2**62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(n, dtype=np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step % (1 << 64)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public SplitMix64 one); returns a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; row i is bytes[offsets[i]:offsets[i+1]]. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    n = len(column)
    if n == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, dtype=np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, counts): byte bounds of all words and the words of each row. No word crosses rows."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = np.zeros(n + 2, dtype=np.bool_)
    inside[1:-1] = table[data]
    edge = inside[1:] != inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    both = cut[inside[cut] & inside[cut + 1]]  # a row ends and the next begins inside one run
    if len(both):
        both = np.unique(both)
    del inside
    edges = np.flatnonzero(edge)
    starts, ends = edges[::2], edges[1::2]
    if len(both):
        starts = np.sort(np.concatenate([starts, both]))
        ends = np.sort(np.concatenate([ends, both]))
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word (of the bytes given, so lower-case first)."""
    out = np.empty(len(starts), dtype=np.uint64)
    at, n = 0, len(starts)
    powers = inverse = np.ones(0, dtype=np.uint64)
    while at < n:
        low = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, low + BLOCK_BYTES, "right")))
        high = int(ends[stop - 1])
        if len(powers) < high - low:
            powers, inverse = _powers(_BASE, high - low), _powers(_BASE_INVERSE, high - low)
        code = _BYTE_CODE[data[low:high]]
        code *= powers[: high - low]
        total = np.empty(high - low + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(code, out=total[1:])
        a, b = starts[at:stop] - low, ends[at:stop] - low
        value = total[b] - total[a]
        value *= inverse[a]
        value ^= (b - a).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        out[at:stop] = mix(value)
        at = stop
    return out


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, row of each): every run of ``width`` words; the whole row as one if it has fewer words, but some."""
    rows = np.repeat(np.arange(len(counts)), counts)
    if width == 1:
        return mix(hashes), rows
    ends = np.cumsum(counts)
    full = np.maximum(counts - width + 1, 0)
    own = np.repeat(np.arange(len(counts)), full)
    first = np.arange(len(own)) - np.repeat(np.cumsum(full) - full, full) + np.repeat(ends - counts, full)
    value = np.zeros(len(own), dtype=np.uint64)
    for k in range(width):
        value = mix(value * np.uint64(0x9DDFEA08EB382D69) + hashes[first + k])
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        short = np.zeros(len(few), dtype=np.uint64)
        for k in range(width - 1):
            has = counts[few] > k
            word = hashes[np.minimum(ends[few] - counts[few] + k, len(hashes) - 1)]
            short = np.where(has, mix(short * np.uint64(0x9DDFEA08EB382D69) + word), short)
        value = np.concatenate([value, mix(short + counts[few].astype(np.uint64))])
        own = np.concatenate([own, few])
    return value, own


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` consecutive hashes, by doubling; windows across rows are among them."""
    joined = lambda a, b: mix(a * np.uint64(0x9DDFEA08EB382D69) + b)
    if len(hashes) < width:
        return hashes[:0]
    done, value = 1, hashes
    while 2 * done <= width:
        value = joined(value[: len(value) - done], value[done:])
        done *= 2
    if done < width:
        step = width - done  # the last two overlap
        value = joined(value[: len(value) - step], value[step:])
    return value
