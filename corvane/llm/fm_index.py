"""An FM-index over a sequence of word numbers, in numpy arrays.

The sequence holds words 1..n_words and separators 0.  Separators are all
different for the order of the suffixes, so no match and no walk crosses one.
"""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 32


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order. ``seq`` ends with a separator.

    Prefix doubling that sorts again only the suffixes that are still tied.
    """
    n = len(seq)
    gaps = np.flatnonzero(seq == 0)
    value = seq.astype(np.int64) + (len(gaps) - 1)
    value[gaps] = np.arange(len(gaps))
    packed = (value << 32) | np.arange(n)
    packed.sort()
    order = packed & 0xFFFFFFFF
    sizes = np.bincount(value)
    rank = (np.cumsum(sizes) - sizes)[value]
    tied = np.flatnonzero(sizes[value] > 1)
    step = 1
    while len(tied):
        key = (rank[tied] << 32) | rank[tied + step]
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        group = key >> 32
        new_group = np.ones(len(tied), dtype=np.bool_)
        new_group[1:] = group[1:] != group[:-1]
        new_key = np.ones(len(tied), dtype=np.bool_)
        new_key[1:] = key[1:] != key[:-1]
        at = np.arange(len(tied))
        place = group + at - np.maximum.accumulate(np.where(new_group, at, 0))
        order[place] = tied
        rank[tied] = place[np.maximum.accumulate(np.where(new_key, at, 0))]
        last = np.ones(len(tied), dtype=np.bool_)
        last[:-1] = new_key[1:]
        tied = tied[~(new_key & last)]
        step *= 2
    return order


class Bits:
    """A bit vector with rank: packed words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, dtype=np.uint8)
        some = np.packbits(bits, bitorder="little")
        packed[: len(some)] = some
        self.words = packed.view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.zeros(len(self.words), dtype=np.int64)
        np.cumsum(ones[:-1], out=self.before[1:])
        self.ones = int(self.before[-1] + ones[-1])
        self.size = n

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & mask)


class Wavelet:
    """A wavelet tree stored level by level: all zeros of a level come before all ones of it in the next."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.levels = []
        now = symbols.astype(np.int32)
        for bit in range(max(1, int(most).bit_length()) - 1, -1, -1):
            ones = (now >> bit) & 1 == 1
            self.levels.append((bit, Bits(ones), len(now) - int(ones.sum())))
            if bit:
                now = np.concatenate([now[~ones], now[ones]])

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> bit) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._down(symbol, at) - self._down(symbol, np.zeros_like(at))

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each position, how often it occurs before it)."""
        symbol, first = np.zeros_like(at), np.zeros_like(at)
        for bit, bits, zeros in self.levels:
            one = bits.get(at)
            symbol |= one.astype(np.int64) << bit
            ones, first_ones = bits.rank(at), bits.rank(first)
            at = np.where(one, zeros + ones, at - ones)
            first = np.where(one, zeros + first_ones, first - first_ones)
        return symbol, at - first


class FMIndex:
    def __init__(self, seq: np.ndarray, n_words: int, sample_every: int = SAMPLE_EVERY):
        order = suffix_array(seq)
        self.wavelet = Wavelet(seq[order - 1], n_words)
        counts = np.bincount(seq, minlength=n_words + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])  # suffixes that begin with a smaller symbol
        sampled = (order % sample_every == 0) | (seq[order - 1] == 0)
        self.marks = Bits(sampled)
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern number, low, high) of the suffix ranges of the patterns that occur. ``patterns``: words, one per row."""
        number = np.arange(len(patterns))
        word = patterns[:, -1]
        low, high = self.first[word], self.first[word + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            there = low < high
            number, low, high = number[there], low[there], high[there]
            if not len(number):
                break
            word = patterns[number, k]
            both = self.wavelet.rank(np.concatenate([word, word]), np.concatenate([low, high]))
            low, high = self.first[word] + both[: len(word)], self.first[word] + both[len(word) :]
        there = low < high
        return number[there], low[there], high[there]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of suffixes given by rank: walk back to a sampled one."""
        out = np.zeros(len(rows), dtype=np.int64)
        walking, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(walking):
            done = self.marks.get(at)
            out[walking[done]] = self.samples[self.marks.rank(at[done])] + steps
            walking, at = walking[~done], at[~done]
            if len(walking):
                symbol, before = self.wavelet.access_rank(at)
                at = self.first[symbol] + before
            steps += 1
        return out
