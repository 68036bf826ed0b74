"""Maximal repetitions (runs) of a word sequence, after Kolpakov and Kucherov.

A suffix automaton gives the factorisation of the sequence: each factor is the
longest piece that also starts earlier.  A run either touches the beginning
of the factor it ends in, or lies inside that factor.  Runs of the first kind
are found by Main's algorithm, which compares what stands before and after the
boundary with the same words moved by a period; those of the second kind are
copies of runs at the factor's earlier occurrence.  Time and memory grow with
the length of the sequence.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

Run = tuple[int, int, int]


class SuffixAutomaton:
    """All substrings of a sequence of integers >= 0, and where each ends first.

    Nearly all states have one transition: it is kept in two arrays, further
    ones in a dictionary.
    """

    def __init__(self, seq: list[int]):
        letter, target, link, size, first = array("q", [-1]), array("q", [0]), array("q", [-1]), array("q", [0]), array("q", [-1])
        more: dict[int, dict[int, int]] = {}
        last = 0
        for i, c in enumerate(seq):
            new = len(size)
            letter.append(-1)
            target.append(0)
            link.append(0)
            size.append(i + 1)
            first.append(i)
            state, old = last, -1
            while state != -1:
                if letter[state] == c:
                    old = target[state]
                elif letter[state] == -1:
                    letter[state], target[state] = c, new
                    state = link[state]
                    continue
                else:
                    old = more.setdefault(state, {}).setdefault(c, -1)
                    if old == -1:
                        more[state][c] = new
                        state = link[state]
                        continue
                break
            if state != -1:
                if size[old] == size[state] + 1:
                    link[new] = old
                else:
                    copy = len(size)
                    letter.append(letter[old])
                    target.append(target[old])
                    link.append(link[old])
                    size.append(size[state] + 1)
                    first.append(first[old])
                    if old in more:
                        more[copy] = dict(more[old])
                    link[old] = link[new] = copy
                    while state != -1:
                        if letter[state] == c:
                            if target[state] != old:
                                break
                            target[state] = copy
                        elif state in more and more[state].get(c) == old:
                            more[state][c] = copy
                        else:
                            break
                        state = link[state]
            last = new
        self.seq, self.letter, self.target, self.more, self.first = seq, letter, target, more, first

    def factors(self) -> Iterator[tuple[int, int, int]]:
        """(begin, end, begin of the first occurrence, or -1 for a new letter) of each factor, in order."""
        seq, letter, target, more, first = self.seq, self.letter, self.target, self.more, self.first
        begin, n = 0, len(seq)
        while begin < n:
            state, at = 0, begin
            while at < n:
                c = seq[at]
                state_next = target[state] if letter[state] == c else more[state][c]
                if first[state_next] >= at:
                    break
                state, at = state_next, at + 1
            if at == begin:
                yield begin, begin + 1, -1
            else:
                yield begin, at, first[state] - (at - begin) + 1
            begin = max(at, begin + 1)


def prefix_lengths(seq: list[int]) -> list[int]:
    """For each place, how many elements from there on equal those from the start on (0 at the start)."""
    n = len(seq)
    out = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(out[i - left], right - i) if i < right else 0
        while i + k < n and seq[k] == seq[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def _crossing(seq: list[int], begin: int, boundary: int, end: int, least: int) -> Iterator[Run]:
    """(start, end, period) of the runs in ``seq[begin:end]`` that touch ``boundary``; some with a multiple of the period too."""
    before, after = seq[begin:boundary], seq[boundary:end]
    mirrored = before[::-1]
    n_before, n_after, n = len(before), len(after), len(seq)
    # the period ends at the boundary: compare with the words one period earlier
    ahead = prefix_lengths([*after, -1, *before, *after])
    back = prefix_lengths(mirrored)
    found = []
    for period in range(1, n_before + 1):
        right = ahead[n_after + 1 + n_before - period]
        left = back[period] if period < n_before else 0
        if left + right >= period and period + left + right >= least:
            found.append((boundary - period - left, boundary + min(right, n_after), period))
    # the period begins at the boundary: compare with the words one period later
    ahead = prefix_lengths(after)
    back = prefix_lengths([*mirrored, -1, *after[::-1], *mirrored])
    for period in range(1, n_after + 1):
        right = ahead[period] if period < n_after else 0
        left = min(back[n_before + 1 + n_after - period], n_before)
        if left + right >= period and period + left + right >= least:
            found.append((boundary - left, boundary + period + right, period))
    for start, stop, period in found:
        if (stop == n or seq[stop] != seq[stop - period]) and (start == 0 or seq[start - 1] != seq[start - 1 + period]):
            yield start, stop, period


def maximal_runs(seq: list[int], least: int = 2) -> list[Run]:
    """(start, length, period) of all runs of at least ``least`` elements and two periods, by start, then period.

    A run that ends in a factor and touches its beginning reaches back less
    than twice the factor before and once the factor itself: were the factor
    before, and the element after it, found one period earlier, then it would
    have been longer.
    """
    n = len(seq)
    period_of: dict[tuple[int, int], int] = {}
    starting: dict[int, list[tuple[int, int]]] = {}

    def add(start: int, end: int, period: int) -> None:
        known = period_of.get((start, end))
        if known is None:
            starting.setdefault(start, []).append((end, period))
        elif known > period:
            starting[start] = [(e, period if e == end else p) for e, p in starting[start]]
        else:
            return
        period_of[start, end] = period

    size_before = 0
    for begin, end, earlier in SuffixAutomaton(seq).factors():
        low = max(0, begin - 2 * size_before - (end - begin))
        if begin and end - low >= least:
            for run in _crossing(seq, low, begin, end, least):
                add(*run)
        if earlier >= 0:
            move = begin - earlier
            for start in range(earlier + 1, end - move - least + 1):
                for stop, period in tuple(starting.get(start, ())):
                    there = min(stop + move, end)
                    size = there - start - move
                    if size >= least and size >= 2 * period and (there == n or seq[there] != seq[there - period]):
                        add(start + move, there, period)
        size_before = end - begin
    return sorted((start, end - start, period) for (start, end), period in period_of.items())
