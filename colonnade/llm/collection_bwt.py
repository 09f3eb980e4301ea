"""Burrows-Wheeler transform and common prefixes of a collection of short strings, built column by column.

The construction inserts one symbol of every string a round (Bauer, Cox and Rosone, 2013; with common
prefixes, Cox, Garofalo, Rosone and Sciortino, 2016).  After round j the transform holds every suffix of at
most j symbols in order: position by position the symbol before the suffix, and how many symbols the suffix
shares with the one above it.  The suffixes of j + 1 symbols are the symbols of the last round's suffixes
put before them, so their places follow from the counts of equal symbols above, and their common prefixes
from the smallest value between two equal symbols.  A symbol is a byte, or two where the strings to be compared
have an even number of bytes.  Both arrays are read from and written to a sequential
file each round; the files have no name and vanish with the task.
"""

from __future__ import annotations

import tempfile

import numpy as np


class _File:
    """One array in a scratch file, replaced as a whole and read front to back."""

    def __init__(self, kind: np.dtype):
        self._file, self._kind = tempfile.TemporaryFile(), kind

    def write(self, values: np.ndarray) -> None:
        self._file.seek(0)
        values.tofile(self._file)
        self._file.truncate()

    def read(self) -> np.ndarray:
        self._file.seek(0)
        return np.fromfile(self._file, self._kind)

    def close(self) -> None:
        self._file.close()


def _sorted_places(symbols: np.ndarray) -> tuple[np.ndarray, int]:
    """Places by symbol, then by place; and how many end markers (0) come first."""
    return np.argsort(symbols, kind="stable"), int(np.count_nonzero(symbols == 0))


def _columns(data: np.ndarray, width: int) -> np.ndarray:
    """A number from 1 on for the ``width`` bytes that start at each place, in their order."""
    gram = data.astype(np.int64)
    for k in range(1, width):
        gram[:-k] = gram[:-k] << 8 | data[k:]
    used = np.zeros(256**width, bool)
    used[gram] = True
    code = np.cumsum(used)
    return code[gram].astype(np.uint8 if code[-1] < 256 else np.uint16 if code[-1] < 65536 else np.uint32)


def suffix_groups(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of the ``least``-symbol strings that start in each string.

    ``data`` holds the bytes, string i at ``starts[i]`` with ``lengths[i] >= least`` bytes.  Returns the
    numbers of all starts, string by string from left to right, and where each string's numbers begin.
    Equal numbers mean equal strings of ``least`` symbols.  An even ``least`` is built by columns of two
    bytes: the collection then holds each string twice, once without its last byte, so that there are half as
    many rounds, over as many suffixes in the end.
    """
    m = len(starts)
    begin = np.concatenate(([0], np.cumsum(lengths - least + 1)))
    if not m:
        return np.zeros(0, np.int64), begin
    width = 2 if least % 2 == 0 else 1
    cap = least // width
    symbol = _columns(data, width)
    # the strings of columns: each ends at another of the last ``width`` places of its string
    ends = np.concatenate([starts + lengths - k for k in range(width)])
    last = np.concatenate([begin[1:] - 1 - k for k in range(width)])  # the number of the string's last start
    lengths = np.concatenate([(lengths - k) // width for k in range(width)])
    by_length = np.argsort(-lengths, kind="stable")  # strings still growing come first
    by_length = by_length[: int(np.count_nonzero(lengths >= cap))]
    ends, last, lengths = ends[by_length], last[by_length], lengths[by_length]
    m = len(ends)
    bwt, lcp = _File(symbol.dtype), _File(np.dtype(np.uint8))
    try:
        bwt.write(symbol[ends - width])
        lcp.write(np.zeros(m, np.uint8))
        place = np.arange(m)  # of each string's last suffix
        for j in range(1, int(lengths[0]) + 1):
            active = int(np.searchsorted(-lengths, -j, side="right"))
            above, shared = bwt.read(), lcp.read()
            order, ended = _sorted_places(above)
            order = order[ended:]
            fresh = np.zeros(len(above), bool)
            fresh[place[:active]] = True
            fresh_row = np.flatnonzero(fresh[order])  # rows after the m empty suffixes
            # common prefixes change for the new rows and for those right below them
            below = fresh_row + 1
            below = below[np.append(below[:-1] != fresh_row[1:], below[-1:] < len(order))]
            rows = np.concatenate((fresh_row, below))
            high, before = order[rows], order[np.maximum(rows, 1) - 1]
            same = np.flatnonzero((rows > 0) & (above[high] == above[before]))
            value = np.zeros(len(rows), np.uint8)
            if len(same):
                # ranges by falling start: no range is read again on the way to the next one
                low = before[same] + 1
                fall = np.argsort(-low)
                same, low = same[fall], low[fall]
                pairs = np.empty(2 * len(low), np.int64)
                pairs[0::2], pairs[1::2] = low, high[same] + 1
                value[same] = np.minimum(np.minimum.reduceat(np.append(shared, np.uint8(0)), pairs)[0::2] + 1, cap)
            # the new arrays: the old ones with the new rows between them
            size = m + len(order)
            held = np.ones(size, bool)
            held[m + fresh_row] = False
            after, common = np.empty(size, symbol.dtype), np.empty(size, np.uint8)
            after[held], common[held] = above, shared
            common[m + rows] = value
            owner = np.empty(len(above), np.int32)
            owner[place[:active]] = np.arange(active)
            owner = owner[order[fresh_row]]
            going = lengths[owner] > j
            after[m + fresh_row] = np.where(going, symbol[np.where(going, ends[owner] - width * (j + 1), 0)], 0)
            place = np.empty(active, np.int64)
            place[owner] = m + fresh_row
            bwt.write(after)
            lcp.write(common)
        above, shared = bwt.read(), lcp.read()
    finally:
        bwt.close()
        lcp.close()
    group = np.cumsum(shared < cap)
    order, ended = _sorted_places(above)
    follow = np.empty(len(above), np.int64)
    follow[order[ended:]] = m + np.arange(len(order) - ended)
    numbers, place = np.empty(int(begin[-1]), np.int64), np.arange(m)
    for j in range(1, int(lengths[0]) + 1):
        active = int(np.searchsorted(-lengths, -j, side="right"))
        place = follow[place[:active]]
        if j >= cap:  # the suffix of j columns starts lengths - j columns into its string
            numbers[last[:active] - width * (j - cap)] = group[place]
    return numbers, begin
