"""Code points of many texts at once, mapped character by character and with runs of separators as one blank."""

from __future__ import annotations

import functools
from collections.abc import Iterable

import numpy as np

BLANK = 32
END = 0


def _fold(points: Iterable[int], letters_only: bool) -> list[int]:
    """What code points become: their lower case, or a blank if they are no letter (or digit)."""
    out = []
    for c in points:
        ch = chr(c)
        low = ch.lower() if ch.isalpha() or not letters_only and ch.isalnum() else ""
        out.append(BLANK if not low else ord(low) if len(low) == 1 else c)
    return out


@functools.cache
def _folded(letters_only: bool) -> np.ndarray:
    """The basic plane, folded."""
    return np.array(_fold(range(1 << 16), letters_only), np.uint32)


def folded_texts(buffer: np.ndarray, begin: np.ndarray, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of texts that are joined with one byte after each (see ``arrays.joined``).

    Returns the code points, each text followed by ``END``; for each its place among the code points of the
    joined texts; where each text starts in the result, and the end; and where each starts before folding.
    """
    points = np.frombuffer(buffer.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.concatenate(([0], np.cumsum((buffer & 0xC0) != 0x80)))[begin]
    table = _folded(letters_only)
    low = table[np.minimum(points, len(table) - 1)]
    above = np.flatnonzero(points >= len(table))
    if len(above):
        kinds, which = np.unique(points[above], return_inverse=True)
        low[above] = np.array(_fold(kinds.tolist(), letters_only), np.uint32)[which]
    low[first[1:] - 1] = END
    previous = np.concatenate(([END], low[:-1]))
    place = np.flatnonzero((low != BLANK) | ((previous != BLANK) & (previous != END)))
    low = low[place]
    return low, place, np.concatenate(([0], np.flatnonzero(low == END) + 1)), first
