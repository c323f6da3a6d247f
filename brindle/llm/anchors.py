"""Anchors: positions of a text that any two occurrences of a long string have in common."""

from __future__ import annotations

import numpy as np

from brindle.llm.common import mixed, prefix_sums, range_hash

#: Bytes whose hash decides which position of a window is its anchor.
GRAM = 32


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, in about log2(width) passes."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors_of(raw: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Anchors of the windows of ``least`` bytes of every text, as arrays:

    text, anchor position, first and last window start with that anchor,
    hash of the gram at the anchor, and hash of all bytes of those windows.

    The anchor of a window is the leftmost position of its smallest gram hash,
    so equal windows have their anchor at the same place.  Every window start
    belongs to exactly one anchor.
    """
    gram = min(GRAM, least)
    width = least - gram + 1
    counts = np.maximum(np.diff(at) - least + 1, 0)
    if not counts.sum():
        none = np.empty(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    bits = np.uint64(max(1, int(len(raw)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    sums = prefix_sums(raw)
    first = np.arange(len(raw) - gram + 1)
    grams = range_hash(sums, first, first + gram)
    keys = (grams & ~low) | first.astype(np.uint64)
    chosen = (_sliding_minimum(keys, width) & low).astype(np.int64)
    before = np.cumsum(counts) - counts
    starts = np.repeat(at[:-1] - before, counts) + np.arange(counts.sum())
    text = np.repeat(np.arange(len(counts)), counts)
    chosen = chosen[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    run = np.flatnonzero(new)
    s_low, s_high = starts[run], starts[np.append(run[1:], len(starts)) - 1]
    anchor = chosen[run]
    around = range_hash(sums, s_low, s_high + least)
    return text[run], anchor, s_low, s_high, grams[anchor], mixed(around + (s_high - s_low).astype(np.uint64))
