"""Repeated strings of a minimum length in a set of byte strings, from their Burrows-Wheeler order."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` symbols at least, and each suffix's place.
    Symbols are below 512. Ties beyond that depth are in any order, but the same for both."""
    n, size = len(symbols), 7
    key = np.zeros(n, np.int64)
    for i in range(size):
        key[: max(0, n - i)] |= symbols[i:].astype(np.int64) << (9 * (size - 1 - i))
    while True:
        order = np.argsort(key)
        new = np.ones(n, bool)
        ranked = key[order]
        new[1:] = ranked[1:] != ranked[:-1]
        group = np.cumsum(new)
        if size >= depth or group[-1] == n:
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            return order, place
        rank = np.empty(n, np.int64)
        rank[order] = group
        key = rank * (n + 1)
        key[: max(0, n - size)] += rank[size:]
        size *= 2


def repeats(texts: list[bytes], length: int) -> np.ndarray:
    """For the concatenation of `texts`, each followed by one separator: whether the string of
    `length` bytes that starts there lies in one text and occurs at another place too.

    Strings are extended backwards one symbol at a time, all of them at once. Before step l, the
    suffixes fall into intervals that share their first l symbols. Suffix j and its predecessor
    share l + 1 if their first symbols agree and the suffixes one symbol on (their images in the
    Burrows-Wheeler order) lie in one interval. Borders are thus found by increasing common prefix,
    each once, and what has no border after `length` steps is repeated: no suffix is followed
    beyond the minimum length."""
    flat = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int16) + 1
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    flat[ends] = 0
    n = len(flat)
    order, place = suffix_order(flat, length)
    first = flat[order]
    image = place[np.minimum(order + 1, n - 1)].astype(np.int32)
    border = np.ones(n, bool)
    border[1:] = (first[1:] != first[:-1]) | (first[1:] == 0)
    open_ = np.flatnonzero(~border)
    here, before = image[open_], image[open_ - 1]
    for _ in range(1, length):
        if not len(open_):
            break
        interval = np.cumsum(border, dtype=np.int32)
        parted = interval[here] != interval[before]
        if parted.any():
            border[open_[parted]] = True
            stay = ~parted
            open_, here, before = open_[stay], here[stay], before[stay]
    found = np.zeros(n, bool)
    found[order[open_]] = True
    found[order[open_ - 1]] = True
    return found
