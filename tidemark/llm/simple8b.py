"""Simple-8b: word-aligned coding of unsigned integers, vectorised in numpy.

Every 64-bit word holds a selector in its top 4 bits and as many equally wide values as the
selector says in the other 60. Selector 0 is the escape: a value of 61 bits or more takes two
such words in a row, its low and its high 32 bits. Values are coded in blocks of BLOCK; no word
crosses a block, and the offset of each block's first word is kept beside the words, so a block
can be decoded without the ones before it and all blocks can be decoded at once.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format: how many values of how many bits each selector stands for.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024


_NARROW = np.array([n.bit_length() for n in range(1 << 16)], np.uint8)  # for ids of usual vocabularies


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    if len(values) and values.max() < len(_NARROW):
        return _NARROW[values.astype(np.int64)]
    out = np.zeros(len(values), np.uint8)
    for shift in (32, 16, 8, 4, 2, 1):
        big = (values >> np.uint64(shift)) > 0
        out[big] += shift
        values = np.where(big, values >> np.uint64(shift), values)
    return out + (values > 0)


def _choices(width: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each position the selector that takes the most values from there on; left: values to the block's end."""
    n = len(width)
    choice = np.where(width > 60, 0, 15).astype(np.uint8)
    spans, size = {1: width}, 1
    while size < 64:  # spans[s]: the widest of s values from here on
        prev, wider = spans[size], spans[size].copy()
        if size < n:
            np.maximum(prev[:-size], prev[size:], out=wider[:-size])
        spans[size * 2], size = wider, size * 2
    for selector in range(14, 0, -1):
        count = int(COUNTS[selector])
        if count > n:
            continue
        base = 1 << (count.bit_length() - 1)
        if spans[base].min() > BITS[selector]:
            continue
        widest = spans[base][: n - count + 1]
        if count > base:
            widest = np.maximum(widest, spans[base][count - base :][: n - count + 1])
        fits = (widest <= BITS[selector]) & (left[: n - count + 1] >= count)
        choice[: n - count + 1][fits] = selector
    return choice


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of `values`, and the offset of each block's first word."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    at = np.arange(n)
    choice = _choices(_widths(values), BLOCK - at % BLOCK if n % BLOCK == 0 else np.minimum(BLOCK - at % BLOCK, n - at))
    step = COUNTS[choice]
    cursor, steps = np.arange(0, n, BLOCK), []
    ends = np.minimum(cursor + BLOCK, n)
    while len(cursor):  # every block moves on by one word
        steps.append(cursor)
        cursor = cursor + step[cursor]
        going = cursor < ends
        cursor, ends = cursor[going], ends[going]
    starts = np.sort(np.concatenate(steps))
    chosen = choice[starts]
    size = 1 + (chosen == 0)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for selector in np.unique(chosen):
        own = chosen == selector
        first, out = starts[own], place[own]
        if selector == 0:
            words[out], words[out + 1] = values[first] & np.uint64(0xFFFFFFFF), values[first] >> np.uint64(32)
            continue
        word = np.full(len(first), int(selector) << 60, np.uint64)
        if BITS[selector]:
            for j in range(COUNTS[selector]):
                word |= values[first + j] << np.uint64(j * BITS[selector])
        words[out] = word
    return words, place[np.searchsorted(starts, np.arange(0, n, BLOCK))].astype(np.int32)


def decode(words: np.ndarray) -> np.ndarray:
    """All values of `words`, which are whole blocks."""
    selector = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.flatnonzero(selector == 0)
    count = COUNTS[selector]
    count[raw[1::2]] = 0  # the high half of an escaped value
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    out[place[raw[::2]]] = (words[raw[::2]] & np.uint64(0xFFFFFFFF)) | (words[raw[1::2]] << np.uint64(32))
    for s in np.unique(selector):
        if BITS[s] and s:
            own = np.flatnonzero(selector == s)
            word, to, mask = words[own], place[own], np.uint64((1 << int(BITS[s])) - 1)
            for j in range(COUNTS[s]):
                out[to + j] = (word >> np.uint64(j * BITS[s])) & mask
    return out


def decode_block(words: np.ndarray, offsets: np.ndarray, block: int) -> np.ndarray:
    """The values of one block alone."""
    end = offsets[block + 1] if block + 1 < len(offsets) else len(words)
    return decode(words[offsets[block] : end])
