"""Hashes of all words of many texts at once, from running sums over their bytes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import xxhash

PIECE, LONG = 1 << 19, 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finisher on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTES, _STEP = mixed(np.arange(1, 257, dtype=np.uint64)), 0x9E3779B97F4A7C15


@cache
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2 ** bits powers of `_STEP` and of its inverse, modulo 2 ** 64."""
    return tuple(np.cumprod(np.full(1 << bits, x, np.uint64)) for x in (_STEP, pow(_STEP, -1, 1 << 64)))


def word_hashes(data: np.ndarray, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of some bytes, at least one: a polynomial of its bytes, taken from running sums; long words by xxhash.

    `marks` tells for each byte value whether it is cut from both ends of a word; words of marks only are left out.
    """
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    edges = np.concatenate([[0][: not space[0]], edges, [len(data)][: not space[-1]]]).astype(np.int64)
    starts, ends = edges[::2], edges[1::2]
    if marks is not None:
        inner = np.flatnonzero(~(space | marks[data]))
        low, high = np.searchsorted(inner, starts), np.searchsorted(inner, ends)
        some = low < high
        starts, ends = inner[low[some]], inner[high[some] - 1] + 1
    up, down = powers(max(len(data).bit_length(), 20))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    out = mixed((sums[ends] - sums[starts]) * down[starts])
    for i in np.flatnonzero(ends - starts > LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out, starts


def pieces(data: bytes) -> Iterator[np.ndarray]:
    """The bytes, cut at white space about every `PIECE`, so that a very long text takes little memory."""
    start = 0
    while start < len(data):
        cut = _WHITE.search(data, start + PIECE)
        end = cut.end() if cut else len(data)
        yield np.frombuffer(data, np.uint8, end - start, start)
        start = end


def in_chunks(texts: Iterable[bytes] | Iterable[str], most: int = 1 << 18) -> Iterator[list]:
    """Texts, in order, about `most` bytes or characters at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held
