"""Words and shingles of a text, vectorised over its UTF-8 bytes. A word is a run of bytes other than [\\x20\\x09-\\x0D], A-Z lower-cased."""

from __future__ import annotations

import numpy as np

from .shared import process_cache

#: Bytes that are hashed at once; a block ends between two words, so a longer word makes a longer block.
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15
SPACE = frozenset(b" \t\n\x0b\x0c\r")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def make(size: int):
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)

    small = 1 << 17
    return process_cache(("powers", small), lambda: make(small)) if n <= small else process_cache(("powers", BLOCK), lambda: make(BLOCK)) if n <= BLOCK else make(n)


def blocks(data: bytes, size: int = BLOCK):
    """(offset, block): the bytes in blocks that end before white space or at the end."""
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] not in SPACE:
            end += 1
        yield at, data[at:end]
        at = end


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and byte behind of each word."""
    found = [_words(block, at) for at, block in blocks(data)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _words(block: bytes, at: int):
    b = np.frombuffer(block, np.uint8)
    b = np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)
    solid = np.concatenate(([False], ~((b == 32) | ((b >= 9) & (b <= 13))), [False]))
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start + at, end + at


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row; of fewer words, of all of them; none of no word."""
    if len(h) == 0:
        return h
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(BASE) + h[i : len(h) - k + 1 + i]
    return mix64(out)
