"""Hashed text features, computed with numpy over blocks of whole texts.

Texts arrive as UTF-8 bytes (None counts as empty). A block concatenates several texts, each followed by a gap of
separators, so that one vectorised pass hashes every word or n-gram of the block. A text is never cut: a text larger
than the block size makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GAP = 4
BLOCK_BYTES = 1 << 18

_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _word_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        table[lo : hi + 1] = True
    return table


def _lower_bytes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


IS_WORD, LOWER = _word_bytes(), _lower_bytes()


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = pow(_ODD, -1, 1 << 64)
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (_ODD, inverse)
            )
        return self.up[:n], self.down[:n]


_POWERS = Powers()


class Block:
    """Some texts in one buffer: `starts` and `ends` are their byte ranges, `first` the index of the first text."""

    def __init__(self, first: int, texts: list[bytes]) -> None:
        self.first, self.n = first, len(texts)
        sizes = np.fromiter((len(t) for t in texts), np.int64, self.n)
        gap = b" " * GAP
        self.raw = np.frombuffer(gap.join(texts) + gap, np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(sizes + GAP)[:-1]]).astype(np.int64)
        self.ends = self.starts + sizes

    def folded(self) -> np.ndarray:
        """Lower-cased bytes: A-Z, and the two-byte letters of the Latin-1 range."""
        low = LOWER[self.raw]
        hit = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[hit] += 0x20
        return low

    def words(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each word in order, index of its text in the block, and the number of words of each text."""
        inside = IS_WORD[low]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]
        up, down = _POWERS.to(len(low) + 1)
        total = np.zeros(len(low) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        h = mix((total[end] - total[start]) * down[start])
        counts = np.diff(np.searchsorted(start, np.append(self.starts, len(low))))
        return h, np.repeat(np.arange(self.n), counts), counts


def blocks(texts: list[bytes | None], limit: int = BLOCK_BYTES, rows: int = 1 << 16) -> Iterator[Block]:
    """Splits a list of texts into blocks of about `limit` bytes and at most `rows` texts."""
    part: list[bytes] = []
    first = size = 0
    for i, t in enumerate(texts):
        t = t or b""
        if part and (size + len(t) > limit or len(part) == rows):
            yield Block(first, part)
            part, first, size = [], i, 0
        part.append(t)
        size += len(t) + GAP
    if part:
        yield Block(first, part)


def word_grams(block: Block, bits: int, skips: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of words and of ordered word pairs at the given distances (1: bigrams, more: skip-grams), and their texts."""
    h, doc, _ = block.words(block.folded())
    shift = np.uint64(64 - bits)
    slots, docs = [h >> shift], [doc]
    for d in skips:
        if len(h) > d:
            same = doc[d:] == doc[:-d]
            pair = mix(h[:-d] * np.uint64(2 * d + 1) + (h[d:] << np.uint64(1)) + np.uint64(d))
            slots.append((pair >> shift)[same])
            docs.append(doc[d:][same])
    return np.concatenate(slots).astype(np.int64), np.concatenate(docs)


def byte_grams(low: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each size n (at most 4), the slot of the n bytes that start at each place of the buffer but the last GAP."""
    wide = low.astype(np.uint32)
    code = np.zeros(len(low) - GAP, np.uint32)
    for n in range(1, max(sizes) + 1):
        code = code | (wide[n - 1 : n - 1 + len(code)] << np.uint32(8 * (n - 1)))
        if n in sizes:
            x = (code ^ np.uint32(n * 0x01000193)) * np.uint32(0x9E3779B1)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77)
            yield n, (x >> np.uint32(32 - bits)).astype(np.int64)
