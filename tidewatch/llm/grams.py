"""Character n-grams of many texts at once, as 64-bit hashes over one long array of code points.

The hash of the k characters ending at a position is a polynomial in a fixed odd multiplier, so the
hashes of all orders come from one addition each, and the context of a position is the hash of
one order less at the position before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15
EDGE = 0  # stands before and after each text
SEGMENT = 100_000  # code points handled at once: their hashes stay in a core's cache


@lru_cache(maxsize=1)
def _folds() -> tuple[np.ndarray, int]:
    """For each code point: its lower-case form if it is a letter, else a space; the first few planes."""
    size = 0x32400
    fold = np.full(size, 32, np.uint32)
    for c in range(size):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            fold[c] = ord(low) if len(low) == 1 else c
    return fold, size


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def letters(text: str) -> np.ndarray:
    """Lower-case letters, any run of other characters being one space; empty if there is no letter."""
    fold, size = _folds()
    p = points(text)
    p = fold[p] if not len(p) or p.max() < size else np.where(p < size, fold[np.minimum(p, size - 1)], 32).astype(np.uint32)
    space = p == 32
    if len(p) and space.any():
        keep = ~space
        keep[1:] |= space[1:] & ~space[:-1]
        p = p[keep]
    return p[1:] if len(p) and p[0] == 32 else p


def segments(texts: list[np.ndarray], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of the texts' code points laid end to end: points, positions to score, their texts.

    Each text gets ``order - 1`` edges before it; a long text is continued in the next segment with as
    many of its own points repeated before, so every position is scored once with its whole context.
    """
    pad = np.full(order - 1, EDGE, np.uint32)
    room, parts = SEGMENT, []
    for i, p in enumerate(texts):
        p = np.concatenate([pad, p])
        at = order - 1
        while at < len(p):
            take = min(room, len(p) - at)
            parts.append((p[at - order + 1 : at + take], i))
            at, room = at + take, room - take
            if not room:
                yield _joined(parts, order)
                room, parts = SEGMENT, []
    if parts:
        yield _joined(parts, order)


def _joined(parts: list[tuple[np.ndarray, int]], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.concatenate([p for p, _ in parts])
    sizes = np.array([len(p) for p, _ in parts])
    scored = np.ones(len(flat), bool)
    starts = np.cumsum(sizes) - sizes
    for k in range(order - 1):
        scored[starts + k] = False
    at = np.flatnonzero(scored)
    return flat, at, np.repeat(np.array([i for _, i in parts]), sizes - order + 1)


def hashes(flat: np.ndarray, order: int) -> list[np.ndarray]:
    """Item k: at each position the hash of the k characters that end there (item 0: zeros)."""
    v = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(29)
    out, power = [np.zeros(len(v), np.uint64), v.copy()], MULTIPLIER
    for k in range(1, order):
        h = out[-1].copy()
        h[k:] += v[: len(v) - k] * np.uint64(power)
        out.append(h)
        power = power * MULTIPLIER % (1 << 64)
    return out


def spread_bits(h: np.ndarray, bits: int) -> np.ndarray:
    """The hash's own top bits after a final mix, as int64."""
    h = h ^ (h >> np.uint64(32))
    return ((h * np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - bits)).astype(np.int64)
