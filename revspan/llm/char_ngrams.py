"""Hashed character n-grams of whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20  # characters that are hashed at a time


def ngram_buckets(text: str | None, orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Bucket numbers (below 2^bits) of all character n-grams of the lower-cased text, chunk by chunk."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    longest = max(orders)
    for start in range(0, len(points), CHUNK):
        part = points[start: start + CHUNK + longest - 1]
        h = np.zeros(len(part), np.uint32)
        for n in range(1, longest + 1):
            m = min(CHUNK, len(part) - n + 1)
            if m <= 0:
                break
            h = h[:m] * np.uint32(0x01000193) + part[n - 1: n - 1 + m]
            if n in orders:
                mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
                yield mixed >> np.uint32(32 - bits)


def present(text: str | None, orders: tuple[int, ...], bits: int, stamp: np.ndarray) -> np.ndarray:
    """The distinct buckets of a text. stamp is scratch space: int32, 2^bits long."""
    found = []
    for buckets in ngram_buckets(text, orders, bits):
        places = np.arange(len(buckets), dtype=np.int32)
        stamp[buckets] = places
        found.append(buckets[stamp[buckets] == places])
    if not found:
        return np.empty(0, np.int64)
    every = np.concatenate(found)
    places = np.arange(len(every), dtype=np.int32)
    stamp[every] = places
    return every[stamp[every] == places].astype(np.int64)


def counted(text: str | None, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """How often each bucket occurs."""
    total = np.zeros(1 << bits, np.int64)
    for buckets in ngram_buckets(text, orders, bits):
        total += np.bincount(buckets, minlength=1 << bits)
    return total
