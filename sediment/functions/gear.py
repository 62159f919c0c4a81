"""Content-defined chunking with a gear hash, two masks and skipped minimum (FastCDC, 2020)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from sediment.config import MIB, ChunkConfig

#: One 64-bit value a byte: the head of MD5 over 64 copies of it.
GEAR = np.array([int.from_bytes(hashlib.md5(bytes([b]) * 64).digest()[:8], "big") for b in range(256)], np.uint64)
#: Bytes hashed at once; a window begins at a chunk's start, so windows don't move cuts.
WINDOW = 8 * MIB
REACH = 64


def mask(bits: int) -> np.uint64:
    """``bits`` ones spread evenly over the upper 48 bits."""
    return np.uint64(sum(1 << (63 - (i * 48) // bits) for i in range(bits)))


def masks(config: ChunkConfig) -> tuple[np.uint64, np.uint64]:
    """The strict mask up to the average size and the loose one beyond."""
    bits = round(np.log2(config.avg_size))
    return mask(bits + 1), mask(bits - 1)


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hashes over the last 64 bytes at each place, by doubling."""
    h = GEAR[data]
    k = 1
    while k < REACH:
        h[k:] = h[k:] + (h[:-k].copy() << np.uint64(k))
        k *= 2
    return h


def cut_lengths(data: bytes, config: ChunkConfig) -> Iterator[int]:
    """Lengths of the chunks of ``data``; they cover it without gaps."""
    view, at = np.frombuffer(data, np.uint8), 0
    window = max(WINDOW, 4 * config.max_size)
    while at < len(view):
        piece = view[at : at + window]
        last = at + len(piece) == len(view)
        for n in _cuts(piece, config, last):
            yield n
            at += n


def _cuts(data: np.ndarray, config: ChunkConfig, last: bool) -> Iterator[int]:
    strict_mask, loose_mask = masks(config)
    h = rolling(data)
    strict, loose = (np.flatnonzero((h & m) == 0) for m in (strict_mask, loose_mask))
    start, n = 0, len(data)
    while start < n and (last or n - start > config.max_size):
        left = n - start
        if left <= config.min_size:
            yield left
            return
        skip, limit = start + config.min_size, start + min(left, config.max_size)
        center = min(start + config.avg_size, limit)
        cut = _first(h, strict, loose, skip, center, limit, strict_mask, loose_mask)
        yield cut - start
        start = cut


def _first(h, strict, loose, skip: int, center: int, limit: int, strict_mask, loose_mask) -> int:
    """The first place from ``skip`` whose hash, begun at ``skip``, meets its mask."""
    near = np.arange(skip, min(skip + REACH - 1, limit))
    shift = (near - skip + 1).astype(np.uint64)
    begun = h[near] - (h[skip - 1] << shift)  # the hash forgets what came before
    hit = np.flatnonzero((begun & np.where(near < center, strict_mask, loose_mask)) == 0)
    if len(hit):
        return int(near[hit[0]])
    far = skip + REACH - 1
    if far < center and (k := np.searchsorted(strict, far)) < len(strict) and strict[k] < center:
        return int(strict[k])
    if (k := np.searchsorted(loose, max(far, center))) < len(loose) and loose[k] < limit:
        return int(loose[k])
    return limit
