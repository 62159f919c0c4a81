"""BLAKE3 (unkeyed, 32 bytes) over numpy lanes: all 1 KiB leaves of a batch of inputs advance together."""

from __future__ import annotations

import numpy as np

#: Fixed values of the published specification: initial words, message order, flags.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
ORDER = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
BLOCK, LEAF = 64, 1024
#: The quarter rounds of one round: columns, then diagonals.
LANES = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(value: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values (lanes x 8) after one block (lanes x 16 words) each."""
    n = len(value)
    low, high = (counter & np.uint64(0xFFFFFFFF)).astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32)
    s = [*value.T.copy(), *(np.full(n, IV[i], np.uint32) for i in range(4)), low, high, length.astype(np.uint32), flags.astype(np.uint32)]
    m = list(words.T)
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(LANES):
            for word, x, y in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                s[a] = s[a] + s[b] + word
                s[d] = _turn(s[d] ^ s[a], x)
                s[c] = s[c] + s[d]
                s[b] = _turn(s[b] ^ s[c], y)
        m = [m[i] for i in ORDER]
    return np.stack([s[i] ^ s[i + 8] for i in range(8)], axis=1)


def blake3_many(inputs: list[bytes]) -> list[str]:
    """Hex hashes of the inputs."""
    if not inputs:
        return []
    sizes = np.array([len(x) for x in inputs], np.int64)
    leaves = np.maximum(1, -(-sizes // LEAF))
    owner = np.repeat(np.arange(len(inputs)), leaves)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(leaves) - leaves, leaves)
    data = b"".join(bytes(x).ljust(int(n) * LEAF, b"\0") for x, n in zip(inputs, leaves))
    words = np.frombuffer(data, "<u4").reshape(len(owner), LEAF // BLOCK, 16)
    length = np.minimum(sizes[owner] - place * LEAF, LEAF)
    blocks, only = np.maximum(1, -(-length // BLOCK)), leaves[owner] == 1
    value = np.tile(IV, (len(owner), 1))
    for b in range(int(blocks.max())):
        live = np.flatnonzero(b < blocks)
        end = b == blocks[live] - 1
        flags = np.where(b == 0, CHUNK_START, 0) | np.where(end, CHUNK_END, 0) | np.where(end & only[live], ROOT, 0)
        value[live] = _compress(value[live], words[live, b], place[live].astype(np.uint64), np.where(end, length[live] - b * BLOCK, BLOCK), flags)
    return [v.astype("<u4").tobytes().hex() for v in _roots(value, owner)]


def _roots(value: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Neighbours join level by level, an odd last one goes up as it is: the left subtree is always full."""
    while len(owner) > owner[-1] + 1:
        first = np.searchsorted(owner, owner)
        count = np.searchsorted(owner, owner, "right") - first
        place = np.arange(len(owner)) - first
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < count))
        flags = PARENT | np.where(count[left] == 2, ROOT, 0)
        words = np.concatenate([value[left], value[left + 1]], axis=1)
        value[left] = _compress(np.tile(IV, (len(left), 1)), words, np.zeros(len(left), np.uint64), np.full(len(left), BLOCK), flags)
        stay = place % 2 == 0
        value, owner = value[stay], owner[stay]
    return value


def blake3_hex(data: bytes) -> str:
    return blake3_many([data])[0]
