"""Content hashes as lower-case hex. SHA-256 is Spark's own; others are named functions over bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sediment.errors import ConfigError
from sediment.functions.blake3 import blake3_hex, blake3_many

HASHERS: dict[str, Callable[[bytes], str]] = {
    "sha256": lambda data: hashlib.sha256(data).hexdigest(),
    "blake3": blake3_hex,
    "blake2b": lambda data: hashlib.blake2b(data, digest_size=32).hexdigest(),
}
#: Hashes that take a whole batch at once.
BATCHED: dict[str, Callable[[list[bytes]], list[str]]] = {"blake3": blake3_many}
#: Bytes of a batch that are hashed at once.
BATCH_BYTES = 8 << 20
HEX_LENGTH = 64


def register_hasher(name: str, function: Callable[[bytes], str]) -> None:
    """Make another 32-byte hash available by name."""
    HASHERS[name] = function
    BATCHED.pop(name, None)


def _batched(data: list[bytes | None], function: Callable[[list[bytes]], list[str]]) -> list[str | None]:
    out: list[str | None] = [None] * len(data)
    places, size = [], 0
    for i, x in enumerate(data):
        if x is not None:
            places.append(i)
            size += len(x)
        if places and (size >= BATCH_BYTES or i == len(data) - 1):
            for k, h in zip(places, function([bytes(data[j]) for j in places])):
                out[k] = h
            places, size = [], 0
    return out


def content_hash(data: Column, hasher: str = "sha256") -> Column:
    if hasher == "sha256":
        return F.sha2(data, 256)
    if hasher not in HASHERS:
        raise ConfigError(f"unknown hasher {hasher}")
    function, together = HASHERS[hasher], BATCHED.get(hasher)

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        if together is not None:
            return pd.Series(_batched(column.tolist(), together), dtype=object)
        return column.map(lambda b: None if b is None else function(bytes(b)))

    return run(data.cast("binary"))


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(text: Column) -> Column:
    """Bytes of 64 hex digits of either case; null for anything else."""
    return F.when(is_hash(text), F.unhex(text))


def is_hash(text: Column) -> Column:
    return F.coalesce(text.rlike(f"^[0-9a-fA-F]{{{HEX_LENGTH}}}$"), F.lit(False))
