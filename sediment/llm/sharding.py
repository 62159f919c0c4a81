"""Sharding by a Feistel permutation of global row numbers.

Rows get gapless numbers in the order of their ids. A keyed Feistel network over
the next power of four, walked along its cycle until it lands below the row
count, permutes the numbers; a permuted number modulo the shard count is the
shard and its quotient the slot. Row counts of shards thus differ by one at most
(law ``rows``), and shard and slot of any row number, or the row number at any
slot, can be computed without the data (:func:`permute`, :func:`unpermute`).

Defined results: a null text has size 1 and checksum 0; rows that share an id are
numbered by checksum and size; a null id comes first; an empty table gives an
empty result. Equal texts are spread like any others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.session import row_numbers

ROUNDS = 6
MIX = np.uint64(0x9E3779B1)


def _halves(n: int) -> int:
    """Bits of each half of the smallest power of four that holds n."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _keys(key: int) -> list[int]:
    return [(key * 2654435761 + r * 40503 + 12345) % (1 << 32) for r in range(1, ROUNDS + 1)]


def _scramble(half: np.ndarray, key: int, bits: int) -> np.ndarray:
    low = np.uint64(0xFFFFFFFF)
    x = (half ^ np.uint64(key)) & low
    x = (x * MIX) & low
    x ^= x >> np.uint64(15)
    x = (x * MIX) & low
    x ^= x >> np.uint64(13)
    return x & np.uint64((1 << bits) - 1)


def _network(x: np.ndarray, keys: list[int], bits: int) -> np.ndarray:
    left, right = x >> np.uint64(bits), x & np.uint64((1 << bits) - 1)
    for k in keys:
        left, right = right, left ^ _scramble(right, k, bits)
    return (right << np.uint64(bits)) | left  # halves crossed: the same network with its keys reversed undoes it


def _walk(rows, n: int, keys: list[int]) -> np.ndarray:
    bits = _halves(n)
    out = _network(np.asarray(rows, dtype=np.uint64), keys, bits)
    while (over := out >= np.uint64(n)).any():
        out[over] = _network(out[over], keys, bits)
    return out.astype(np.int64)


def permute(rows, n: int, key: int) -> np.ndarray:
    """Where the rows (numbers below ``n``) go."""
    return _walk(rows, n, _keys(key))


def unpermute(places, n: int, key: int) -> np.ndarray:
    """Which rows come to the places."""
    return _walk(places, n, _keys(key)[::-1])


def shard_rows(docs: DataFrame, shards: int = 8, key: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, row, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = row_numbers(narrow, ["doc_id", "text_crc32", "size"], "row", "shard-rows")

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, key))

    placed = rows.withColumn("place", place("row"))
    return placed.select("doc_id", "size", "text_crc32", "row", (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {int(shards)}").alias("slot"))
