"""Similarity signatures: twelve sampled features folded into super-features of three tiers.

Texts shorter than 64 bytes have no signature; below 256 bytes the whole chunk's
feature stands in every slot. Otherwise the chunk is split into twelve parts of
equal length (the last takes what is over) and the first 32 bytes of each part
are hashed. Tier 3 folds four features a slot, tier 2 three, tier 1 two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.session import fresh_name, let

LEAST, FULL = 64, 256
PARTS, SAMPLE = 12, 32
#: Tier -> features a slot.
TIERS = {3: 4, 2: 3, 1: 2}
SLOTS = [(tier, slot) for tier, width in TIERS.items() for slot in range(PARTS // width)]
MULTIPLIER = 0x9E3779B97F4A7C15
KEYS = "array<struct<tier:int,slot:int,sf:{}>>"
LOW64 = (1 << 64) - 1


def size_class(length: Column) -> Column:
    return F.when(length < LEAST, F.lit("none")).when(length < FULL, F.lit("whole")).otherwise(F.lit("sampled"))


def feature_list(data: bytes) -> list[int] | None:
    """Twelve 64-bit features, or None for chunks that are too small."""
    n = len(data)
    if n < LEAST:
        return None
    if n < FULL:
        return [xxhash.xxh3_64_intdigest(data)] * PARTS
    part = n // PARTS
    width = min(SAMPLE, part)
    return [xxhash.xxh3_64_intdigest(data[i * part : i * part + width]) for i in range(PARTS)]


def super_features(data: bytes) -> dict[tuple[int, int], int] | None:
    """(tier, slot) -> 64-bit super-feature."""
    features = feature_list(data)
    if features is None:
        return None
    if len(data) < FULL:
        return dict.fromkeys(SLOTS, features[0])
    found = {}
    for tier, slot in SLOTS:
        h = 0
        for v in features[slot * TIERS[tier] : (slot + 1) * TIERS[tier]]:
            h = ((h * MULTIPLIER) & LOW64) ^ v
        found[tier, slot] = h
    return found


def key_lists(column: pa.Array) -> pa.Array:
    """For a batch of chunks the lists (tier, slot, super-feature as signed number); the folds go over whole columns."""
    found = [None if b is None else feature_list(b) for b in column.to_pylist()]
    none = np.array([f is None for f in found], bool)
    features = np.array([f for f in found if f is not None], np.uint64).reshape(-1, PARTS)
    whole = np.array([len(b) < FULL for b, f in zip(column.to_pylist(), found) if f is not None], bool)
    folded = np.empty((len(features), len(SLOTS)), np.uint64)
    for at, (tier, slot) in enumerate(SLOTS):
        h = np.zeros(len(features), np.uint64)
        for k in range(slot * TIERS[tier], (slot + 1) * TIERS[tier]):
            h = h * np.uint64(MULTIPLIER) ^ features[:, k]
        folded[:, at] = np.where(whole, features[:, 0], h)
    tiers, slots = (pa.array(np.tile(np.array(x, np.int32), len(features))) for x in zip(*SLOTS))
    items = pa.StructArray.from_arrays([tiers, slots, pa.array(folded.ravel().view(np.int64))], names=["tier", "slot", "sf"])
    offsets = np.concatenate([[0], np.cumsum(~none) * len(SLOTS)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), items, mask=pa.array(none))


def with_keys(chunks: DataFrame, data: str = "data", keys: str = "keys") -> DataFrame:
    """``chunks`` with the column ``keys``: (tier, slot, sf) of each slot, null for small chunks."""

    @F.arrow_udf(KEYS.format("bigint"))
    def run(column: pa.Array) -> pa.Array:
        return key_lists(column)

    return chunks.withColumn(keys, run(F.col(data)))


def sql_features(data: Column) -> Column:
    """The features in built-in functions: heads of MD5 digests, null for small chunks."""
    n = F.octet_length(data)
    part = F.floor(n / PARTS).cast("int")

    def sampled(p: Column) -> Column:
        width = F.least(F.lit(SAMPLE), p)
        return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.substring(F.md5(F.substring(data, i * p + 1, width)), 1, 16))

    whole = F.array_repeat(F.substring(F.md5(data), 1, 16), PARTS)
    return F.when(n < LEAST, F.lit(None)).when(n < FULL, whole).otherwise(let(part, sampled))


def sql_keys(features: Column, length: Column) -> Column:
    """(tier, slot, sf) with the features of a slot joined by '-'; equal exactly if they all are."""

    def key(tier: int, slot: int) -> Column:
        width = TIERS[tier]
        parts = [F.get(features, F.lit(slot * width + k)) for k in range(width)]
        sf = F.when(length < FULL, parts[0]).otherwise(F.concat_ws("-", *parts))
        return F.struct(F.lit(tier).alias("tier"), F.lit(slot).alias("slot"), sf.alias("sf"))

    return F.when(features.isNotNull(), F.array(*[key(t, s) for t, s in SLOTS]))


def head_tail_similar(a: Column, b: Column) -> Column:
    """Equal first 64 bytes, or equal last 64 where both are longer; a plain optional filter."""
    na, nb = F.octet_length(a), F.octet_length(b)
    tails = (na > LEAST) & (nb > LEAST) & (F.substring(a, -LEAST, LEAST) == F.substring(b, -LEAST, LEAST))
    return (F.substring(a, 1, LEAST) == F.substring(b, 1, LEAST)) | tails


def signature_table(chunks: DataFrame, data: str = "data") -> DataFrame:
    """hash, length, size_class and the super-features by tier as arrays."""
    keyed = with_keys(chunks, data, fresh_name(chunks, "keys"))
    tier = lambda t: F.transform(F.filter(F.col("keys"), lambda x: x["tier"] == t), lambda x: x["sf"])
    return keyed.select("hash", F.octet_length(data).alias("length"), size_class(F.octet_length(data)).alias("size_class"), tier(3).alias("tier3"), tier(2).alias("tier2"), tier(1).alias("tier1"))


