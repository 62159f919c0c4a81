"""Payload codecs: entropy test, compression choice, delta against a base, decoding."""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

FULL, RAW, DELTA = "full", "full_raw", "delta"
ENTROPY_SAMPLE, ENTROPY_LEAST, ENTROPY_VALUES = 1024, 256, 220
DELTA_LEAST, DELTA_RATIO = 256, 4
PAYLOAD = "struct<entry_type:string,payload:binary,stored_length:int>"


def is_high_entropy(data: bytes) -> bool:
    """More than 220 byte values among the first 1024 bytes; false where they are fewer than 256."""
    head = data[:ENTROPY_SAMPLE]
    return len(head) >= ENTROPY_LEAST and len(set(head)) > ENTROPY_VALUES


def choose_payload(data: bytes, level: int = 3) -> tuple[str, bytes]:
    """(type, bytes): compressed unless the data look random or shrink by less than a twentieth."""
    if is_high_entropy(data):
        return RAW, data
    packed = zstandard.ZstdCompressor(level=level).compress(data)
    return (RAW, data) if len(packed) >= len(data) * 95 // 100 else (FULL, packed)


def delta_allowed(a: int, b: int) -> bool:
    return min(a, b) >= DELTA_LEAST and max(a, b) <= DELTA_RATIO * min(a, b)


def delta_gate(a: Column, b: Column) -> Column:
    """Both lengths at least 256 and within a factor of four."""
    return (F.least(a, b) >= DELTA_LEAST) & (F.greatest(a, b) <= DELTA_RATIO * F.least(a, b))


def encode_delta(data: bytes, base: bytes, level: int = 3) -> bytes | None:
    """The data with the base as dictionary, if a tenth smaller than without; else None."""
    if not delta_allowed(len(data), len(base)):
        return None
    held = zstandard.ZstdCompressionDict(base, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    delta = zstandard.ZstdCompressor(level=level, dict_data=held).compress(data)
    alone = len(zstandard.ZstdCompressor(level=level).compress(data))
    return delta if len(delta) < alone * 90 // 100 else None


def decode(entry_type: str, payload: bytes, base: bytes | None, length: int) -> bytes:
    if entry_type == RAW:
        return payload
    if entry_type == FULL:
        return zstandard.ZstdDecompressor().decompress(payload, max_output_size=length)
    if base is None:
        raise ValueError("a delta needs its base")
    held = zstandard.ZstdCompressionDict(base, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdDecompressor(dict_data=held).decompress(payload, max_output_size=length)


def payload_column(data: Column, base: Column | None = None, level: int = 3) -> Column:
    """struct(entry_type, payload, stored_length): a delta where the base gives one, else alone."""

    def one(d, b) -> dict:
        d = bytes(d)
        delta = encode_delta(d, bytes(b), level) if b is not None else None
        kind, payload = (DELTA, delta) if delta is not None else choose_payload(d, level)
        return {"entry_type": kind, "payload": payload, "stored_length": len(payload)}

    @F.pandas_udf(PAYLOAD)
    def run(d: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x, y) for x, y in zip(d, b)], columns=["entry_type", "payload", "stored_length"])

    return run(data, F.lit(None).cast("binary") if base is None else base)


def decoded_column(entry_type: Column, payload: Column, base: Column, length: Column) -> Column:
    """The chunk's bytes; null where they can't be decoded (a report's business, not an error)."""

    @F.pandas_udf("binary")
    def run(kind: pd.Series, data: pd.Series, over: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for k, p, b, size in zip(kind, data, over, n):
            try:
                out.append(decode(k, bytes(p), None if b is None else bytes(b), int(size)))
            except (zstandard.ZstdError, ValueError, TypeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(entry_type, payload, base, length)


def distinct_bytes(data: Column) -> Column:
    """Distinct byte values among the first 1024 bytes, in built-in functions."""
    head = F.hex(F.substring(data, 1, ENTROPY_SAMPLE))
    pairs = F.regexp_extract_all(head, F.lit(".."), F.lit(0))
    return F.when(F.octet_length(data) > 0, F.size(F.array_distinct(pairs))).otherwise(0)


def high_entropy(data: Column) -> Column:
    n = F.least(F.octet_length(data), F.lit(ENTROPY_SAMPLE))
    return (n >= ENTROPY_LEAST) & (distinct_bytes(data) > ENTROPY_VALUES)
