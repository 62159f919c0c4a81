"""Pack files: chunk bundles with a trailing index, read into and written from chunk-store rows.

Layout: data, index, 52-byte footer (index offset u64, index length u32, BLAKE3 of
what is covered, magic u64; little-endian). Versions 1 and 2 hold each payload in
place. Version 3 holds the full and raw payloads together in one zstandard frame,
into which their offsets point, and deltas after it; its checksum also covers the
footer's other fields. Index numbers are LEB128 varints.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.errors import ChecksumMismatch, PackFormatError
from sediment.functions.blake3 import blake3_hex
from sediment.functions.codec import DELTA, FULL, RAW

#: Fixed values of the format.
MAGIC = {1: 0x3156314B43415050, 2: 0x3256314B43415050, 3: 0x3356314B43415050}
FOOTER = 52
KINDS = [FULL, DELTA, RAW]
LEVEL = 3
ROWS = "hash string, entry_type string, base_hash string, payload binary, orig_length int, stored_length int, signature binary, pack string"


@dataclass(frozen=True)
class Entry:
    hash: str
    kind: str
    payload: bytes
    orig_length: int
    base_hash: str | None = None
    signature: bytes | None = None


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise PackFormatError("index ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        value = shift = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value
            if shift > 63:
                raise PackFormatError("number too long")


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def write_pack(entries: list[Entry]) -> bytes:
    """A version-3 pack; full and raw entries come first."""
    solid = [e for e in entries if e.kind != DELTA]
    deltas = [e for e in entries if e.kind == DELTA]
    block = b"".join(e.payload for e in solid)
    data = bytearray(zstandard.ZstdCompressor(level=LEVEL).compress(block) if block else b"")
    index = bytearray(_number(len(entries)))
    inside = 0
    for e in [*solid, *deltas]:
        at, inside = (len(data), inside) if e.kind == DELTA else (inside, inside + len(e.payload))
        if e.kind == DELTA:
            data += e.payload
        index += bytes.fromhex(e.hash) + _number(at) + _number(len(e.payload)) + _number(e.orig_length) + _number(KINDS.index(e.kind))
        index += bytes.fromhex(e.base_hash) if e.kind == DELTA else b""
        index += b"\0" if e.signature is None else b"\1" + _number(len(e.signature)) + e.signature
    tail = len(data).to_bytes(8, "little") + len(index).to_bytes(4, "little")
    magic = MAGIC[3].to_bytes(8, "little")
    covered = bytes(data) + bytes(index)
    return covered + tail + bytes.fromhex(blake3_hex(covered + tail + magic)) + magic


def read_pack(data: bytes) -> list[Entry]:
    if len(data) < FOOTER:
        raise PackFormatError("pack too short")
    tail, checksum, magic = data[-52:-40], data[-40:-8], int.from_bytes(data[-8:], "little")
    version = next((v for v, m in MAGIC.items() if m == magic), None)
    if version is None:
        raise PackFormatError("bad magic")
    body = data[:-FOOTER]
    if bytes.fromhex(blake3_hex(body + (tail + data[-8:] if version == 3 else b""))) != checksum:
        raise ChecksumMismatch("pack checksum")
    start, size = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:], "little")
    if start + size > len(body):
        raise PackFormatError("index extends past data")
    r = _Reader(body[start : start + size])
    listed = []
    for _ in range(r.number()):
        h, at, n, orig = r.take(32).hex(), r.number(), r.number(), r.number()
        kind, base, signature = FULL, None, None
        if version > 1:
            code = r.number()
            if code >= len(KINDS):
                raise PackFormatError("unknown entry type")
            kind = KINDS[code]
            base = r.take(32).hex() if kind == DELTA else None
            if r.number():
                signature = r.take(r.number())
        listed.append((h, at, n, orig, kind, base, signature))
    solid = body
    if version == 3:
        end = min([x[1] for x in listed if x[4] == DELTA], default=start)
        held = max([x[1] + x[2] for x in listed if x[4] != DELTA], default=0)
        try:
            solid = zstandard.ZstdDecompressor().decompressobj().decompress(body[:end]) if end else b""
        except zstandard.ZstdError as e:
            raise PackFormatError(str(e)) from e
        if held > len(solid):
            raise PackFormatError("entry extends past its block")
    found = []
    for h, at, n, orig, kind, base, signature in listed:
        source = body if kind == DELTA else solid
        if at + n > len(source):
            raise PackFormatError("entry extends past the data")
        found.append(Entry(h, kind, source[at : at + n], orig, base, signature))
    return found


def read_packs(spark: SparkSession, path: str, glob: str = "*.pack") -> tuple[DataFrame, DataFrame]:
    """(rows, errors): chunk rows of all sound packs; pack and error of the others."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    names = [c.split()[0] for c in ROWS.split(", ")] + ["error"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows = [(e.hash, e.kind, e.base_hash, e.payload, e.orig_length, len(e.payload), e.signature, name, None) for e in read_pack(content.as_py())]
                except (PackFormatError, ChecksumMismatch) as e:
                    rows = [(None,) * 7 + (name, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    read = files.mapInArrow(run, f"{ROWS}, error string")
    return read.where("error is null").drop("error"), read.where("error is not null").select("pack", "error")


def to_packs(chunks: DataFrame) -> DataFrame:
    """pack_id, content: the rows of a chunk store as packs; a pack's rows meet in one task (its bytes are bounded)."""
    entry = F.struct("seq", "hash", "entry_type", "payload", "orig_length", "base_hash")
    grouped = chunks.groupBy("pack_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack_id, entries in zip(batch.column(0), batch.column(1)):
                listed = [Entry(e["hash"], e["entry_type"], e["payload"], e["orig_length"], e["base_hash"]) for e in entries.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([pack_id.as_py()], pa.int64()), pa.array([write_pack(listed)], pa.binary())], names=["pack_id", "content"])

    return grouped.mapInArrow(run, "pack_id long, content binary")
