import os

import pytest
from pyspark.sql import functions as F

from sediment.errors import ChecksumMismatch, PackFormatError
from sediment.functions.blake3 import blake3_hex
from sediment.functions.codec import DELTA, FULL, RAW, choose_payload, decode
from sediment.schemas import CHUNK_STORE
from sediment.sources.packfile import MAGIC, Entry, _number, read_pack, read_packs, to_packs, write_pack


def entries():
    found = []
    for i in range(50):
        data = f"chunk number {i} with some text ".encode() * (i + 1) if i % 3 else os.urandom(300)
        kind, payload = choose_payload(data)
        found.append(Entry(blake3_hex(data), kind, payload, len(data), None, b"sig" if i % 5 == 0 else None))
    found.append(Entry("ab" * 32, DELTA, b"delta bytes", 900, "cd" * 32))
    return found


def test_round_trip():
    want = entries()
    got = read_pack(write_pack(want))
    assert sorted(got, key=lambda e: e.hash) == sorted(want, key=lambda e: e.hash)
    assert [e.kind for e in got][-1] == DELTA and {e.kind for e in got} == {FULL, RAW, DELTA}
    assert all(blake3_hex(decode(e.kind, e.payload, None, e.orig_length)) == e.hash for e in got if e.kind != DELTA)
    assert read_pack(write_pack([])) == []


@pytest.mark.parametrize("version", [1, 2])
def test_earlier_versions(version):
    payload = choose_payload(b"hello " * 100)[1]
    body = payload + _number(1) + bytes(32) + _number(0) + _number(len(payload)) + _number(600) + (b"\0\0" if version == 2 else b"")
    pack = body + len(payload).to_bytes(8, "little") + (len(body) - len(payload)).to_bytes(4, "little") + bytes.fromhex(blake3_hex(body)) + MAGIC[version].to_bytes(8, "little")
    (e,) = read_pack(pack)
    assert e == Entry("00" * 32, FULL, payload, 600) and decode(FULL, e.payload, None, 600) == b"hello " * 100


def test_damage():
    pack = write_pack(entries())
    for bad, error in ((pack[:5] + bytes([pack[5] ^ 1]) + pack[6:], ChecksumMismatch), (pack[:-10], PackFormatError), (pack[:-1] + b"x", PackFormatError), (b"", PackFormatError)):
        with pytest.raises(error):
            read_pack(bad)


def test_packs_and_tables(spark, tmp_path):
    rows = [(e.hash, i % 2, e.kind, e.base_hash, e.payload, e.orig_length, len(e.payload), None, "i", i) for i, e in enumerate(entries())]
    packs = to_packs(spark.createDataFrame(rows, CHUNK_STORE)).collect()
    assert len(packs) == 2
    for p in packs:
        (tmp_path / f"{p['pack_id']}.pack").write_bytes(bytes(p["content"]))
    (tmp_path / "9.pack").write_bytes(b"broken")
    back, errors = read_packs(spark, str(tmp_path))
    assert {r["hash"] for r in back.collect()} == {r[0] for r in rows} and errors.count() == 1
    assert back.where(F.col("entry_type") == DELTA).first()["base_hash"] == "cd" * 32
