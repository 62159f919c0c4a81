import hashlib
import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sediment.config import FINE, MIB, TEXT, BackupOptions, ChunkConfig, SimilarityConfig
from sediment.errors import ConfigError
from sediment.functions import codec, features, gear, hashing
from sediment.functions.blake3 import blake3_hex, blake3_many
from sediment.sources.uri import hadoop_options, parse_store, safe_target

PATTERN = bytes(i % 251 for i in range(300_000))


def byte_by_byte(data, config):
    strict, loose = map(int, gear.masks(config))
    out, start = [], 0
    while start < len(data):
        left = len(data) - start
        if left <= config.min_size:
            return [*out, left]
        limit = min(left, config.max_size)
        center, h, cut = min(config.avg_size, limit), 0, limit
        for i in range(config.min_size, limit):
            h = ((h << 1) + int(gear.GEAR[data[start + i]])) & ((1 << 64) - 1)
            if not h & (strict if i < center else loose):
                cut = i
                break
        out.append(cut)
        start += cut
    return out


@pytest.mark.parametrize("config", [FINE, TEXT, ChunkConfig()])
@pytest.mark.parametrize("data", [b"", b"x" * 200, bytes(100_000), b"\xab" * 50_000, PATTERN, random.Random(3).randbytes(200_000)], ids=range(6))
def test_cuts_are_those_of_the_plain_loop(config, data):
    cuts = list(gear.cut_lengths(data, config))
    assert cuts == byte_by_byte(data, config)
    assert sum(cuts) == len(data) and all(0 < n <= config.max_size for n in cuts)


@given(st.binary(max_size=20_000))
@settings(max_examples=40, deadline=None)
def test_cuts_cover_any_bytes(data):
    cuts = list(gear.cut_lengths(data, FINE))
    assert sum(cuts) == len(data) and cuts == list(gear.cut_lengths(data, FINE))


def test_windows_do_not_move_cuts(monkeypatch):
    data = random.Random(8).randbytes(120_000)
    whole = list(gear.cut_lengths(data, FINE))
    monkeypatch.setattr(gear, "WINDOW", 5000)
    assert list(gear.cut_lengths(data, FINE)) == whole


def test_cuts_find_each_other_after_an_insertion():
    data = random.Random(5).randbytes(100_000)
    moved = data[:100] + b"\xff" + data[100:]
    pieces = []
    for d in (data, moved):
        at, own = 0, set()
        for n in gear.cut_lengths(d, FINE):
            own.add(d[at : at + n])
            at += n
        pieces.append(own)
    assert len(pieces[0] & pieces[1]) > 0.9 * len(pieces[0])


@pytest.mark.parametrize("bad", [(32, 256, 1024), (128, 200, 1024), (128, 256, 300), (MIB // 2, MIB, 2 * MIB)])
def test_chunk_config_is_validated(bad):
    with pytest.raises(ConfigError):
        ChunkConfig(*bad)


def test_derived_configs():
    assert ChunkConfig.from_chunk_size(32768) == ChunkConfig(16384, 32768, 131072)
    assert ChunkConfig.from_chunk_size(524288).max_size == MIB
    assert list(gear.cut_lengths(b"x", ChunkConfig(64, 128, 512))) == [1]  # averages from 128 are valid
    assert [SimilarityConfig(t).least_tier for t in (0.0, 0.7, 0.8, 0.85, 0.9, 7)] == [1, 1, 2, 2, 3, 3]
    assert not SimilarityConfig(-1).enabled and BackupOptions().level == 3


#: Published vectors: bytes 0, 1, ... 250, 0, ... of the length.
@pytest.mark.parametrize("n, digest", [(0, "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"), (1, "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"), (1024, "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"), (1025, "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444")])
def test_blake3_vectors(n, digest):
    assert blake3_hex(PATTERN[:n]) == digest


def test_blake3_abc_and_batches():
    assert blake3_hex(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    inputs = [PATTERN[:n] for n in (0, 1, 64, 1023, 1024, 1025, 2048, 3073, 5000, 102_400)]
    assert blake3_many(inputs) == [blake3_hex(x) for x in inputs]


def test_hashers(spark):
    df = spark.createDataFrame([(b"abc",), (b"",), (None,)], "data binary")
    for name, function in (("sha256", lambda b: hashlib.sha256(b).hexdigest()), ("blake3", blake3_hex), ("blake2b", lambda b: hashlib.blake2b(b, digest_size=32).hexdigest())):
        got = [r[0] for r in df.select(hashing.content_hash(F.col("data"), name)).collect()]
        assert got == [function(b"abc"), function(b""), None]
    hashing.register_hasher("zeros", lambda b: "0" * 64)
    assert df.select(hashing.content_hash(F.col("data"), "zeros")).first()[0] == "0" * 64
    with pytest.raises(ConfigError):
        hashing.content_hash(F.col("data"), "nothing")
    hexes = spark.createDataFrame([("AB" * 32,), ("xy" * 32,), ("ab",), (None,)], "h string")
    assert [r[0] and bytes(r[0]) for r in hexes.select(hashing.from_hex(F.col("h"))).collect()] == [b"\xab" * 32, None, None, None]
    assert hexes.select(hashing.to_hex(hashing.from_hex(F.col("h")))).first()[0] == "ab" * 32


def test_signature_classes():
    assert features.super_features(b"x" * 63) is None
    whole = features.super_features(b"\xab" * 128)
    assert set(whole.values()) == {xxhash.xxh3_64_intdigest(b"\xab" * 128)} and len(whole) == 13
    data = PATTERN[:4096]
    got, listed = features.super_features(data), features.feature_list(data)
    assert listed == [xxhash.xxh3_64_intdigest(data[i * 341 : i * 341 + 32]) for i in range(12)]
    h = 0
    for v in listed[4:8]:
        h = (h * features.MULTIPLIER) % (1 << 64) ^ v
    assert got[3, 1] == h and sorted({t for t, _ in got}) == [1, 2, 3]


def test_edited_chunks_share_super_features():
    data = bytearray(random.Random(1).randbytes(4096))
    before = features.super_features(bytes(data))
    data[100] ^= 0xFF
    data[2000] ^= 0xFF
    after = features.super_features(bytes(data))
    assert sum(before[k] == after[k] for k in before) >= 1


def test_sql_signatures(spark):
    rows = [(i, PATTERN[i : i + n]) for i, n in enumerate((10, 64, 255, 256, 300, 4096))]
    df = spark.createDataFrame(rows, "i int, data binary")
    for r in df.select("i", "data", features.sql_features(F.col("data")).alias("f")).collect():
        d = bytes(r["data"])
        p = len(d) // 12
        md5 = lambda b: hashlib.md5(b).hexdigest()[:16]
        want = None if len(d) < 64 else [md5(d)] * 12 if len(d) < 256 else [md5(d[i * p : i * p + min(32, p)]) for i in range(12)]
        assert r["f"] == want
    keyed = features.with_keys(df).collect()
    assert [r["keys"] is None for r in keyed] == [True] + [False] * 5 and all(len(r["keys"]) == 13 for r in keyed[1:])


def test_head_tail(spark):
    a = PATTERN[:200]
    rows = [(a, a[:100] + b"zz" + a[102:]), (a, b"q" + a[1:]), (a, b"q" + a[1:199] + b"q"), (b"s" * 30, b"s" * 30), (b"s" * 30, b"t" * 30)]
    df = spark.createDataFrame(rows, "a binary, b binary")
    assert [r[0] for r in df.select(features.head_tail_similar(F.col("a"), F.col("b"))).collect()] == [True, True, False, True, False]


@pytest.mark.parametrize("data, want", [(b"x" * 5000, False), (bytes(range(256))[:255], False), (bytes(range(256)) * 4, True), (bytes(range(220)) * 2, False), (bytes(range(221)) * 2, True)])
def test_high_entropy(spark, data, want):
    assert codec.is_high_entropy(data) == want
    df = spark.createDataFrame([(data,)], "d binary")
    assert tuple(df.select(codec.high_entropy(F.col("d")), codec.distinct_bytes(F.col("d"))).first()) == (want, len(set(data[:1024])))


def test_payload_choice_and_delta():
    rng = random.Random(2)
    noise = rng.randbytes(4000)
    assert codec.choose_payload(noise)[0] == codec.RAW and codec.choose_payload(b"text " * 500)[0] == codec.FULL
    base = bytes(rng.choice(b"abcdefgh ") for _ in range(4096))
    data = bytearray(base)
    for i in range(0, 4096, 1000):
        data[i] = 65
    delta = codec.encode_delta(bytes(data), base)
    assert delta is not None and codec.decode(codec.DELTA, delta, base, 4096) == bytes(data)
    assert codec.encode_delta(base[:100], base) is None and codec.encode_delta(base, base[:500]) is None
    assert codec.encode_delta(noise, base) is None
    with pytest.raises(ValueError):
        codec.decode(codec.DELTA, delta, None, 4096)


@given(st.binary(max_size=3000), st.integers(0, 2999))
@settings(max_examples=40, deadline=None)
def test_any_payload_decodes(data, flip):
    kind, payload = codec.choose_payload(data)
    assert codec.decode(kind, payload, None, len(data)) == data
    changed = bytearray(data)
    if changed:
        changed[flip % len(changed)] ^= 1
    delta = codec.encode_delta(bytes(changed), data)
    assert delta is None or codec.decode(codec.DELTA, delta, data, len(data)) == bytes(changed)


def test_store_locations():
    assert parse_store("s3://b/some/key?region=eu&endpoint=http://x").path == "s3a://b/some/key"
    assert parse_store("gcs://b").path == "gs://b" and parse_store("/tmp/x/").path == "/tmp/x"
    assert hadoop_options(parse_store("s3://b?region=eu")) == {"fs.s3a.bucket.b.endpoint.region": "eu"}
    for bad in ("", "s3://", "s3://b?secret_access_key=k", "s3://b?what=1"):
        with pytest.raises(ConfigError):
            parse_store(bad)
    assert safe_target("/d", "a/b") == "/d/a/b"
    for bad in ("../x", "a/../../x", "/etc/passwd", "a/../b"):
        with pytest.raises(ConfigError):
            safe_target("/d", bad)


def test_key_lists_against_single_chunks(spark):
    rng = random.Random(5)
    rows = [(None,), (b"",)] + [(rng.randbytes(n),) for n in (1, 63, 64, 65, 255, 256, 257, 383, 384, 1024, 5000)]
    for r in features.with_keys(spark.createDataFrame(rows, "data binary").repartition(3)).collect():
        want = None if r["data"] is None else features.super_features(bytes(r["data"]))
        got = None if r["keys"] is None else {(k["tier"], k["slot"]): k["sf"] & features.LOW64 for k in r["keys"]}
        assert got == want
    assert features.key_lists(features.pa.array([None, b"x"], "binary")).to_pylist() == [None, None]
    assert len(features.key_lists(features.pa.array([], "binary"))) == 0
