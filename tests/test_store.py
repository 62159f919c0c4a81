import os
import random

import pytest
from pyspark.sql import functions as F

from sediment.config import FINE, BackupOptions, ChunkConfig, SimilarityConfig
from sediment.errors import ChunkNotFound, StoreCorrupted
from sediment.functions.gear import cut_lengths
from sediment.operators import dedup, manifest, similarity
from sediment.operators.chunking import cdc_chunks, fixed_chunks
from sediment.operators.restore import decode_chunks
from sediment.plans import backup as b
from sediment.schemas import CHUNK_STORE, FILES
from sediment.sources.files import from_table, read_files
from sediment.sources.store import ChunkStore, export_manifests, import_manifests
from sediment.streaming.ingest import ingest_stream, watch_files

OPTIONS = BackupOptions(chunks=FINE)


def table(spark, files, modified=1):
    rows = [(n, n, len(c), modified, 0o640, c) for n, c in files.items()]
    return spark.createDataFrame(rows, FILES)


def sample_files(seed=1):
    rng = random.Random(seed)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) + str(rng.randrange(400)) for _ in range(1500)).encode()
    near = bytearray(text)
    for i in range(300, len(near), 2500):
        near[i] = 35
    return {"a.txt": text, "dir/copy.txt": text, "near.txt": bytes(near), "empty": b"", "noise": rng.randbytes(5000), "short": b"23 bytes of plain text.", "zeros": bytes(20_000)}


@pytest.fixture
def store(spark, tmp_path):
    return ChunkStore(spark, str(tmp_path / "store"))


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    held = ChunkStore(spark, str(tmp_path_factory.mktemp("filled") / "store"))
    stats = {r["name"]: r for r in b.backup(table(spark, sample_files()), held, OPTIONS).collect()}
    return held, stats


def test_restore_gives_every_byte(filled):
    held, _ = filled
    back = {r["name"]: bytes(r["content"]) for r in b.restored(held).collect()}
    assert back == sample_files()


def test_stats(filled):
    _, s = filled
    files = sample_files()
    assert all(s[n]["source_size"] == len(c) and not s[n]["unchanged"] for n, c in files.items())
    assert s["dir/copy.txt"]["new_chunks"] == 0 and s["dir/copy.txt"]["dedup_chunks"] == s["a.txt"]["total_chunks"]
    assert s["empty"]["total_chunks"] == 0 and s["empty"]["dedup_ratio"] == 1.0 and s["empty"]["savings_pct"] == 0.0
    assert s["zeros"]["new_chunks"] <= 2 < s["zeros"]["total_chunks"]


def test_near_duplicates_become_deltas(filled):
    _, s = filled
    near = s["near.txt"]
    assert near["near_duplicate_chunks"] > 0 and near["delta_chunks"] > 0 and near["delta_savings"] > 0
    assert near["physical_size"] < near["stored_size"]


def test_verify_info_list(filled):
    held, _ = filled
    report, errors = b.verify(held)
    r = report.first()
    assert r["ok"] and r["files_checked"] == 7 and errors.count() == 0
    info = manifest.store_info(held.manifests()).first()
    assert info["file_count"] == 7 and info["total_size"] == sum(map(len, sample_files().values())) and info["total_chunks"] == r["chunks_checked"]
    assert [r["name"] for r in manifest.list_files(held.manifests()).collect()] == sorted(sample_files())
    with pytest.raises(ChunkNotFound):
        b.verify(held, "nothing")
    with pytest.raises(ChunkNotFound):
        b.restored(held, "nothing")


def test_reads_by_hash(spark, filled, tmp_path):
    held, _ = filled
    some = held.hashes().orderBy("hash").limit(3).collect()
    wanted = spark.createDataFrame([(r["hash"],) for r in some] + [("00" * 32,)], "hash string")
    got = {r["hash"]: r for r in b.get_chunks(wanted, held).collect()}
    assert got["00" * 32]["error"] == "not found" and sum(r["error"] is None for r in got.values()) == 3
    assert held.contains(some[0]["hash"].upper()) and not held.contains("00" * 32)
    assert held.has_file("a.txt") and not held.has_file("b.txt")
    assert held.signatures().count() <= held.cached_index().count() == held.chunks().count()
    export_manifests(held.manifests(), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 7


def test_write_out(filled, tmp_path):
    held, _ = filled
    assert b.restore(held, str(tmp_path)) == 7
    for n, c in sample_files().items():
        path = tmp_path / n
        assert path.read_bytes() == c and int(path.stat().st_mtime) == 1 and path.stat().st_mode & 0o777 == 0o640
    assert b.restore(held, str(tmp_path / "one"), "a.txt") == 1 and os.listdir(tmp_path / "one") == ["a.txt"]


def test_incremental_delete_orphans(spark, store):
    files = {"a": b"first " * 300, "b": b"second" * 300}
    b.backup(table(spark, files), store, OPTIONS)
    again = {r["name"]: r for r in b.backup(table(spark, files), store, OPTIONS).collect()}
    assert all(r["unchanged"] and r["total_chunks"] == 0 for r in again.values())
    touched = {r["name"]: r for r in b.backup(table(spark, files, modified=2), store, OPTIONS).collect()}
    assert not touched["a"]["unchanged"] and touched["a"]["new_chunks"] == 0
    forced = b.backup(table(spark, files, modified=2), store, BackupOptions(chunks=FINE, force=True)).first()
    assert forced["total_chunks"] > 0
    assert b.sweep(store).count() == 0
    b.delete_file(store, "b")
    assert [r["name"] for r in store.manifests().collect()] == ["a"] and b.sweep(store).count() > 0
    with pytest.raises(ChunkNotFound):
        b.delete_file(store, "b")
    b.backup(table(spark, {"b": files["b"]}, modified=3), store, OPTIONS)
    assert b.sweep(store).count() == 0 and b.verify(store)[0].first()["ok"]


def test_bases_across_ingests_and_migration(spark, store, tmp_path):
    files = sample_files(3)
    b.backup(table(spark, {"a": files["a.txt"]}), store, OPTIONS)
    later = b.backup(table(spark, {"n": files["near.txt"]}), store, OPTIONS).first()
    assert later["delta_chunks"] > 0
    target = ChunkStore(spark, str(tmp_path / "other"))
    moved = b.migrate(store, target)
    assert moved["files"] == 2 and moved["chunks"] > 0 and b.migrate(store, target)["chunks"] == 0
    back = {r["name"]: bytes(r["content"]) for r in b.restored(target).collect()}
    assert back == {"a": files["a.txt"], "n": files["near.txt"]}


def test_similarity_off(spark, store):
    files = sample_files(4)
    stats = b.backup(table(spark, {"a": files["a.txt"], "n": files["near.txt"]}), store, BackupOptions(chunks=FINE, similarity=SimilarityConfig(0))).collect()
    assert all(r["near_duplicate_chunks"] == r["delta_chunks"] == 0 for r in stats)


def test_damage_is_reported(spark, filled, tmp_path):
    held, _ = filled
    rows = held.chunks()
    names = sorted(r["hash"] for r in rows.where("entry_type = 'full'").select("hash").collect())
    lost, broken = names[0], names[1]
    hurt = rows.where(F.col("hash") != lost).withColumn("payload", F.when(F.col("hash") == broken, F.lit(b"garbage")).otherwise(F.col("payload")))
    other = ChunkStore(spark, str(tmp_path / "hurt"))
    other.append_chunks(hurt)
    other.append_manifests(held.manifests())
    other.append_manifests(spark.createDataFrame([("bad", "bad", 1, 1, 0, ["zz"], "x")], other.manifests().schema))
    report, errors = b.verify(other)
    kinds = {r["error"] for r in errors.collect()}
    assert not report.first()["ok"] and {"not found", "not readable", "bad hash"} <= kinds
    with pytest.raises(ChunkNotFound):
        b.restore(other, str(tmp_path / "out"))


def entry(h, kind="full_raw", base=None, payload=b"x"):
    return (h, 0, kind, base, payload, len(payload), len(payload), None, "i", 0)


def test_chains(spark):
    from sediment.functions.codec import DELTA, encode_delta

    rng = random.Random(6)
    data = [bytes(rng.choice(b"abcdef ") for _ in range(2000))]
    for k in range(5):
        nxt = bytearray(data[-1])
        nxt[100 * k] = 90
        data.append(bytes(nxt))
    rows = [entry("h0", payload=data[0])] + [("h%d" % k, 0, DELTA, "h%d" % (k - 1), encode_delta(data[k], data[k - 1]), 2000, 1, None, "i", k) for k in range(1, 6)]
    store = spark.createDataFrame(rows, CHUNK_STORE)
    wanted = spark.createDataFrame([("h5",), ("h0",)], "hash string")
    assert {r["hash"]: bytes(r["data"]) for r in decode_chunks(wanted, store).collect()} == {"h5": data[5], "h0": data[0]}
    with pytest.raises(StoreCorrupted):
        decode_chunks(wanted, store, depth=3)
    circle = spark.createDataFrame([entry("a", DELTA, "b"), entry("b", DELTA, "a")], CHUNK_STORE)
    with pytest.raises(StoreCorrupted):
        decode_chunks(spark.createDataFrame([("a",)], "hash string"), circle)
    lone = spark.createDataFrame([entry("a", DELTA, "gone")], CHUNK_STORE)
    assert decode_chunks(spark.createDataFrame([("a",)], "hash string"), lone).first()["data"] is None


def test_chunk_operators(spark):
    files = spark.createDataFrame([("a", b"x" * 1300), ("b", b""), ("c", None)], "file_id string, content binary")
    fixed = fixed_chunks(files, 512).orderBy("chunk_no").collect()
    assert [(r["file_id"], r["offset"], r["length"]) for r in fixed] == [("a", 0, 512), ("a", 512, 512), ("a", 1024, 276)]
    assert {r["file_id"] for r in cdc_chunks(files, ChunkConfig(64, 256, 1024)).collect()} == {"a"}
    halves = lambda data, config: iter([len(data) // 2, len(data) - len(data) // 2] if data else [])
    assert [r["length"] for r in cdc_chunks(files, FINE, chunker=halves).collect()] == [650, 650]
    chunks = spark.createDataFrame([("h1", "f", 0, 10), ("h1", "f", 1, 10), ("h2", "g", 0, 5)], "hash string, name string, chunk_no int, length int")
    stats = {r["name"]: r for r in dedup.dedup_stats(chunks, "name", ["name", "chunk_no"]).collect()}
    assert (stats["f"]["new_chunks"], stats["f"]["dedup_ratio"], stats["f"]["savings_pct"]) == (1, 2.0, 50.0)
    firsts = dedup.first_occurrences(chunks, ["name", "chunk_no"], [])
    have = spark.createDataFrame([("h1",)], "hash string")
    assert dedup.new_chunks(firsts, have).first()["hash"] == "h2" and dedup.known_chunks(firsts, have).first()["hash"] == "h1"


def keys(*slots):
    return [(t, s, v) for t, s, v in slots]


def test_best_match_rules(spark):
    schema = "hash string, seq long, length int, keys array<struct<tier:int,slot:int,sf:bigint>>"
    rows = [
        ("b1", 1, 500, keys((3, 0, 1), (2, 0, 7), (2, 1, 8))), ("b2", 2, 500, keys((3, 1, 2), (3, 2, 3))), ("b3", 3, 500, keys((2, 0, 7), (2, 1, 8), (1, 0, 5))),
        ("q1", 10, 500, keys((3, 0, 1), (3, 1, 2), (3, 2, 3), (2, 0, 7), (2, 1, 8))), ("q2", 11, 500, keys((1, 0, 5))), ("q3", 12, 50, None), ("q4", 13, 500, keys((1, 0, 99))),
    ]
    chunks = spark.createDataFrame(rows, schema)
    got = {r["hash"]: (r["base_hash"], r["tier"], r["matches"]) for r in similarity.best_matches(chunks).collect()}
    assert got["q1"] == ("b2", 3, 2) and got["q2"] == ("b3", 1, 1) and got["b3"] == ("b1", 2, 2) and "q4" not in got
    strict = similarity.best_matches(chunks, SimilarityConfig(0.8))
    assert {r["hash"] for r in strict.collect()} == {"q1", "b3"}
    outcome = {r["hash"]: r["outcome"] for r in similarity.outcomes(chunks, strict).collect()}
    assert (outcome["q1"], outcome["q2"], outcome["q3"]) == ("near_duplicate", "unique", "too_small")


def test_bucket_cap_and_sequential_rule(spark):
    schema = "hash string, seq long, keys array<struct<tier:int,slot:int,sf:bigint>>"
    rows = [(f"00{i:02d}", i, keys((3, 0, 1), (1, i % 2, i))) for i in range(10)]
    chunks = spark.createDataFrame(rows, schema)
    assert {r["base_hash"] for r in similarity.best_matches(chunks).collect()} == {"0000"}
    slots = similarity.exploded(chunks, ["hash", "seq"])
    assert similarity.bases(slots, "seq", 5).where("tier = 3").count() == 5
    found = {r["hash"]: r["base_hash"] for r in similarity.sequential_matches(chunks).collect()}
    assert found == {f"00{i:02d}": "0000" for i in range(1, 10)}
    assert similarity.sequential_matches(chunks, config=SimilarityConfig(0)).count() == 0
    other = spark.createDataFrame([(f"00{i:02d}", i, keys((3, 0, i))) for i in range(10)] + [("00ff", 20, keys((3, 0, 0)))], schema)
    assert similarity.sequential_matches(other, budget=20).count() == 0 and similarity.sequential_matches(other, budget=400).count() == 1


def test_evicted_bases_leave_their_buckets(spark):
    schema = "hash string, seq long, keys array<struct<tier:int,slot:int,sf:bigint>>"
    # room for one base: each of six chunks of a bucket is evicted by one of another before the next comes
    rows = [(f"00{i:02d}", i, keys((3, 0, i if i % 2 else 1000))) for i in range(11)] + [("00ff", 11, keys((3, 0, 1000)))]
    found = similarity.sequential_matches(spark.createDataFrame(rows, schema), budget=4).collect()
    assert [(r["hash"], r["base_hash"]) for r in found] == [("00ff", "0010")]


def one_by_one(rows, room, most=5):
    """The sequential search over one shard with a plain list of live bases, the least recently used first."""
    live, arrived, out = [], [], {}
    for h, _, slots in sorted(rows, key=lambda r: (r[1], r[0])):
        best = None
        for tier in (3, 2, 1):
            counts = {}
            for key in [k for k in slots if k[0] == tier]:
                for base, own in [x for x in arrived if x[0] in live and key in x[1]][:most]:
                    counts[base] = counts.get(base, 0) + 1
            if counts:
                best = max(counts, key=counts.__getitem__)
                out[h] = (best, tier, counts[best])
                break
        if best is None:
            live = live[-(room - 1) :] if room > 1 else []
            arrived.append((h, slots))
        live = [x for x in live if x != best] + [best or h]
    return out


@pytest.mark.parametrize("room", [1, 7, 40, 1000])
def test_sequential_search_against_one_by_one(spark, room):
    rng = random.Random(room)
    rows = []
    for i in range(300):  # half the chunks share nothing
        sf = lambda k: 10_000 + 100 * i + k if i % 2 else rng.randrange(25)
        rows.append((f"00{rng.getrandbits(40):010x}", i // 3, keys((3, 0, sf(1)), (3, 1, sf(2)), (2, 0, sf(3)), (1, 0, sf(4)), (1, 1, sf(5)))))
    chunks = spark.createDataFrame(rows, "hash string, seq long, keys array<struct<tier:int,slot:int,sf:bigint>>").repartition(4)
    for most in (0, similarity.BROADCAST_ROWS):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(similarity, "BROADCAST_ROWS", most)
            found = {r["hash"]: (r["base_hash"], r["tier"], r["matches"]) for r in similarity.sequential_matches(chunks, budget=4 * room).collect()}
        assert found == one_by_one(rows, room)


def test_chunks_that_share_nothing_stay_out_of_the_sequential_task(spark):
    far = spark.range(2000).selectExpr("'00' shard", "concat('00', lpad(hex(id), 6, '0')) hash", "id seq", "array(named_struct('tier', 3, 'slot', 0, 'sf', id % 1999)) keys")
    for room, rows in ((5000, [None, None]), (100, [0, 1999])):
        got = similarity.sequential_rows(far.withColumn("keys", F.col("keys").cast("array<struct<tier:int,slot:int,sf:bigint>>")), room).collect()
        assert sorted(r["seq"] for r in got) == [0, 1999] and sorted((r["row"] for r in got), key=str) == rows


def test_json_manifests(spark, tmp_path):
    (tmp_path / "a.txt.manifest").write_text('{\n "path": "/x/a.txt", "size": 3, "modified": "17", "permissions": 420,\n "chunk_hashes": ["aa", "bb"]\n}')
    r = import_manifests(spark, str(tmp_path)).first()
    assert (r["name"], r["size"], r["modified"], r["chunk_hashes"]) == ("a.txt", 3, 17, ["aa", "bb"])


def test_stream_ingest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    held, point = ChunkStore(spark, str(tmp_path / "store")), str(tmp_path / "point")
    for turn, name in enumerate(("one", "two")):
        (source / name).write_bytes(b"streamed content " * 200)
        query = ingest_stream(watch_files(spark, str(source)), held, point, OPTIONS)
        query.awaitTermination(120)
        assert held.manifests().count() == turn + 1
    assert held.chunks().groupBy("hash").count().where("count > 1").count() == 0
    assert b.verify(held)[0].first()["ok"]


def test_stream_names_files_by_their_whole_path(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / "in" / d).mkdir(parents=True)
        (tmp_path / "in" / d / "same.txt").write_bytes(d.encode() * 300)
    held = ChunkStore(spark, str(tmp_path / "store"))
    ingest_stream(watch_files(spark, str(tmp_path / "in")), held, str(tmp_path / "point"), OPTIONS).awaitTermination(120)
    assert {r["name"] for r in held.manifests().collect()} == {"a/same.txt", "b/same.txt"} == {r["name"] for r in read_files(spark, str(tmp_path / "in")).collect()}


def test_modes_are_read_and_restored(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, mode in (("run sh", 0o755), ("secret%20", 0o600)):
        (tmp_path / "in" / name).write_bytes(name.encode() * 100)
        (tmp_path / "in" / name).chmod(mode)
    held = ChunkStore(spark, str(tmp_path / "store"))
    b.backup(read_files(spark, str(tmp_path / "in")), held, OPTIONS)
    assert b.restore(held, str(tmp_path / "out")) == 2
    assert {p.name: p.stat().st_mode & 0o7777 for p in (tmp_path / "out").iterdir()} == {"run sh": 0o755, "secret%20": 0o600}


def test_rows_changed_at_equal_size_are_stored(spark, store):
    for text in ("abc" * 100, "abd" * 100):
        b.backup(from_table(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text"), store, OPTIONS)
        assert bytes(b.restored(store).first()["content"]) == text.encode()
    again = b.backup(from_table(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text"), store, OPTIONS)
    assert again.first()["unchanged"]


def test_packs_hold_their_bytes(spark, store):
    data = random.Random(3).randbytes(600_000)
    b.backup(table(spark, {"big": data}), store, BackupOptions(chunks=FINE, similarity=SimilarityConfig(0), pack_bytes=16_384))
    packs = store.index().groupBy("pack_id").agg(F.sum("orig_length").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("z")).orderBy("pack_id").collect()
    assert len(packs) >= 600_000 // 16_384 and all(r["n"] < 16_384 + FINE.max_size for r in packs)
    assert all(x["z"] < y["a"] for x, y in zip(packs, packs[1:]))


def test_unreadable_store_is_an_error(spark, tmp_path):
    (tmp_path / "store" / "chunks").mkdir(parents=True)
    (tmp_path / "store" / "chunks" / "part-0.parquet").write_bytes(b"not a table at all")
    with pytest.raises(Exception):
        ChunkStore(spark, str(tmp_path / "store")).next_seq()


def test_small_averages_cover(spark):
    config = ChunkConfig.from_chunk_size(128)
    data = random.Random(4).randbytes(40_000) + bytes(3000)
    lengths = list(cut_lengths(data, config))
    assert sum(lengths) == len(data) and all(config.min_size <= n <= config.max_size for n in lengths[:-1])
    assert len(set(lengths)) > 20 and list(cut_lengths(data, config)) == lengths


def test_command_line(spark, tmp_path, capsys):
    from sediment.cli import main

    source = tmp_path / "in" / "sub"
    source.mkdir(parents=True)
    (source / "f.txt").write_bytes(b"command line " * 500)
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    assert main(["backup", str(tmp_path / "in"), store, "--chunk-size", "256"], spark) == 0
    assert main(["list", store], spark) == main(["info", store], spark) == main(["verify", store], spark) == 0
    assert main(["restore", store, out], spark) == 0 and (tmp_path / "out/sub/f.txt").read_bytes() == b"command line " * 500
    assert main(["migrate", store, str(tmp_path / "copy")], spark) == 0
    assert main(["delete", store, "sub/f.txt"], spark) == 0 and main(["delete", store, "sub/f.txt"], spark) == 1
    assert "sub/f.txt" in capsys.readouterr().out
