"""Backup, restore, verify, delete, migrate: plans over the chunk store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.config import BackupOptions
from sediment.errors import ChunkNotFound
from sediment.functions.codec import DELTA, delta_gate, payload_column
from sediment.functions.features import with_keys
from sediment.functions.gear import cut_lengths
from sediment.functions.hashing import HASHERS, content_hash
from sediment.operators import manifest as m
from sediment.operators.chunking import Chunker, cdc_chunks, hashed
from sediment.operators.dedup import first_occurrences, new_chunks, ratio, savings, share
from sediment.operators.restore import assemble_files, decode_chunks
from sediment.operators.similarity import best_matches
from sediment.session import row_numbers, staged
from sediment.sources.store import ChunkStore
from sediment.sources.uri import safe_target


def backup(files: DataFrame, store: ChunkStore, options: BackupOptions = BackupOptions(), chunker: Chunker = cut_lengths, hasher: str = "sha256") -> DataFrame:
    """Store new or changed files; one row of statistics per given file.

    Chunk bytes are cut once into a staged table. Everything that decides about a
    chunk (dedup, bases) moves hashes and numbers only; bytes meet their base once,
    for the chunks that are new and have one.
    """
    todo = m.changed(files, store.manifests(), options.force)
    ingest = store.new_ingest()
    meta = staged(todo.drop("content"), "todo")
    cut = staged(hashed(cdc_chunks(todo, options.chunks, key="name", chunker=chunker), hasher), "chunks")
    refs = cut.select("name", "chunk_no", "hash", "length")

    firsts = new_chunks(first_occurrences(refs, ["name", "chunk_no"], ["length"]), store.index())
    numbered, _ = row_numbers(firsts, ["name", "chunk_no"], "place", "new-chunks")
    fresh = staged(numbered.withColumn("seq", F.col("place") + store.next_seq()), "new-seq")
    fresh = staged(_packed(fresh, options.pack_bytes, store.next_pack()), "new-packs")

    own = cut.join(fresh.select("name", "chunk_no"), ["name", "chunk_no"], "left_semi").select("hash", "data", "length")
    keyed = staged(with_keys(own).join(fresh.select("hash", "seq", "pack_id"), "hash"), "new-keys")
    if options.similarity.enabled:
        stored = store.signatures()
        found = best_matches(keyed.select("hash", "seq", "keys"), options.similarity, stored)
        chosen = staged(_flat(found.select("hash", "base_hash"), store.index()), "bases")
        wanted = chosen.select(F.col("base_hash").alias("hash")).distinct()
        bases = decode_chunks(wanted, store.chunks()).unionByName(keyed.join(wanted, "hash", "left_semi").select("hash", "data"))
        bases = bases.select(F.col("hash").alias("base_hash"), F.col("data").alias("base"), F.octet_length("data").alias("base_length"))
        based = keyed.join(chosen, "hash", "left").join(bases, "base_hash", "left")
        allowed = F.when(delta_gate(F.col("length"), F.col("base_length")), F.col("base"))
    else:
        based = keyed.withColumn("base_hash", F.lit(None).cast("string"))
        allowed = F.lit(None).cast("binary")
    packed = based.withColumn("p", payload_column(F.col("data"), allowed, options.level))
    kind = F.col("p.entry_type")
    rows = packed.select(
        "hash", "pack_id", kind.alias("entry_type"), F.when(kind == DELTA, F.col("base_hash")).alias("base_hash"), F.col("p.payload").alias("payload"),
        F.col("length").alias("orig_length"), F.col("p.stored_length").alias("stored_length"), "keys", F.lit(ingest).alias("ingest_id"), "seq", F.col("base_hash").alias("similar_to"),
    )
    rows = staged(rows, "new-rows")
    store.append_chunks(rows)
    manifests = m.build_manifests(meta, refs).withColumn("ingest_id", F.lit(ingest))
    store.append_manifests(manifests)
    return file_stats(files, meta, refs, fresh.join(rows.select("hash", "entry_type", "stored_length", "similar_to"), "hash"))


#: Places whose lengths are added up by one window.
RUN = 1024


def _packed(fresh: DataFrame, pack_bytes: int, first: int) -> DataFrame:
    """``fresh`` (place, length) with pack_id: a pack holds the chunks that begin in its pack_bytes of all new bytes.

    Sums of runs go through one task (a row per RUN chunks), lengths within a run through the run's.
    """
    runs = fresh.groupBy(F.call_function("div", F.col("place"), F.lit(RUN)).alias("run")).agg(F.sum(F.col("length").cast("long")).alias("bytes"))
    upto = F.sum("bytes").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select("run", F.coalesce(upto, F.lit(0)).alias("start"))
    inside = F.sum(F.col("length").cast("long")).over(Window.partitionBy("run").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    placed = fresh.withColumn("run", F.call_function("div", F.col("place"), F.lit(RUN))).join(starts, "run")
    pack = F.lit(first) + F.call_function("div", F.col("start") + F.coalesce(inside, F.lit(0)), F.lit(pack_bytes))
    return placed.withColumn("pack_id", pack).drop("run", "start")


def _flat(found: DataFrame, index: DataFrame) -> DataFrame:
    """Only bases that are no deltas themselves stay, so chains have one link."""
    deltas = index.where(F.col("entry_type") == DELTA).select(F.col("hash").alias("base_hash"))
    based = found.select(F.col("hash").alias("base_hash"))
    return found.join(deltas, "base_hash", "left_anti").join(based, "base_hash", "left_anti").select("hash", "base_hash")


def file_stats(files: DataFrame, todo: DataFrame, refs: DataFrame, fresh: DataFrame) -> DataFrame:
    """By file: sizes, chunk counts, near-duplicates, deltas and ratios, logical and physical apart."""
    whole = refs.groupBy("name").agg(F.count("*").alias("total_chunks"))
    delta = F.col("entry_type") == DELTA
    new = fresh.groupBy("name").agg(
        F.count("*").alias("new_chunks"), F.sum(F.col("length").cast("long")).alias("stored_size"), F.sum(F.col("stored_length").cast("long")).alias("physical_size"),
        F.count("similar_to").alias("near_duplicate_chunks"), F.count_if(delta).alias("delta_chunks"),
        F.sum(F.when(delta, (F.col("length") - F.col("stored_length")).cast("long"))).alias("delta_savings"),
    )
    given = files.select("name", F.col("size").alias("source_size")).join(todo.select("name", F.lit(True).alias("processed")), "name", "left")
    both = given.join(whole, "name", "left").join(new, "name", "left")
    counts = ["total_chunks", "new_chunks", "stored_size", "physical_size", "near_duplicate_chunks", "delta_chunks", "delta_savings"]
    both = both.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})
    both = both.withColumn("unchanged", F.col("processed").isNull()).withColumn("dedup_chunks", F.col("total_chunks") - F.col("new_chunks"))
    return both.select(
        "name", "unchanged", "source_size", *counts, "dedup_chunks", ratio("source_size", "stored_size").alias("dedup_ratio"),
        ratio("source_size", "physical_size").alias("physical_ratio"), savings("source_size", "stored_size").alias("savings_pct"), share("near_duplicate_chunks", "total_chunks").alias("near_duplicate_pct"),
    )


def restored(store: ChunkStore, name: str | None = None) -> DataFrame:
    """name, path, modified, permissions, content, complete of one file or all."""
    chosen = store.manifests() if name is None else store.manifests().where(F.col("name") == name)
    if not chosen.limit(1).count():
        raise ChunkNotFound(f"no such file: {name}" if name else "the store has no files")
    entries = m.entries(chosen)
    data = decode_chunks(entries, store.chunks())
    whole = assemble_files(entries, data)
    empty = F.coalesce("content", F.lit(b"")).alias("content")
    return chosen.select("name", "path", "size", "modified", "permissions").join(whole, "name", "left").select("name", "path", "size", "modified", "permissions", empty, F.coalesce("complete", F.lit(True)).alias("complete"))


def restore(store: ChunkStore, dest: str, name: str | None = None) -> int:
    """Write files below ``dest`` (a folder every executor sees); times and permissions are set. Returns their number."""
    chosen = store.manifests() if name is None else store.manifests().where(F.col("name") == name)
    bad = m.entries(chosen).join(store.hashes(), "hash", "left_anti").select("name").limit(1).collect()
    if bad:  # before anything is written, and without a payload read
        raise ChunkNotFound(f"{bad[0]['name']} has chunks that the store lacks")
    files = restored(store, name)

    def write(rows) -> None:
        import os

        for r in rows:
            if not r["complete"]:
                raise ChunkNotFound(f"{r['name']} has chunks that can't be read")
            target = safe_target(dest, r["name"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(f"{target}.part", "wb") as f:
                f.write(bytes(r["content"]))
            os.chmod(f"{target}.part", r["permissions"] or 0o644)
            os.utime(f"{target}.part", (r["modified"], r["modified"]))
            os.replace(f"{target}.part", target)

    files.foreachPartition(write)
    return chosen.count()


def verify(store: ChunkStore, name: str | None = None, hasher: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """(report of one row, errors by chunk)."""
    manifests = store.manifests()
    chosen = manifests if name is None else manifests.where(F.col("name") == name)
    if name is not None and not chosen.limit(1).count():
        raise ChunkNotFound(f"no such file: {name}")
    data = decode_chunks(m.entries(chosen), store.chunks())
    held = data.select("hash", content_hash(F.col("data"), hasher).alias("actual"))
    checked = staged(m.verify(chosen, held), "verified")
    return m.verify_report(chosen, checked), checked.where("error is not null")


def get_chunks(wanted: DataFrame, store: ChunkStore, hasher: str = "sha256") -> DataFrame:
    """hash, data, error of the wanted chunks (column hash): every read is held against its hash."""
    asked = wanted.select("hash").distinct()
    read = decode_chunks(asked, store.chunks()).withColumn("actual", content_hash(F.col("data"), hasher)).withColumn("found", F.lit(True))
    met = asked.join(read, "hash", "left")
    error = F.when(F.col("found").isNull(), "not found").when(F.col("actual").isNull(), "not readable").when(F.col("actual") != F.col("hash"), "hash mismatch")
    return met.select("hash", F.when(error.isNull(), F.col("data")).alias("data"), error.alias("error"))


def delete_file(store: ChunkStore, name: str) -> None:
    """Forget a manifest; its chunks become orphans if nothing else lists them."""
    row = store.manifests().where(F.col("name") == name)
    if not row.limit(1).count():
        raise ChunkNotFound(f"no such file: {name}")
    store.append_manifests(staged(row.withColumn("ingest_id", F.lit(store.new_ingest())), "deleted"), deleted=True)


def sweep(store: ChunkStore) -> DataFrame:
    """Chunks that could be removed."""
    return m.orphans(store.index(), store.manifests())


def migrate(source: ChunkStore, target: ChunkStore) -> dict[str, int]:
    """Copy manifests and the chunks that the target lacks, payloads as they are; bases come along."""
    listed = m.entries(source.manifests()).select("hash").distinct()
    bases = source.index().join(listed, "hash", "left_semi").where("base_hash is not null").select(F.col("base_hash").alias("hash"))
    missing = listed.union(bases).distinct().join(target.index().select("hash"), "hash", "left_anti")
    first_seq, first_pack = target.next_seq(), target.next_pack()
    rows = source.chunks().join(missing, "hash", "left_semi").withColumn("seq", F.col("seq") + first_seq).withColumn("pack_id", F.col("pack_id") + first_pack)
    rows = staged(rows, "migrated")
    manifests = staged(source.manifests(), "migrated-manifests")
    target.append_chunks(rows)
    target.append_manifests(manifests)
    done = manifests.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    return {"files": done["files"], "bytes": done["bytes"], "chunks": rows.count()}


def hashers() -> list[str]:
    return sorted(HASHERS)
