"""The chunk store: Parquet tables ``chunks`` and ``manifests`` under one location.

Chunks are appended by ingest and carry entry type, base, payload, lengths and
signature keys, so reading the index prunes the payloads away. Manifests are
appended too; the latest ingest of a name holds, and a deletion is a row without
hashes. A job's files show only once it is committed; chunks are committed before
the manifests that list them. One ingest at a time may write to a store.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.schemas import CHUNK_STORE, MANIFESTS
from sediment.sources.uri import StoreLocation, hadoop_options, parse_store

DELETED = "deleted BOOLEAN, ingested TIMESTAMP"


class ChunkStore:
    def __init__(self, spark: SparkSession, location: str | StoreLocation):
        self.spark = spark
        self.location = parse_store(location) if isinstance(location, str) else location
        for k, v in hadoop_options(self.location).items():
            spark.sparkContext._jsc.hadoopConfiguration().set(k, v)

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.location.child(name)
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(jpath):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)  # a table that is there but can't be read is an error

    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNK_STORE)

    def index(self) -> DataFrame:
        """hash and place of every chunk, without payloads."""
        return self.chunks().select("hash", "pack_id", "entry_type", "base_hash", "orig_length", "stored_length", "seq")

    def cached_index(self) -> DataFrame:
        """The index on executors' disks, for sessions that probe it often."""
        return self.index().persist(StorageLevel.DISK_ONLY)

    def hashes(self) -> DataFrame:
        return self.chunks().select("hash").distinct()

    def signatures(self) -> DataFrame:
        """What the similarity search needs of stored chunks; rebuilding its index is this scan."""
        return self.chunks().where("keys is not null").select("hash", "seq", "keys")

    def contains(self, chunk: str) -> bool:
        return self.chunks().where(F.col("hash") == chunk.lower()).limit(1).count() > 0

    def has_file(self, name: str) -> bool:
        return self.manifests().where(F.col("name") == name).limit(1).count() > 0

    def history(self) -> DataFrame:
        return self._read("manifests", f"{MANIFESTS}, {DELETED}")

    def manifests(self) -> DataFrame:
        """The latest manifest of each name that isn't deleted."""
        columns = ["path", "size", "modified", "permissions", "chunk_hashes", "ingest_id", "deleted"]
        latest = self.history().groupBy("name").agg(F.max_by(F.struct(*columns), F.struct("ingested", "ingest_id")).alias("m"))
        return latest.where(~F.col("m.deleted")).select("name", *[F.col(f"m.{c}").alias(c) for c in columns[:-1]])

    def append_chunks(self, chunks: DataFrame) -> None:
        names = [f.split()[0] for f in CHUNK_STORE.replace("ARRAY<STRUCT<tier: INT, slot: INT, sf: BIGINT>>", "X").split(", ")]
        chunks.select(*names).write.mode("append").option("compression", "zstd").parquet(self.location.child("chunks"))

    def append_manifests(self, manifests: DataFrame, deleted: bool = False) -> None:
        names = [f.split()[0] for f in MANIFESTS.split(", ")]
        rows = manifests.select(*names, F.lit(deleted).alias("deleted"), F.current_timestamp().alias("ingested"))
        rows.write.mode("append").parquet(self.location.child("manifests"))

    def next_seq(self) -> int:
        """Sequence numbers of an ingest begin above all earlier ones."""
        return (self.index().agg(F.max("seq")).first()[0] or 0) + 1

    def next_pack(self) -> int:
        top = self.index().agg(F.max("pack_id")).first()[0]
        return 0 if top is None else top + 1

    @staticmethod
    def new_ingest() -> str:
        return uuid.uuid4().hex


def import_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests kept as one JSON document a file."""
    rows = spark.read.option("multiLine", "true").json(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.manifest)?$", 1)
    return rows.select(name.alias("name"), "path", F.col("size").cast("long").alias("size"), F.col("modified").cast("long").alias("modified"), F.col("permissions").cast("int").alias("permissions"), "chunk_hashes", F.lit("imported").alias("ingest_id"))


def export_manifests(manifests: DataFrame, path: str) -> None:
    """Manifests as JSON lines."""
    manifests.select("name", "path", "size", "modified", "permissions", "chunk_hashes").write.json(path)
