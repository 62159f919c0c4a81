"""Exact deduplication against a persistent digest index.

The index is a table of SHA-256 digests, bucketed and sorted by digest. A batch
is reduced to one row per digest, sort-merge anti-joined with the index, and what
is new is appended. Every row of the batch then learns which row of its group
stays by meeting its digest's row of the index.

A batch has an id. Run again under the same id, it finds its own digests in the
index and gives the same verdicts, so a driver lost after the append loses no
document. One batch at a time may write to an index.

Defined results: a null text counts as empty; equal texts are identical texts; texts of
any length are hashed whole; of
equal texts in one batch the row with the largest ``doc_id`` stays (a null id is
smaller than any other); of rows that also share the id exactly one stays; a text
that an earlier batch brought in is dropped wholly, and its ``keep_id`` is the id
that the index holds. An empty batch leaves the index as it is.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.session import scratch_path, staged

#: Groups beyond a 4096th of a batch are at most 4096; their index rows are broadcast.
HEAVY_GROUPS = 4096
#: Dropped rows that may be broadcast to the scan that filters the texts (24 bytes each).
BROADCAST_ROWS = 1_000_000


class DigestIndex:
    """The digest table at ``path``: digest, keep_id, group_size, batch.

    The number of buckets is kept with the table (in ``path``/layout) and holds for
    every session that opens it; ``buckets`` counts when it is made. The catalog
    only names the folder while the index is open: :meth:`close` forgets the name
    and leaves the files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = self._layout(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.name = f"sediment_digests_{hashlib.sha256(self.path.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/digests'"
        )

    def _layout(self, wanted: int) -> int:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/layout")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            self.spark.range(1).select(F.lit(wanted).alias("buckets")).coalesce(1).write.parquet(f"{self.path}/layout")
        return self.spark.read.parquet(f"{self.path}/layout").first()["buckets"]

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, fresh: DataFrame) -> None:
        fresh.select("digest", "keep_id", "group_size", "batch").repartition(self.buckets, "digest").write.insertInto(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digest(text) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Verdicts for a batch, one row per document: doc_id, digest, keep_id, group_size, kept.

    ``group_size`` counts the copies in the batch that brought the text in. ``batch``:
    its id, the same whenever the same rows are run again (a new one by default).
    """
    batch = batch or uuid.uuid4().hex
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest"))
    rows = staged(narrow.withColumn("row", F.monotonically_increasing_id()), "digests")
    groups = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("n"))
    groups = staged(groups.select("digest", F.col("top.doc_id").alias("top_id"), F.col("top.row").alias("top_row"), "n"), "digest-groups")
    fresh = groups.join(index.table().select("digest").hint("merge"), "digest", "left_anti")
    index.append(fresh.select("digest", F.col("top_id").alias("keep_id"), F.col("n").alias("group_size"), F.lit(batch).alias("batch")))

    least = max(1000, rows.count() // HEAVY_GROUPS)
    row = F.when(F.col("batch") == batch, F.col("top_row")).alias("keep_row")
    known = staged(groups.join(index.table().hint("merge"), "digest").select("digest", "keep_id", "group_size", row, (F.col("n") > least).alias("heavy")), "known-digests")
    heavy = F.broadcast(known.where("heavy"))
    light = rows.join(heavy.select("digest"), "digest", "left_anti").join(known.where("not heavy").hint("merge"), "digest")
    both = light.unionByName(rows.join(heavy, "digest"))
    return both.select("doc_id", "digest", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"))


def drop_duplicates(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The documents that stay, with the columns of ``docs``.

    The few dropped (id, digest) pairs go to the scan, by broadcast up to
    BROADCAST_ROWS and by an exchange beyond, so texts are not sorted by digest.
    """
    own = index or DigestIndex(docs.sparkSession, scratch_path(docs.sparkSession, "digest-index"))
    verdicts = staged(deduplicate(docs, own, id_col, text_col, batch), "verdicts")
    if index is None:
        own.close()
    per_pair = verdicts.groupBy("doc_id", "digest").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    seen = per_pair.agg(F.sum((~F.col("stays")).cast("long")).alias("gone"), F.max("n").alias("n")).first()
    dropped = per_pair.where(~F.col("stays")).select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest"))
    dropped = F.broadcast(dropped) if (seen["gone"] or 0) <= BROADCAST_ROWS else dropped.hint("merge")
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no column of ``docs`` meets a helper column by name
    keyed = docs.toDF(*at.values()).withColumn("key", digest(F.col(at[text_col])))
    same = F.col(at[id_col]).cast("long").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_digest"))
    left = keyed.join(dropped, same, "left_anti")
    if (seen["n"] or 0) > 1:  # rows that share id and text
        left = left.dropDuplicates([at[id_col], "key"])
    return left.select(*[F.col(c).alias(name) for name, c in at.items()])
