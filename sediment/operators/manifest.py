"""Manifests: ordered hash lists, and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions.hashing import is_hash


def ordered(value: Column, by: Column) -> Column:
    """Aggregate: the values in the order of ``by``."""
    return F.transform(F.array_sort(F.collect_list(F.struct(by.alias("k"), value.alias("v")))), lambda x: x["v"])


def build_manifests(files: DataFrame, chunks: DataFrame, key: str = "name") -> DataFrame:
    """``files`` (without content) with chunk_hashes in file order; an empty file has an empty list."""
    lists = chunks.groupBy(key).agg(ordered(F.col("hash"), F.col("chunk_no")).alias("chunk_hashes"))
    return files.join(lists, key, "left").withColumn("chunk_hashes", F.coalesce("chunk_hashes", F.array().cast("array<string>")))


def entries(manifests: DataFrame, key: str = "name") -> DataFrame:
    """A row per listed chunk: key, chunk_no, hash."""
    return manifests.select(key, F.posexplode("chunk_hashes").alias("chunk_no", "hash"))


def list_files(manifests: DataFrame) -> DataFrame:
    return manifests.select("name", "size", "modified", F.size("chunk_hashes").alias("chunk_count")).orderBy("name")


def store_info(manifests: DataFrame) -> DataFrame:
    """file_count, total_size, total_chunks (listed, not distinct)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return manifests.agg(F.count("*").alias("file_count"), total("size").alias("total_size"), total(F.size("chunk_hashes")).alias("total_chunks"))


def changed(files: DataFrame, manifests: DataFrame, force: bool = False) -> DataFrame:
    """Files that are new or differ in size or modification second."""
    if force:
        return files
    known = manifests.select(F.col("name"), F.col("size"), F.col("modified"))
    return files.join(known, ["name", "size", "modified"], "left_anti")


def verify(manifests: DataFrame, held: DataFrame, name: str | None = None) -> DataFrame:
    """Errors of listed chunks: name, chunk_no, hash, error (null: sound).

    ``held``: hash, actual (the hash that the stored bytes have; null where they can't be decoded).
    """
    chosen = manifests if name is None else manifests.where(F.col("name") == name)
    met = entries(chosen).join(held.select("hash", "actual", F.lit(True).alias("found")), "hash", "left")
    error = (
        F.when(~is_hash(F.col("hash")), F.lit("bad hash"))
        .when(F.col("found").isNull(), F.lit("not found"))
        .when(F.col("actual").isNull(), F.lit("not readable"))
        .when(F.col("actual") != F.lower("hash"), F.lit("hash mismatch"))
    )
    return met.select("name", "chunk_no", "hash", error.alias("error"))


def verify_report(manifests: DataFrame, checked: DataFrame) -> DataFrame:
    """files_checked, chunks_checked (bad hashes don't count), errors, ok."""
    files = manifests.agg(F.count("*").alias("files_checked"))
    sums = checked.agg(
        F.coalesce(F.count_if(F.coalesce(F.col("error") != "bad hash", F.lit(True))), F.lit(0)).alias("chunks_checked"),
        F.count("error").alias("errors"),
    )
    return files.join(sums, F.lit(True)).withColumn("ok", F.col("errors") == 0)  # one row and one row


def orphans(index: DataFrame, manifests: DataFrame) -> DataFrame:
    """Stored chunks that no manifest reaches, directly or as a base of a listed delta."""
    listed = entries(manifests).select("hash").distinct()
    bases = index.join(listed, "hash", "left_semi").where("base_hash is not null").select(F.col("base_hash").alias("hash"))
    return index.join(listed.union(bases).distinct(), "hash", "left_anti")
