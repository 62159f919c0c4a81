"""Inputs as a files table: name, path, size, modified, permissions, content."""

from __future__ import annotations

import os
import posixpath
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, glob: str | None = None, root: str | None = None) -> DataFrame:
    """Files below ``path``; ``name`` is the path below ``root`` (the folder itself by default)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return as_files(reader.load(path), root or path)


def as_files(found: DataFrame, root: str) -> DataFrame:
    """Rows of the binaryFile source as a files table, named by their path below ``root``."""
    bare = F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", "")
    base = unquote(root).rstrip("/")
    base = base.partition(":")[2].lstrip("/") if ":" in base.split("/")[0] else base.lstrip("/")
    below = F.regexp_replace(bare, "^/*" + _escaped(base) + "/*", "")
    name = F.when(below == "", F.element_at(F.split(bare, "/"), -1)).otherwise(below)
    return found.select(name.alias("name"), bare.alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("modified"), _mode(F.col("path")).alias("permissions"), "content")


def _mode(path: Column) -> Column:
    """Permission bits of files in a mounted file system; 0644 where the store keeps none."""

    @F.pandas_udf("int")
    def run(paths: pd.Series) -> pd.Series:
        def of(p: str) -> int:
            try:
                return os.stat(p.partition(":")[2]).st_mode & 0o7777 if p.startswith("file:") else 0o644
            except OSError:  # gone since it was listed, or not mounted here
                return 0o644

        return paths.map(of).astype("int32")

    return run(path)


def _escaped(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in text)


def from_table(rows: DataFrame, key: str, text: str, prefix: str = "") -> DataFrame:
    """A text column as files named by key. A row has no time; a digest of its content stands for it, so a change of equal size is one."""
    content = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    name = F.concat(F.lit(prefix), F.col(key).cast("string"))
    return rows.select(name.alias("name"), name.alias("path"), F.octet_length(content).cast("long").alias("size"), F.pmod(F.xxhash64(content), F.lit(1 << 33)).alias("modified"), F.lit(0o644).alias("permissions"), content.alias("content"))


def basename(path: str) -> str:
    return posixpath.basename(path.rstrip("/"))
