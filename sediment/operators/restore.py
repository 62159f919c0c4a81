"""Stored payloads back to bytes: delta chains by rounds of equi-joins, files by ordered concatenation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.errors import StoreCorrupted
from sediment.functions.codec import DELTA, decoded_column
from sediment.session import staged

MAX_DEPTH = 16


def decode_chunks(wanted: DataFrame, store: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """hash, data of the wanted chunks (column hash) and of their bases; data is null if it can't be decoded.

    Round k decodes deltas whose base round k-1 gave; a chain longer than
    ``depth``, or a circle, is an error; a delta without its base is null.
    """
    entry = ["hash", "entry_type", "base_hash", "payload", "orig_length"]
    need = store.select(*entry).join(wanted.select("hash").distinct(), "hash", "left_semi")
    levels = [staged(need, "chain-0")]
    while (bases := levels[-1].where(F.col("entry_type") == DELTA).select(F.col("base_hash").alias("hash")).distinct()).limit(1).count():
        if len(levels) > depth:
            raise StoreCorrupted(f"delta chain longer than {depth}")
        levels.append(staged(store.select(*entry).join(bases, "hash", "left_semi"), f"chain-{len(levels)}"))
    done = None
    for level in levels[::-1]:
        whole = level.where(F.col("entry_type") != DELTA).withColumn("base", F.lit(None).cast("binary"))
        delta = level.where(F.col("entry_type") == DELTA)
        delta = delta.withColumn("base", F.lit(None).cast("binary")) if done is None else delta.join(done.select(F.col("hash").alias("base_hash"), F.col("data").alias("base")), "base_hash", "left")
        both = whole.select(*entry, "base").unionByName(delta.select(*entry, "base"))
        data = decoded_column(F.col("entry_type"), F.col("payload"), F.col("base"), F.col("orig_length"))
        done = staged(both.select("hash", data.alias("data")), "chain-data")
    return done.join(wanted.select("hash").distinct(), "hash", "left_semi").dropDuplicates(["hash"])


def assemble_files(entries: DataFrame, data: DataFrame, key: str = "name") -> DataFrame:
    """key, content, complete: chunks in file order; a file with a missing chunk isn't complete."""
    met = entries.join(data, "hash", "left")
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", F.col("data").alias("d"))))
    grouped = met.groupBy(key).agg(parts.alias("parts"), F.count_if(F.col("data").isNull()).alias("missing"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [b"".join(p["d"].as_py() or b"" for p in row) for row in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary()), pa.array([m == 0 for m in batch.column(2).to_pylist()])], names=[key, "content", "complete"])

    kind = entries.schema[key].dataType.simpleString()
    return grouped.mapInArrow(run, f"{key} {kind}, content binary, complete boolean")
