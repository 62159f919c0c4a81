"""Files to chunks: fixed size in built-in functions, content-defined over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.config import ChunkConfig
from sediment.functions.gear import cut_lengths
from sediment.functions.hashing import content_hash

#: bytes, config -> chunk lengths that cover them.
Chunker = Callable[[bytes, ChunkConfig], Iterator[int]]
BATCH_BYTES = 8 << 20


def fixed_chunks(files: DataFrame, size: int, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all but the content), chunk_no, offset, length, data."""
    keep = [c for c in files.columns if c != content] if keep is None else keep
    n = F.octet_length(F.col(content))
    numbered = files.where(n > 0).select(*keep, content, F.explode(F.sequence(F.lit(0), ((n - 1) / size).cast("int"))).alias("chunk_no"))
    data = F.substring(F.col(content), F.col("chunk_no") * size + 1, F.lit(size))
    cut = numbered.select(*keep, "chunk_no", (F.col("chunk_no").cast("long") * size).alias("offset"), data.alias("data"))
    return cut.select(*keep, "chunk_no", "offset", F.octet_length("data").alias("length"), "data")


def cdc_chunks(files: DataFrame, config: ChunkConfig, content: str = "content", key: str = "file_id", chunker: Chunker = cut_lengths) -> DataFrame:
    """key, chunk_no, offset, length, data: contiguous, without gaps; an empty or null file has no chunks."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("key", batch.column(0).type), ("chunk_no", pa.int32()), ("offset", pa.int64()), ("length", pa.int32()), ("data", pa.binary())])
            rows, held = [], 0
            for file_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, at = data.as_py() or b"", 0
                for no, n in enumerate(chunker(data, config)):
                    rows.append((file_id, no, at, n, data[at : at + n]))
                    at, held = at + n, held + n
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    cut = files.select(F.col(key), F.col(content).cast("binary")).mapInArrow(run, f"key {kind}, chunk_no int, offset long, length int, data binary")
    return cut.withColumnRenamed("key", key)


def hashed(chunks: DataFrame, hasher: str = "sha256", data: str = "data") -> DataFrame:
    return chunks.withColumn("hash", content_hash(F.col(data), hasher))
