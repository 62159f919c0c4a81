"""Session settings and the shared folder in which plans cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder and any other
    master a folder under the (shared) warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            folder = "file://" + tempfile.mkdtemp(prefix="sediment-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sediment/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, wanted: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``; an expression named twice inside a lambda is computed once."""
    return F.transform(F.array(value), body)[0]


def row_numbers(df: DataFrame, order: list[str], rownum: str, name: str) -> tuple[DataFrame, int]:
    """``df`` with gapless global row numbers (from 0) in the order of ``order``, and the row count.

    A range exchange sorts the rows, the sorted rows are written once, and each
    row's number is its place in its partition plus the rows in the partitions
    before. Only one row per partition goes through a single task.
    """
    spark = df.sparkSession
    mid = fresh_name(df, "__mid")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c) for c in order]).sortWithinPartitions(*order)
    rows = staged(ranged.withColumn(mid, F.monotonically_increasing_id()), name)
    part = fresh_name(rows, "__part")
    counts = rows.groupBy(F.shiftright(F.col(mid), 33).alias(part)).agg(F.count("*").alias("n")).collect()
    starts, total = [], 0
    for r in sorted(counts, key=lambda r: r[part]):  # as many as range partitions
        starts.append((r[part], total))
        total += r["n"]
    start = fresh_name(rows, "__start")
    table = spark.createDataFrame(starts, f"`{part}` long, `{start}` long")
    numbered = rows.withColumn(part, F.shiftright(F.col(mid), 33)).join(F.broadcast(table), part)
    place = F.col(start) + F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(rownum, place).drop(mid, part, start), total
