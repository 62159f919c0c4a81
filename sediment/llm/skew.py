"""Equi-joins of narrow tables whose key may be one for a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this part of all rows is heavy; so at most so many keys are.
HEAVY = 4096
#: Rows of a key that one task may hold in any case.
LEAST = 1000


def heavy_keys(many: DataFrame, key: str) -> DataFrame | None:
    """key, parts: the keys with more than a 4096th of the rows (at most 4096), and into how many parts each is split; None if there are none."""
    total = many.count()
    if total <= LEAST:
        return None
    counts = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    found = counts.where((F.col("n") > LEAST) & (F.col("n") * HEAVY > total)).collect()  # at most HEAVY rows
    rows = [(r[key], min(HEAVY, -(-r["n"] * HEAVY // total))) for r in found]
    kind = many.schema[key].dataType.simpleString()
    return many.sparkSession.createDataFrame(rows, f"`{key}` {kind}, parts int") if rows else None


def look_up(many: DataFrame, one: DataFrame, key: str, heavy: DataFrame | None | bool = True) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has one narrow row a key: heavy keys' rows are broadcast, the rest meet by exchange.

    ``heavy``: their keys or None, if they are known.
    """
    heavy = heavy_keys(many, key) if heavy is True else heavy
    if heavy is None:
        return many.join(one, key)
    few = F.broadcast(one.join(F.broadcast(heavy.select(key)), key, "left_semi"))  # at most HEAVY rows
    return many.join(few, key).unionByName(many.join(F.broadcast(heavy.select(key)), key, "left_anti").join(one, key))


def look_up_wide(many: DataFrame, one: DataFrame, key: str, spread: str) -> DataFrame:
    """The same where ``one`` has wide rows: a heavy key's row is copied to the parts of its key, which ``spread`` deals."""
    heavy = heavy_keys(many, key)
    if heavy is None:
        return many.join(one, key)
    heavy = F.broadcast(heavy)
    salted = many.join(heavy, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    copies = one.join(heavy, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return salted.join(copies, [key, "part"]).drop("part")
