"""Exact deduplication of chunks. The first occurrence is the least of the order columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_occurrences(chunks: DataFrame, order: list[str], carry: list[str], key: str = "hash") -> DataFrame:
    """One row per key: key, ``order`` and ``carry`` of its first occurrence, and refs.

    Combined before the exchange, so a chunk that a third of all files hold is one
    row per task; no window sorts its copies.
    """
    top = F.min(F.struct(*order, *carry)).alias("top")
    grouped = chunks.groupBy(key).agg(top, F.count("*").alias("refs"))
    return grouped.select(key, *[F.col(f"top.{c}").alias(c) for c in [*order, *carry]], "refs")


def new_chunks(firsts: DataFrame, store: DataFrame, key: str = "hash") -> DataFrame:
    """Those whose key the store lacks."""
    return firsts.join(store.select(key), key, "left_anti")


def known_chunks(firsts: DataFrame, store: DataFrame, key: str = "hash") -> DataFrame:
    return firsts.join(store.select(key), key, "left_semi")


def dedup_stats(chunks: DataFrame, group: str, order: list[str]) -> DataFrame:
    """By group: chunks and bytes in all, and those of first occurrences, with ratios.

    First occurrences carry their group, so both sides are aggregated before they meet.
    """
    firsts = first_occurrences(chunks, order, [group, "length"] if group not in order else ["length"])
    whole = chunks.groupBy(group).agg(F.count("*").alias("total_chunks"), F.sum(F.col("length").cast("long")).alias("source_bytes"))
    new = firsts.groupBy(group).agg(F.count("*").alias("new_chunks"), F.sum(F.col("length").cast("long")).alias("stored_bytes"))
    zero = F.lit(0).cast("long")
    both = whole.join(new, group, "left").withColumns({c: F.coalesce(c, zero) for c in ("new_chunks", "stored_bytes")})
    return both.select(group, "total_chunks", "new_chunks", "source_bytes", "stored_bytes", ratio("source_bytes", "stored_bytes").alias("dedup_ratio"), savings("source_bytes", "stored_bytes").alias("savings_pct"))


def ratio(source: str, stored: str):
    """source/stored; 1 where nothing is stored."""
    return F.round(F.when(F.col(stored) == 0, F.lit(1.0)).otherwise(F.col(source).cast("double") / F.col(stored)), 6)


def savings(source: str, stored: str):
    """Percent saved; 0 where there is no source."""
    return F.round(F.when(F.col(source) == 0, F.lit(0.0)).otherwise((1 - F.col(stored).cast("double") / F.col(source)) * 100), 6)


def share(part: str, whole: str):
    """Percent of the whole; 0 where that is 0."""
    return F.round(F.when(F.col(whole) == 0, F.lit(0.0)).otherwise(F.col(part).cast("double") / F.col(whole) * 100), 6)
