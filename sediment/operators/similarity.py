"""Near-duplicate chunks by super-features.

``candidate`` search: every earlier distinct chunk is eligible, the first few of a
(tier, slot, super-feature) bucket are examined, and the best candidate is the one
of the highest tier, then most common slots, then first slot, then first come.
``sequential`` search adds the rule that a chunk with a base is no base itself,
by going in order through the chunks that share a super-feature with another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.config import SimilarityConfig
from sediment.functions.features import LOW64
from sediment.session import row_numbers, staged

#: Rows of one column that may be broadcast.
BROADCAST_ROWS = 500_000


def exploded(chunks: DataFrame, keep: list[str], keys: str = "keys") -> DataFrame:
    """A row per slot: ``keep``, tier, slot, sf."""
    return chunks.where(F.col(keys).isNotNull()).select(*keep, F.explode(keys).alias("k")).select(*keep, "k.tier", "k.slot", "k.sf")


def bases(slots: DataFrame, seq: str, most: int) -> DataFrame:
    """The first ``most`` chunks of each bucket; the rank is cut before the exchange as well."""
    ranked = slots.withColumn("__rank", F.row_number().over(Window.partitionBy("tier", "slot", "sf").orderBy(seq)))
    return ranked.where(F.col("__rank") <= most).drop("__rank")


def candidates(queries: DataFrame, base: DataFrame, key: str = "hash", seq: str = "seq") -> DataFrame:
    """hash, base_hash, base_seq, tier, matches, first_slot for pairs that share a bucket, base before query."""
    b = base.select(F.col(key).alias("base_hash"), F.col(seq).alias("base_seq"), "tier", "slot", "sf")
    met = queries.join(b, ["tier", "slot", "sf"]).where(F.col("base_seq") < F.col(seq))
    return met.groupBy(key, "base_hash", "base_seq", "tier").agg(F.count("*").alias("matches"), F.min("slot").alias("first_slot"))


def best(found: DataFrame, key: str = "hash") -> DataFrame:
    """The best candidate of each chunk; a maximum over structs, combined before the exchange."""
    top = F.max(F.struct("tier", "matches", (-F.col("first_slot")).alias("slot_"), (-F.col("base_seq")).alias("seq_"), "base_hash")).alias("top")
    return found.groupBy(key).agg(top).select(key, F.col("top.base_hash").alias("base_hash"), F.col("top.tier").alias("tier"), F.col("top.matches").alias("matches"), (-F.col("top.slot_")).alias("first_slot"), (-F.col("top.seq_")).alias("base_seq"))


def best_matches(chunks: DataFrame, config: SimilarityConfig = SimilarityConfig(), stored: DataFrame | None = None, keys: str = "keys") -> DataFrame:
    """Best candidates above the tier gate among ``chunks`` (hash, seq, keys) and ``stored`` ones."""
    slots = exploded(chunks, ["hash", "seq"], keys)
    pool = slots if stored is None else slots.unionByName(exploded(stored, ["hash", "seq"], keys))
    return gate(best(candidates(slots, bases(pool, "seq", config.candidates_per_bucket))), config)


def index_size(chunks: DataFrame, keys: str = "keys") -> DataFrame:
    """chunks, slots, buckets of the similarity index over ``chunks``."""
    per_bucket = exploded(chunks, ["hash"], keys).groupBy("tier", "slot", "sf").agg(F.count("*").alias("n"))
    sizes = per_bucket.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("slots"), F.count("*").alias("buckets"))
    signed = chunks.agg(F.count_if(F.col(keys).isNotNull()).alias("chunks"))
    return signed.join(sizes, F.lit(True)).select("chunks", "slots", "buckets")  # one row and one row


def gate(found: DataFrame, config: SimilarityConfig) -> DataFrame:
    """Only the best is tried: a chunk whose best candidate fails is unique."""
    return found.where(F.lit(config.enabled) & (F.col("tier") >= config.least_tier))


def outcomes(chunks: DataFrame, matched: DataFrame, length: str = "length") -> DataFrame:
    """hash, outcome (too_small, near_duplicate, unique), similar_to, tier."""
    small = F.col(length) < 64
    joined = chunks.select("hash", length).join(matched.select("hash", "base_hash", "tier"), "hash", "left")
    outcome = F.when(small, F.lit("too_small")).when(F.col("base_hash").isNotNull(), F.lit("near_duplicate")).otherwise(F.lit("unique"))
    return joined.select("hash", outcome.alias("outcome"), F.col("base_hash").alias("similar_to"), "tier")


def sequential_matches(chunks: DataFrame, shards: int = 4, config: SimilarityConfig = SimilarityConfig(), budget: int = 1_000_000) -> DataFrame:
    """The order-dependent search for parity tests, by shard of the hash's first byte.

    Only unique chunks become bases; each shard keeps at most budget/shards of
    them, least recently used first out; a chunk looks only in its own shard. The
    order is that of ``seq`` (null first), then of the hash.

    A chunk that shares no super-feature within its shard neither finds a base nor
    is found as one; it only takes room. So the others alone go through their
    shard's task, each with the number of chunks before it, by which those left
    out count in evictions.
    """
    shard = F.conv(F.substring("hash", 1, 2), 16, 10).cast("int") % shards
    most, room = config.candidates_per_bucket, max(1, budget // shards)
    least = config.least_tier if config.enabled else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, nth = None, None, 0
        for batch in batches:
            rows = []
            for own, h, row, keys in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3)):
                if held is None or own != at:
                    at, held, nth = own, Bases(room), 0
                alone = 0 if row is None else row - nth  # chunks left out, from any beginning
                nth += 1
                held.forget(alone)
                slots = [_slot(k["tier"], k["slot"], k["sf"]) for k in keys.as_py()]
                found = held.best(slots, most)
                if found and found[1] >= least:
                    held.touch(found[0], alone)
                    rows.append((h, *found))
                else:
                    held.add(h, slots, alone)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, MATCH_TYPES)], names=["hash", "base_hash", "tier", "matches"])

    dealt = sequential_rows(chunks.withColumn("shard", shard), room).repartitionById(shards, F.col("shard"))
    ordered = dealt.sortWithinPartitions("shard", "seq", "hash").select("shard", "hash", "row", "keys")
    return ordered.mapInArrow(run, "hash string, base_hash string, tier int, matches int")


def sequential_rows(chunks: DataFrame, room: int) -> DataFrame:
    """The chunks (shard, hash, seq, keys) that share a super-feature, with their row among all; row is null where no shard has over ``room`` chunks."""
    slim = staged(chunks.where("keys is not null").select("shard", "hash", "seq", "keys"), "sequential")
    linked = staged(_sharing(slim), "sequential-linked")
    met = slim.join(_met(linked), "hash", "left_semi")
    fullest = slim.groupBy("shard").count().agg(F.max("count").alias("n")).first()["n"] or 0
    if fullest <= room:  # nothing is evicted
        return met.withColumn("row", F.lit(None).cast("long"))
    numbered, _ = row_numbers(slim.select("shard", "seq", "hash"), ["shard", "seq", "hash"], "row", "sequential-rows")
    return met.join(numbered.join(_met(linked), "hash", "left_semi").select("hash", "row"), "hash")


def _sharing(slim: DataFrame) -> DataFrame:
    """The hashes of chunks with a super-feature that another of their shard has too, whatever its tier and slot."""
    sf = F.array_distinct(F.transform("keys", lambda k: F.xxhash64("shard", k["sf"])))
    slots = slim.select("hash", F.explode(sf).alias("bucket"))
    shared = staged(slots.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "sequential-shared")
    return slots.join(_met(shared), "bucket", "left_semi").select("hash").distinct()


def _met(few: DataFrame) -> DataFrame:
    """``few`` as the right side of a join: by broadcast up to BROADCAST_ROWS, else by exchange."""
    return F.broadcast(few) if few.count() <= BROADCAST_ROWS else few.hint("merge")


MATCH_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32()]


def _slot(tier: int, slot: int, sf: int) -> int:
    """A bucket as one number; its last four bits are the slot, the two before them the tier."""
    return (sf & LOW64) << 6 | tier << 4 | slot


class Bases:
    """Live bases and their buckets, in order of arrival; the least recently used goes first.

    ``alone`` counts the chunks passed by that are bases in no bucket here; each takes room when it comes.
    """

    def __init__(self, room: int):
        self.room = room
        self.live: dict[str, tuple[list[int], int]] = {}  # buckets, and ``alone`` at the last use
        self.index: dict[int, str | dict[str, None]] = {}  # most buckets have one base

    def best(self, slots: list[int], most: int) -> tuple[str, int, int] | None:
        for tier in (3, 2, 1):
            counts: dict[str, int] = {}
            for s in slots:
                if s >> 4 & 3 == tier and (held := self.index.get(s)) is not None:
                    for h in (held,) if isinstance(held, str) else islice(held, most):
                        counts[h] = counts.get(h, 0) + 1
            if counts:
                top = max(counts, key=counts.__getitem__)  # the first of equals
                return top, tier, counts[top]
        return None

    def touch(self, h: str, alone: int) -> None:
        self.live[h] = self.live.pop(h)[0], alone

    def forget(self, alone: int) -> None:
        """Drop the bases after whose last use ``room`` others were used."""
        while self.live:
            oldest, (slots, then) = next(iter(self.live.items()))
            if alone - then + len(self.live) - 1 < self.room:
                return
            del self.live[oldest]
            for s in slots:
                held = self.index[s]
                if isinstance(held, str):
                    del self.index[s]
                else:
                    held.pop(oldest, None)
                    if len(held) == 1:
                        self.index[s] = next(iter(held))

    def add(self, h: str, slots: list[int], alone: int) -> None:
        self.live[h] = slots, alone
        for s in slots:
            held = self.index.get(s)
            if held is None:
                self.index[s] = h
            elif isinstance(held, str):
                self.index[s] = {held: None, h: None}
            else:
                held[h] = None
