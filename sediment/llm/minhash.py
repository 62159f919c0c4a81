"""Near-duplicate groups from SetSketch registers.

A text's set of five-word shingles is sketched into ``REGISTERS`` truncated
minima on an exponential scale: register i holds floor(1 - log_b x) of the least
exponential variate x that hash i gives any shingle. Registers of a union are the
maxima of the parts' registers, so sketches merge. Bands of registers put texts
into buckets; in each bucket texts are paired with its centre, the text that shares most
buckets with most others (a star, never all pairs). Pairs pass on if the joint likelihood of their registers at the
known set sizes peaks near the threshold, and are confirmed by exact set overlap.
Confirmed links join texts to components. Texts of buckets that still hold several
components meet once more, so that a link whose ends both missed the star's centre
is found as well: two sets that are linked share one of the rarest quarter of
their shingles, and where the first shared one stands in the order of rarity bounds
how much they can share, so only texts of different components that pass are paired.

Equal sets are collapsed before all this: one representative per set goes on.

Defined results: words are split at ASCII white space after A-Z are lowered; a text
of one to four words is one shingle; a text without words (or null) has an empty
set and links with nothing; texts of any length go whole; texts that share an id are
documents of their own, and a component goes by the least id of its documents; a null
id takes part as the least id. Shingles are compared
by 64-bit hashes: two different ones are taken as equal with a chance of 5e-20.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.llm.skew import HEAVY, heavy_keys, look_up, look_up_wide
from sediment.session import staged

WIDTH = 5
#: Bands of four 16-bit registers: a link at similarity 0.75 is missed with a chance of 6e-6.
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
#: Pairs whose likelihood peaks below this aren't verified (6 deviations from 0.75).
LEAST_ESTIMATE = 0.5
WORDS_KEPT = 200_000
#: Cells of ids: at most so many rows are broadcast to thin texts out before their exchange.
CELLS = 1 << 20
#: The node of a null id (its negative is a long too).
NO_ID = 1 - (1 << 63)

_seeds = np.random.RandomState(20240607)
XORS = _seeds.randint(0, 1 << 63, REGISTERS, dtype=np.int64).astype(np.uint64)
ODDS = _seeds.randint(0, 1 << 63, REGISTERS, dtype=np.int64).astype(np.uint64) | np.uint64(1)
SPREAD = _seeds.randint(0, 1 << 63, WIDTH, dtype=np.int64).astype(np.uint64) | np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes | None, words: WordHashes) -> np.ndarray:
    """The text's set as ascending 64-bit hashes."""
    tokens = (text or b"").lower().split()  # on bytes: A-Z, and ASCII white space
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(h) - WIDTH + 1)
    acc = np.full(n, min(len(h), WIDTH), np.uint64)
    for j in range(min(len(h), WIDTH)):
        acc = _mixed(acc ^ (h[j : j + n] * SPREAD[j]))
    return np.unique(acc)


def registers(found: np.ndarray) -> np.ndarray:
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(least, ((found[at : at + 1024, None] ^ XORS) * ODDS).min(axis=0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / math.log(BASE)), 0, LIMIT + 1).astype(">u2")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarities of greatest likelihood, for rows of registers and set sizes."""
    plus, minus = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - plus - minus
    u, v = na / (na + nb), nb / (na + nb)
    lo, hi = np.zeros(len(a)), np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        log = lambda x: np.log(np.maximum(x, 1e-12))
        return plus * log(up) + minus * log(down) + same * log(1 - up - down)

    for _ in range(40):  # it is concave: ternary search
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = likelihood(x) < likelihood(y)
        lo, hi = np.where(left, x, lo), np.where(left, hi, y)
    return (lo + hi) / 2


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in batches:
        digest, size, regs = [], [], []
        for text in batch.column(1):
            s = shingles(text.as_py(), words)
            size.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            regs.append(registers(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(regs, pa.binary())], names=["doc_id", "text_key", "digest", "n", "regs"])


def sketches(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text, text_key): doc_id, text_key, digest of its set (null if empty), n, regs (big-endian)."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), "text_key").mapInArrow(_sketch, "doc_id long, text_key long, digest binary, n long, regs binary")


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u2").reshape(-1, REGISTERS).astype(np.int32) for c in ("ra", "rb"))
        na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
        keep = (estimate(a, b, na, nb) >= LEAST_ESTIMATE) & (100 * np.minimum(na, nb) >= 75 * np.maximum(na, nb))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sets = WordHashes(), {}

        def of(doc_id: int, text: bytes) -> np.ndarray:
            if doc_id not in sets:
                if len(sets) >= 256:
                    sets.clear()
                sets[doc_id] = shingles(text, words)
            return sets[doc_id]

        for batch in batches:
            found = []
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                x, y = of(a, ta.as_py()), of(b, tb.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                found.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(found, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, reps: DataFrame, pool: DataFrame, percent: int, name: str) -> DataFrame:
    """Those of the pairs (a < b) that are links: by likelihood first, then by their full sets."""
    r = reps.select("rep", "n", "regs")
    both = _both(pairs, r.toDF("a", "na", "ra"), r.toDF("b", "nb", "rb")).select("a", "b", "na", "nb", "ra", "rb")
    likely = staged(both.mapInArrow(_likely, "a long, b long"), f"{name}-likely")
    met = _both(likely, pool.toDF("a", "ta"), pool.toDF("b", "tb")).select("a", "b", "ta", "tb")
    return staged(met.mapInArrow(_confirmed(percent), "a long, b long"), f"{name}-links")


def _both(pairs: DataFrame, of_a: DataFrame, of_b: DataFrame) -> DataFrame:
    """The pairs with what either end has; an end of many pairs is copied to parts of them."""
    return look_up_wide(look_up_wide(pairs, of_a, "a", "b"), of_b, "b", "a")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per shingle of each text."""
    words = WordHashes()
    for batch in batches:
        held, rows = [], 0
        for rep, component, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            s = shingles(text.as_py(), words)
            held.append((rep, component, s))
            rows += len(s)
            if rows >= 100_000:
                yield _token_rows(held)
                held, rows = [], 0
        if held:
            yield _token_rows(held)


def _token_rows(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    n = np.array([len(s) for *_, s in held])
    columns = [np.repeat([r for r, *_ in held], n), np.repeat([c for _, c, _ in held], n), np.repeat(n, n), np.concatenate([s for *_, s in held]).astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rep", "component", "n", "token"])


def _across(mixed: DataFrame, pool: DataFrame, star: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of different components that may be linked by their rarest shingles; ``mixed``: rep, component."""
    texts = mixed.join(pool, "rep").select("rep", "component", "text")
    tokens = staged(texts.mapInArrow(_tokens, "rep long, component long, n long, token long"), "mixed-shingles")
    # a shingle of one component pairs nothing; it counts by its number only, as rarer than all others
    freq = tokens.groupBy("token").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    freq = staged(freq.select("token", "c"), "shared-shingles")
    heavy = freq.where(F.col("c") * HEAVY > tokens.count()).select("token")
    met = look_up(tokens, freq, "token", heavy)
    own = Window.partitionBy("rep")  # the shared shingles of one text
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("c", "token")) - 1
    # of each text the rarest shingles, one more than a linked set can lack
    left = met.withColumn("place", place).where(F.col("place") <= F.col("n") - F.call_function("div", F.col("n") * percent + 99, F.lit(100)))
    left = staged(left.select("token", "rep", "component", "n", "place"), "rare-shingles")
    x, y = left.toDF("token", "a", "ca", "na", "pa"), left.toDF("token", "b", "cb", "nb", "pb")
    # at the first shingle that two sets share, what follows in the shorter rest bounds their overlap
    enough = (100 + percent) * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= percent * (F.col("na") + F.col("nb"))
    fits = (F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & enough
    pairs = x.join(y, "token").where(fits).select("a", "b").distinct()
    return pairs.join(star, ["a", "b"], "left_anti")


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the ids (both by rep). Texts whose cell holds no id never reach the exchange."""

    def cell(c: str):
        return F.pmod(F.xxhash64(c), F.lit(CELLS)).alias("cell")

    cells = staged(ids.select(cell("rep")).distinct(), "cells")
    near = texts.join(F.broadcast(cells), cell("rep") == cells["cell"], "left_semi")
    return near.join(ids.hint("merge"), "rep", "left_semi")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(rep, component): the least id reachable, for the ends of the links.

    Rounds of hooking every node to its least neighbour's label and of jumping to
    the label's label; each is a few exchanges of narrow rows.
    """
    ends = links.select("a", "b").union(links.select("b", "a")).distinct()
    ends = staged(ends, f"{name}-ends")
    labels = staged(ends.groupBy(F.col("a").alias("rep")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    turn, hot = 0, heavy_keys(ends, "b")
    while True:
        turn += 1
        near = look_up(ends, labels.toDF("b", "there"), "b", hot).groupBy("a").agg(F.min("there").alias("there"))
        hooked = staged(labels.join(near.withColumnRenamed("a", "rep"), "rep").select("rep", F.least("label", "there").alias("label"), F.col("label").alias("was")), f"{name}-hooked-{turn}")
        jumped = look_up(hooked, hooked.select(F.col("rep").alias("label"), F.col("label").alias("on")), "label")  # a label is a node
        after = staged(jumped.select("rep", F.least("label", "on").alias("label"), "was"), f"{name}-{turn}")
        moved = after.where(F.col("label") != F.col("was")).limit(1).count()
        labels = after.select("rep", "label")
        if not moved:
            return labels.withColumnRenamed("label", "component")


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return _grouped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), percent).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept, by row of (doc_id, text)."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = staged(sketches(docs.withColumn("text_key", key)), "sketches")
    names = rows.where("digest is not null").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select(F.col("doc_id").alias("named"))
    names = staged(names, "names-of-several")
    several = names.limit(1).count() > 0
    least = F.lit(NO_ID)
    if several:  # texts that share an id: each is a node with a number of its own, below all ids
        texts = rows.join(names, F.col("doc_id").eqNullSafe(F.col("named")), "left_semi").select("doc_id", "text_key").distinct()
        numbers = staged(texts.select(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key"), (F.monotonically_increasing_id() - (1 << 62)).alias("number")), "numbers-of-several")

        def noded(df: DataFrame) -> DataFrame:
            met = df.join(numbers, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")), "left")
            return met.withColumn("node", F.coalesce("number", "doc_id", least)).drop("of", "of_key", "number")
    else:

        def noded(df: DataFrame) -> DataFrame:
            return df.withColumn("node", F.coalesce("doc_id", least))

    rows = noded(rows)
    reps = staged(rows.where("digest is not null").groupBy("digest").agg(F.min("node").alias("rep"), F.min(F.coalesce("doc_id", least)).alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs")), "set-reps")
    texts = noded(docs.withColumn("text_key", key)).select(F.col("node").alias("rep"), F.col("text").cast("binary").alias("text"))

    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.substring(F.col("regs"), i * (2 * ROWS) + 1, F.lit(2 * ROWS)).alias("key")))
    placed = reps.select("rep", F.explode(bands).alias("x")).select("rep", "x.band", "x.key")
    shared = placed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(placed.join(shared.hint("merge"), ["band", "key"]), "bucket-members")
    pool = staged(_only(texts, members.select("rep").distinct()), "bucket-texts")
    # a group's most typical text shares the most buckets with the most others: it is the centre
    weight = members.groupBy("rep").agg(F.sum("n").alias("weight"))
    weighed = members.join(weight, "rep").select("band", "key", "rep", "weight")
    centre = weighed.groupBy("band", "key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("r"))).alias("top")).select("band", "key", (-F.col("top.r")).alias("centre"))
    rays = members.join(centre.hint("merge"), ["band", "key"]).where("rep <> centre")
    star = staged(rays.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct(), "star")
    links = _verified(star, reps, pool, percent, "star")
    labels = components(links)

    # members of one bucket that the stars left in different components
    of = members.join(labels, "rep", "left").select("band", "key", "rep", F.coalesce("component", "rep").alias("component"))
    torn = of.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band", "key")
    mixed = staged(of.join(torn, ["band", "key"], "left_semi").select("rep", "component").distinct(), "mixed")
    more = _verified(_across(mixed, pool, star, percent), reps, pool, percent, "cross")
    if more.limit(1).count():
        labels = components(links.union(more), "all-components")

    named = reps.join(labels, "rep", "left").select("digest", "id", F.coalesce("component", "rep").alias("component"))
    if several:  # components go by the least id of their documents
        ids = named.groupBy("component").agg(F.min("id").alias("least_id"))
        named = look_up(named, staged(ids, "component-ids"), "component").select("digest", F.col("least_id").alias("component"))
    own = F.coalesce("doc_id", least)
    some = look_up(rows.where("digest is not null"), staged(named, "named-sets"), "digest").select("doc_id", "text_key", "n", "component")
    both = some.unionByName(rows.where("digest is null").select("doc_id", "text_key", "n", F.lit(None).cast("long").alias("component")))
    found = both.withColumn("c", F.coalesce("component", own))
    return found.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("c") == least, F.lit(None)).otherwise(F.col("c")).alias("component_id"), (F.col("c") == own).alias("kept"))


#: Dropped rows that may be broadcast to the scan that filters the texts.
BROADCAST_ROWS = 1_000_000


def drop_near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are kept, with the columns of ``docs``; documents without words all stay, and so do rows that share a kept id and text."""
    found = staged(_grouped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), percent), "near-duplicates")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone"), F.col("text_key").alias("gone_key")).distinct()
    gone = F.broadcast(gone) if found.where(~F.col("kept")).count() <= BROADCAST_ROWS else gone.hint("merge")
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no column of ``docs`` meets a helper column by name
    plain = docs.toDF(*at.values())
    same = F.col(at[id_col]).cast("long").eqNullSafe(F.col("gone")) & (F.xxhash64(F.coalesce(at[text_col], F.lit(""))) == F.col("gone_key"))
    return plain.join(gone, same, "left_anti").select(*[F.col(c).alias(name) for name, c in at.items()])
