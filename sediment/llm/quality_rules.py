"""Document rules with host-level verdicts, in DataFrame functions only.

Each text gets counts (words, symbols, repeated lines, repeated three-word
windows) and three soft rules on them. Failures are added up by host, each
host's failure rate of each rule is shrunk toward an empirical beta prior fitted
over all hosts, and the verdicts go back to the documents. A host's rate is held against
the fitted prior: where that of a soft rule is more than ``watch_spread`` of the prior's
standard deviations above its mean, documents that fail the rule go; at
other hosts one such failure is excused. A host whose rate of any failure is
more than ``reject_spread`` deviations above the mean, and at least ``reject_rate``, loses
all its documents; and a document that fails the base rule goes whatever its host.

Defined results: a null text has no words and fails the base rule; a text of any length is
read whole; a null host is a host of its own; where all hosts have one rate, or there
is one host, no soft failure counts; rows that share an id are judged on their own; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.session import fresh_name, let, staged

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SOFT = ("symbols", "lines", "lengths")
#: Positions share a long with 44 bits of a window's hash; longer texts and collisions take the string path.
PLACE_BITS = 20
#: Host verdicts that may be broadcast: rows, and bytes of their names.
BROADCAST_HOSTS, BROADCAST_BYTES = 100_000, 8_000_000
#: Beyond that, hosts with more than a 4096th of all rows still are: at most so many.
HEAVY_HOSTS = 4096


@dataclass(frozen=True)
class HostPolicy:
    reject_rate: float = 0.5
    reject_spread: float = 4.0
    watch_spread: float = 0.5
    #: Prior observations where the hosts' rates don't spread, and the range of fitted ones.
    strength: float = 100.0
    strength_range: tuple[float, float] = (1.0, 10_000.0)


def words_of(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _covered(starts: Column) -> Column:
    """Words under three-word windows that begin at the ascending ``starts``."""
    steps = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1), p + 3) - p).cast("long"))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)


def _window(words: Column, i: Column) -> Column:
    return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _covered_by_text(words: Column) -> Column:
    """The plain path: sort the windows' strings."""
    windows = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(_window(words, i).alias("w"), i.alias("p"))))

    def found(s):
        twice = F.filter(s, lambda x, i: (x["w"] == F.get(s, i - 1)["w"]) | F.coalesce(x["w"] == F.get(s, i + 1)["w"], F.lit(False)))
        return F.array_sort(F.transform(twice, lambda x: x["p"]))

    return let(let(windows, found), _covered)


def n_repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur at least twice among ``words``."""
    place = F.lit((1 << PLACE_BITS) - 1)

    def packed(i):
        h = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long"))

    hashed = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), packed))

    def same(a, b):
        return F.coalesce(F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS), F.lit(False))

    def repeated(s):
        return F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))

    def counted(r):
        def clash(x, i):
            y = F.get(r, i - 1)
            return same(x, y) & (_window(words, x.bitwiseAND(place).cast("int")) != _window(words, y.bitwiseAND(place).cast("int")))

        starts = F.sort_array(F.transform(r, lambda x: x.bitwiseAND(place)))
        clashes = F.exists(F.transform(r, clash), lambda x: x)
        return F.when(F.size(r) == 0, F.lit(0).cast("long")).when(clashes, _covered_by_text(words)).otherwise(let(starts, _covered))

    n = F.size(words)
    return F.when(n < 4, F.lit(0).cast("long")).when(n >= 1 << PLACE_BITS, _covered_by_text(words)).otherwise(let(let(hashed, repeated), counted))


def with_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one struct column ``__m`` of counts and failures (see :func:`metrics`)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    symbols = F.length(text) - F.length(_without(text, SYMBOLS))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" " + SPACES))) > 0)

    def counts(w):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("n"))).alias("lines"),
            n_repeat_words(w).alias("n_repeat_words"),
        )

    return docs.withColumn(fresh_name(docs, "__m"), let(words_of(text), counts))


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def judged(docs: DataFrame, text_col: str, host_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` as __d_0, __d_1, ..., then host, counts, base_failed and the soft failures; written once."""
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no column of ``docs`` meets a helper column by name
    x = lambda c: F.col(f"__m.{c}")
    rows = with_metrics(docs.toDF(*at.values()), at[text_col]).select(
        *[F.col(at[c]).alias(f"__d_{i}") for i, c in enumerate(keep)],
        F.col(at[host_col]).cast("string").alias("__host"),
        x("n_words").alias("n_words"), x("word_chars").alias("word_chars"), x("n_symbols").alias("n_symbols"),
        x("lines.dup").alias("n_dup_lines"), x("lines.n").alias("__lines"), x("n_repeat_words").alias("n_repeat_words"),
    )
    n = F.col("n_words")
    return rows.select(
        "*",
        ((n < 50) | (100 * F.col("n_repeat_words") > 50 * n)).alias("base_failed"),
        (10 * F.col("n_symbols") > n).alias("f_symbols"),
        (10 * F.col("n_dup_lines") > 3 * F.col("__lines")).alias("f_lines"),
        ((F.col("word_chars") > 12 * n) | (F.col("word_chars") < 2 * n)).alias("f_lengths"),
    )


def host_verdicts(rows: DataFrame, policy: HostPolicy) -> DataFrame:
    """Every host's verdicts: __h (null-safe key), __n (its rows), v_reject, v_symbols, v_lines, v_lengths."""
    rules = {"any": F.col("base_failed") | F.col("f_symbols") | F.col("f_lines") | F.col("f_lengths")} | {r: F.col(f"f_{r}") for r in SOFT}
    hosts = rows.groupBy("__host").agg(F.count("*").alias("n"), *[F.sum(c.cast("long")).alias(r) for r, c in rules.items()])
    hosts = staged(hosts, "host-rates")
    spread = hosts.agg(*[f(F.col(r) / F.col("n")).alias(f"{k}_{r}") for r in rules for k, f in (("m", F.avg), ("v", F.var_pop))]).first()
    against = {}
    for r in rules:
        a, s = beta_prior(spread[f"m_{r}"], spread[f"v_{r}"], policy)
        mean = a / s
        deviation = math.sqrt(mean * (1 - mean) / (s + 1))
        rate = (F.col(r) + F.lit(a)) / (F.col("n") + F.lit(s))
        against[r] = rate > mean + (policy.reject_spread if r == "any" else policy.watch_spread) * deviation
        if r == "any":
            against[r] &= rate >= policy.reject_rate
    return hosts.select(F.col("__host").alias("__h"), F.col("n").alias("__n"), against["any"].alias("v_reject"), *[against[r].alias(f"v_{r}") for r in SOFT])


def beta_prior(mean: float | None, var: float | None, policy: HostPolicy) -> tuple[float, float]:
    """Moments of the hosts' rates as (alpha, alpha + beta)."""
    mean, var = mean or 0.0, var or 0.0
    room = mean * (1 - mean)
    low, high = policy.strength_range
    strength = min(high, max(low, room / var - 1)) if 0 < var < room else policy.strength
    return mean * strength, strength


def _met(rows: DataFrame, policy: HostPolicy) -> DataFrame:
    hosts = staged(host_verdicts(rows, policy), "host-verdicts")
    verdicts = hosts.where(F.col("v_reject") | F.col("v_symbols") | F.col("v_lines") | F.col("v_lengths"))
    size = verdicts.agg(F.count("*").alias("n"), F.sum(F.octet_length("__h")).alias("b")).first()
    same = F.col("__host").eqNullSafe(F.col("__h"))
    if size["n"] <= BROADCAST_HOSTS and (size["b"] or 0) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(verdicts), same, "left")
    else:
        total = hosts.agg(F.sum("__n")).first()[0]
        heavy = F.broadcast(hosts.where(F.col("__n") * HEAVY_HOSTS > total))
        light = rows.join(heavy, same, "left_anti").join(verdicts.hint("merge"), same, "left")
        joined = rows.join(heavy, same).unionByName(light)
    no = F.lit(False)
    against = F.coalesce(F.col("v_reject"), no)
    for r in SOFT:
        against = against | (F.col(f"f_{r}") & F.coalesce(F.col(f"v_{r}"), no))
    return joined.withColumn("kept", ~F.col("base_failed") & ~against).withColumn("host_rejected", F.coalesce(F.col("v_reject"), no))


def quality_report(docs: DataFrame, policy: HostPolicy = HostPolicy(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: doc_id, counts, base_failed, kept, host_rejected."""
    rows = staged(judged(docs, text_col, host_col, [id_col]), "quality")
    return _met(rows, policy).select(F.col("__d_0").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


def filter_documents(docs: DataFrame, policy: HostPolicy = HostPolicy(), text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that pass, with the columns of ``docs``; their texts are read and written once."""
    rows = staged(judged(docs, text_col, host_col, docs.columns), "quality")
    return _met(rows, policy).where("kept").select(*[F.col(f"__d_{i}").alias(c) for i, c in enumerate(docs.columns)])
