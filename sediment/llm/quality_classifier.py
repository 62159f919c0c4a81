"""Quality scores from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation
maximisation over the counts of vote patterns (of all documents; at most 3 to the
number of labellers) estimates how each labeller votes on good and on bad
documents and the share of good ones; a pattern's posterior is the label of its
documents. What a labeller is built for bounds how often it may call a good
document bad, which fixes the classes: junk of several kinds, each seen by few
labellers, is one class against them all. Posterior labels
of a bounded sample train a linear scorer on hashed features, and the scorer runs
over every whole text.

Defined results: a null or empty text votes bad by length and gets a score like
any other; texts of any length are scored whole; rows that share an id are scored on
their own, and the least of their texts trains; an empty table gives an
empty result; without any votes for or against, posteriors are one half. Scores don't
depend on how the rows are dealt to partitions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.session import staged

GOOD, BAD, NONE = 1, 0, 2
#: Labellers, and the greatest share of good documents that each may call bad.
LABELLERS = {"length": 0.2, "symbols": 0.002, "case": 0.002, "lines": 0.01, "variety": 0.002, "punctuation": 0.2, "letters": 0.005, "rhythm": 0.01}
WORDS_KEPT = 200_000


@dataclass(frozen=True)
class ScorerConfig:
    dims: int = 1 << 15
    #: Documents that train the scorer: those least by a hash of their ids; longer texts (in bytes) don't train.
    sample: int = 6000
    longest_training_text: int = 32_000
    rounds: int = 120
    rate: float = 0.5
    decay: float = 1e-4
    keep_from: float = 0.5


class Measured:
    """What labellers and features see of one text."""

    def __init__(self, text: bytes):
        self.words = text.split()
        self.n = len(self.words)
        lines = [x for x in text.split(b"\n") if x.strip()]
        self.lines, self.dup = len(lines), len(lines) - len(set(lines))
        self.ended = sum(x.rstrip()[-1:] in b".!?" and not x.rstrip().endswith(b"!!") for x in lines)
        self.distinct = len(set(self.words))
        self.symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
        self.upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        self.letters = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
        self.high = len(text) - len(text.translate(None, bytes(range(128, 256))))
        self.space = len(text) - sum(map(len, self.words))
        self.size = len(text)


def votes(m: Measured) -> tuple[int, ...]:
    """One vote a labeller, in the order of LABELLERS."""
    n, solid = max(m.n, 1), max(m.size - m.space, 1)
    mean = (m.size - m.space) / n

    def between(x: float, bad_below: float, good_from: float) -> int:
        return BAD if x < bad_below else GOOD if x >= good_from else NONE

    return (
        between(m.n, 5, 80),
        between(-m.symbols / n, -0.1, -0.02),
        between(-m.upper / solid, -0.3, -0.1),
        between(-m.dup / max(m.lines, 1), -0.3, -0.05) if m.lines > 3 else NONE,
        between(m.distinct / math.sqrt(2 * n), 2, 4) if m.n >= 50 else NONE,
        between(m.ended / max(m.lines, 1), 0.3, 0.7),
        between((m.letters + m.high) / solid, 0.7, 0.85),
        BAD if mean > 12 or mean < 2.5 else GOOD if 3 <= mean <= 10 else NONE,
    )


def pattern(given: tuple[int, ...]) -> int:
    return sum(v * 3**j for j, v in enumerate(given))


def expectation_maximisation(counts: dict[int, int], bounds: list[float] | None = None, rounds: int = 200) -> tuple[np.ndarray, float, dict[int, float]]:
    """(vote shares [labeller, truth, vote], share of good, posterior of good by pattern).

    Shares are of the votes given; to abstain says nothing. ``bounds``: greatest
    share of bad votes on good documents, by labeller.
    """
    bounds = list(LABELLERS.values()) if bounds is None else bounds
    codes = sorted(counts)
    weight = np.array([counts[c] for c in codes], float)
    given = np.array([[c // 3**j % 3 for j in range(len(bounds))] for c in codes], int).reshape(len(codes), len(bounds))
    shares = np.ones((len(bounds), 2, 3))
    shares[:, GOOD, BAD], shares[:, BAD, BAD] = bounds, 0.5
    shares[:, :, GOOD] = 1 - shares[:, :, BAD]
    prior, post = 0.8, np.full(len(codes), 0.5)
    for _ in range(rounds if codes else 0):
        log = np.log(shares)
        good, bad = (math.log(p) + sum(log[j, t][given[:, j]] for j in range(len(bounds))) for p, t in ((prior, GOOD), (1 - prior, BAD)))
        post = 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))
        prior = float(np.clip((weight * post).sum() / weight.sum(), 0.02, 0.98))
        for truth, mass in ((GOOD, weight * post), (BAD, weight * (1 - post))):
            for j, most in enumerate(bounds):
                found = np.bincount(given[:, j], mass, minlength=3)[:2] + 0.5
                share = found[BAD] / found.sum()
                share = min(share, most) if truth == GOOD else share
                shares[j, truth, BAD], shares[j, truth, GOOD] = share, 1 - share
    return shares, prior, dict(zip(codes, post.tolist()))


def accuracies(shares: np.ndarray, prior: float) -> np.ndarray:
    """How often each labeller is right when it votes."""
    right = prior * shares[:, GOOD, GOOD] + (1 - prior) * shares[:, BAD, BAD]
    wrong = prior * shares[:, GOOD, BAD] + (1 - prior) * shares[:, BAD, GOOD]
    return right / (right + wrong)


_SHAPES = [(re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0")]


class FeatureHashes(dict):
    """Word -> (slot of the word, slot of its shape)."""

    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= WORDS_KEPT:
            self.clear()
        shape = word
        for pat, sign in _SHAPES:
            shape = pat.sub(sign, shape)
        found = self[word] = (xxhash.xxh3_64_intdigest(word.lower()) % self.dims, xxhash.xxh3_64_intdigest(b"shape " + shape[:12]) % self.dims)
        return found


def text_features(m: Measured, dims: int) -> list[int]:
    """Slots that a text has once, whatever its length."""
    n = max(m.n, 1)
    named = [("length", int(math.log2(n + 1))), ("dup", int(8 * m.dup / max(m.lines, 1))), ("variety", int(8 * m.distinct / n)), ("ended", int(4 * m.ended / max(m.lines, 1))), ("upper", int(20 * m.upper / max(m.size, 1))), ("symbols", int(10 * min(2, m.symbols / n)))]
    return [xxhash.xxh3_64_intdigest(f"text {k} {v}".encode()) % dims for k, v in named]


def features(m: Measured, hashes: FeatureHashes) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): shares of words and shapes, and the text's own slots."""
    slots = np.array([s for w in m.words for s in hashes[w]], np.int64)
    found, counts = np.unique(slots, return_counts=True)
    own = np.array(text_features(m, hashes.dims), np.int64)
    return np.concatenate([found, own]), np.concatenate([counts / max(m.n, 1), np.ones(len(own))])


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, config: ScorerConfig) -> tuple[np.ndarray, float]:
    """(weights, bias) of the logistic scorer, by full gradient steps scaled per slot."""
    weights, bias = np.zeros(config.dims), 0.0
    if not rows:
        return weights, bias
    row = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
    slot, value = np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows])
    squares, bias_square = np.full(config.dims, 1e-8), 1e-8
    for _ in range(config.rounds):
        z = np.bincount(row, value * weights[slot], minlength=len(rows)) + bias
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(rows)
        g = np.bincount(slot, value * off[row], minlength=config.dims) + config.decay * weights
        squares += g * g
        weights -= config.rate * g / np.sqrt(squares)
        bias_square += off.sum() ** 2
        bias -= config.rate * off.sum() / math.sqrt(bias_square)
    return weights, bias


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [pattern(votes(Measured(t.as_py() or b""))) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64())], names=["doc_id", "pattern"])


def _featurize(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = FeatureHashes(dims)
        for batch in batches:
            seen = [Measured(t.as_py() or b"") for t in batch.column(1)]
            found = [features(m, hashes) for m in seen]
            slots, shares = ([x.astype(kind).tobytes() for x in column] for column, kind in zip(zip(*found) if found else ((), ()), (np.int32, np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots, pa.binary()), pa.array(shares, pa.binary()), pa.array([pattern(votes(m)) for m in seen], pa.int64())], names=["doc_id", "slots", "shares", "pattern"])

    return run


def _score(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = FeatureHashes(len(weights))
        known: dict[bytes, float] = {}
        for batch in batches:
            scores = []
            for t in batch.column(1):
                m, total = Measured(t.as_py() or b""), 0.0
                for w in m.words:
                    x = known.get(w)
                    if x is None:
                        if len(known) >= WORDS_KEPT:
                            known.clear()
                        a, b = hashes[w]
                        x = known[w] = float(weights[a] + weights[b])
                    total += x
                z = total / max(m.n, 1) + sum(weights[s] for s in text_features(m, len(weights))) + bias
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def fit(docs: DataFrame, config: ScorerConfig = ScorerConfig(), id_col: str = "doc_id", text_col: str = "text"):
    """(weights, bias, posterior by pattern): votes of all documents, features of the sample."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    voted = staged(narrow.mapInArrow(_vote, "doc_id long, pattern long"), "votes")
    counts = {r["pattern"]: r["count"] for r in voted.groupBy("pattern").count().collect()}  # at most 3^labellers
    _, _, post = expectation_maximisation(counts)
    short = narrow.where("doc_id is not null").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= config.longest_training_text)
    ids = short.select("doc_id").distinct().withColumn("h", F.xxhash64("doc_id"))
    picked = staged(ids.orderBy("h", "doc_id").limit(config.sample).select("doc_id"), "sample")
    texts = short.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(b""))).alias("text"))
    rows = texts.mapInArrow(_featurize(config.dims), "doc_id long, slots binary, shares binary, pattern long").collect()  # the sample
    rows = sorted(rows, key=lambda r: r["doc_id"])
    found = [(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in rows]
    weights, bias = train(found, np.array([post[r["pattern"]] for r in rows]), config)
    return weights, bias, post, voted


def score_documents(docs: DataFrame, config: ScorerConfig = ScorerConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score, kept."""
    weights, bias, _, _ = fit(docs, config, id_col, text_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    scored = narrow.mapInArrow(_score(weights.astype(np.float32), bias), "doc_id long, score double")
    return scored.withColumn("kept", F.col("score") >= config.keep_from)
