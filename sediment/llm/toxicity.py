"""Toxicity by compression distance.

Separate zstandard raw-content dictionaries are trained on toxic and on ordinary
text, as ``pairs`` pairs of equal size. Training texts of either class are dealt into
as many folds; a pair holds whole windows of its fold's toxic texts in one
dictionary and of its fold's ordinary texts in the other, behind a background of ordinary
windows that both share. Which windows stand there is found by compression alone:
the windows of a fold are ranked by how many bytes the other folds' pairs save on
them (the second least of those savings, so that what only one other fold holds,
such as a copy, doesn't count), those saved most enter the next round's pairs, and of ordinary
text those that were wrongly saved.

A window of a text is compressed with each pair; what it saves is the mean over the
pairs without the third that save most. Windows on which the first pair saves
nothing, or the first two less than two bytes, count as nothing saved. The largest
savings of a text and how many and which share of its windows save a byte or more go
through a logistic calibration, fitted on labelled documents that trained no
dictionary and weighted to the share of toxic documents among all labels.

Labels, language, source and id never enter a score. Training uses a bounded
sample of labelled rows (``ToxicConfig``); scoring reads whole texts.

Defined results: a null or empty text has one empty window and gets the score of
no evidence; without labelled rows of both classes every score is the share of
toxic rows among the labels (0 without labels); rows that share an id are scored
on their own, and the least of their texts trains; a document with several labels is
toxic if one of them says so; a label that is null is no label; texts of any length
are scored whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.session import staged

TABLE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Windows that are compressed together, one dictionary after the other.
BATCH_WINDOWS = 4096


@dataclass(frozen=True)
class ToxicConfig:
    #: Labelled rows that train: those least by a hash of their ids, of either class; longer texts (in bytes) don't train.
    toxic_sample: int = 2400
    ordinary_sample: int = 6000
    longest_training_text: int = 32_000
    #: Words in a window.
    window: int = 6
    #: Pairs of dictionaries, fewer where a fold would have less toxic texts than this.
    pairs: int = 5
    fold_texts: int = 4
    #: Windows of a fold that are ranked.
    fold_windows: int = 6000
    #: Bytes of the shared background, and of a dictionary's own windows.
    background: int = 60_000
    own: int = 16_000
    #: Rounds of ranking, and bytes saved from which a toxic window stays.
    rounds: int = 2
    least_saved: int = 2
    predicted_from: float = 0.7


def windows(text: str | None, size: int) -> list[bytes]:
    words = (text or "").lower().encode("utf-8", "replace").translate(TABLE).split()
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)] or [b" "]


def _compressor(dictionary: bytes):
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    # faster strategies index every third place of a dictionary, so a match would count by where it happens to stand
    params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTOPT, min_match=4, search_log=4, window_log=17, hash_log=15, chain_log=15, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress


def _saved(cut: list[bytes], toxic, ordinary) -> np.ndarray:
    """Bytes that the toxic dictionary saves on each window."""
    return np.fromiter(map(len, map(ordinary, cut)), np.int64, len(cut)) - np.fromiter(map(len, map(toxic, cut)), np.int64, len(cut))


def savings(cut: list[bytes], pairs: list[tuple]) -> np.ndarray:
    """What each window saves over all pairs of compressors."""
    left, found = np.arange(len(cut)), np.empty((len(cut), 0))
    for k, pair in enumerate(pairs):
        found = np.column_stack([found, _saved([cut[i] for i in left], *pair)])
        if k < 2:
            able = found.sum(1) > k
            left, found = left[able], found[able]
    out = np.zeros(len(cut))
    out[left] = np.sort(found, axis=1)[:, : -(-2 * len(pairs) // 3)].mean(1)
    return out


def evidence(saved: np.ndarray) -> list[float]:
    top = [max(0.0, x) for x in np.sort(saved)[:-4:-1].tolist()] + [0.0, 0.0]
    counts = [int((saved >= least).sum()) for least in (1, 2, 3, 5)]
    n = len(saved)
    return [*top[:3], *map(math.log1p, counts), *(20 * c / max(n, 20) for c in counts[1:3]), math.log(n + 1), 1.0]


@dataclass(frozen=True)
class ToxicModel:
    #: (toxic, ordinary) dictionaries.
    pairs: tuple[tuple[bytes, bytes], ...]
    weights: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]
    config: ToxicConfig

    def scorer(self):
        """A function from texts to their scores."""
        pairs = [(_compressor(t), _compressor(o)) for t, o in self.pairs]
        w, c, s = (np.array(x) for x in (self.weights, self.center, self.scale))

        def score(texts: list[str | None]) -> list[float]:
            if not pairs:
                return [self.weights[0]] * len(texts)
            cut = [windows(t, self.config.window) for t in texts]
            z = (np.array(_evidence(cut, pairs)) - c) / s @ w
            return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()

        return score


def _evidence(docs: list[list[bytes]], pairs: list[tuple]) -> list[list[float]]:
    ends = np.cumsum([len(d) for d in docs])
    return [evidence(x) for x in np.split(savings([w for d in docs for w in d], pairs), ends[:-1])]


def _joined(cut: list[bytes], size: int) -> bytes:
    """``size`` bytes of windows, the first at the end."""
    held, n = [], 0
    for w in cut:
        if n >= size:
            break
        held.append(w)
        n += len(w)
    return b"".join(held[::-1])[-size:] if size else b""


def train_pairs(toxic: list[list[bytes]], ordinary: list[list[bytes]], config: ToxicConfig, rng: random.Random) -> list[tuple[bytes, bytes]]:
    """(toxic, ordinary) dictionaries from the windows of texts of either class."""
    n = max(1, min(config.pairs, len(toxic) // config.fold_texts))

    def folds(docs: list[list[bytes]]) -> list[list[bytes]]:
        seen, out = set(), []
        for k in range(n):  # a window counts for the first fold that has it
            own = [w for w in dict.fromkeys(w for d in docs[k::n] for w in d) if w not in seen]
            seen.update(own)
            rng.shuffle(own)
            out.append(own[: config.fold_windows])
        return out

    sides = folds(toxic), folds(ordinary)
    pool = [w for fold in sides[1] for w in fold]
    background = _joined(rng.sample(pool, len(pool)), config.background)
    ranked = [list(side) for side in sides]
    for turn in range(config.rounds + 1):
        pairs = []
        for t, o in zip(*ranked):
            size = min(config.own, sum(map(len, t)), sum(map(len, o)))
            pairs.append((background + _joined(t, size), background + _joined(o, size)))
        if turn == config.rounds or n == 1:
            return pairs
        able = [(_compressor(t), _compressor(o)) for t, o in pairs]
        for side, least in ((0, config.least_saved), (1, None)):
            for k, fold in enumerate(sides[side]):
                others = np.sort([_saved(fold, *pair) for j, pair in enumerate(able) if j != k], axis=0)[(n - 1) // 4]
                order = np.argsort(-others, kind="stable")
                if least is not None and (others >= least).any():
                    order = order[: int((others >= least).sum())]
                ranked[side][k] = [fold[i] for i in order]


def fit(toxic: list[str], ordinary: list[str], share: float, config: ToxicConfig = ToxicConfig(), seed: int = 3) -> ToxicModel:
    """Dictionaries from two thirds of either class, calibration from the rest."""
    if not toxic or not ordinary:
        return ToxicModel((), (share,), (0.0,), (1.0,), config)
    rng = random.Random(seed)
    cut = [[windows(t, config.window) for t in rng.sample(texts, len(texts))] for texts in (toxic, ordinary)]
    learn, rest = [[x for i, x in enumerate(c) if i % 3] for c in cut], [[x for i, x in enumerate(c) if not i % 3] for c in cut]
    pairs = train_pairs(*(x or y for x, y in zip(learn, rest)), config, rng)
    able = [(_compressor(t), _compressor(o)) for t, o in pairs]
    x = np.array([e for part in rest for e in _evidence(part, able)])
    y = np.repeat([1.0, 0.0], [len(rest[0]), len(rest[1])])
    importance = np.where(y == 1, share / len(rest[0]), (1 - share) / len(rest[1])) * len(y)
    center, scale = x.mean(0), x.std(0) + 1e-9
    center[-1], scale[-1] = 0.0, 1.0
    z, w = (x - center) / scale, np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps, slightly ridged
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (importance * (p - y)) + 1e-2 * w
        w = w - np.linalg.solve((z * (importance * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w)), g)
    return ToxicModel(tuple(pairs), tuple(w.tolist()), tuple(center.tolist()), tuple(scale.tolist()), config)


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, config: ToxicConfig = ToxicConfig()) -> ToxicModel:
    """From labelled rows whose crc32(doc_id) mod 3 isn't 1."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(remainder(F.col("doc_id")) != 1)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic") > 0).alias("toxic"))
    known = staged(known, "toxic-labels")
    size = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = size.get(True, 0) / max(1, sum(size.values()))
    picked = None
    for value, most in ((True, config.toxic_sample), (False, config.ordinary_sample)):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    picked = staged(picked, "toxic-sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= config.longest_training_text)
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()  # at most both samples
    rows = sorted(rows, key=lambda r: r["doc_id"])
    unique = [list(dict.fromkeys(r["text"] for r in rows if r["toxic"] == value)) for value in (True, False)]
    return fit(*unique, share, config)


def score_documents(docs: DataFrame, labels: DataFrame, config: ToxicConfig = ToxicConfig()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            scores, held, words = [], [], 0
            for t in batch.column(1):
                held.append(t.as_py())
                words += len(held[-1] or "") // 6
                if words >= BATCH_WINDOWS * config.window:
                    scores += score(held)
                    held, words = [], 0
            scores += score(held) if held else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= config.predicted_from).cast("int").alias("predicted"))
