"""Best-fit packing of token pieces by hierarchical residuals.

Every task tokenizes its documents and packs their pieces best-fit (longest
first). Bins within ``slack`` of full are final; the others go on as items, with
their contents, to an eighth as many tasks, which pack the bins best-fit again, until one
task would be left or tasks would hold more than ``TASK_ROWS`` pieces. Each round is
written to the shared folder before the next begins.

A document is its ids and one end id. Longer ones than the capacity are cut from
the back, so the first piece is the short one; full pieces are bins at once.

Defined results: a null text is empty and makes one piece of the end id; rows that
share an id are documents of their own; the string of a special token is that token;
a text of any length or of one long run is tokenized whole; an empty table gives an
empty result; bytes that aren't UTF-8 are replaced as Python's decoder does.
"""

from __future__ import annotations

import base64
import importlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.session import staged

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"
ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32", "bin", "offset", "fill")]])
#: Pieces that a task holds at once, here and in merging rounds.
TASK_ROWS = 1_000_000
FAN_IN = 8
#: The contract's vocabulary.
VOCABULARY = "public:byte_bpe_50k.json"
#: Its ranks give the same ids faster, except in texts with a special token; their pattern overflows the stack on whitespace runs of a million.
RANKS = {"public:byte_bpe_50k.json": "byte_bpe_50k.tiktoken"}
LONG_RUN = re.compile(r"\s{10000}")


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Callable[[str], list[int]]:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them. ``vocabulary``: a path, or ``public:NAME`` for a file of the public_tokenizers package."""
    public = importlib.import_module("public_tokenizers") if vocabulary.startswith("public:") else None
    path = public.path(vocabulary[7:]) if public else vocabulary
    if path.endswith(".tiktoken"):
        return _ranked(path)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)

    def whole(text: str) -> list[int]:
        return tok.encode(text, add_special_tokens=False).ids

    if vocabulary not in RANKS:
        return whole
    special = re.compile("|".join(re.escape(t.content) for t in tok.get_added_tokens_decoder().values()))
    ranked = _ranked(public.path(RANKS[vocabulary]))
    return lambda text: whole(text) if special.search(text) or LONG_RUN.search(text) else ranked(text)


def _ranked(path: str) -> Callable[[str], list[int]]:
    import tiktoken

    public = importlib.import_module("public_tokenizers")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: longest first, each into the fullest bin that has room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, 0  # rooms: bit r is set while a bin with r left is open
    bin_of, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if fits := rooms >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, bins = capacity, bins, bins + 1
        bin_of[i], offset[i] = b, capacity - room
        if left := room - size:
            by_room[left].append(b)
            rooms |= 1 << left
    return bin_of, offset


def _first_id(level: int) -> int:
    return level << 58 | TaskContext.get().partitionId() << 34


def _tokenize(vocabulary: str, end_id: int, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at, rows = encoder(vocabulary), _first_id(0), []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode((text.as_py() or b"").decode("utf-8", "replace")), end_id], "<u4")
                rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cuts(len(ids), capacity))]
            if len(rows) >= TASK_ROWS:
                out, at = _packed(rows, at, capacity)
                yield from out.to_batches(max_chunksize=50_000)
                rows = []
        if rows:
            yield from _packed(rows, at, capacity)[0].to_batches(max_chunksize=50_000)

    return run


def _packed(rows: list[tuple], at: int, capacity: int) -> tuple[pa.Table, int]:
    doc_id, piece, start, length, crc = zip(*rows)
    length = np.array(length, np.int64)
    bin_of, offset = best_fit(length, capacity)
    fill = np.bincount(bin_of, weights=length).astype(np.int64)
    columns = [pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length), pa.array(crc, pa.int64()), pa.array(bin_of + at), pa.array(offset), pa.array(fill[bin_of])]
    return pa.Table.from_arrays(columns, schema=ARROW), at + len(fill)


def _merge(level: int, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Underfull bins as items, each moving as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).cast(ARROW)
        _, first, item = np.unique(t["bin"].to_numpy(), return_index=True, return_inverse=True)
        sizes, inside = t["fill"].to_numpy()[first], t["offset"].to_numpy()
        bin_of, offset = best_fit(sizes, capacity)
        fill = np.bincount(bin_of, weights=sizes).astype(np.int64)
        new = {"bin": bin_of[item] + _first_id(level), "offset": inside + offset[item], "fill": fill[bin_of[item]]}
        for name, values in new.items():
            t = t.set_column(ARROW.get_field_index(name), name, pa.array(values))
        yield from t.to_batches(max_chunksize=50_000)

    return run


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, slack: int = 8, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    tasks = max(1, narrow.rdd.getNumPartitions())
    bins = staged(narrow.mapInArrow(_tokenize(vocabulary, end_id, capacity), SCHEMA), "packed-0")
    final, level = [], 0
    while True:
        open_ = bins.where(F.col("fill") < capacity - slack)
        rows = open_.count()
        least = -(-rows // TASK_ROWS)
        if not rows or level and tasks <= max(1, least):
            break
        level, tasks = level + 1, max(1, least, tasks // FAN_IN)
        final.append(bins.where(F.col("fill") >= capacity - slack))
        bins = staged(open_.repartition(tasks, "bin").mapInArrow(_merge(level, capacity), SCHEMA), f"packed-{level}")
    for part in final:
        bins = bins.unionByName(part)
    return bins.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
