import importlib
import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from sediment.llm import mixing, packing


def mixture(df, **options):
    placed, (s, epoch, block, slot, place) = mixing.mix(df, **options)
    return [(r["doc_id"], r[s], r[epoch], r[block], r[slot], r[place]) for r in placed.collect()]


@pytest.fixture(scope="module")
def three(spark):
    rows = [(i, "a") for i in range(100)] + [(1000 + i, "b") for i in range(40)] + [(2000 + i, None) for i in range(10)]
    return spark.createDataFrame(rows, "doc_id long, source string").repartition(4)


def earliest_deadline_first(shares, blocks):
    """Slots by the rule in exact fractions, until every source has placed its blocks."""
    total, done, out = sum(shares), [0] * len(shares), []
    while any(d < b for d, b in zip(done, blocks)):
        w = [Fraction(p, total) for p in shares]
        ready = [(math.ceil((d + 1) / x), i) for i, (d, x) in enumerate(zip(done, w)) if math.floor(d / x) <= len(out)]
        i = min(ready)[1]
        out.append((i, done[i]))
        done[i] += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "": 0.2}, {"a": 0.3335, "b": 0.3335, "": 0.333}, {"a": 7, "b": 1, "": 90}])
def test_schedule_against_brute_force(three, weights):
    rows = mixture(three, weights=weights, block_rows=4)
    one = mixing.shared_out(three.selectExpr("coalesce(source, '') source").groupBy("source").count().withColumnRenamed("count", "n"), 0.7, weights).first()
    shares = [r["share"] for r in one["sources"]]
    exact = [Fraction(str(weights[s])) for s in sorted(weights)]
    assert sum(shares) == one["fine"] and [Fraction(p, one["fine"]) for p in shares] == [w / sum(exact) for w in exact]
    want = earliest_deadline_first(shares, [3, 25, 10])
    assert sorted({(r[4], sorted(weights).index(r[1]), r[3]) for r in rows}) == [(t, i, k) for t, (i, k) in enumerate(want)]
    done = Counter()
    for t, (i, _) in enumerate(want):
        done[sorted(weights)[i]] += 1
        assert all(abs(done[s] - (t + 1) * w / sum(exact)) < 1 for s, w in zip(sorted(weights), exact))


def test_deviation_from_target_weights_over_100000_slots(spark):
    weights = {"a": 0.3335, "b": 0.3335, "c": 0.333 - 1 / 90_000, "d": 1 / 90_000}
    sizes = spark.createDataFrame([("a", 40_000), ("b", 40_000), ("c", 40_000), ("d", 1)], "source string, n long")
    sources = mixing.shared_out(sizes, 0.7, weights)
    slots = mixing._slots_needed(sources, 1)
    laid = sorted((r["slot"], r["i"], r["nth"]) for r in mixing.laid_out(mixing.staged(sources, "test"), slots, 1).collect())
    assert len(laid) > 100_000 and [t for t, *_ in laid] == list(range(len(laid)))
    order = np.array([i for _, i, _ in laid])
    for i, w in enumerate(weights.values()):
        gone = np.cumsum(order == i)
        assert np.abs(gone - w * np.arange(1, len(laid) + 1)).max() < 1 + 1e-6
        assert [k for _, j, k in laid if j == i] == list(range(gone[-1]))


def test_every_row_is_placed_and_epochs_repeat_whole_blocks(three):
    rows = mixture(three, weights={"a": 0.5, "b": 0.3, "": 0.2}, block_rows=4)
    ids = {r["doc_id"] for r in three.collect()}
    assert {r[0] for r in rows} == ids
    assert len({(r[4], r[5]) for r in rows}) == len(rows)
    first = Counter(r[0] for r in rows if r[2] == 0)
    assert set(first) == ids and set(first.values()) == {1}
    by_block = defaultdict(set)
    for d, s, e, b, slot, _ in rows:
        by_block[s, b].add(slot)
        assert len(by_block[s, b]) == 1


def test_mixing_edges(spark, empty, clashing, docs):
    assert mixture(empty) == []
    assert {r[0] for r in mixture(docs)} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    out = mixing.mixed(clashing)
    assert out.columns == clashing.columns and out.count() >= clashing.count()
    with pytest.raises(ValueError, match="s1"):
        mixture(docs, weights={"": 1.0, "s0": 1.0})
    with pytest.raises(ValueError):
        mixture(docs, weights=dict.fromkeys(["", "s0", "s1", "s2", "s3"], 0.0))
    with pytest.raises(ValueError, match="slots"):
        mixture(docs, weights={"": 1.0, "s0": 1.0, "s1": 1.0, "s2": 1.0, "s3": 1e-9})


def test_mixing_with_clashing_names(spark):
    names = ["doc_id", "source", "blocks", "nth", "slot", "i", "key", "seq", "place", "__s", "__part", "__slot", "__source", "of", "b", "named", "c0", "a`b", "release"]
    df = spark.createDataFrame([(k, f"s{k % 2}", *range(17)) for k in range(50)], ", ".join(f"`{c.replace('`', '``')}` long" if c != "source" else "source string" for c in names))
    out = mixing.mixed(df, block_rows=4)
    assert out.columns == names and {r["doc_id"] for r in out.collect()} == set(range(50)) and {tuple(r)[2:] for r in out.collect()} == {tuple(range(17))}


def test_blocks_grow_so_that_slots_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SLOTS", 20)
    df = spark.range(1000).selectExpr("id doc_id", "case when id % 3 = 0 then 'a' else 'b' end source")
    rows = mixture(df, block_rows=4)
    assert {r[0] for r in rows} == set(range(1000)) and max(r[4] for r in rows) < 40


def test_any_number_of_sources(spark):
    df = spark.range(2500).selectExpr("id doc_id", "case when id < 1200 then concat('s', id) else 'big' end source")
    rows = mixture(df, block_rows=4)
    assert {r[0] for r in rows} == set(range(2500)) and Counter(r[2] for r in rows)[0] == 2500
    assert sorted({r[4] for r in rows}) == list(range(max(r[4] for r in rows) + 1))


def test_long_mixtures_hold_the_exact_weights(spark):
    weights = {"a": 0.6786, "b": 0.32, "c": 0.0014}
    df = spark.createDataFrame([(i, "c" if i < 8 else "ab"[i % 2]) for i in range(600)], "doc_id long, source string")
    rows = mixture(df, weights=weights, block_rows=1)
    assert len({r[4] for r in rows}) == len(rows) == max(r[4] for r in rows) + 1 > 5000 and {r[0] for r in rows} == set(range(600))
    done = Counter()
    for t, r in enumerate(sorted(rows, key=lambda r: r[4])):
        done[r[1]] += 1
        assert all(abs(done[s] - (t + 1) * Fraction(str(w))) < 1 for s, w in weights.items())
    placed, _ = mixing.mix(df, weights=weights, block_rows=1)
    assert not any(x in placed._jdf.queryExecution().toString() for x in ("Python", "Pandas", "MapInArrow"))


def test_mixing_is_native(spark, docs):
    placed, _ = mixing.mix(docs)
    plan = placed._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))


def test_best_fit_fills():
    sizes = np.array([600, 424, 1000, 24, 512, 512, 1])
    bins, offset = packing.best_fit(sizes, 1024)
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= 1024 and len(fill) == 4
    for b in set(bins):
        at = sorted((offset[i], sizes[i]) for i in np.flatnonzero(bins == b))
        assert all(x + n == y for (x, n), (y, _) in zip(at, at[1:])) and at[0][0] == 0


def test_cuts():
    assert packing.cuts(1024, 1024) == [(0, 1024)]
    assert packing.cuts(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]


def pieces(df, **options):
    return packing.pack(df, **options).collect()


def test_packing_against_brute_force(spark, docs, corpus):
    tokenizers, public = importlib.import_module("tokenizers"), importlib.import_module("public_tokenizers")
    tok = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows, by_doc, by_seq = pieces(docs), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == {i for i, *_ in corpus}
    total = 0
    for i, t, *_ in corpus:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        total += len(ids)
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in own] == packing.cuts(len(ids), 1024)
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own]
    for held in by_seq.values():
        held.sort()
        assert held[0][0] == 0 and sum(n for _, n in held) <= 1024
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:]))
    assert len(by_seq) <= 1.02 * total / 1024 + 2


def test_packing_merges_across_tasks(spark):
    df = spark.createDataFrame([(i, "word " * (200 + i % 300)) for i in range(400)], "doc_id long, text string").repartition(64)
    rows = pieces(df)
    alone = packing.best_fit(np.array([r["length"] for r in rows]), 1024)[0].max() + 1
    assert len({r["sequence_id"] for r in rows}) <= 1.05 * alone + 1


def test_merging_moves_bins_whole(monkeypatch):
    monkeypatch.setattr(packing, "_first_id", lambda level: level << 58)
    rng = np.random.RandomState(5)
    rows = [(i, 0, 0, int(n), 7) for i, n in enumerate(rng.randint(1, 500, 200))]
    table = pa.concat_tables([packing._packed(rows[:100], 0, 1024)[0], packing._packed(rows[100:], 1000, 1024)[0]])
    merged = pa.Table.from_batches(packing._merge(1, 1024)(iter(table.to_batches())))
    old = defaultdict(dict)
    for r in table.to_pylist():
        old[r["bin"]][r["doc_id"]] = r["offset"]
    new = {r["doc_id"]: (r["bin"], r["offset"], r["fill"]) for r in merged.to_pylist()}
    for held in old.values():
        assert len({new[d][0] for d in held}) == 1 and len({new[d][1] - at for d, at in held.items()}) == 1
    by_bin = defaultdict(list)
    for (d, *_), (b, at, fill) in zip(rows, (new[r[0]] for r in rows)):
        by_bin[b].append((at, rows[d][3], fill))
    for held in by_bin.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n, _), (b, *_) in zip(held, held[1:])) and sum(n for _, n, _ in held) == held[0][2] <= 1024


def test_packing_edges(spark, empty, clashing):
    assert pieces(empty) == []
    odd = spark.createDataFrame([(1, None), (1, ""), (2, "a" * 20_000), (3, " " * 1_000_000), (4, "<|endoftext|>"), (None, "x")], "doc_id long, text string")
    rows = pieces(odd)
    assert len([r for r in rows if r["doc_id"] == 1]) == 2 and all(r["length"] == 1 for r in rows if r["doc_id"] == 1)
    assert len({r["doc_id"] for r in rows}) == 5
    assert len({r["doc_id"] for r in pieces(clashing)}) == clashing.select("doc_id").distinct().count()


@pytest.mark.parametrize("text", ["Ünïcode — “quotes” 123 don't", "a  b\n\n c\t", "日本語のテキスト 🙂", "<|endoftext|> x"])
def test_ranks_give_the_tokenizers_ids(text):
    assert packing.encoder(packing.VOCABULARY)(text) == packing.encoder("public:byte_bpe_50k.json")(text)


@pytest.mark.parametrize("text", ["end <|endoftext|> start", " " * 1_000_000, "a" + "\n" * 1_000_000 + "b", "x " * 300_000], ids=["special", "spaces", "newlines", "long"])
def test_ids_are_the_tokenizers_own(text):
    tokenizers, public = importlib.import_module("tokenizers"), importlib.import_module("public_tokenizers")
    tok = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert packing.encoder(packing.VOCABULARY)(text) == tok.encode(text, add_special_tokens=False).ids
