import random
import re
from collections import defaultdict

import numpy as np

from sediment.llm import minhash, skew
from tests.llm.conftest import prose


def brute(rows):
    """doc_id -> (n_shingles, component_id), by comparing all sets."""
    sets = {}
    for i, t, *_ in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                    a, b = find(x), find(y)
                    root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, rows):
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    want = brute(rows)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_against_brute_force(spark, corpus):
    check(spark, corpus)


def test_chains_passages_and_cores(spark):
    """Chains whose ends aren't similar, shared passages below the threshold, and a core that only the shortest text reveals."""
    rng = random.Random(11)
    rows = []
    words = prose(rng, 120).split()
    for _ in range(25):
        rows.append(" ".join(words))
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    passage = prose(rng, 60)
    rows += [passage + " " + prose(rng, n) for n in (1, 3, 5, 8, 9, 10, 11, 12, 14, 18, 25, 40, 60) for _ in range(6)]
    rows += ["One two three four", "one TWO three four", "one two three", "É é", "é É", "a b c d e", "a b c d e f"]
    rng.shuffle(rows)
    check(spark, list(enumerate(rows)))


def test_edges(spark, empty, clashing):
    assert minhash.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "x y"), (3, None), (4, "")], "doc_id long, text string")
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == 5 and {r["doc_id"] for r in rows if r["n_shingles"] == 0} == {3, 4}
    left = minhash.drop_near_duplicates(clashing)
    assert left.columns == clashing.columns and 0 < left.count() <= clashing.count()


def test_sketches_merge_and_estimate():
    words = minhash.WordHashes()
    rng = random.Random(1)
    a, b = (minhash.shingles(prose(rng, 400).encode(), words) for _ in range(2))
    union = np.maximum(minhash.registers(a).astype(int), minhash.registers(b).astype(int))
    assert (union == minhash.registers(np.union1d(a, b)).astype(int)).all()
    for share in (0.2, 0.5, 0.75, 0.9):
        pool = np.random.RandomState(3).randint(0, 1 << 62, 4000).astype(np.uint64)
        n = 2000
        same = int(n * 2 * share / (1 + share))
        x, y = np.unique(pool[:n]), np.unique(pool[n - same : 2 * n - same])
        regs = [minhash.registers(s).astype(int)[None] for s in (x, y)]
        got = minhash.estimate(*regs, np.array([len(x)]), np.array([len(y)]))[0]
        assert abs(got - share) < 0.15


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 300), (200, 300), (200, 400)] + [(1000, 1000 + k) for k in range(1, 50)]
    rng.shuffle(links)
    got = {r["rep"]: r["component"] for r in minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = defaultdict(int) | {i: 0 for i in range(61)} | dict.fromkeys((100, 200, 300, 400), 100) | {1000 + k: 1000 for k in range(50)}
    assert got == dict(want)


def test_registers_bucket_as_documented():
    assert minhash.REGISTERS == minhash.BANDS * minhash.ROWS
    assert (1 - 0.75**minhash.ROWS) ** minhash.BANDS < 1e-5


def test_texts_that_share_an_id_are_judged_apart(spark):
    rng = random.Random(8)
    one, two = prose(rng, 80), prose(rng, 90)
    near = one + " more"
    rows = [(3, one), (5, near), (5, two), (None, two + " end"), (7, near), (7, near), (None, ""), (5, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    n = len(minhash.shingles(one.encode(), minhash.WordHashes()))
    assert got == {(3, n, 3, True), (5, n + 1, 3, False), (7, n + 1, 3, False), (5, 86, None, False), (None, 87, None, True), (None, 0, None, True), (5, 0, 5, True)}
    left = minhash.drop_near_duplicates(df).collect()
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in left) == sorted([(3, one), (0, two + " end"), (0, ""), (5, " ")])


def test_clashing_names(spark):
    names = ["doc_id", "text", "__gone", "gone", "gone_key", "text_key", "node", "rep", "component", "c0", "a`b"]
    df = spark.createDataFrame([(i, "the same text of more than five words", *range(9)) for i in range(4)], ", ".join(f"`{c.replace('`', '``')}` {'string' if c == 'text' else 'long'}" for c in names))
    out = minhash.drop_near_duplicates(df)
    assert out.columns == names and [tuple(r)[2:] for r in out.collect()] == [tuple(range(9))]


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 5)
    links = [(1, 1 + k) for k in range(1, 400)] + [(1000 + k, 2000) for k in range(300)] + [(2000, 3000)]
    got = {r["rep"]: r["component"] for r in minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 401)} | {1000 + k: 1000 for k in range(300)} | {2000: 1000, 3000: 1000}
    many = spark.createDataFrame([(1 if k % 2 else k, k) for k in range(500)], "a long, b long")
    one = spark.range(500).selectExpr("id a", "concat('x', id) t")
    monkeypatch.setattr(skew, "LEAST", 1000)
    assert skew.heavy_keys(many, "a") is None and skew.look_up(many, one, "a").count() == 500
    monkeypatch.setattr(skew, "LEAST", 5)
    heavy = skew.heavy_keys(many, "a").collect()
    assert [r["a"] for r in heavy] == [1] and heavy[0]["parts"] > 1
    for met in (skew.look_up(many, one, "a"), skew.look_up_wide(many, one, "a", "b")):
        assert sorted((r["a"], r["b"], r["t"]) for r in met.select("a", "b", "t").collect()) == sorted((1 if k % 2 else k, k, f"x{1 if k % 2 else k}") for k in range(500))


def test_group_of_near_copies_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 5)
    rng = random.Random(21)
    base, rows = prose(rng, 100).split(), []
    for _ in range(150):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append(" ".join(words))
    rows += [prose(rng, 80) for _ in range(30)]
    check(spark, list(enumerate(rows)))
