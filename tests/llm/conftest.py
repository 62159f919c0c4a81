import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba ke li mo nu pa re si to vu".split() for b in "an el ir on us ta".split()]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars) with nulls, empties, copies, near copies, a very long text and a hot group."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(60)]
    texts += [None, "", " \t\n", "one two", "x"]
    texts += [texts[0]] * 40 + [texts[1], texts[1]]
    for k in range(40):  # near copies of one text
        words = texts[2].split()
        for _ in range(k % 5):
            words[rng.randrange(len(words))] = "changed" + str(rng.randrange(1000))
        texts.append(" ".join(words))
    texts.append(prose(rng, 30_000))
    texts += ["the same line here again and again\n" * 40]
    return [(i, t, "en", None if i % 17 == 0 else f"s{min(i % 7, 3)}", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark, corpus):
    """Extra columns with the names that operators use."""
    rows = [(*r, "a", 1, 2, 3.0) for r in corpus[:30]] + [(None, "a b c d e f", "en", "s1", 11, "a", 1, 2, 3.0), (3, "again three", "en", "s1", 11, "a", 1, 2, 3.0)]
    return spark.createDataFrame(rows, DOCS + ", digest string, kept int, n_words long, __m double")
