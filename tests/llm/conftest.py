import random

import pytest

ODD = [None, "", " ", "\n\n", "\t \x0b", "a", "Ä", "!!!", "123", "a b", "é" * 200, "x " * 3000, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"]


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Random texts with exact copies, near copies, shared passages, odd rows, ties and repeated rows, and columns
    whose names clash with those that the operators use."""
    rng = random.Random(7)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(80)]
    passage = words(rng, 40)
    for i in range(0, 80, 5):
        texts[i] = texts[i] + "\n" + passage
    for i in range(20):
        t = rng.choice(texts).split(" ")
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = "changed"
        texts.append(" ".join(t))
    texts += [rng.choice(texts) for _ in range(15)] + [rng.choice(texts).replace(" ", "  ") for _ in range(5)] + ODD
    rng.shuffle(texts)
    rows = [(i, t, "kept", "row", 1, "x") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3]]  # repeated rows
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, row string, n_chars long, score string").repartition(5)


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus.limit(0)


def rows_of(df):
    """(doc_id, text) of a table, in order."""
    return sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.fixture(scope="session")
def pairs(corpus):
    return rows_of(corpus)
