"""Line dedup beyond one edit against brute force."""

import numpy as np
import pytest

from brindle.llm import line_dedup
from tests.llm.test_corpus_operators import edits, line_rows


def brute(pairs, most, shortest=20):
    first = {}
    for n, (_, text) in enumerate(pairs):
        for i, line in enumerate(text.split("\n")):
            if len(line) >= shortest:
                first.setdefault(line, (n, i))
    gone = {x for x, p in first.items() if any(q < p and abs(len(x) - len(y)) <= most and edits(x, y) <= most for y, q in first.items())}
    out = []
    for n, (doc, text) in enumerate(pairs):
        lines = text.split("\n")
        kept = [x for i, x in enumerate(lines) if len(x) < shortest or (first[x] == (n, i) and x not in gone)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most,hot", [(2, 32), (2, 1), (3, 32), (3, 2)])
def test_more_edits(spark, monkeypatch, most, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = np.random.default_rng(most)
    lines = ["".join(rng.choice(list("abcde "), n)) for n in (20, 21, 30, 41)]
    for _ in range(90):
        x = list(lines[rng.integers(len(lines))])
        for _ in range(rng.integers(1, most + 3)):
            k, p = rng.integers(3), rng.integers(len(x))
            x[p : p + (k != 0)] = [] if k == 1 else [str(rng.choice(list("xyz")))]
        lines.append("".join(x))
    lines += ["z" * 24, "z" * 26, "z" * 27]
    order = rng.permutation(len(lines))
    rows = [(i, "\n".join(lines[k] for k in order[i * 3 : i * 3 + 3])) for i in range(33)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert line_rows(df, max_edits=most) == brute(rows, most)


def test_two_letters_of_a_long_line(spark):
    line = "".join(np.random.default_rng(1).choice(list("abcdefgh "), 400))
    rows = [(1, line), (2, "#" + line[1:-1] + "#")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r[2] for r in line_rows(df, max_edits=2)] == [0, 1]
    assert [r[2] for r in line_rows(df)] == [0, 0]
