"""Toxic passages by maximum-scoring segment search.

Learning.  From a bounded sample of labelled documents (at most ``max_per_class`` a class, chosen by a hash of
doc_id), words and their beginnings of 4 to 8 letters are counted by class, so that compounds of a toxic stem
count together.  The log-odds of each between toxic and clean text is smoothed by a Dirichlet prior whose mass
follows its overall frequency; what is not ``z`` standard deviations from 0 weighs nothing.  A token has the
log-odds of its word, or else of its longest weighted beginning, less ``drift``, so clean text sinks.

Search.  One scan from left to right finds all maximal scoring segments of a document in linear time: runs of
rising score are kept on a stack and joined when a later run ends above and starts no lower.

Calibration.  Segment scores of random text follow an extreme-value law, P(S >= x) ~ K n exp(-lambda x);
lambda solves sum p exp(lambda s) = 1 over the token scores of clean documents, and K follows from the mean of their
best segments.  A segment is significant when its expected number in a clean text of that length is at most
``level``.  The document's normalised best score, the number of significant segments and their summed excess go
through a logistic curve, weighted back to the class sizes.

Everything after the counts is cross-fitted within the given labelled rows: the sample is cut into ``FOLDS`` parts by
a hash of doc_id, each part is scored with weights from the others, and lambda, K and the curve come from those
scores.  ``z`` and the prior's mass are the pair of ``GRID`` with the least logistic loss there; no other row, held
out or not, has a say.  The final weights are those of the whole sample.

labels, lang, source and doc_id are not inputs of a score.  Null and empty texts have no segments and get the
curve's value there.  Labels without a document, documents without a label and null labels teach nothing; several
labels of one doc_id count as toxic when any is, and of several rows with one doc_id the least text teaches.  Without
labelled rows of both classes every score is 0.  Ties in the choice of words go to the first in string order, ties in
the grid to its first pair.  Texts are read whole; repeated rows and rows without a doc_id are judged each on its own.
An empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from brindle.llm.common import drop, read_table, ship, slices, stage, text_or_empty, worker
from brindle.llm.language_id import remainder

PASSAGES = ArrayType(StructType([StructField("first", LongType()), StructField("last", LongType()), StructField("excess", DoubleType())]))
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 39 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Lower-cased runs of digits, letters, apostrophes and non-ASCII characters, as UTF-8."""
    low = text if text.isascii() else text.lower()
    return low.encode("utf-8", "surrogatepass").translate(_TABLE).split()


BEGINNINGS = (8, 7, 6, 5, 4)
FOLDS = 3
#: (z, prior) to choose from.
GRID = ((3.3, 0.05), (2.3, 0.05), (3.3, 0.5), (2.3, 0.5))


def expand(counts: Counter) -> Counter:
    """Counts of words (with an end mark) and of their beginnings, from counts of words."""
    out: Counter = Counter()
    for w, n in counts.items():
        t = w.decode("utf-8", "replace")
        out[t + "$"] += n
        for k in BEGINNINGS:
            if len(t) >= k:
                out[t[:k]] += n
    return out


class Scores(dict):
    """The weight of each word met so far, None where it has none; emptied beyond ``limit`` words."""

    def __init__(self, weights: dict[str, float], limit: int = 200_000):
        super().__init__()
        self.weights, self.limit = weights, limit

    def __missing__(self, word: bytes) -> float | None:
        t = word.decode("utf-8", "replace")
        found = self.weights.get(t + "$")
        for k in BEGINNINGS:
            if found is None and len(t) >= k:
                found = self.weights.get(t[:k])
        if len(self) >= self.limit:
            self.clear()
        self[word] = found
        return found


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    drift: float = 0.5
    rate: float = 1.0  # lambda
    scale: float = 0.1  # K
    level: float = 0.01
    curve: tuple[float, ...] = ()


def segments(at: list[int], score: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score); every token not listed scores -drift.

    ``at`` are the ascending positions of the tokens whose score is not -drift, ``score`` theirs.
    """
    stack: list[tuple[int, int, float, float]] = []  # first, last, total before, total after
    total, last = 0.0, -1
    for p, s in zip(at, score, strict=True):
        total -= drift * (p - last - 1)
        last = p
        before, total = total, total + s
        if s <= 0:
            continue
        first, low, high = p, before, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= high:
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, p, low, high))
    return [(a, b, hi - lo) for a, b, lo, hi in stack]


def positions(own: list[bytes], known: Scores) -> tuple[int, list[int], list[float]]:
    """Number of tokens, and place and weight of those that have one."""
    found = [*map(known.__getitem__, own)]
    at = [i for i, w in enumerate(found) if w is not None]
    return len(found), at, [found[i] for i in at]


def best_segment(n: int, at: list[int], weight: list[float], drift: float) -> float:
    return max((s for _, _, s in segments(at, [w - drift for w in weight], drift)), default=0.0)


def features(own: list[bytes], model: Model, known: Scores) -> tuple[int, list[tuple[int, int, float]], tuple[float, float, float]]:
    """Number of tokens, significant segments with their excess, and the document's three statistics."""
    n, at, weight = positions(own, known)
    if not at:
        return n, [], (0.0, 0.0, 0.0)
    base = math.log(model.scale * n)
    best, out = 0.0, []
    for a, b, s in segments(at, [w - model.drift for w in weight], model.drift):
        excess = model.rate * s - base
        best = max(best, excess)
        if excess >= -math.log(model.level):
            out.append((a, b, excess))
    return n, out, (best, math.log1p(len(out)), math.log1p(sum(e for _, _, e in out)))


def probability(x: tuple[float, float, float], model: Model) -> float:
    if not model.curve:
        return 0.0
    z = model.curve[0] + sum(c * v for c, v in zip(model.curve[1:], x, strict=True))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by: dict[tuple[int, int], Counter] = {(k, f): Counter() for k in (0, 1) for f in range(FOLDS)}

    def out():
        for (kind, fold), plain in by.items():
            c = expand(plain)
            keys = list(c)
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000]
                n = pa.array([c[k] for k in part], pa.int64())
                zero = pa.array(np.zeros(len(part), np.int64))
                at = pa.array(np.full(len(part), fold, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), at, n if kind else zero, zero if kind else n], names=["word", "fold", "toxic", "clean"])
            plain.clear()

    for batch in slices(batches, 2):
        for toxic, fold, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            by[toxic, fold].update(words(text))
        if sum(map(len, by.values())) > 300_000:
            yield from out()
    yield from out()


def _fold_scores(models) -> dict[tuple[int, int], tuple[Model, Scores]]:
    return {key: (m, Scores(m.weights, 100_000)) for key, m in models.value.items()}


def _levels(models):
    """For each fold and pair of the grid: counts of clean token scores, in hundredths, and for the best segments of
    clean documents the sums of their scores and of the logarithms of their documents' lengths."""

    @worker("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _fold_scores(models)
        by: dict[tuple[int, int], Counter] = {key: Counter() for key in known}
        sums = {key: [0.0, 0.0, 0] for key in known}
        for batch in slices(batches, 2):
            for fold, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = words(text)
                for pair in range(len(GRID)):
                    key = fold, pair
                    model, scores = known[key]
                    n, at, weight = positions(own, scores)
                    by[key].update(round(100 * (w - model.drift)) for w in weight)
                    by[key][round(-100 * model.drift)] += n - len(at)
                    best = best_segment(n, at, weight, model.drift)
                    if best > 0:
                        for i, x in enumerate((best, math.log(n), 1)):
                            sums[key][i] += x
        rows = [(*key, level, float(n), 0.0, 0.0) for key, c in by.items() for level, n in c.items()]
        rows += [(*key, None, float(n), total, logs) for key, (total, logs, n) in sums.items()]
        kinds = [pa.int32()] * 3 + [pa.float64()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["fold", "pair", "level", "n", "best", "logs"])

    return run


def _featurer(models):
    """The statistics of every document under each pair of the grid, by weights that have not seen it."""

    @worker("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _fold_scores(models)
        for batch in slices(batches, 2):
            rows = []
            for toxic, fold, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                own = words(text)
                rows.extend((pair, toxic, *features(own, *known[fold, pair])[2]) for pair in range(len(GRID)))
            kinds = [pa.int32()] * 2 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["pair", "toxic", "best", "number", "excess"])

    return run


def _rate(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum share * exp(lambda * score) = 1, by bisection."""
    if not (scores > 0).any():
        return 1.0
    low, high = 0.0, 1.0
    f = lambda x: float((share * np.exp(np.minimum(x * scores, 600))).sum()) - 1
    while f(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Weighted logistic regression by Newton steps; a small ridge keeps separable samples finite."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    pull = np.full(a.shape[1], ridge)
    pull[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (weight * (y - p)) - pull * b
        h = (a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(pull)
        step = np.linalg.solve(h, g)
        b = b + step * min(1.0, 4 / max(4.0, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def _weigher(counts: DataFrame, totals, max_words: int, z_least: float):
    """A function of (fold left out or None, prior): tokens, log-odds and distance from 0 in standard deviations."""

    def weigh(out: int | None, prior: float) -> tuple[list[str], np.ndarray, np.ndarray]:
        folds = [f for f in range(FOLDS) if f != out]
        n_t, n_c = sum(totals[f"t{f}"] or 0 for f in folds), sum(totals[f"c{f}"] or 0 for f in folds)
        if not n_t or not n_c:
            return [], np.zeros(0), np.zeros(0)
        t, c = (sum((F.col(f"{k}{f}") for f in folds[1:]), F.col(f"{k}{folds[0]}")) for k in "tc")
        mass = prior * (n_t + n_c)
        a = (t + c) * (mass / (n_t + n_c))
        odds = F.log((t + a) / (n_t + mass - t - a)) - F.log((c + a) / (n_c + mass - c - a))
        distance = F.abs(odds / F.sqrt(1 / (t + a) + 1 / (c + a)))
        top = counts.filter(t + c > 0).select("word", odds.alias("w"), distance.alias("z")).filter(F.col("z") >= z_least)
        held = top.orderBy(F.col("z").desc(), "word").limit(max_words).toArrow()
        return held.column(0).to_pylist(), held.column(1).to_numpy(), held.column(2).to_numpy()

    return weigh


def _model(found: tuple[list[str], np.ndarray, np.ndarray], z: float, drift: float, level: float) -> Model:
    names, odds, distance = found
    return Model({w: x for w, x, d in zip(names, odds.tolist(), distance.tolist(), strict=True) if d >= z}, drift, level=level)


def _calibrate(models: dict[tuple[int, int], Model], levels: dict[str, list]) -> None:
    """lambda and K of each fold's models from the clean documents that they have not seen."""
    by: dict[tuple[int, int], list] = {key: [[], [], None] for key in models}
    for fold, pair, level, n, best, logs in zip(*levels.values(), strict=True):
        if level is None:
            by[fold, pair][2] = (n, best, logs)
        else:
            by[fold, pair][0].append(level / 100)
            by[fold, pair][1].append(n)
    for key, (scores, n, best) in by.items():
        share = np.array(n, float)
        models[key].rate = _rate(np.array(scores), share / max(1.0, share.sum()))
        if best and best[0]:
            mean = (models[key].rate * best[1] - best[2]) / best[0]  # the mean of a Gumbel law is ln K + Euler's constant
            models[key].scale = math.exp(max(-7.0, min(7.0, mean - 0.5772156649)))


def learn(docs: DataFrame, labels: DataFrame, max_per_class: int = 20_000, max_words: int = 50_000, drift: float = 0.5, level: float = 0.01) -> Model:
    """The model from labelled documents; the driver holds at most 2 * ``max_per_class`` rows of statistics for each
    pair of the grid, and ``max_words`` weights for each fold and prior."""
    spark = docs.sparkSession
    ship(spark)
    one = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model()
    # A share of each class by hash; the share is set a little low so that the bound holds, and the limit makes sure.
    share = {k: min(1.0, 0.97 * max_per_class / n) if n > max_per_class else 1.0 for k, n in sizes.items()}
    lot = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20))
    drawn = lot < F.when(F.col("toxic") == 1, share.get(1, 0) * (1 << 20)).otherwise(share.get(0, 0) * (1 << 20))
    chosen = one.filter("toxic IN (0, 1)").filter(drawn).orderBy(lot, "doc_id").limit(2 * max_per_class)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS)).cast("int").alias("fold")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = stage(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", fold, "text"), "toxicity-sample")
    columns = [F.sum(F.when(F.col("fold") == f, F.col(k)).otherwise(0)).alias(f"{k[0]}{f}") for k in ("toxic", "clean") for f in range(FOLDS)]
    counts = stage(sample.mapInArrow(_count, "word string, fold int, toxic long, clean long").groupBy("word").agg(*columns), "toxicity-counts")
    totals = counts.filter("endswith(word, '$')").agg(*[F.sum(c).alias(c) for c in counts.columns[1:]]).first()
    weigh = _weigher(counts, totals, max_words, min(z for z, _ in GRID))
    priors = sorted({p for _, p in GRID})
    by_fold = {(f, p): weigh(f, p) for f in range(FOLDS) for p in priors}
    models = {(f, i): _model(by_fold[f, p], z, drift, level) for f in range(FOLDS) for i, (z, p) in enumerate(GRID)}
    held = spark.sparkContext.broadcast(models)
    levels = sample.filter("toxic = 0").mapInArrow(_levels(held), "fold int, pair int, level int, n double, best double, logs double")
    _calibrate(models, levels.groupBy("fold", "pair", "level").agg(*[F.sum(c).alias(c) for c in ("n", "best", "logs")]).toArrow().to_pydict())
    held.destroy()
    held = spark.sparkContext.broadcast(models)
    rows = sample.mapInArrow(_featurer(held), "pair int, toxic int, best double, number double, excess double").toArrow()
    held.destroy()
    drop(sample)
    pairs, y, *x = (rows.column(i).to_numpy() for i in range(5))
    x, y = np.column_stack(x), y.astype(float)
    best = None
    for i in range(len(GRID)):
        of = pairs == i
        weight = np.where(y[of] == 1, 1 / share[1], 1 / share[0])
        curve = _fit(x[of], y[of], weight)
        p = 1 / (1 + np.exp(-np.clip(curve[0] + x[of] @ np.array(curve[1:]), -30, 30)))
        loss = -float((weight * np.where(y[of] == 1, np.log(p), np.log1p(-p))).sum())
        if best is None or loss < best[0] - 1e-9:
            best = loss, i, curve
    z, prior = GRID[best[1]]
    model = _model(weigh(None, prior), z, drift, level)
    own = [models[f, best[1]] for f in range(FOLDS)]
    model.rate = float(np.mean([m.rate for m in own]))
    model.scale = float(np.exp(np.mean([math.log(m.scale) for m in own])))
    model.curve = best[2]
    drop(counts)
    return model


def _judge(model):
    @worker("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        known = Scores(m.weights)
        for batch in slices(batches, 1):
            rows = [features(words(t), m, known) for t in batch.column(1).to_pylist()]
            found = [[{"first": a, "last": b, "excess": e} for a, b, e in r[1]] for r in rows]
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("excess", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([probability(r[2], m) for r in rows], pa.float64()), pa.array(found, kind)], names=["row", "score", "passages"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """row (a struct of every column but text), score, and passages: significant segments as word ranges with their excess."""
    spark = docs.sparkSession
    ship(spark)
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), text_or_empty().alias("text"))
    schema = StructType([given.schema["row"]]).add("score", "double").add("passages", PASSAGES)
    return given.mapInArrow(_judge(spark.sparkContext.broadcast(model)), schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    model = learn(docs, labels.select("doc_id", "toxic").filter(remainder(3) != 1))
    held = F.coalesce(remainder(3) == 1, F.lit(False))
    scored = score(docs.select("doc_id", "text", held.alias("held_out")), model)
    return scored.select("row.doc_id", "row.held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
