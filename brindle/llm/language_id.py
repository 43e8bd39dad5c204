"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1; a letter trigram is the product (binding) of the first
vector permuted twice, the second permuted once and the third; a document is the sum (bundle) of its trigrams,
a language the sum of its training documents.  A document goes to the prototype with the greatest cosine, which
is also the score.  Trigrams run over lower-cased letters with one blank for everything else, and those with the
blank in the middle are left out.  A letter's vector follows from its code point, so there is no vocabulary.

Prototypes are learned from all given training rows.  They are read ``BLOCK`` languages at a time, ``dimension`` sums
each; beyond one block the documents go through one pass a block, and each pass keeps the better answer, so that the
number of languages has no bound.  A batch's bundles are summed from its (text, trigram) counts: trigrams that many
texts share as a product of dense blocks, the others text by text, so that memory follows the text and not the
number of texts times that of trigrams.

Null text, and text without a letter, gives ``und`` with score 0.  Texts are read whole.  A row without a lang
teaches nothing; without any training row every document is ``und``, and an empty table gives an empty one.  Equal
cosines go to the first language in string order.  Repeated rows are judged each on its own, and so are rows without
a doc_id; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.llm.common import cached, read_table, ship, slices, stage, text_or_empty, worker

DIMENSION, BLOCK = 1024, 500
_LOWER: list[np.ndarray] = []
_VECTORS: dict[int, Letters] = {}


def _clear() -> None:
    for held in (_LOWER, _VECTORS):
        held.clear()


cached("language_id", _clear)


def letters(points: np.ndarray) -> np.ndarray:
    """Lower-case letters as they are, a blank for all else; a table that grows as blocks are met."""
    if not _LOWER:
        _LOWER.append(np.zeros(0x110000, np.uint32))
    table = _LOWER[0]
    out = table[points]
    if (out == 0).any():
        for block in np.unique(points[out == 0] >> 8):
            for c in range(block << 8, (block + 1) << 8):
                low = chr(c).lower()
                table[c] = ord(low[0]) if chr(c).isalpha() else 32
        out = table[points]
    return out


def letter_vector(point: int, dimension: int) -> np.ndarray:
    bits = np.random.Generator(np.random.PCG64(point)).integers(0, 2, dimension, np.int8)
    return (2 * bits - 1).astype(np.int8)


class Letters:
    """Letter vectors, permuted twice, once and not at all; emptied beyond ``limit`` letters."""

    def __init__(self, dimension: int, limit: int = 1 << 14):
        self.dimension, self.limit = dimension, limit
        self.place: dict[int, int] = {}
        self.table = np.zeros((3, 256, dimension), np.int8)

    def rows(self, points: list[int]) -> np.ndarray:
        if len(self.place) + len(points) > self.limit:
            self.place = {}
        for p in points:
            if p not in self.place:
                at = self.place[p] = len(self.place)
                if at == self.table.shape[1]:
                    self.table = np.concatenate((self.table, np.zeros_like(self.table)), axis=1)
                v = letter_vector(p, self.dimension)
                self.table[:, at] = np.roll(v, 2), np.roll(v, 1), v
        return np.array([self.place[p] for p in points], np.int64)


def gram_vectors(codes: np.ndarray, dimension: int) -> np.ndarray:
    """The vectors of trigrams given as 3 x 21 bits."""
    held = _VECTORS.setdefault(dimension, Letters(dimension))
    parts = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF])
    points, number = np.unique(parts, return_inverse=True)
    a, b, c = held.rows(points.tolist())[number.reshape(parts.shape)]
    return held.table[0, a] * held.table[1, b] * held.table[2, c]


@dataclass
class Counts:
    """How often each trigram occurs in each text (or owner): places with a count above 0, by text."""

    codes: np.ndarray
    text: np.ndarray
    code: np.ndarray
    count: np.ndarray
    texts: int


def trigram_counts(texts: list[str], owner: list[int] | None = None, owners: int | None = None, cells: int = 1 << 23) -> tuple[Counts, np.ndarray]:
    """Counts of trigrams by owner (the text itself by default), and whether each text has a letter."""
    points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = letters(points)
    text_of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    text_of = np.concatenate((text_of[:1], text_of))
    ink = kinds != 32
    has = np.zeros(len(texts), bool)
    has[text_of[ink]] = True
    keep = ink | np.append(True, ink[:-1])  # one blank of each run
    kinds, text_of = kinds[keep], text_of[keep]
    middle = np.flatnonzero(kinds[1:-1] != 32)
    alphabet, number = np.unique(kinds, return_inverse=True)
    size = len(alphabet)
    small = (number[middle] * size + number[middle + 1]) * size + number[middle + 2]
    used, column = np.unique(small, return_inverse=True) if size > 160 else _dense(small, size**3)
    wide = alphabet.astype(np.int64)
    codes = (wide[used // (size * size)] << 42) | (wide[used // size % size] << 21) | wide[used % size]
    who = text_of[middle + 1] if owner is None else np.asarray(owner, np.int64)[text_of[middle + 1]]
    n, place = len(texts) if owner is None else owners, who * len(used) + column
    if n * len(used) <= cells:
        table = np.bincount(place, minlength=n * len(used))
        at = np.flatnonzero(table)
        count = table[at]
    else:
        at, count = np.unique(place, return_counts=True)
    return Counts(codes, at // max(1, len(used)), at % max(1, len(used)), count, n), has


def _dense(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    there = np.zeros(size, bool)
    there[values] = True
    used = np.flatnonzero(there)
    place = np.zeros(size, np.int64)
    place[used] = np.arange(len(used))
    return used, place[values]


def bundle(counts: Counts, dimension: int, block: int = 2048, rows: int = 2048) -> np.ndarray:
    """The sum of its trigrams' vectors for each text."""
    out = np.zeros((counts.texts, dimension), np.float32)
    n = len(counts.codes)
    shared = np.bincount(counts.code, minlength=n)
    rank = np.empty(n, np.int64)
    rank[np.argsort(-shared, kind="stable")] = np.arange(n)  # the most shared trigrams lie in the first blocks
    place = rank[counts.code]
    order = np.argsort(place // block, kind="stable")  # by text within a block
    cuts = np.searchsorted((place // block)[order], np.arange(-(-n // block) + 1))
    codes = np.empty(n, np.int64)
    codes[rank] = counts.codes
    for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        vectors = gram_vectors(codes[i * block : (i + 1) * block], dimension)
        here = order[a:b]
        text, column, count = counts.text[here], place[here] - i * block, counts.count[here].astype(np.float32)
        if 32 * len(here) > counts.texts * len(vectors):
            for low in range(0, counts.texts, 1024):
                some = slice(*np.searchsorted(text, (low, low + 1024)).tolist())
                table = np.zeros((min(1024, counts.texts - low), len(vectors)), np.float32)
                table[text[some] - low, column[some]] = count[some]
                out[low : low + 1024] += table @ vectors.astype(np.float32)
            continue
        for low in range(0, len(here), rows):
            part = slice(low, low + rows)
            first = np.flatnonzero(np.append(True, np.diff(text[part]) != 0))
            out[text[part][first]] += np.add.reduceat(vectors[column[part]] * count[part, None], first, axis=0)
    return out


def _groups(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1, limit):
        for i in range(0, batch.num_rows, 512):
            yield batch.slice(i, 512)


def _learner(dimension: int, most: int = 2 * BLOCK):
    @worker("language_id")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, row in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * dimension), pa.array(np.arange(dimension, dtype=np.int32)), pa.array(row)], names=["lang", "at", "value"])
            sums.clear()

        for batch in _groups(batches):
            langs = batch.column(0).to_pylist()
            names = sorted(set(langs))
            at = {x: i for i, x in enumerate(names)}
            counts, _ = trigram_counts(batch.column(1).to_pylist(), [at[x] for x in langs], len(names))
            for name, row in zip(names, bundle(counts, dimension).astype(np.float64), strict=True):
                sums[name] = sums.get(name, 0) + row
            if len(sums) > most:
                yield from out()
        yield from out()

    return run


@dataclass
class Profiles:
    """Language prototypes, dealt over blocks of about ``BLOCK`` languages."""

    table: DataFrame
    blocks: int
    dimension: int

    def block(self, number: int) -> dict[str, np.ndarray]:
        """Unit vectors by language."""
        out = {}
        for r in sorted(self.table.filter(F.col("block") == number).collect(), key=lambda r: r["lang"]):
            v = np.zeros(self.dimension)
            v[[c["at"] for c in r["cells"]]] = [c["value"] for c in r["cells"]]
            if v.any():
                out[r["lang"]] = (v / np.linalg.norm(v)).astype(np.float32)
        return out


def learn(rows: DataFrame, dimension: int = DIMENSION, block: int = BLOCK) -> Profiles:
    """Prototypes by language from (lang, text) rows."""
    ship(rows.sparkSession)
    given = rows.filter("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))
    sums = given.mapInArrow(_learner(dimension), "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found = stage(sums.groupBy("lang").agg(F.collect_list(F.struct("at", "value")).alias("cells")), "language-profiles")
    blocks = max(1, -(-found.count() // block))
    return Profiles(found.withColumn("block", F.pmod(F.xxhash64("lang"), F.lit(blocks)).cast("int")), blocks, dimension)


def _judge(prototypes: dict[str, np.ndarray], dimension: int, columns: list[str]):
    names = list(prototypes)
    table = np.array([prototypes[x] for x in names], np.float32).reshape(len(names), dimension)

    @worker("language_id")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            counts, has = trigram_counts(batch.column(1).to_pylist())
            made = bundle(counts, dimension)
            norm = np.linalg.norm(made, axis=1)
            has &= norm > 0
            langs, score = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            if names:
                near = (made @ table.T) / np.maximum(norm, 1e-9)[:, None]
                best = near.argmax(axis=1)
                for i in np.flatnonzero(has).tolist():
                    name, value = names[best[i]], float(near[i, best[i]])
                    if langs[i] == "und" or (-value, name) < (-score[i], langs[i]):
                        langs[i], score[i] = name, value
            held = {"row": batch.column(0), "text": batch.column(1), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(score, pa.float64())}
            yield pa.RecordBatch.from_arrays([held[c] for c in columns], names=columns)

    return run


def identify(docs: DataFrame, profiles: Profiles, keep_text: bool = False) -> DataFrame:
    """row (a struct of every column but text), lang_pred and score of every row, and the text, empty for null."""
    ship(docs.sparkSession)
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), text_or_empty().alias("text"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    for number in range(profiles.blocks):
        last = number == profiles.blocks - 1
        columns = [c for c in given.columns if c != "text" or keep_text or not last]
        judged = given.mapInArrow(_judge(profiles.block(number), profiles.dimension, columns), StructType([given.schema[c] for c in columns]))
        given = judged if last else stage(judged, "language-pass")
    return given.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))


def remainder(n: int) -> Column:
    """crc32 of doc_id as text modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(remainder(5) == 0, F.lit(False))
    profiles = learn(docs.filter(remainder(5) != 0))
    found = identify(docs.select("doc_id", "text", held.alias("held_out")), profiles)
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")
