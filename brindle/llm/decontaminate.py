"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark text.

A-Z are lower-cased and words are runs of digits, a-z and non-ASCII characters.  Every window of ``width``
consecutive item words (the whole item where it has fewer) is a pattern.  The automaton's letters are words: each
word of the benchmark has a number, and a document is read once as the sequence of its words' numbers, so that one
pass finds all occurrences, overlapping ones included.  Hits are word numbers; the spans map them to character
offsets of the original text.

The automaton holds about ``block_windows`` windows, 0.8 KB each.  The benchmark is cut into pieces of at most
a fifth of that (an item's pieces overlap by ``width`` - 1 words, so no window is lost) and the pieces are dealt over
as many blocks as that takes.  A block is collected, broadcast, scanned and dropped before the next one is read; the
runs of hits are merged by document.

Null or empty texts have no words, hit nothing and count 0 items; items without words have no window.
Items whose item_id is null hit like any other; together they are one item, null and last in ``items``, which
counts once in n_items and adds nothing to items_sha256.  Repeated rows are scanned each on its own; a repeated
item_id counts once a document.  There are no ties to break.  An empty benchmark leaves every document clean, an
empty table gives an empty one.  Texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cached, drop, read_table, row_key, ship, stage, text_or_empty, worker
from brindle.llm.skew import attach

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_BUILT: dict = {}
cached("decontaminate", _BUILT.clear)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

RUNS = "array<struct<first:long,last:long,start:long,end:long>>"
SCHEMA = f"doc_id long, rk long, n_words long, runs {RUNS}, items array<string>"
_RUN_KIND = pa.list_(pa.struct([(f, pa.int64()) for f in ("first", "last", "start", "end")]))


def _place(item: str | None) -> tuple[bool, str]:
    """Sort key of an item, null last."""
    return item is None, item or ""


def words(text: str) -> list[bytes]:
    """The words of ``text`` as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split()


class Patterns:
    """The automaton of items given as (id, words joined by blanks)."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        windows: dict[str, set[str | None]] = {}
        for item, joined in items:
            text = "".join(self._letter(w) for w in words(joined))
            for i in range(max(1, len(text) - width + 1) if text else 0):
                windows.setdefault(text[i : i + width], set()).add(item)
        self.found = ahocorasick.Automaton()
        same: dict[frozenset, tuple] = {}
        for w, ids in windows.items():
            key = frozenset(ids)
            self.found.add_word(w, (len(w), same.setdefault(key, tuple(sorted(ids, key=_place)))))
        if windows:
            self.found.make_automaton()

    def _letter(self, word: bytes) -> str:
        if word not in self.letters:
            n = len(self.letters) + 1
            self.letters[word] = chr(n if n < 0xD800 else n + 0x800)  # no surrogates
        return self.letters[word]

    def hits(self, own: list[bytes]) -> list[tuple[int, tuple[int, tuple]]]:
        """(last word, (number of words, items)) of every occurrence."""
        if not len(self.found):
            return []
        letter = self.letters.get
        return list(self.found.iter("".join([letter(w, "\0") for w in own])))


def merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of inclusive ranges of word numbers; neighbouring ranges stay apart only with a gap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def scan(text: str, patterns: Patterns) -> tuple[int, list[tuple[int, int, int, int]], list[str | None]]:
    """Number of words, merged runs of hit words with their character offsets, and the items that occur."""
    own = words(text)
    found = patterns.hits(own)
    if not found:
        return len(own), [], []
    runs = merged([(e - n + 1, e) for e, (n, _) in found])
    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    return len(own), [(a, b, at[a][0], at[b][1]) for a, b in runs], sorted({i for _, (_, ids) in found for i in ids}, key=_place)


def _scanner(key: str, items, width: int):
    @worker("decontaminate")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Patterns(items.value, width)
        patterns = _BUILT[key]
        for batch in batches:
            rows = [scan(t, patterns) for t in batch.column(2).to_pylist()]
            runs = [[dict(zip(("first", "last", "start", "end"), x, strict=True)) for x in r[1]] for r in rows]
            columns = [batch.column(0).cast(pa.int64()), batch.column(1), pa.array([r[0] for r in rows], pa.int64()), pa.array(runs, _RUN_KIND), pa.array([r[2] for r in rows], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rk", "n_words", "runs", "items"])

    return run


def _pieces(benchmark: DataFrame, width: int, most: int) -> DataFrame:
    """(item, text, windows): items as words joined by blanks, in pieces of at most ``most`` windows."""
    own = F.filter(F.split(F.translate(text_or_empty(), UPPER, LOWER), SEPARATORS), lambda w: w != "")
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), own.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - width), F.lit(most))
    cut = rows.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s") + 1, most + width - 1).alias("w"))
    return cut.select("item", F.array_join("w", " ").alias("text"), F.greatest(F.lit(1), F.size("w") - width + 1).alias("windows"))


def _scan_block(given: DataFrame, block: DataFrame, width: int) -> tuple[DataFrame, object]:
    rows = sorted(((r["item"], r["text"]) for r in block.collect()), key=lambda r: (_place(r[0]), r[1]))
    key = hashlib.sha256(repr((width, rows)).encode("utf-8", "surrogatepass")).hexdigest()
    held = given.sparkSession.sparkContext.broadcast(rows)
    return given.mapInArrow(_scanner(key, held, width), SCHEMA), held


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_windows: int = 250_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, rk, n_words, hits (word ranges), spans (character ranges of the
    original text, end exclusive) and items that occur."""
    spark = docs.sparkSession
    ship(spark)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rk"), text_or_empty().alias("text"))
    pieces = _pieces(benchmark, width, max(1, block_windows // 5)).select("item", "text", "windows")
    total = pieces.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    if total <= block_windows:
        found, _ = _scan_block(given, pieces, width)
    else:
        blocks = -(-2 * int(total) // block_windows)  # half full on average, since pieces are dealt by hash
        dealt = stage(pieces.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int")), "decontaminate-pieces")
        parts = []
        for b in range(blocks):
            one, held = _scan_block(given, dealt.filter(F.col("block") == b).select("item", "text"), width)
            parts.append(stage(one.filter(F.size("runs") > 0).select("doc_id", "rk", "runs", "items"), "decontaminate-hits"))
            held.destroy()
        drop(dealt)
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        # Repeated rows of a document have the same runs, so each key's are a set.
        grouped = every.groupBy("doc_id", "rk").agg(
            F.array_distinct(F.flatten(F.collect_set("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count("*").alias("copies"))
        counted, held = _scan_block(given, pieces.limit(0), width)
        found = attach(counted.select("doc_id", "rk", "n_words"), grouped.withColumn("runs", _merge("runs")), ["doc_id", "rk"], "copies", how="left")
        found = found.withColumns({"runs": F.coalesce("runs", F.array().cast(RUNS)), "items": F.coalesce("items", F.array().cast("array<string>"))})
    hits = F.transform("runs", lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last")))
    spans = F.transform("runs", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return found.select("doc_id", "rk", "n_words", hits.alias("hits"), spans.alias("spans"), "items")


def _merge(column: str):
    """Merge runs of an array in SQL, as ``merged`` does."""
    return F.expr(
        f"aggregate(array_sort({column}), cast(array() as {RUNS}), (acc, x) -> "
        "case when size(acc) > 0 and x.first <= element_at(acc, -1).last + 1 "
        "then concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).first as first, greatest(element_at(acc, -1).last, x.last) as last, "
        "element_at(acc, -1).start as start, greatest(element_at(acc, -1).end, x.end) as end))) "
        "else concat(acc, array(x)) end)"
    )


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_benchmark(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    hit = F.coalesce(F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1), F.lit(0))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


_SQL_WORDS = "list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"
ORACLE = f"""
WITH i AS (SELECT cast(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, len(w) AS k, w FROM (
        SELECT item, w[s:s + 9] AS w FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM i WHERE len(w) > 0))),
d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
q AS (SELECT r, s, k, w[s:s + k - 1] AS x FROM
        (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)),
h AS (SELECT q.r, q.s, q.k, p.item FROM q JOIN p ON q.k = p.k AND q.x = p.w),
c AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + k - 1)) AS pos FROM h) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT d.doc_id, cast(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN n USING (r)
"""
