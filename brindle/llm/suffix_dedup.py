"""Repeated byte strings by a depth-limited radix sort of suffixes.

Of every suffix only the first ``width`` bytes matter.  Suffixes are ordered by most-significant-digit passes:
the leading digit is the 24-byte string inside the window whose hash is least (any digit may lead, since only
equality of whole windows is asked), it deals the suffixes over the cluster, and parts that hold one document are
dropped there.  Within a part the next passes take 25 bytes each until the threshold depth is reached; the parts
left are exactly the windows that repeat.  ``repeats`` has the passes.  Leading digits taken at the first byte would
deal a record for every byte of the corpus, several times the text; the least-hash digit is shared by the suffixes of
a run of windows, which travel as one context.

A byte goes when a window that covers it also starts in a document with a smaller doc_id; windows are judged on
the input and never cross documents.  Null text counts as empty; a null doc_id comes after all others; rows with
the same doc_id, repeated rows among them, do not remove from each other, and there are no other ties.  An empty table
gives an empty one.  Texts are read whole, of any length; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from brindle.llm.common import Rolling, mix64, read_table
from brindle.llm.repeats import Scheme, anchor_runs, remove_repeats, sliding_min

WIDTH, GRAM, BLOCK = 50, 24, 1 << 24
_U = np.uint64


def minimizers(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and hash of every anchor's run of windows, over texts laid end to end."""
    parts = []
    for low in range(0, max(1, len(raw) - WIDTH + 1), BLOCK):
        piece = raw[low : low + BLOCK + WIDTH - 1]
        if len(piece) < WIDTH:
            break
        hashes = mix64(Rolling(piece).windows(GRAM))
        grams = (hashes >> _U(25) << _U(25)) | np.arange(len(hashes), dtype=_U)
        least = sliding_min(grams, WIDTH - GRAM + 1)
        place = low + np.arange(len(least))
        ends = np.repeat(offsets[1:], np.diff(offsets))[low : low + len(least)]
        first, last, at = anchor_runs(least & _U((1 << 25) - 1), place + WIDTH <= ends)
        parts.append((first + low, last + low, hashes[at.astype(np.int64)]))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, _U)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _probe(raw, offsets):
    first, _, value = minimizers(raw, offsets)
    return np.searchsorted(offsets, first, side="right") - 1, value, np.ones(len(first), bool)


def _runs(raw, offsets, keys, key_of):
    first, last, value = minimizers(raw, offsets)
    key = key_of(value)
    keep = np.isin(key, keys)
    first, last, key = first[keep], last[keep], key[keep]
    text = np.searchsorted(offsets, first, side="right") - 1
    return text, key.astype(np.int64), first - offsets[text], last - first + 1, first, last + WIDTH


def _finish(data: bytes, ranges: np.ndarray):
    n, removed, spans, kept, at = len(data), 0, 0, [], 0
    for first, last in ranges.tolist():
        if first > at or not spans:
            spans += 1
        begin, end = max(first, at), last + WIDTH
        kept.append(data[at:begin])
        removed += end - begin
        at = end
    kept.append(data[at:])
    text = b"".join(kept)
    return (n, removed, spans, hashlib.sha256(text).hexdigest()), text


def scheme() -> Scheme:
    return Scheme(
        _probe, _runs, lambda raw, offsets: raw.tobytes(),
        lambda context: [context[i : i + WIDTH] for i in range(len(context) - WIDTH + 1)],
        lambda data: len(data) - WIDTH + 1, _finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", 25,
    )


def suffix_dedup(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept text, where a character that lost some of its
    bytes is left out) of every row."""
    return remove_repeats(docs, scheme, keep_text)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT r, doc_id, hex(b) AS x, octet_length(b) AS n FROM t),
w AS (SELECT r, doc_id, s, substr(x, 2 * s - 1, 100) AS w FROM (SELECT r, doc_id, x, unnest(generate_series(1, n - 49)) AS s FROM h WHERE n >= 50)),
m AS (SELECT w, min(doc_id) AS first FROM w GROUP BY w HAVING min(doc_id) < max(doc_id)),
d AS (SELECT w.r, w.s FROM w JOIN m ON w.w = m.w AND w.doc_id > m.first),
g AS (SELECT r, s, CASE WHEN lag(s) OVER o IS NULL OR s > lag(s) OVER o + 50 THEN 1 ELSE 0 END AS new FROM d WINDOW o AS (PARTITION BY r ORDER BY s)),
k AS (SELECT r, min(s) AS a, max(s) + 49 AS b FROM (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS k FROM g) GROUP BY r, k),
p AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS prev FROM k),
q AS (SELECT p.r, count(*) AS spans, sum(p.b - p.a + 1) AS removed, max(p.b) AS last,
             string_agg(substr(h.x, 2 * p.prev + 1, 2 * (p.a - p.prev - 1)), '' ORDER BY p.a) AS kept
      FROM p JOIN h ON p.r = h.r GROUP BY p.r)
SELECT h.doc_id, cast(h.n AS BIGINT) AS n_bytes, cast(coalesce(q.removed, 0) AS BIGINT) AS n_removed, coalesce(q.spans, 0) AS n_spans,
       sha256(unhex(coalesce(q.kept, '') || substr(h.x, 2 * coalesce(q.last, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN q ON h.r = q.r
"""
