"""Repeated word windows by fixed-block anchors.

Every document's words are cut into non-overlapping blocks of ``BLOCK`` words, which are the index; every rolling
window of ``BLOCK`` words is a probe.  A window of ``WIDTH`` = 2 * BLOCK - 1 words holds exactly one block of its
own document, so a window that two documents share is hit by at least one probe.  A hit is extended to both sides
only as far as the windows reach that hold it, up to 6 words, and all copies of a hit are compared at once, window by
window (``repeats`` has the passes): a removed run is the union of its windows, as long as the maximal repeat, but no
pair of copies is ever laid side by side, of which a passage in k documents has k * k.  Where several hits lie in one
window, the one with the least hash stands for it.

A word goes when a window of 13 words that covers it also starts in a document with a smaller doc_id; windows are
judged on the input and never cross documents.  Words are runs of anything but ASCII white space, unchanged.
Null text has no words; a null doc_id comes after all others; rows with the same doc_id, repeated rows among them, do
not remove from each other, and there are no other ties.  An empty table gives an empty one.  Texts are read whole, of
any length; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from brindle.llm.common import BASES, Rolling, mix64, read_table, word_spans
from brindle.llm.repeats import Scheme, anchor_runs, remove_repeats, sliding_min

BLOCK = 7
WIDTH = 2 * BLOCK - 1
PIECE = 1 << 24
_U = np.uint64


def _words(raw, offsets):
    starts, ends, first = word_spans(raw, offsets)
    hashes = mix64(Rolling(raw.astype(_U) + _U(1)).spans(starts, ends) + (ends - starts).astype(_U))
    return starts, ends, first, hashes


def _blocks(first, hashes):
    """Hash of the block that starts at each word, and the text of each word; the last words start none."""
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = max(0, len(hashes) - BLOCK + 1)
    at = np.arange(n)
    return mix64(Rolling(hashes, BASES[1]).spans(at, at + BLOCK)), of


def _probe(raw, offsets):
    _, _, first, hashes = _words(raw, offsets)
    value, of = _blocks(first, hashes)
    at = np.arange(len(value))
    text = of[: len(value)]
    long = (first[1:] - first[:-1])[text] >= WIDTH if len(value) else np.zeros(0, bool)
    keep = long & (at + BLOCK <= first[text + 1])
    at, text = at[keep], text[keep]
    return text, value[keep], (at - first[text]) % BLOCK == 0


def _runs(raw, offsets, keys, key_of):
    starts, ends, first, hashes = _words(raw, offsets)
    value, of = _blocks(first, hashes)
    # Bounds of the words in the text that _flat gives: words joined by one space, texts by one space.
    size = ends - starts
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    n = len(hashes) - WIDTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none, none
    key = key_of(value)
    none_here = _U(2**64 - 1)
    hit = np.isin(key, keys)
    found = []
    for cut in range(0, n, PIECE):  # a place in a piece fits into 25 bits
        part = slice(cut, cut + PIECE + WIDTH - BLOCK)
        here = value[part]
        packed = np.where(hit[part], (here >> _U(25) << _U(25)) | np.arange(len(here), dtype=_U), none_here)
        least = sliding_min(packed, WIDTH - BLOCK + 1)[: n - cut]
        place = np.arange(cut, cut + len(least))
        low, high, anchor = anchor_runs(least & _U((1 << 25) - 1), (place + WIDTH <= first[of[place] + 1]) & (least != none_here))
        found.append((low + cut, high + cut, key[part][anchor.astype(np.int64)].astype(np.int64)))
    low, high, h = (np.concatenate(x) for x in zip(*found, strict=True))
    text = of[low]
    return text, h, low - first[text], high - low + 1, begin[low], begin[high + WIDTH] - 1


def _flat(raw, offsets) -> bytes:
    data, cuts = raw.tobytes(), offsets.tolist()
    return b" ".join(w for a, b in zip(cuts[:-1], cuts[1:], strict=True) for w in data[a:b].split())


def _windows(context: bytes) -> list[bytes]:
    words = context.split(b" ")
    return [b" ".join(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)]


def _finish(data: bytes, ranges: np.ndarray):
    words = data.split()
    kept, at, removed = [], 0, 0
    for first, last in ranges.tolist():
        begin, end = max(first, at), last + WIDTH
        kept.extend(words[at:begin])
        removed += end - begin
        at = end
    kept.extend(words[at:])
    text = b" ".join(kept)
    return (len(words), removed, hashlib.sha256(text).hexdigest()), text


def scheme() -> Scheme:
    return Scheme(_probe, _runs, _flat, _windows, lambda data: len(data.split()) - WIDTH + 1, _finish, "n_words long, n_removed long, kept_sha256 string", 32)


def substring_dedup(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept words joined by one space) of every row."""
    return remove_repeats(docs, scheme, keep_text)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id,
                  list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
w AS (SELECT r, doc_id, s, array_to_string(w[s:s + 12], ' ') AS g FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 12)) AS s FROM t WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
d AS (SELECT DISTINCT r, pos FROM (SELECT w.r, unnest(generate_series(w.s, w.s + 12)) AS pos FROM w JOIN m ON w.g = m.g AND w.doc_id > m.first)),
u AS (SELECT r, pos, word FROM (SELECT r, unnest(generate_series(1, len(w))) AS pos, unnest(w) AS word FROM t)),
k AS (SELECT u.r, string_agg(u.word, ' ' ORDER BY u.pos) AS kept FROM u ANTI JOIN d ON u.r = d.r AND u.pos = d.pos GROUP BY u.r),
c AS (SELECT r, count(*) AS n FROM d GROUP BY r)
SELECT t.doc_id, cast(len(t.w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM t LEFT JOIN k ON t.r = k.r LEFT JOIN c ON t.r = c.r
"""
