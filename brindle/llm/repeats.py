"""Windows that recur across documents, for both substring operators.

A *scheme* says what a window is and assigns every window of a text to one anchor inside it, chosen by content,
so that equal windows have equal anchors.  Whole copies of a text are set aside first (all their windows stand in
the least of them), by their SHA-256.  The rest takes four passes:

1. ``_probe``: every partition lists its anchors as 32-bit codes by document, dealt by the rest of their hash.
   Codes that it sees in two documents are known to recur and go to the reducers once, whatever their number of
   copies; the others are asked about.
2. ``_answer``: reducers, dealt by code, tell for every document which of its codes occur in another one too.
3. ``_contexts``: each document, joined with its recurring codes, gives the bytes around each such anchor.  Of
   equal contexts in one partition only the least document's go on; the others' windows are decided here.
   ``_decide``: reducers, dealt by code, compare the contexts of an anchor byte by byte and find, for each window,
   the least document that has it.
4. ``_finish`` removes what is covered, again joined with the document by its key.

Codes only select candidates (a false match costs time, nothing else); what is removed rests on compared bytes.
No pass sends a hot anchor's copies to one task: after the map side there is at most one row per partition and
distinct context, and where over ``HOT`` documents have an anchor, what is left of its contexts is dealt window by
window, by the whole window, since at a common passage's edges every document has its own surroundings.  Answers and
decisions travel as one block per pair of partitions and are gathered to one row a document.  The text is shuffled
once, by document key, and Spark reuses that exchange in passes 1, 3 and 4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import partitions, ship, slices, stage, string_buffers, text_or_empty, worker
from brindle.llm.skew import attach

_U = np.uint64
CHUNK = 1 << 20
HOT = 4096
_HOT_BIT = _U(1 << 62)  # of a key; its bucket has at most 31 bits
LAST = (1 << 63) - 1  # a null doc_id comes after every other
_REST = 31


@dataclass
class Scheme:
    """What the passes need to know.

    ``probe(raw, offsets)``: (text number, hash, may be indexed) of every anchor.
    ``runs(raw, offsets, keys, key_of)``: for the anchors whose key is in ``keys``, (text number, key, first window,
    number of windows, begin, end) where begin and end bound the bytes of those windows in ``flat(raw, offsets)``.
    ``windows(context)``: the bytes of each window of a context; ``count(data)``: the number of windows of a text.
    ``finish(data, ranges)``: the result's columns for one text and what stays, from ranges (first, last window).
    """

    probe: Callable
    runs: Callable
    flat: Callable
    windows: Callable
    count: Callable
    finish: Callable
    columns: str
    digit: int


def anchor_runs(anchor: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of valid windows with one anchor: first window, last window, and the anchor's position."""
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at, np.zeros(0, _U)
    own = anchor[at]
    cut = np.append(True, (own[1:] != own[:-1]) | (np.diff(at) != 1))
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last], own[first]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _groups(x: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal neighbours."""
    if not len(x):
        return []
    edge = np.flatnonzero(np.append(True, x[1:] != x[:-1])).tolist()
    return list(zip(edge, [*edge[1:], len(x)], strict=True))


def key_of(buckets: int) -> Callable[[np.ndarray], np.ndarray]:
    """The key of a 64-bit hash: its bucket and 31 more bits."""
    return lambda value: (((value >> _U(32)) % _U(buckets)) << _U(_REST)) | (value & _U((1 << _REST) - 1))


def _planes(x: np.ndarray) -> bytes:
    """Small whole numbers by byte plane, so that the zero bytes lie together and compress."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


_ASK, _KNOWN, _SEEN = 0, 1, 2
_PROBES = "bucket int, kind int, docs binary, counts binary, codes binary"


def _flush(docs: np.ndarray, doc: np.ndarray, keys: np.ndarray, index: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows of one chunk of at most 2**15 texts; ``docs`` holds the texts' row keys.

    A code is the 31 bits of a key outside of its bucket, and whether the anchor may be indexed.
    """
    packed = np.sort((keys << _U(16)) | (doc.astype(_U) << _U(1)) | index.astype(_U))
    if not len(packed):
        return
    packed = packed[np.append((packed[1:] >> _U(1)) != (packed[:-1] >> _U(1)), True)]  # the last of a text's equal keys has the index bit
    value = packed >> _U(16)
    start = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    size = np.diff(np.append(start, len(packed)))
    indexed = np.maximum.reduceat(packed & _U(1), start) > 0
    known = np.repeat((size > 1) & indexed, size)
    code = (((value & _U((1 << _REST) - 1)) << _U(1)) | (packed & _U(1))).astype("<u4")
    who = ((packed >> _U(1)) & _U((1 << 15) - 1)).astype(np.int64)
    bucket = (value >> _U(_REST)).astype(np.int64)
    for kind, mask in ((_ASK, ~known), (_KNOWN, known)):
        order = np.argsort((bucket[mask] << 15) | who[mask], kind="stable")
        place, by, codes = bucket[mask][order], who[mask][order], code[mask][order]
        for a, b in _groups(place):
            turn = np.flatnonzero(np.append(True, by[a + 1 : b] != by[a : b - 1]))
            yield int(place[a]), kind, docs[by[a:b][turn]].tobytes(), _planes(np.diff(np.append(turn, b - a))), codes[a:b].tobytes()
    seen = start[(size > 1) & indexed]
    place, codes = bucket[seen], code[seen] | np.uint32(1)
    for a, b in _groups(place):
        yield int(place[a]), _SEEN, b"", b"", codes[a:b].tobytes()


def _probe(scheme: Callable[[], Scheme], buckets: int):
    @worker("repeats")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, key = scheme(), key_of(buckets)
        names, kinds = ["bucket", "kind", "docs", "counts", "codes"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        held: list[tuple] = []
        total = texts = 0

        def out():
            docs = np.concatenate([h[0] for h in held])
            step = np.cumsum([0] + [len(h[0]) for h in held[:-1]])
            doc = np.concatenate([h[1] + d for h, d in zip(held, step, strict=True)])
            return _rows(list(_flush(docs, doc, np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]), buckets)), names, kinds)

        for big in slices(batches, 2):
            for i in range(0, big.num_rows, 1 << 13):
                batch = big.slice(i, 1 << 13)
                doc, hashes, index = s.probe(*string_buffers(batch.column(2)))
                held.append((np.asarray(batch.column(1)), doc, key(hashes), index))
                total, texts = total + len(doc), texts + batch.num_rows
                if total >= CHUNK or texts >= 3 << 13:
                    yield out()
                    held, total, texts = [], 0, 0
        if held:
            yield out()

    return run


_BLOCKS = "place int, bucket int, docs binary, counts binary, data binary"
_BLOCK_NAMES, _BLOCK_KINDS = ["place", "bucket", "docs", "counts", "data"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _blocks(rk: np.ndarray, data: np.ndarray, bucket: int, places: int) -> Iterator[tuple]:
    """Blocks of (row key, record) pairs, one for each of ``places`` groups of rows."""
    place = rk.view(_U) % _U(places)
    order = np.lexsort((rk, place))
    place, rk, data = place[order], rk[order], data[order]
    for a, b in _groups(place):
        turn = np.flatnonzero(np.append(True, rk[a + 1 : b] != rk[a : b - 1]))
        yield int(place[a]), bucket, rk[a:b][turn].tobytes(), _planes(np.diff(np.append(turn, b - a))), data[a:b].tobytes()


def _answer(places: int):
    @worker("repeats")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            for bucket, kind, docs, counts, codes in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                held = by.setdefault(bucket, [[], [], [], [], []])
                codes = np.frombuffer(codes, "<u4")
                if kind == _SEEN:
                    held[4].append(codes)
                    continue
                rk = np.repeat(np.frombuffer(docs, np.int64), _unplanes(counts))
                held[0 if kind == _ASK else 2].append(rk)
                held[1 if kind == _ASK else 3].append(codes)
        for bucket in sorted(by):
            asked, codes, known, known_codes, seen = [np.concatenate(x) if x else np.zeros(0, np.int64 if i in (0, 2) else "<u4") for i, x in enumerate(by.pop(bucket))]
            every = np.concatenate((codes, seen, seen))  # a code seen in two documents elsewhere counts twice
            if len(every):
                order = np.argsort(every)
                value = every[order] >> 1
                start = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
                size = np.diff(np.append(start, len(value)))
                indexed = np.maximum.reduceat(every[order] & 1, start) > 0
                mark = np.zeros(len(every), bool)
                mark[order] = np.repeat((size > 1) & indexed, size)
                known = np.concatenate((known, asked[mark[: len(codes)]]))
                known_codes = np.concatenate((known_codes, codes[mark[: len(codes)]]))
            if len(known):
                # The index bit is not asked any more; in answers the last bit marks a hot anchor.
                value, number, documents = np.unique(known_codes >> 1, return_inverse=True, return_counts=True)
                known_codes = (value << 1 | (documents > HOT)).astype("<u4")[number]
                yield _rows(list(_blocks(known, known_codes, bucket, places)), _BLOCK_NAMES, _BLOCK_KINDS)

    return run


def _gather(width: int, with_bucket: bool):
    """One row a document from blocks: its records of ``width`` 32-bit numbers, or keys made of bucket and code."""

    @worker("repeats")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rks, data = [], []
        for batch in batches:
            for bucket, docs, counts, blob in zip(*[batch.column(i).to_pylist() for i in range(1, 5)], strict=True):
                rks.append(np.repeat(np.frombuffer(docs, np.int64), _unplanes(counts)))
                record = np.frombuffer(blob, "<u4").reshape(-1, width)
                if with_bucket:
                    record = _U(bucket) << _U(_REST) | (record[:, 0] >> 1).astype(_U) | np.where(record[:, 0] & 1, _HOT_BIT, _U(0))
                data.append(record)
        if not rks:
            return
        rk, data = np.concatenate(rks), np.concatenate(data)
        order = np.argsort(rk, kind="stable")
        rk, data = rk[order], data[order]
        groups = _groups(rk)
        for i in range(0, len(groups), 10_000):
            part = groups[i : i + 10_000]
            yield _rows([(int(rk[a]), data[a:b].tobytes()) for a, b in part], ["rk", "extra"], [pa.int64(), pa.binary()])

    return run


_CONTEXTS = "h long, doc_id long, rk long, start long, count long, context binary"


def _contexts(scheme: Callable[[], Scheme], buckets: int, limit: int = 150_000):
    names = ["h", "doc_id", "rk", "start", "count", "context"]

    @worker("repeats")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, key = scheme(), key_of(buckets)
        held: list[tuple] = []
        contexts: list[bytes] = []

        def fold(columns: list[np.ndarray], texts: np.ndarray) -> tuple[np.ndarray, pa.RecordBatch]:
            """Which rows have no equal context in a smaller document here; the other rows' windows are decided:
            runs of them, joined where one goes on where the other ends."""
            _, doc, rk, start, count = columns
            number, distinct = pd.factorize(texts)
            least = np.full(len(distinct), LAST, np.int64)
            np.minimum.at(least, number, doc)
            done = doc > least[number]
            order = np.lexsort((start[done], rk[done], doc[done]))
            doc, rk, start, count = (x[done][order] for x in (doc, rk, start, count))
            new = np.append(True, (rk[1:] != rk[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + count[:-1]))[: len(rk)]
            first = np.flatnonzero(new)
            total = np.add.reduceat(count, first) if len(first) else count
            return ~done, pa.RecordBatch.from_arrays([*[pa.array(x) for x in (rk[first], doc[first], rk[first], start[first], total)], pa.nulls(len(first), pa.binary())], names=names)

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held, contexts
            columns = [np.concatenate([x[i] for x in held]) for i in range(5)]
            hot = np.concatenate([x[5] for x in held])
            texts = np.empty(len(contexts), object)
            texts[:] = contexts
            held, contexts = [], []
            on, decided = fold(columns, texts)
            yield decided
            cool = on & ~hot
            yield pa.RecordBatch.from_arrays([*[pa.array(x[cool]) for x in columns], pa.array(texts[cool].tolist(), pa.binary())], names=names)
            left = np.flatnonzero(on & hot)
            for i in range(0, len(left), 10_000):
                part = left[i : i + 10_000]
                split = [s.windows(t) for t in texts[part]]
                sizes = np.array([len(w) for w in split])
                own = np.empty(int(sizes.sum()), object)
                own[:] = [w for ws in split for w in ws]
                place = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                deal = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in own]), "<i8") & LAST
                doc, rk, start = (np.repeat(columns[k][part], sizes) for k in (1, 2, 3))
                single = [deal, doc, rk, start + place, np.ones(len(own), np.int64)]
                on_too, decided = fold(single, own)
                yield decided
                yield pa.RecordBatch.from_arrays([*[pa.array(x[on_too]) for x in single], pa.array(own[on_too].tolist(), pa.binary())], names=names)

        for big in slices(batches, 2):
            flagged = big.filter(big.column(3).is_valid())
            for i in range(0, flagged.num_rows, 1 << 13):
                batch = flagged.slice(i, 1 << 13)
                keys = np.unique(np.frombuffer(b"".join(batch.column(3).to_pylist()), _U))
                raw, offsets = string_buffers(batch.column(2))
                data = s.flat(raw, offsets)
                plain = keys & ~_HOT_BIT
                text, h, start, count, begin, end = s.runs(raw, offsets, plain, key)
                hot = np.isin(h, plain[keys >= _HOT_BIT].astype(np.int64))
                held.append((h, np.asarray(batch.column(0))[text], np.asarray(batch.column(1))[text], start, count, hot))
                contexts.extend([data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
                if len(contexts) >= limit:
                    yield from out()
        if held:
            yield from out()

    return run


def least_documents(contexts: list[tuple[bytes, int]], windows: Callable[[bytes], list[bytes]], digit: int) -> list[list[int]]:
    """For every window of every context, the least document that has an equal window.

    Most-significant-digit passes: windows are dealt by their next ``digit`` bytes, a part with one document left
    is done at once, and after the last byte the parts are the groups of equal windows.
    """
    out = []
    part: list[tuple[int, int, int, bytes]] = []
    for c, (context, doc) in enumerate(contexts):
        own = windows(context)
        out.append([doc] * len(own))
        part.extend((c, i, doc, w) for i, w in enumerate(own))
    parts, depth = [part], 0
    while parts:
        nxt = []
        for part in parts:
            dealt: dict[bytes, list] = {}
            for x in part:
                dealt.setdefault(x[3][depth : depth + digit], []).append(x)
            for low, own in dealt.items():
                if len(own) < 2:
                    continue
                first = min(x[2] for x in own)
                if all(x[2] == first for x in own):
                    continue
                if len(low) == digit:
                    nxt.append(own)
                else:
                    for c, i, _, _ in own:
                        out[c][i] = first
        parts, depth = nxt, depth + digit
    return out


def _decide(scheme: Callable[[], Scheme], places: int):
    @worker("repeats")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scheme()
        held, decided = [], []
        for batch in batches:
            ready = batch.column(5).is_null()
            done = batch.filter(ready)
            if done.num_rows:
                decided.append(np.column_stack([np.asarray(done.column(i)) for i in (1, 2, 3, 4)]))
            if done.num_rows < batch.num_rows:
                held.append(batch.filter(pc.invert(ready)))
        if held:
            rows = pa.Table.from_batches(held)
            h, doc, rk, start, count = (rows.column(i).to_numpy() for i in range(5))
            number, distinct = pd.factorize(np.array(rows.column(5).to_pylist(), object))
            del held, rows
            n = len(distinct)
            least = np.full(n, LAST, np.int64)
            np.minimum.at(least, number, doc)
            anchor = np.zeros(n, np.int64)
            anchor[number] = h
            order = np.argsort(anchor, kind="stable")
            mixed: list[np.ndarray] = []
            for a, b in _groups(anchor[order]):
                if b - a > 1 and (least[order[a:b]] != least[order[a]]).any():
                    mixed.append(order[a:b])
            later = doc > least[number]
            decided.append(np.column_stack([doc, rk, start, count])[later])  # equal whole contexts
            if mixed:
                # The rows of each context that is not yet wholly decided: those of its least document.
                by_number = np.argsort(number, kind="stable")
                bounds = np.searchsorted(number[by_number], np.arange(n + 1))
                found: list[tuple[int, int, int, int]] = []
                for group in mixed:
                    contexts = [(distinct[c], int(least[c])) for c in group.tolist()]
                    for c, firsts in zip(group.tolist(), least_documents(contexts, s.windows, s.digit), strict=True):
                        own = int(least[c])
                        hit = np.array(firsts) < own
                        if not hit.any():
                            continue
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                        for i in by_number[bounds[c] : bounds[c + 1]].tolist():
                            if doc[i] == own:
                                found.extend((own, int(rk[i]), int(start[i]) + int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True))
                if found:
                    decided.append(np.array(found, np.int64))
        every = np.concatenate(decided) if decided else np.zeros((0, 4), np.int64)
        if len(every):
            # A record: doc_id in two halves, then first window and number of windows.
            record = np.empty((len(every), 4), "<u4")
            record[:, :2] = np.ascontiguousarray(every[:, 0]).view("<u4").reshape(-1, 2)
            record[:, 2:] = every[:, 2:]
            yield _rows(list(_blocks(np.ascontiguousarray(every[:, 1]), record, 0, places)), _BLOCK_NAMES, _BLOCK_KINDS)

    return run


def merged_ranges(blob: bytes | None, doc: int) -> np.ndarray:
    """Sorted disjoint ranges (first window, last window) of the document's records."""
    if blob is None:
        return np.zeros((0, 2), np.int64)
    record = np.frombuffer(blob, "<u4").reshape(-1, 4)
    mine = np.ascontiguousarray(record[:, :2]).view("<i8").ravel() == doc
    pairs = record[mine, 2:].astype(np.int64)
    if not len(pairs):
        return pairs
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    end = np.maximum.accumulate(pairs[:, 0] + pairs[:, 1] - 1)
    cut = np.append(True, pairs[1:, 0] > end[:-1] + 1)
    last = np.append(np.flatnonzero(cut)[1:], len(pairs)) - 1
    return np.column_stack([pairs[cut, 0], end[last]])


def _finish(scheme: Callable[[], Scheme], keep_text: bool):
    @worker("repeats")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scheme()
        fields = [f.split() for f in s.columns.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string()}
        names = ["doc_id", *[f[0] for f in fields], *(["text"] if keep_text else [])]
        for batch in slices(batches, 1):
            rows = []
            for doc, text, blob, copy in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                n = s.count(data) if copy else 0
                values, kept = s.finish(data, np.array([[0, n - 1]]) if n > 0 else merged_ranges(blob, doc))
                rows.append((None if doc == LAST else doc, *values, *([kept.decode("utf-8", "ignore")] if keep_text else [])))
            yield _rows(rows, names, [pa.int64(), *[kinds[f[1]] for f in fields], *([pa.string()] if keep_text else [])])

    return run


def remove_repeats(docs: DataFrame, scheme: Callable[[], Scheme], keep_text: bool = False) -> DataFrame:
    """doc_id and the scheme's columns (and the kept text) of every row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    n = partitions(spark)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    rk = F.xxhash64(doc, text_or_empty())
    given = docs.select(rk.alias("rk"), doc.alias("doc_id"), text_or_empty().alias("text"))
    digests = docs.select(rk.alias("rk"), doc.alias("doc_id"), F.unhex(F.sha2(text_or_empty(), 256)).alias("digest"))
    several = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("rows")).filter("first < last").select("digest", "first", "rows")
    later = attach(digests, stage(several, "repeats-several"), ["digest"], "rows").filter("doc_id > first")
    # A row key is a hash; the documents that it stands for as a copy are listed with it.
    copies = later.groupBy("rk").agg(F.collect_set("doc_id").alias("copy"))
    # Every use of ``given`` keeps the same three columns, so that Spark shuffles it once.
    is_copy = F.coalesce(F.array_contains("copy", F.col("doc_id")), F.lit(False))
    alone = given.join(copies, "rk", "left").filter(~is_copy).select("doc_id", "rk", "text")
    blocks = alone.mapInArrow(_probe(scheme, n), _PROBES).repartitionById(n, "bucket").mapInArrow(_answer(n), _BLOCKS)
    flags = blocks.repartitionById(n, "place").mapInArrow(_gather(1, True), "rk long, extra binary")
    contexts = given.join(flags, "rk", "left").select("doc_id", "rk", "text", "extra").mapInArrow(_contexts(scheme, n), _CONTEXTS)
    decided = contexts.repartition(n, "h").mapInArrow(_decide(scheme, n), _BLOCKS)
    ranges = decided.repartitionById(n, "place").mapInArrow(_gather(4, False), "rk long, extra binary")
    schema = f"doc_id long, {scheme().columns}" + (", text string" if keep_text else "")
    return given.join(ranges, "rk", "left").join(copies, "rk", "left").select("doc_id", "text", "extra", is_copy.alias("copy")).mapInArrow(_finish(scheme, keep_text), schema)
