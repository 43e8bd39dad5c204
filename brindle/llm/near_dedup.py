"""Near duplicates by an LSH forest over MinHash signatures.

A-Z are lower-cased, words are runs of anything but ASCII white space, and a document's set holds its distinct
``width``-word shingles (the whole sequence where it has fewer words).  Documents with equal sets form a class
and one of them stands for it.

The forest is ``TREES`` sorted orders of the classes, each by its own ``DEPTH`` MinHash values.  Classes that
share the first ``LEAST`` values in an order form a region.  In a region of up to ``SMALL`` classes all are
candidates of each other; in a larger one the depth grows until the part is that small, and besides each class
meets its ``NEAR`` next neighbours, those with the longest common prefix.  So a region of m classes gives at most
m * SMALL / 2 + m * NEAR candidates, whatever its size.  The orders are range-partitioned, so a region that holds a
third of the table is spread over tasks; rows at the partitions' borders are joined up in a second, small pass.
Most of a large region is one component by then.  Its other members are held, as queries, against all of it, in
tiles of about ``TILE`` by ``TILE`` sets and ``TILE_VALUES`` shingles, and each tile gives one link per pair of a query
and a component, so no pair that shares a region goes unseen and no group meets in one task.  That is quadratic where
many texts are alike without being near duplicates: m of them in one region cost about m * m / TILE**2 tiles.
A pair at similarity 0.8 shares the least prefix of some order with probability 1 - (1 - 0.8**3)**16 > 0.99998.

Every candidate is confirmed on the full sets, 100 * intersection >= 100 * threshold * union in whole numbers,
and groups are connected components of the confirmed links.  Words are told apart byte for byte within a batch and by
64 bits of their BLAKE2b digest across batches; a shingle is a chain of bijective mixes of these.  Equal sets are
found by 128 bits of a BLAKE2b digest of the whole set.

Null and empty texts, and texts without words, have an empty set and link with nothing.  Rows that share a doc_id
are one node: all of its sets are linked, and each of its rows has the node's component.  A row without a doc_id
links nothing and is kept only where no row with an id has its set.  Ties: a group is named by its least doc_id.  An
empty table gives an empty one.  Texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import drop, lower_ascii, mix64, partitions, read_table, ship, slices, stage, string_buffers, text_or_empty, word_spans, word_values, worker
from brindle.llm.components import components
from brindle.llm.skew import attach

TREES, DEPTH, LEAST, SMALL, NEAR, TILE, TILE_VALUES = 16, 6, 3, 16, 2, 2000, 4 << 20
BROADCAST_IDS = 1_000_000
_U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_FACTORS = _RANDOM.integers(0, 1 << 63, TREES * DEPTH, np.int64).astype(_U) * _U(2) + _U(1)
_CHAIN = _U(0xD1342543DE82EF95)
_SHIFTS = _RANDOM.integers(0, 1 << 63, TREES * DEPTH, np.int64).astype(_U)


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit values of each text's distinct shingles, sorted, text after text, and n + 1 bounds."""
    raw = lower_ascii(raw)
    starts, ends, first = word_spans(raw, offsets)
    n_docs = len(offsets) - 1
    if len(starts) == 0:
        return np.zeros(0, _U), np.zeros(n_docs + 1, np.int64)
    word = word_values(raw, starts, ends)
    of = np.repeat(np.arange(n_docs), np.diff(first))
    at = np.arange(len(word))
    size = np.diff(first)
    short = first[:-1][(size > 0) & (size < width)]
    begin = np.concatenate((at[at + width <= first[of + 1]], short))
    length = np.minimum(width, first[of[begin] + 1] - begin)
    value = mix64(length.astype(_U))
    for k in range(width):
        on = length > k
        value[on] = mix64(value[on] * _CHAIN + word[begin[on] + k])
    owner = of[begin].astype(np.uint16 if n_docs < 1 << 16 else np.int64)
    order = np.argsort(value)
    order = order[np.argsort(owner[order], kind="stable")]
    value, owner = value[order], owner[order]
    new = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))
    return value[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=n_docs))))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values, one row per non-empty set: the least of each multiply-shift hash, as big-endian 32 bits."""
    full = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(full), len(_FACTORS)), ">u4")
    if len(full):
        wide = mix64(values)
        for i, (a, b) in enumerate(zip(_FACTORS, _SHIFTS, strict=True)):
            out[:, i] = np.minimum.reduceat(wide * a + b, full) >> _U(32)
    return out


def _describe(width: int):
    @worker("near_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            values, bounds = shingles(*string_buffers(batch.column(1)), width)
            n = np.diff(bounds)
            full = np.flatnonzero(n > 0)
            prints = np.zeros((len(n), 2), np.int64)
            for i in full.tolist():
                prints[i] = np.frombuffer(hashlib.blake2b(_pack(values[bounds[i] : bounds[i + 1]]), digest_size=16).digest(), "<i8")
            blob = signatures(values, bounds).tobytes()
            step = 4 * len(_FACTORS)
            sig: list[bytes | None] = [None] * len(n)
            for i, at in enumerate(full.tolist()):
                sig[at] = blob[i * step : (i + 1) * step]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(np.ascontiguousarray(prints[:, 0])), pa.array(np.ascontiguousarray(prints[:, 1])), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "c1", "c2", "sig"])

    return run


def _pack(values: np.ndarray) -> bytes:
    return values.astype("<u8").tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u8").astype(_U, copy=False)


def _sets(width: int):
    @worker("near_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            values, bounds = shingles(*string_buffers(batch.column(1)), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_pack(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["doc_id", "set"])

    return run


def neighbours(tree: np.ndarray, keys: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs among rows sorted by (tree, keys); ``keys`` has one column per MinHash value."""
    n = len(rep)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    same = tree[1:] == tree[:-1]
    common = np.where(same, np.logical_and.accumulate(keys[1:] == keys[:-1], axis=1).sum(axis=1), -1)
    region, size = [], []
    for depth in range(LEAST, keys.shape[1] + 1):
        number = np.concatenate(([0], np.cumsum(common < depth)))
        region.append(number)
        size.append(np.bincount(number)[number])
    left, right = [], []
    for step in range(1, min(SMALL, n)):
        close = np.zeros(n - step, bool)
        for number, count in zip(region, size, strict=True):
            close |= (number[step:] == number[:-step]) & (count[step:] <= SMALL)
        if step <= NEAR:
            close |= region[0][step:] == region[0][:-step]
        at = np.flatnonzero(close)
        left.append(rep[at])
        right.append(rep[at + step])
    a, b = np.concatenate(left), np.concatenate(right)
    apart = a != b
    return np.minimum(a, b)[apart], np.maximum(a, b)[apart]


def _in_large(tree: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Rows of regions that are large, or that may go on in another partition."""
    same = (tree[1:] == tree[:-1]) & (keys[1:, :LEAST] == keys[:-1, :LEAST]).all(axis=1)
    number = np.concatenate(([0], np.cumsum(~same)))
    return np.flatnonzero((np.bincount(number)[number] > SMALL) | (number == 0) | (number == number[-1]))


def _walk(borders: bool):
    @worker("near_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.asarray(b.column(0)), b"".join(b.column(1).to_pylist()), np.asarray(b.column(2))) for b in batches if b.num_rows]
        if not held:
            return
        tree = np.concatenate([h[0] for h in held])
        keys = np.frombuffer(b"".join(h[1] for h in held), ">u4").reshape(len(tree), DEPTH)
        rep = np.concatenate([h[2] for h in held])
        a, b = neighbours(tree, keys, rep)
        if len(a):
            pair = np.unique(np.rec.fromarrays([a, b]))
            a, b = pair["f0"], pair["f1"]
        for i in range(0, len(a), 1 << 18):
            part = slice(i, i + (1 << 18))
            m = len(a[part])
            yield pa.RecordBatch.from_arrays([pa.array(a[part]), pa.array(b[part]), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=["a", "b", "tree", "key"])
        if borders:
            n = len(rep)
            edge = sorted({*range(min(SMALL, n)), *range(max(0, n - SMALL), n)})
            for at, depth in ((edge, DEPTH), (_in_large(tree, keys), LEAST)):
                for i in range(0, len(at), 1 << 16):
                    part = at[i : i + (1 << 16)]
                    prefix = pa.array([keys[j, :depth].tobytes() for j in part], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(rep[part]), pa.nulls(len(part), pa.int64()), pa.array(tree[part], pa.int32()), prefix], names=["a", "b", "tree", "key"])

    return run


def _confirm(percent: int):
    @worker("near_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = _unpack(x.as_py()), _unpack(y.as_py())
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    continue
                both = np.sort(np.concatenate((p, q)))
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["u", "v"])

    return run


def _sweep(percent: int):
    """Links of the queries of a tile to the components of its targets, the least target of each component."""

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        targets = [r for r in rows if not r[2]]
        sets = [_unpack(r[3]) for r in targets]
        if not targets:
            return
        size = np.array([len(x) for x in sets])
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], np.repeat(np.arange(len(sets)), size)[order]
        rep, component = np.array([r[0] for r in targets]), np.array([r[1] for r in targets])
        for q, own, _, blob in (r for r in rows if r[2]):
            x = _unpack(blob)
            low, high = np.searchsorted(values, x), np.searchsorted(values, x, side="right")
            hits = [owner[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True) if b > a]
            shared = np.bincount(np.concatenate(hits), minlength=len(sets)) if hits else np.zeros(len(sets), np.int64)
            near = np.flatnonzero((100 * shared >= percent * (len(x) + size - shared)) & (component != own))
            best: dict[int, int] = {}
            for i in near.tolist():
                best[component[i]] = min(best.get(component[i], rep[i]), rep[i])
            for t in best.values():
                yield min(q, int(t)), max(q, int(t))

    @worker("near_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        held, current = [], None
        for batch in batches:
            for r in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
                if r[:4] != current:
                    found.extend(links(held))
                    held, current = [], r[:4]
                held.append(r[4:])
        found.extend(links(held))
        part = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["u", "v"])

    return run


def _fetch_sets(given: DataFrame, ids: DataFrame, width: int, bound: int) -> DataFrame:
    """(doc_id, set) of the given documents; their ids are broadcast only while they are few."""
    wanted = stage(ids, "near-wanted", bound)
    few = wanted.count() <= BROADCAST_IDS
    return stage(given.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id long, set binary"), "near-sets")


def _left_over(members: DataFrame, classes: DataFrame, group: DataFrame, total: int) -> DataFrame:
    """Members of large regions that are not one component, with their component, into how many tiles and blocks the
    region's sets and its queries are cut, and whether the member is a query: outside of the largest component."""
    big = stage(members.groupBy("tree", "key").agg(F.count("*").alias("n")).filter(F.col("n") > SMALL), "near-big", total)
    inside = attach(members, big, ["tree", "key"], "n", total=total).drop("n")
    named = inside.join(classes.select("rep", "size"), "rep").join(group, F.col("rep") == F.col("node"), "left")
    labelled = stage(named.select("tree", "key", "rep", "size", F.coalesce("component", "rep").alias("component")), "near-labelled")
    sizes = labelled.groupBy("tree", "key", "component").agg(F.count("*").alias("k"), F.sum("size").alias("v"))
    tops = sizes.groupBy("tree", "key").agg(F.max(F.struct("k", "v", "component")).alias("t"), F.count("*").alias("c"), F.sum("k").alias("n"), F.sum("v").alias("v")).filter("c > 1")
    cut = lambda rows, values: F.ceil(F.greatest(rows / TILE, values / TILE_VALUES)).cast("int")
    tops = tops.select(
        "tree", "key", "n", F.col("t.component").alias("top"), cut(F.col("n"), F.col("v")).alias("tiles"), cut(F.col("n") - F.col("t.k"), F.col("v") - F.col("t.v")).alias("blocks"))
    return attach(labelled, stage(tops, "near-tops", total), ["tree", "key"], "n", total=total).select("tree", "key", "tiles", "blocks", "rep", "component", (F.col("component") != F.col("top")).alias("query"))


def _one_node(rows: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Links between the classes of each doc_id that has several, and (doc_id, rep) of those, None without any."""
    both = F.struct("c1", "c2")
    several = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(both).alias("a"), F.max(both).alias("b")).filter("a <> b").select("doc_id")
    several = stage(several, "near-repeated")
    if several.isEmpty():
        return None
    own = rows.filter("n_shingles > 0").select("doc_id", "c1", "c2").join(several, "doc_id", "left_semi").distinct()
    own = stage(own.join(classes.select("c1", "c2", "rep"), ["c1", "c2"]).select("doc_id", "rep"), "near-repeated-classes")
    first = own.groupBy("doc_id").agg(F.min("rep").alias("u"))
    return own.join(first, "doc_id").filter("u <> rep").select("u", F.col("rep").alias("v")).distinct(), first


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    ship(spark)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = stage(given.mapInArrow(_describe(width), "doc_id long, n_shingles long, c1 long, c2 long, sig binary"), "near-rows")
    total = rows.count()
    grouped = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("c1", "c2")
    least, size = F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size")
    classes = stage(grouped.agg(least, F.min("sig").alias("sig"), size, F.count("*").alias("rows")), "near-classes", 4 * total)
    cut = F.array(*[F.substring("sig", 1 + 4 * DEPTH * t, 4 * DEPTH) for t in range(TREES)])
    orders = classes.select(F.posexplode(cut).alias("tree", "key"), "rep")
    n = partitions(spark)
    walked = stage(
        orders.repartitionByRange(n, "tree", "key", "rep").sortWithinPartitions("tree", "key", "rep").mapInArrow(_walk(True), "a long, b long, tree int, key binary"),
        "near-walk",
    )
    single = walked.filter("b IS NULL").select("tree", "key", F.col("a").alias("rep"))
    edge = single.filter(F.octet_length("key") == 4 * DEPTH).repartition(1).sortWithinPartitions("tree", "key", "rep")
    found = walked.filter("b IS NOT NULL").select("a", "b").unionByName(edge.mapInArrow(_walk(False), "a long, b long, tree int, key binary").select("a", "b"))
    pairs = stage(found.distinct(), "near-pairs", walked.count())
    sets = _fetch_sets(given, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), width, 2 * pairs.count())
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y"))
    linked = stage(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "u long, v long"), "near-links", pairs.count())
    drop(pairs, sets)
    repeated = _one_node(rows, classes)
    if repeated:
        linked = linked.unionByName(repeated[0])
    group = components(linked)
    members = single.filter(F.octet_length("key") == 4 * LEAST)
    rest = stage(_left_over(members, classes, group, walked.count()), "near-rest", walked.count())
    if not rest.isEmpty():
        held = _fetch_sets(given, rest.select(F.col("rep").alias("doc_id")).distinct(), width, rest.count()).select(F.col("doc_id").alias("rep"), "set")
        place = lambda count: F.pmod(F.xxhash64("rep"), F.col(count)).cast("int")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        targets = rest.select("tree", "key", place("tiles").alias("tile"), every("blocks").alias("block"), "rep", "component", F.lit(False).alias("query"))
        queries = rest.filter("query").select("tree", "key", every("tiles").alias("tile"), place("blocks").alias("block"), "rep", "component", F.lit(True).alias("query"))
        at = ["tree", "key", "tile", "block"]
        tiled = targets.unionByName(queries).join(held, "rep").repartition(n, *at).sortWithinPartitions(*at).select(*at, "rep", "component", "query", "set")
        group = components(linked.unionByName(tiled.mapInArrow(_sweep(percent), "u long, v long")))
    drop(walked)
    named = stage(classes.join(group, F.col("rep") == F.col("node"), "left").select("c1", "c2", "rows", F.coalesce("component", "rep").alias("component_id")), "near-named", 4 * total)
    drop(classes)
    full = rows.select("doc_id", "n_shingles", "c1", "c2").filter("n_shingles > 0")
    some = attach(full, named, ["c1", "c2"], "rows", "left", total).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    none = rows.filter("n_shingles = 0").select("doc_id", "n_shingles")
    if repeated:
        own = repeated[1].join(group, F.col("u") == F.col("node"), "left").select("doc_id", F.coalesce("component", "u").alias("component_id"))
        none = none.join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    else:
        none = none.withColumn("component_id", F.col("doc_id"))
    return some.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"), width=2)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w]
        ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i:i + 1])) END AS s FROM w),
c AS (SELECT doc_id, len(s) AS n, s FROM s),
g AS (SELECT doc_id, n, unnest(s) AS g FROM c),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k, any_value(a.n) AS nu, any_value(b.n) AS nv
      FROM g AS a JOIN g AS b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT u, v FROM p WHERE 100 * k >= 80 * (nu + nv - k)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, cast(c.n AS BIGINT) AS n_shingles, m.component_id, c.doc_id = m.component_id AS kept
FROM c JOIN m ON c.doc_id = m.a
"""
