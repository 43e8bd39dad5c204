"""Connected components by alternating stars, with every round written to the shared folder.

Edges are pairs of ids.  The large star hangs every larger neighbour of a node under the least id it sees, the
small star every smaller one; they alternate until the edges no longer change, which leaves one star per
component with the least id in the middle.  A centre with many edges is salted (``skew``).  Before that, each partition replaces its edges by the stars of a
local union-find, which shortens chains.  Nothing but two checksums reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import drop, ship, stage
from brindle.llm.skew import HOT_ROWS, attach


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    pairs = [(x, root(x)) for x in parent]
    pairs = [(x, r) for x, r in pairs if x != r]
    for i in range(0, len(pairs), 100_000):
        part = np.array(pairs[i : i + 100_000], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["u", "v"])


def _least(e: DataFrame, total: int) -> DataFrame:
    """(u, least v, number of edges); written down where a node may have so many edges that its join is salted."""
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return stage(least, "star-centres", total) if total > HOT_ROWS else least


def _large(e: DataFrame, total: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, 2 * total)
    return attach(both, least, ["u"], "n", total=2 * total).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small(e: DataFrame, total: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down, total)
    rest = attach(down, least, ["u"], "n", total=total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (u, v) but the component's own least id."""
    ship(edges.sparkSession)
    e = stage(edges.select("u", "v").mapInArrow(_local_stars, "u long, v long"), "stars")
    sums = (F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)))
    before = tuple(e.agg(*sums).first())
    while before[0]:
        # The large star gives at most one edge a given edge in each direction.
        last, e = e, stage(_small(_large(e, before[0]), 2 * before[0]), "stars", 2 * before[0])
        after = tuple(e.agg(*sums).first())
        drop(last)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
