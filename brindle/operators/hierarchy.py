"""Trees: closure, ancestors, descendants, integrity and repair.

A tree is (id, parent_id, self_managed, status).  Walks go level by level as joins: each step joins the frontier
with the table, so a step costs one pass over the edges and the number of steps is the depth.  Where the caller
knows the depth (``levels``) the plan stays lazy; otherwise every level is written to the shared folder and the
walk goes on as long as it finds something, to any depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.durable import durable


def closure(tree: DataFrame, levels: int | None = None) -> DataFrame:
    """(ancestor_id, descendant_id, barrier, depth), self rows included.

    barrier is 0 on self rows and 1 where the descendant or a tenant strictly between is self-managed.  ``levels``
    fixes the number of steps where the depth is known, which keeps the plan lazy.  Without it the walk ends by
    itself, and a node on a cycle or below one has its self row alone.
    """
    nodes = tree.select("id", "parent_id", "self_managed")
    there = nodes.select(F.col("id").alias("parent_id"))
    up = nodes.join(there, "parent_id", "left_semi").select(F.col("id").alias("__id"), F.col("parent_id").alias("__next"), F.col("self_managed").alias("__own"))
    level = nodes.select(F.col("id").alias("ancestor_id"), F.col("id").alias("descendant_id"), F.lit(0).alias("barrier"), F.lit(0).alias("depth"))
    parts, before = [level], None
    step = 0
    while levels is None or step < levels:
        step += 1
        own = F.when(F.col("__own"), 1).otherwise(F.col("barrier")).alias("barrier")
        level = level.join(up, F.col("ancestor_id") == F.col("__id")).select(F.col("__next").alias("ancestor_id"), "descendant_id", own, F.lit(step).alias("depth"))
        if levels is None:
            level = durable(level)
            size = level.count()
            if not size:
                break
            if size == before:
                # Of the nodes that got this far none has ended; a node that ends has an ancestor that ended here.
                endless = level.select("descendant_id").distinct()
                parts = parts[:1] + [p.join(endless, "descendant_id", "left_anti") for p in parts[1:]]
                break
            before = size
        parts.append(level)
    return reduce(DataFrame.unionByName, parts).select("ancestor_id", "descendant_id", "barrier", "depth")


def ancestors(closed: DataFrame, tree: DataFrame, starts: DataFrame, respect_barriers: bool = True) -> DataFrame:
    """(start_id, id, depth) from the parent up to the root.  Respecting barriers, a self-managed start has none, and
    the walk ends with the first self-managed ancestor, which is still in."""
    rows = closed.filter("depth > 0").join(starts.select(F.col("id").alias("start_id")), F.col("descendant_id") == F.col("start_id"))
    rows = rows.select("start_id", F.col("ancestor_id").alias("id"), "depth")
    if not respect_barriers:
        return rows
    own = tree.select(F.col("id").alias("__id"), "self_managed")
    marked = rows.join(own, F.col("id") == F.col("__id")).drop("__id")
    first = marked.filter("self_managed").groupBy("start_id").agg(F.min("depth").alias("__stop"))
    closed_starts = own.filter("self_managed").select(F.col("__id").alias("start_id"))
    kept = marked.join(closed_starts, "start_id", "left_anti").join(first, "start_id", "left")
    return kept.filter("__stop IS NULL OR depth <= __stop").select("start_id", "id", "depth")


def descendants(tree: DataFrame, start: str, respect_barriers: bool = True, statuses: tuple = (), max_depth: int | None = None, levels: int | None = None) -> DataFrame:
    """(id, depth, path) below ``start`` in pre-order of ``path``.  A barrier child and all below it are left out, and
    so is a subtree whose top has another status; the start itself is neither listed nor tested.  Without ``levels``
    the walk goes on until a level is empty."""
    kids = tree.select("id", "parent_id", "self_managed", "status")
    if respect_barriers:
        kids = kids.filter("NOT self_managed")
    if statuses:
        kids = kids.filter(F.col("status").isin(*statuses))
    kids = kids.select(F.col("id").alias("__id"), F.col("parent_id").alias("__parent"))
    level = tree.filter(F.col("id") == start).select("id", F.lit(0).alias("depth"), F.array("id").alias("path"))
    parts = [level.filter(F.lit(False))]
    step, last = 0, min((x for x in (max_depth, levels) if x is not None), default=None)
    while last is None or step < last:
        step += 1
        fresh = ~F.array_contains("path", F.col("__id"))
        level = level.join(kids, F.col("id") == F.col("__parent")).filter(fresh).select(F.col("__id").alias("id"), F.lit(step).alias("depth"), F.concat("path", F.array("__id")).alias("path"))
        if levels is None:
            level = durable(level)
            if level.isEmpty():
                break
        parts.append(level)
    return reduce(DataFrame.unionByName, parts).orderBy("path")


def is_ancestor(closed: DataFrame, pairs: DataFrame, respect_barriers: bool = True) -> DataFrame:
    """Pairs (ancestor_id, descendant_id) with ``result``; nothing is its own ancestor, and barriers break the line."""
    rows = closed.filter("depth > 0")
    if respect_barriers:
        rows = rows.filter("barrier = 0")
    hit = rows.select("ancestor_id", "descendant_id", F.lit(True).alias("__hit"))
    return pairs.join(hit, ["ancestor_id", "descendant_id"], "left").withColumn("result", F.coalesce("__hit", F.lit(False))).drop("__hit")


CATEGORIES = ("orphan", "broken_parent", "cycle", "depth", "root_count", "missing_self_row", "coverage_gap", "stale_edge", "barrier", "status")


def integrity(tree: DataFrame, stored: DataFrame, levels: int | None = None, depth: str | None = None) -> DataFrame:
    """(category, id, other_id) of every fault between a tree and its stored closure.

    orphan: a parent that does not exist.  broken_parent: a live node under a deleted one.  cycle: nodes from which no
    walk (of ``levels`` steps, where that is given) reaches a root or an orphan.  depth: a stored depth (column ``depth``) that is not the real one.
    root_count: a root, where there is more than one.  The rest compare the stored closure with the expected one.
    """
    none = F.lit(None).cast("string")
    ids = tree.select(F.col("id").alias("__pid"), F.col("status").alias("__pstatus"))
    child = tree.join(ids, F.col("parent_id") == F.col("__pid"), "left")
    orphan = child.filter("parent_id IS NOT NULL AND __pid IS NULL").select(F.lit("orphan").alias("category"), "id", F.col("parent_id").alias("other_id"))
    broken = child.filter("__pstatus = 3 AND status <> 3").select(F.lit("broken_parent").alias("category"), "id", F.col("parent_id").alias("other_id"))
    want = closure(tree, levels=levels).persist()  # used several times below; a lost block is worked out again
    ends = child.filter("parent_id IS NULL OR __pid IS NULL").select(F.col("id").alias("ancestor_id"))
    reach = want.join(ends, "ancestor_id", "left_semi").select(F.col("descendant_id").alias("id"))
    cycle = tree.join(reach, "id", "left_anti").select(F.lit("cycle").alias("category"), "id", none.alias("other_id"))
    roots = tree.filter("parent_id IS NULL")
    many = roots.agg(F.count("*").alias("__n"))
    root = roots.crossJoin(F.broadcast(many)).filter("__n <> 1").select(F.lit("root_count").alias("category"), "id", none.alias("other_id"))
    out = [orphan, broken, cycle, root]
    if depth is not None:
        real = want.groupBy(F.col("descendant_id").alias("id")).agg(F.max("depth").alias("__d"))
        out.append(tree.join(real, "id").filter(F.col(depth) != F.col("__d")).select(F.lit("depth").alias("category"), "id", none.alias("other_id")))
    st = tree.select(F.col("id").alias("descendant_id"), F.col("status").alias("__status"))
    a = want.join(st, "descendant_id").select("ancestor_id", "descendant_id", F.col("barrier").alias("__wb"), F.col("__status").alias("__ws"), F.lit(True).alias("__want"))
    b = stored.select("ancestor_id", "descendant_id", F.col("barrier").alias("__hb"), F.col("descendant_status").alias("__hs"), F.lit(True).alias("__have"))
    kind = (
        F.when(F.col("__have").isNull() & (F.col("ancestor_id") == F.col("descendant_id")), "missing_self_row").when(F.col("__have").isNull(), "coverage_gap")
        .when(F.col("__want").isNull(), "stale_edge").when(F.col("__wb") != F.col("__hb"), "barrier").when(F.col("__ws") != F.col("__hs"), "status")
    )
    diff = a.join(b, ["ancestor_id", "descendant_id"], "full_outer").withColumn("category", kind).filter("category IS NOT NULL")
    out.append(diff.select("category", F.col("descendant_id").alias("id"), F.col("ancestor_id").alias("other_id")))
    return reduce(DataFrame.unionByName, out)


def fault_counts(faults: DataFrame) -> DataFrame:
    """A count for each category, 0 where there is no fault."""
    spark = faults.sparkSession
    names = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return names.join(faults.groupBy("category").count(), "category", "left").select("category", F.coalesce("count", F.lit(0)).alias("n"))


def repair(tree: DataFrame, stored: DataFrame, levels: int | None = None) -> DataFrame:
    """(action, ancestor_id, descendant_id, barrier, descendant_status) that make the stored closure right; nodes on
    cycles and nodes below an orphan are left alone."""
    want = closure(tree, levels=levels).persist()
    roots = tree.filter("parent_id IS NULL").select(F.col("id").alias("ancestor_id"))
    sound = want.join(roots, "ancestor_id", "left_semi").select("descendant_id").distinct()
    st = tree.select(F.col("id").alias("descendant_id"), F.col("status").alias("__ws"))
    a = want.join(sound, "descendant_id", "left_semi").join(st, "descendant_id").select("ancestor_id", "descendant_id", F.col("barrier").alias("__wb"), "__ws")
    gone = stored.join(tree.select(F.col("id").alias("descendant_id")), "descendant_id", "left_semi").join(sound, "descendant_id", "left_anti").select("ancestor_id", "descendant_id")
    b = stored.join(gone, ["ancestor_id", "descendant_id"], "left_anti").select("ancestor_id", "descendant_id", F.col("barrier").alias("__hb"), F.col("descendant_status").alias("__hs"))
    action = F.when(F.col("__hb").isNull(), "insert").when(F.col("__wb").isNull(), "delete").when((F.col("__wb") != F.col("__hb")) | (F.col("__ws") != F.col("__hs")), "update")
    out = a.join(b, ["ancestor_id", "descendant_id"], "full_outer").withColumn("action", action).filter("action IS NOT NULL")
    return out.select("action", "ancestor_id", "descendant_id", F.coalesce("__wb", "__hb").alias("barrier"), F.coalesce("__ws", "__hs").alias("descendant_status")).orderBy("ancestor_id", "descendant_id")


def inherited(closed: DataFrame, tree: DataFrame, values: DataFrame, value: str = "value") -> DataFrame:
    """Each node with the value of itself or its nearest ancestor; the walk does not pass a self-managed node."""
    reach = closed.filter("barrier = 0 OR depth = 0")
    hit = reach.join(values.select(F.col("id").alias("ancestor_id"), F.col(value)), "ancestor_id")
    near = hit.groupBy(F.col("descendant_id").alias("id")).agg(F.min_by(value, "depth").alias(value))
    return tree.select("id").join(near, "id", "left")


def closest(requests: DataFrame, chain: DataFrame, rows: DataFrame, private_first: bool = True) -> DataFrame:
    """For each (start_id, name) the row of the nearest tenant on its chain (start_id, id, depth); an ancestor's private
    row is not seen, and of one tenant's rows the private one comes first."""
    near = requests.join(chain, "start_id").join(rows.withColumnRenamed("tenant_id", "id"), ["id", "name"]).filter("depth = 0 OR sharing <> 'private'")
    first = F.when(F.col("sharing") == "private", 0).otherwise(1) if private_first else F.lit(0)
    best = near.groupBy("start_id", "name").agg(F.min(F.struct("depth", first.alias("p"), "id", "sharing")).alias("b"))
    return requests.join(best.select("start_id", "name", F.col("b.id").alias("owner_id"), F.col("b.depth").alias("depth"), F.col("b.sharing").alias("sharing")), ["start_id", "name"], "left")


def resolve_alias(requests: DataFrame, chain: DataFrame, rows: DataFrame) -> DataFrame:
    """For each (start_id, alias): ``outcome``, owner_id, depth and ``layers``.

    ``rows`` has tenant_id, alias, sharing and enabled; ``chain`` has start_id, id and depth.  The nearest enabled row on
    the chain is found; an ancestor's private row is not seen.  Without one the outcome is ``disabled`` where a disabled
    row was passed, else ``not_found``.  ``layers`` holds the ids of all enabled rows, the farthest first, which is the
    order in which settings are merged.
    """
    seen = requests.join(chain, "start_id").join(rows.withColumnRenamed("tenant_id", "id"), ["id", "alias"]).filter("depth = 0 OR sharing <> 'private'")
    spot = F.when(F.col("enabled"), F.struct("depth", "id"))
    one = seen.groupBy("start_id", "alias").agg(F.min(spot).alias("__near"), F.sort_array(F.collect_list(spot), asc=False).alias("__all"))
    out = requests.join(one, ["start_id", "alias"], "left")
    outcome = F.when(F.col("__near").isNotNull(), "found").when(F.col("__all").isNotNull(), "disabled").otherwise("not_found")
    layers = F.coalesce(F.transform("__all", lambda x: x["id"]), F.array().cast("array<string>"))
    return out.select("start_id", "alias", outcome.alias("outcome"), F.col("__near.id").alias("owner_id"), F.col("__near.depth").alias("depth"), layers.alias("layers"))


def retention_due(tree: DataFrame, now: Column, default_seconds: int) -> DataFrame:
    """Deleted nodes past their retention, deepest first; future stamps and windows that are not valid are not due."""
    window = F.coalesce("retention_seconds", F.lit(default_seconds))
    age = F.unix_seconds(now) - F.unix_seconds("deleted_at")
    return tree.filter((F.col("deleted_at").isNotNull()) & (age >= 0) & (window >= 0) & (age >= window)).orderBy(F.col("depth").desc(), "deleted_at", "id")


def move_subtrees(closed: DataFrame, moves: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, depth) after each node ``id`` of ``moves`` hangs under ``new_parent_id``.

    Rows of a moved subtree survive inside it, since the ancestors of a node form a chain: those no further away than the
    moved node.  New ones join everything above the new parent with everything below the moved node.  A moved node or a
    new parent that stands in another moved subtree, or a new parent below its own node, is refused.
    """
    pairs = closed.select("ancestor_id", "descendant_id", "depth")
    below = pairs.join(moves.select(F.col("id").alias("ancestor_id"), "new_parent_id"), "ancestor_id").select(F.col("ancestor_id").alias("id"), "new_parent_id", "descendant_id", F.col("depth").alias("__down"))
    ends = moves.select(F.col("id").alias("descendant_id"), F.lit(1).alias("__least")).unionByName(moves.select(F.col("new_parent_id").alias("descendant_id"), F.lit(0).alias("__least")))
    if not below.join(ends, "descendant_id").filter("__down >= __least").isEmpty():
        raise ValueError("a moved node or its new parent stands in a moved subtree")
    stays = pairs.join(below.select("descendant_id", "__down"), "descendant_id", "left").filter("__down IS NULL OR depth <= __down")
    above = pairs.select(F.col("descendant_id").alias("new_parent_id"), "ancestor_id", F.col("depth").alias("__up"))
    added = below.join(above, "new_parent_id").select("ancestor_id", "descendant_id", (F.col("__up") + F.col("__down") + 1).cast(closed.schema["depth"].dataType).alias("depth"))
    return stays.select("ancestor_id", "descendant_id", "depth").unionByName(added)


def unhydrated(closed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ids that a closure names and that have no row in ``nodes``."""
    named = closed.select(F.col("ancestor_id").alias("id")).unionByName(closed.select(F.col("descendant_id").alias("id")))
    return named.distinct().join(nodes.select("id"), "id", "left_anti")


def hydrated(closed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The closure with its ancestors' rows as ``node``; an id without a row is an error, not a shorter result."""
    if not unhydrated(closed, nodes).isEmpty():
        raise ValueError("the closure names nodes that do not exist")
    rows = nodes.select(F.col("id").alias("ancestor_id"), F.struct(*[F.col(c) for c in nodes.columns]).alias("node"))
    return closed.join(rows, "ancestor_id")


def with_parent_in(tree: DataFrame, condition: Column) -> DataFrame:
    """Nodes whose parent meets the condition."""
    parents = tree.filter(condition).select(F.col("id").alias("parent_id"))
    return tree.join(parents, "parent_id", "left_semi")
