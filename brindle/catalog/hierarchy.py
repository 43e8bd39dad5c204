"""Queries of trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalog.book import Book
from brindle.operators import hierarchy as h

book = Book()
QUERIES = book.queries
LEVELS = 3


def stored(t):
    """The stored closure, with planted faults: missing, stale, wrong barrier, wrong status, by customer number."""
    tree = t.tenants()
    rows = h.closure(tree, levels=LEVELS).join(tree.select(F.col("id").alias("descendant_id"), F.col("status").alias("descendant_status")), "descendant_id")
    n = F.coalesce(F.expr("try_cast(substring(descendant_id, 2) as int)"), F.lit(0))
    leaf = F.startswith("descendant_id", F.lit("c"))
    rows = rows.filter(~(leaf & (n % 100 == 1) & (F.col("depth") == 2)) & ~(leaf & (n % 100 == 2) & (F.col("depth") == 0)))
    rows = rows.withColumns({"barrier": F.when(leaf & (n % 100 == 3) & (F.col("depth") == 1), 1 - F.col("barrier")).otherwise(F.col("barrier")), "descendant_status": F.when(leaf & (n % 100 == 4), 2 - F.col("descendant_status") % 2).otherwise(F.col("descendant_status"))})
    stale = rows.filter(leaf & (n % 100 == 5) & (F.col("depth") == 1)).withColumn("ancestor_id", F.lit("n_gone"))
    return rows.unionByName(stale).select("ancestor_id", "descendant_id", "barrier", "descendant_status")


_STORED = """x AS (SELECT c.*, t.status, starts_with(descendant_id, 'c') AS leaf, coalesce(try_cast(substr(descendant_id, 2) AS INTEGER), 0) AS n FROM closure c JOIN tenants t ON c.descendant_id = t.id)"""


@book("tree_closure", "SELECT ancestor_id, descendant_id, barrier, depth FROM closure")
def _(t):
    return h.closure(t.tenants())


@book("tree_ancestors", """SELECT c.descendant_id AS start_id, c.ancestor_id AS id, c.depth FROM closure c JOIN tenants s ON c.descendant_id = s.id
WHERE c.depth > 0 AND NOT s.self_managed AND NOT EXISTS (SELECT 1 FROM closure m JOIN tenants t ON m.ancestor_id = t.id WHERE m.descendant_id = c.descendant_id AND m.depth > 0 AND m.depth < c.depth AND t.self_managed)""")
def _(t):
    tree = t.tenants()
    return h.ancestors(h.closure(tree, levels=LEVELS), tree, tree.select("id"))


@book("tree_ancestors_all", "SELECT descendant_id AS start_id, ancestor_id AS id, depth FROM closure WHERE depth > 0")
def _(t):
    tree = t.tenants()
    return h.ancestors(h.closure(tree, levels=LEVELS), tree, tree.select("id"), respect_barriers=False)


@book("tree_descendants", "SELECT c.descendant_id AS id, c.depth FROM closure c JOIN tenants t ON c.descendant_id = t.id WHERE c.ancestor_id = 'root' AND c.depth > 0 AND c.barrier = 0")
def _(t):
    return h.descendants(t.tenants(), "root", levels=LEVELS).select("id", "depth")


@book("tree_descendants_status", """WITH RECURSIVE w AS (SELECT id, 1 AS depth FROM tenants WHERE parent_id = 'r1' AND status = 1 UNION ALL SELECT t.id, w.depth + 1 FROM tenants t JOIN w ON t.parent_id = w.id WHERE t.status = 1 AND w.depth < 2)
SELECT id, depth FROM w""")
def _(t):
    return h.descendants(t.tenants(), "r1", respect_barriers=False, statuses=(1,), max_depth=2, levels=LEVELS).select("id", "depth")


@book("tree_is_ancestor", """WITH p AS (SELECT 'n' || c_nationkey AS ancestor_id, 'c' || c_custkey AS descendant_id FROM customer UNION SELECT 'n' || (c_custkey % 25), 'c' || c_custkey FROM customer)
SELECT ancestor_id, descendant_id, EXISTS (SELECT 1 FROM closure c WHERE c.ancestor_id = p.ancestor_id AND c.descendant_id = p.descendant_id AND c.depth > 0 AND c.barrier = 0) AS result FROM p""")
def _(t):
    # Every customer is asked about its own nation and about another one.
    c = t.raw("customer")
    asked = [c.select(F.concat(F.lit("n"), k).alias("ancestor_id"), F.concat(F.lit("c"), "c_custkey").alias("descendant_id")) for k in (F.col("c_nationkey"), F.col("c_custkey") % 25)]
    return h.is_ancestor(h.closure(t.tenants(), levels=LEVELS), asked[0].unionByName(asked[1]).distinct())


@book("tree_integrity", f"""WITH {_STORED}, v AS (SELECT CASE WHEN leaf AND n % 100 = 1 AND depth = 2 THEN 'coverage_gap' WHEN leaf AND n % 100 = 2 AND depth = 0 THEN 'missing_self_row'
 WHEN leaf AND n % 100 = 3 AND depth = 1 THEN 'barrier' WHEN leaf AND n % 100 = 4 AND status <> 2 - status % 2 THEN 'status' END AS category FROM x UNION ALL SELECT 'stale_edge' FROM x WHERE leaf AND n % 100 = 5 AND depth = 1)
SELECT c.category, count(v.category) AS n FROM (VALUES ('orphan'), ('broken_parent'), ('cycle'), ('depth'), ('root_count'), ('missing_self_row'), ('coverage_gap'), ('stale_edge'), ('barrier'), ('status')) c(category) LEFT JOIN v ON c.category = v.category GROUP BY c.category""")
def _(t):
    return h.fault_counts(h.integrity(t.tenants(), stored(t)))


@book("tree_repair", f"""WITH {_STORED} SELECT 'insert' AS action, ancestor_id, descendant_id, barrier, status AS descendant_status FROM x WHERE leaf AND (n % 100 = 1 AND depth = 2 OR n % 100 = 2 AND depth = 0)
UNION ALL SELECT 'update', ancestor_id, descendant_id, barrier, status FROM x WHERE leaf AND (n % 100 = 3 AND depth = 1 OR n % 100 = 4 AND status <> 2 - status % 2)
UNION ALL SELECT 'delete', 'n_gone', descendant_id, barrier, status FROM x WHERE leaf AND n % 100 = 5 AND depth = 1""")
def _(t):
    return h.repair(t.tenants(), stored(t), LEVELS)


@book("tree_inherited", """WITH v AS (SELECT id, 'v' || id AS value FROM tenants WHERE id IN ('root', 'r1', 'n3', 'n7', 'n11', 'c17', 'c34'))
SELECT t.id, (SELECT arg_min(v.value, c.depth) FROM closure c JOIN v ON c.ancestor_id = v.id WHERE c.descendant_id = t.id AND (c.barrier = 0 OR c.depth = 0)) AS value FROM tenants t""")
def _(t):
    tree = t.tenants()
    values = tree.filter("id IN ('root', 'r1', 'n3', 'n7', 'n11', 'c17', 'c34')").select("id", F.concat(F.lit("v"), "id").alias("value"))
    return h.inherited(h.closure(tree, levels=LEVELS), tree, values)


@book("tree_closest", """WITH s AS (SELECT * FROM (VALUES ('root', 'key', 'shared'), ('n3', 'key', 'private'), ('n3', 'key', 'shared'), ('n8', 'key', 'private'), ('r2', 'key', 'shared'), ('c5', 'key', 'private'), ('c5', 'key', 'shared')) v(tenant_id, name, sharing)),
m AS (SELECT c.descendant_id AS start_id, s.tenant_id, c.depth, s.sharing, row_number() OVER (PARTITION BY c.descendant_id ORDER BY c.depth, s.sharing <> 'private') AS r FROM closure c JOIN s ON c.ancestor_id = s.tenant_id WHERE c.depth = 0 OR s.sharing <> 'private')
SELECT t.id AS start_id, m.tenant_id AS owner_id, m.depth, m.sharing FROM tenants t LEFT JOIN m ON t.id = m.start_id AND m.r = 1""")
def _(t):
    tree = t.tenants()
    rows = t.spark.createDataFrame([("root", "key", "shared"), ("n3", "key", "private"), ("n3", "key", "shared"), ("n8", "key", "private"), ("r2", "key", "shared"), ("c5", "key", "private"), ("c5", "key", "shared")], "tenant_id string, name string, sharing string")
    chain = h.closure(tree, levels=LEVELS).select(F.col("descendant_id").alias("start_id"), F.col("ancestor_id").alias("id"), "depth")
    return h.closest(tree.select(F.col("id").alias("start_id"), F.lit("key").alias("name")), chain, rows).select("start_id", "owner_id", "depth", "sharing")


@book("tree_alias", """WITH s AS (SELECT * FROM (VALUES ('root', 'svc', 'shared', true), ('n3', 'svc', 'shared', false), ('n8', 'svc', 'private', true), ('r2', 'svc', 'shared', true), ('c5', 'svc', 'private', true), ('n4', 'old', 'shared', false), ('c5', 'old', 'private', false)) v(tenant_id, alias, sharing, enabled)),
q AS (SELECT id AS start_id, a.alias FROM tenants, (VALUES ('svc'), ('old')) a(alias)), m AS (SELECT c.descendant_id AS start_id, s.alias, s.tenant_id, c.depth, s.enabled FROM closure c JOIN s ON c.ancestor_id = s.tenant_id WHERE c.depth = 0 OR s.sharing <> 'private'),
g AS (SELECT start_id, alias, min(depth) FILTER (WHERE enabled) AS depth, arg_min(tenant_id, depth) FILTER (WHERE enabled) AS owner_id, string_agg(tenant_id, ',' ORDER BY depth DESC) FILTER (WHERE enabled) AS layers FROM m GROUP BY ALL)
SELECT q.start_id, q.alias, CASE WHEN g.depth IS NOT NULL THEN 'found' WHEN g.start_id IS NOT NULL THEN 'disabled' ELSE 'not_found' END AS outcome, owner_id, depth, coalesce(layers, '') AS layers FROM q LEFT JOIN g ON q.start_id = g.start_id AND q.alias = g.alias""")
def _(t):
    tree = t.tenants()
    rows = t.spark.createDataFrame(
        [("root", "svc", "shared", True), ("n3", "svc", "shared", False), ("n8", "svc", "private", True), ("r2", "svc", "shared", True), ("c5", "svc", "private", True), ("n4", "old", "shared", False), ("c5", "old", "private", False)],
        "tenant_id string, alias string, sharing string, enabled boolean",
    )
    chain = h.closure(tree, levels=LEVELS).select(F.col("descendant_id").alias("start_id"), F.col("ancestor_id").alias("id"), "depth")
    asked = tree.select(F.col("id").alias("start_id"), F.explode(F.array(F.lit("svc"), F.lit("old"))).alias("alias"))
    return h.resolve_alias(asked, chain, rows).withColumn("layers", F.array_join("layers", ","))


@book("tree_retention_due", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 = 0 AND c_custkey * 3600 >= CASE WHEN c_custkey % 2 = 0 THEN 1000000 ELSE 2000000 END")
def _(t):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    gone = t.raw("customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4).alias("depth"), F.when(F.col("c_custkey") % 5 == 0, now - F.make_dt_interval(hours=F.col("c_custkey").cast("int"))).alias("deleted_at"),
        F.when(F.col("c_custkey") % 2 == 0, 1000000).cast("long").alias("retention_seconds"),
    )
    return h.retention_due(gone, now, 2000000).select("id")


@book("tree_move", """WITH RECURSIVE moved AS (SELECT id, CASE WHEN starts_with(id, 'n') AND cast(substr(id, 2) AS INTEGER) % 6 = 1 THEN 'r' || ((cast(substr(parent_id, 2) AS INTEGER) + 1) % 5) ELSE parent_id END AS parent_id FROM tenants),
w AS (SELECT id AS ancestor_id, id AS descendant_id, 0 AS depth FROM moved UNION ALL SELECT m.parent_id, w.descendant_id, w.depth + 1 FROM w JOIN moved m ON w.ancestor_id = m.id WHERE m.parent_id IS NOT NULL)
SELECT ancestor_id, descendant_id, depth FROM w""")
def _(t):
    tree = t.tenants()
    nations = tree.filter("id LIKE 'n%' AND try_cast(substring(id, 2) AS int) % 6 = 1")
    moves = nations.select("id", F.expr("concat('r', (try_cast(substring(parent_id, 2) AS int) + 1) % 5)").alias("new_parent_id"))
    return h.move_subtrees(h.closure(tree, levels=LEVELS), moves)


@book("tree_unhydrated", "SELECT id FROM tenants WHERE starts_with(id, 'c') AND cast(substr(id, 2) AS INTEGER) % 10 = 3")
def _(t):
    tree = t.tenants()
    return h.unhydrated(h.closure(tree, levels=LEVELS), tree.filter("NOT (id LIKE 'c%' AND try_cast(substring(id, 2) AS int) % 10 = 3)"))


@book("tree_hydrated", "SELECT ancestor_id, descendant_id, depth, p.status AS ancestor_status FROM closure JOIN tenants p ON p.id = ancestor_id")
def _(t):
    tree = t.tenants()
    return h.hydrated(h.closure(tree, levels=LEVELS), tree).select("ancestor_id", "descendant_id", "depth", F.col("node.status").alias("ancestor_status"))


@book("tree_parent_condition", "SELECT t.id FROM tenants t JOIN tenants p ON t.parent_id = p.id WHERE p.self_managed")
def _(t):
    return h.with_parent_in(t.tenants(), F.col("self_managed")).select("id")
