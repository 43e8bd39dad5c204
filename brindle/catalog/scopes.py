"""Queries under row-level scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalog.book import Book
from brindle.operators import hierarchy
from brindle.operators.scopes import Eq, In, InGroup, InGroupSubtree, InTenantSubtree, Lookups, Scope, apply_scope, compile_decision, cross_tenant_reads, guarded_insert, guarded_update

book = Book()
QUERIES = book.queries


def lookups(t) -> Lookups:
    """Groups are nations under regions; their members are suppliers.  Tenants are the tree's."""
    member = t.raw("supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("group_id"), F.col("s_suppkey").alias("resource_id"))
    groups = t.raw("nation").select(F.concat(F.lit("r"), "n_regionkey").alias("ancestor_id"), F.concat(F.lit("n"), "n_nationkey").alias("descendant_id"))
    same = t.raw("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("ancestor_id"), F.concat(F.lit("n"), "n_nationkey").alias("descendant_id"))
    tree = t.tenants()
    closed = hierarchy.closure(tree, levels=3).join(tree.select(F.col("id").alias("descendant_id"), F.col("status").alias("descendant_status")), "descendant_id")
    return Lookups(member, groups.unionByName(same), closed, {"supplier": "l_suppkey"})


@book("scope_tenants", "SELECT id FROM usage_records WHERE tenant_id IN ('t1', 't2') AND gts_id = 'click'")
def _(t):
    return apply_scope(t.usage_records(), Scope(((In("tenant_id", ("t1", "t2")), Eq("gts_id", "click")),))).select("id")


@book("scope_any_of", "SELECT id FROM usage_records WHERE tenant_id = 't3' OR resource_id IN ('r1', 'r2') AND status = 'active'")
def _(t):
    return apply_scope(t.usage_records(), Scope(((Eq("tenant_id", "t3"),), (In("resource_id", ("r1", "r2")), Eq("status", "active")), (Eq("no_such", 1),)))).select("id")


@book("scope_deny", "SELECT id FROM usage_records WHERE false")
def _(t):
    return apply_scope(t.usage_records(), compile_decision({"allow": True, "constraints": [[{"type": "unknown"}]]})).select("id")


@book("scope_group", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (3, 8))")
def _(t):
    return apply_scope(t.raw("lineitem"), Scope(((InGroup("supplier", ("n3", "n8")),),)), lookups(t)).select("l_orderkey", "l_linenumber")


@book("scope_group_subtree", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1)")
def _(t):
    return apply_scope(t.raw("lineitem"), Scope(((InGroupSubtree("supplier", ("r1",)),),)), lookups(t)).select("l_orderkey", "l_linenumber")


@book("scope_tenant_subtree", "SELECT id FROM tenants WHERE id IN (SELECT c.descendant_id FROM closure c JOIN tenants t ON c.descendant_id = t.id WHERE c.ancestor_id = 'r1' AND (c.barrier = 0 AND t.status = 1 OR c.descendant_id = 'r1'))")
def _(t):
    return apply_scope(t.tenants(), Scope(((InTenantSubtree("id", "r1", True, (1,)),),)), lookups(t)).select("id")


@book("scope_or_of_sets", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) OR l_suppkey IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (0, 3)) OR l_orderkey = 7")
def _(t):
    s = Scope(((InGroup("supplier", ("n3",)),), (InGroupSubtree("supplier", ("r0", "r3")),), (Eq("l_orderkey", 7),)))
    return apply_scope(t.raw("lineitem"), s, lookups(t)).select("l_orderkey", "l_linenumber")


@book("scope_then_join", "SELECT payer_id, count(*) AS n, cast(sum(amount_minor) AS BIGINT) AS total FROM journal_lines WHERE tenant_id = 't4' AND side = 'DR' AND entry_id IN (SELECT entry_id FROM journal_entries WHERE tenant_id = 't4' AND period_id >= '199701') GROUP BY payer_id")
def _(t):
    scope = Scope.tenants("t4")
    lines, entries = apply_scope(t.journal_lines(), scope), apply_scope(t.journal_entries(), scope).filter("period_id >= '199701'")
    return lines.filter("side = 'DR'").join(entries.select("entry_id"), "entry_id", "left_semi").groupBy("payer_id").agg(F.count("*").alias("n"), F.sum("amount_minor").alias("total"))


@book("scope_cross_tenant", "SELECT id, tenant_id = 't' || (event_id % 15) OR event_id % 15 < 5 AND tenant_id IN ('t1', 't2') AS allowed, tenant_id <> 't' || (event_id % 15) AS audited FROM usage_records")
def _(t):
    reads = t.usage_records().withColumn("reader_id", F.concat(F.lit("t"), (F.col("event_id") % 15).cast("string")))
    grants = t.spark.createDataFrame([(f"t{i}", x) for i in range(5) for x in ("t1", "t2")], "reader_id string, tenant_id string")
    return cross_tenant_reads(reads, grants).select("id", "allowed", "audited")


@book("scope_insert_guard", "SELECT id, CASE WHEN tenant_id IN ('t1', 't5') THEN 'inserted' ELSE 'refused' END AS outcome FROM usage_records")
def _(t):
    fit, refused = guarded_insert(t.usage_records().select("id", "tenant_id"), Scope.tenants("t1", "t5"))
    return fit.select("id", F.lit("inserted").alias("outcome")).unionByName(refused.select("id", F.lit("refused").alias("outcome")))


@book("scope_update_guard", "SELECT id, CASE WHEN tenant_id NOT IN ('t1', 't5') THEN 'out_of_scope' WHEN event_id % 4 = 0 AND tenant_id <> 't1' THEN 'tenant_change' ELSE 'applied' END AS verdict FROM usage_records")
def _(t):
    rows = t.usage_records()
    changes = rows.select("id", F.when(F.col("event_id") % 4 == 0, "t1").alias("tenant_id"))
    return guarded_update(rows.select("id", "tenant_id"), changes, Scope.tenants("t1", "t5")).select("id", "verdict")
