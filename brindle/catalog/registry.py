"""Queries of shared tables: upserts, set operations, settings, key-value state, type registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalog.book import Book
from brindle.functions.text import common_suffix, type_matches
from brindle.operators import tables

book = Book()
QUERIES = book.queries


def kv(t):
    """A change log: versions of a key, some deleted, some past their time."""
    e = t.events()
    return e.select(
        F.concat(F.lit("k/"), (F.col("event_id") % 300).cast("string")).alias("key"), F.col("event_id").alias("version"), F.col("value"), (F.col("event_id") % 13 == 0).alias("deleted"),
        F.when(F.col("event_id") % 4 == 0, F.col("ts") + F.make_dt_interval(days=F.lit(5))).alias("expires_at"),
    )


_KV = "kv AS (SELECT 'k/' || (event_id % 300) AS key, event_id AS version, event_id % 13 = 0 AS deleted, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 5 DAY END AS expires_at FROM events)"


@book("kv_latest", f"WITH {_KV} SELECT key, version FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS r FROM kv) WHERE r = 1 AND NOT deleted AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-02-04 12:00:00')")
def _(t):
    return tables.latest_keys(kv(t), F.lit("2024-02-04 12:00:00").cast("timestamp")).select("key", "version")


@book("kv_prefix", f"WITH {_KV} SELECT DISTINCT key FROM kv WHERE starts_with(key, 'k/12')")
def _(t):
    return tables.scan_prefix(kv(t).select("key").distinct(), "k/12")


@book("upsert_latest", "SELECT event_id % 500 AS key, max(event_id) AS version FROM events GROUP BY ALL")
def _(t):
    e = t.events().select((F.col("event_id") % 500).alias("key"), F.col("event_id").alias("version"), "value")
    return tables.upsert_latest(e.filter("version < 6000"), e.filter("version >= 6000"), ["key"], "version").select("key", "version")


@book("upsert_add", "SELECT user_id, cast(sum(cast(round(value * 100) AS BIGINT)) AS BIGINT) AS spent FROM events GROUP BY user_id")
def _(t):
    e = t.events().select("event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("spent"))
    old = e.filter("event_id < 5000").groupBy("user_id").agg(F.sum("spent").alias("spent"))
    return tables.upsert_add(old, e.filter("event_id >= 5000").select("user_id", "spent"), ["user_id"], ["spent"])


@book("insert_absent", "SELECT event_id FROM events WHERE event_id % 9 <> 0")
def _(t):
    e = t.events().select("event_id")
    return tables.insert_absent(e.filter("event_id % 9 = 0"), e, ["event_id"])


@book("compare_and_set", "SELECT o_orderkey AS id, o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS version, o_orderkey % 3 = 0 AS applied FROM orders")
def _(t):
    cur = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("version"), F.lit("old").alias("v"))
    new = cur.filter("id % 3 <> 1").select("id", F.when(F.col("id") % 3 == 0, F.col("version")).otherwise(F.col("version") + 9).alias("seen"), F.lit("new").alias("v"))
    return tables.compare_and_set(cur, new, "id", "seen", "version", "v").select("id", "version", "applied")


@book("merge_by_id", "SELECT c_custkey FROM customer WHERE c_acctbal < 3000 OR c_nationkey < 6")
def _(t):
    c = t.raw("customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return tables.merge_by_id([c.filter("c_acctbal < 3000"), c.filter("c_nationkey < 6")], "c_custkey", ["c_custkey"]).select("c_custkey")


@book("set_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    return tables.difference(t.raw("customer").select(F.col("c_custkey").alias("id")), t.raw("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")), ["id"])


@book("related_rows", "SELECT n_nationkey, coalesce(string_agg(cast(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') AS members FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey")
def _(t):
    kids = t.raw("supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return tables.related(t.raw("nation").select("n_nationkey"), kids, "n_nationkey").select("n_nationkey", F.array_join(F.transform("children", lambda c: c["s_suppkey"].cast("string")), ",").alias("members"))


@book("patch_fields", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(t):
    c = t.raw("customer").select("c_custkey", "c_mktsegment")
    return tables.patch(c, c.filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "NEW").alias("c_mktsegment")), "c_custkey", ["c_mktsegment"])


@book("expire_rows", "SELECT event_id, CASE WHEN event_id % 3 <> 2 AND ts <= TIMESTAMP '2024-01-15' THEN 'EXPIRED' ELSE ['PENDING', 'ACTIVE', 'DONE'][event_id % 3 + 1] END AS status FROM events")
def _(t):
    rows = t.events().select("event_id", F.element_at(F.array(F.lit("PENDING"), F.lit("ACTIVE"), F.lit("DONE")), (F.col("event_id") % 3 + 1).cast("int")).alias("status"), F.col("ts").alias("expires_at"))
    return tables.expire(rows, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id", "status")


@book("config_layers", """WITH x AS (SELECT c_custkey AS start_id, c_custkey % 2 = 0 AS enforced, c_nationkey, c_custkey % 5 AS own FROM customer)
SELECT start_id, CASE WHEN enforced THEN 'root' WHEN own = 0 THEN 'r' || c_nationkey ELSE 'c' || start_id END AS value, cast(least(100, CASE WHEN own = 1 THEN 10 ELSE 1000 END) AS BIGINT) AS rate, CASE WHEN own = 2 THEN 'a,b' ELSE 'a' END AS tags FROM x""")
def _(t):
    c = t.raw("customer")
    tag = lambda *x: F.array(*[F.lit(i) for i in x])
    root = c.select(F.col("c_custkey").alias("start_id"), F.lit(2).alias("depth"), F.when(F.col("c_custkey") % 2 == 0, "enforce").otherwise("inherit").alias("sharing"), F.lit("root").alias("value"), F.lit(100).cast("long").alias("rate"), tag("a").alias("tags"))
    nation = c.select(F.col("c_custkey").alias("start_id"), F.lit(1).alias("depth"), F.lit("inherit").alias("sharing"), F.concat(F.lit("r"), "c_nationkey").alias("value"), F.lit(None).cast("long").alias("rate"), F.lit(None).cast("array<string>").alias("tags"))
    hidden = nation.withColumns({"sharing": F.lit("private"), "value": F.lit("never"), "rate": F.lit(1).cast("long")})
    own = c.select(F.col("c_custkey").alias("start_id"), F.lit(0).alias("depth"), F.lit("private").alias("sharing"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("c"), "c_custkey")).alias("value"),
                   F.when(F.col("c_custkey") % 5 == 1, 10).cast("long").alias("rate"), F.when(F.col("c_custkey") % 5 == 2, tag("b", "a")).otherwise(F.array().cast("array<string>")).alias("tags"))
    merged = tables.layered(root.unionByName(nation).unionByName(hidden).unionByName(own))
    return merged.select("start_id", "value", "rate", F.array_join("tags", ",").alias("tags"))


@book("type_wildcards", "SELECT p_partkey, starts_with(p_type, 'ECO') AS prefix, p_type = 'ECONOMY' AS exact, true AS any FROM part")
def _(t):
    return t.raw("part").select("p_partkey", type_matches(F.col("p_type"), "ECO*").alias("prefix"), type_matches(F.col("p_type"), "ECONOMY").alias("exact"), type_matches(F.col("p_type"), "*").alias("any"))


@book("common_suffix", "SELECT n_regionkey, 'r' || n_regionkey || '.example.com' AS suffix FROM nation GROUP BY n_regionkey")
def _(t):
    n = t.raw("nation").select("n_regionkey", F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".r"), F.col("n_regionkey").cast("string"), F.lit(".example.com")).alias("host"))
    return n.groupBy("n_regionkey").agg(common_suffix(F.collect_list("host")).alias("suffix"))


@book("distinct_values", "SELECT DISTINCT o_orderpriority FROM orders")
def _(t):
    return t.raw("orders").select("o_orderpriority").distinct()


@book("group_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, cast(coalesce(sum(cast(round(o_totalprice * 100) AS BIGINT)) FILTER (WHERE o_totalprice > 400000), 0) AS BIGINT) AS large FROM orders GROUP BY ALL")
def _(t):
    m = F.round(F.col("o_totalprice") * 100).cast("long")
    return t.raw("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.coalesce(F.sum(F.when(F.col("o_totalprice") > 400000, m)), F.lit(0)).alias("large"))
