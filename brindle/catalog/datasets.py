"""The supplied tables in the shapes that the operators expect, in Spark and, as common table expressions, in SQL.

Usage records come from events (one extra compensation row for some), the journal and the invoices from orders and
lineitem, the tenant tree from region, nation and customer, messages from conversations.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def minor(name: str):
    """Whole hundredths of a double with two decimals."""
    return F.round(F.col(name) * 100).cast("long")


class Tables:
    """Lazy access to the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def usage_records(self) -> DataFrame:
        e = self.events()
        base = e.select(
            F.concat(F.lit("e"), "event_id").alias("id"), F.concat(F.lit("t"), "user_id").alias("tenant_id"), F.col("event_type").alias("gts_id"),
            F.when(F.col("event_type") == "error", "gauge").otherwise("counter").alias("kind"), minor("value").alias("value"), F.col("ts").alias("created_at"),
            F.concat(F.lit("r"), (F.col("event_id") % 20).cast("string")).alias("resource_id"), F.when(F.col("event_id") % 2 == 0, "compute").otherwise("storage").alias("resource_type"),
            F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("s"), (F.col("event_id") % 7).cast("string"))).alias("subject_id"),
            F.concat(F.lit("k"), (F.col("event_id") - F.col("event_id") % 50).cast("string"), F.lit("-"), (F.col("event_id") % 45).cast("string")).alias("idempotency_key"),
            F.lit(None).cast("string").alias("corrects_id"), F.when(F.col("event_id") % 29 == 0, "inactive").otherwise("active").alias("status"),
            F.map_from_arrays(F.array(F.lit("k")), F.array(F.get_json_object("props", "$.k"))).alias("metadata"), F.col("event_id"),
        )
        back = base.filter("event_id % 10 = 9 AND gts_id <> 'error'").withColumns(
            {"corrects_id": F.col("id"), "id": F.concat(F.lit("c"), "event_id"), "value": -F.expr("value div 2"), "idempotency_key": F.concat(F.lit("x"), "idempotency_key")}
        )
        return base.unionByName(back)

    def journal_entries(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("entry_id"), F.concat(F.lit("t"), (F.col("o_custkey") % 10).cast("string")).alias("tenant_id"),
            F.date_format("o_orderdate", "yyyyMM").alias("period_id"), F.col("o_orderdate").cast("timestamp").alias("posted_at"),
            F.when(F.col("o_orderkey") % 13 == 5, F.col("o_orderkey") - 1).alias("reverses_entry_id"), F.col("o_orderkey").alias("created_seq"), F.col("o_custkey").alias("payer_id"),
        )

    def journal_lines(self) -> DataFrame:
        """A debit to receivables for each item and one credit, to revenue, of their sum; every 97th entry is a cent short."""
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        l = self.raw("lineitem")
        debit = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_orderkey").alias("entry_id"), F.concat(F.lit("t"), (F.col("o_custkey") % 10).cast("string")).alias("tenant_id"), F.col("o_custkey").alias("payer_id"),
            F.lit("DR").alias("side"), F.lit("AR").alias("account_class"), minor("l_extendedprice").alias("amount_minor"), F.when(F.col("o_custkey") % 2 == 0, "USD").otherwise("EUR").alias("currency"),
            F.col("l_suppkey").alias("stream"),
        )
        credit = debit.groupBy("entry_id", "tenant_id", "payer_id", "currency").agg(F.sum("amount_minor").alias("total")).select(
            "entry_id", "tenant_id", "payer_id", F.lit("CR").alias("side"), F.lit("REVENUE").alias("account_class"),
            (F.col("total") - F.when(F.col("entry_id") % 97 == 0, 1).otherwise(0)).alias("amount_minor"), "currency", F.lit(None).cast("long").alias("stream"),
        )
        return debit.unionByName(credit)

    def invoices(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("payer_id"), minor("o_totalprice").alias("open_minor"),
            F.col("o_orderdate").cast("date").alias("due_date"), F.col("o_orderdate").cast("timestamp").alias("posted_at"), (F.col("o_orderstatus") == "F").alias("settled"),
        )

    def tenants(self) -> DataFrame:
        """Regions, nations and customers as three levels under one root."""
        region = self.raw("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("root").alias("parent_id"), F.lit(False).alias("self_managed"), F.lit(1).alias("status"))
        nation = self.raw("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), (F.col("n_nationkey") % 7 == 0).alias("self_managed"), F.when(F.col("n_nationkey") % 11 == 3, 2).otherwise(1).alias("status"))
        customer = self.raw("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), (F.col("c_custkey") % 17 == 0).alias("self_managed"), F.when(F.col("c_custkey") % 9 == 4, 2).otherwise(1).alias("status"))
        root = self.spark.createDataFrame([("root", None, False, 1)], "id string, parent_id string, self_managed boolean, status int")
        return root.unionByName(region).unionByName(nation).unionByName(customer)

    def messages(self) -> DataFrame:
        c = self.raw("conversations")
        return c.select(
            F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.col("conv_id").alias("session_id"), F.col("turn"),
            F.when(F.col("turn") > 0, F.concat_ws("-", F.col("conv_id"), (F.col("turn") - 1))).alias("parent_id"), "role", F.col("text").alias("content"),
            (F.col("turn") % 7 == 6).alias("hidden"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(F.col("conv_id") * 10 + F.col("turn")).cast("int"))).alias("created_at"),
        )


_CTES = {
    "usage_records": """base_usage AS (
  SELECT 'e' || event_id AS id, 't' || user_id AS tenant_id, event_type AS gts_id, CASE WHEN event_type = 'error' THEN 'gauge' ELSE 'counter' END AS kind,
         cast(round(value * 100) AS BIGINT) AS value, ts AS created_at, 'r' || (event_id % 20) AS resource_id, CASE WHEN event_id % 2 = 0 THEN 'compute' ELSE 'storage' END AS resource_type,
         CASE WHEN event_id % 3 <> 0 THEN 's' || (event_id % 7) END AS subject_id, 'k' || (event_id - event_id % 50) || '-' || (event_id % 45) AS idempotency_key,
         cast(NULL AS VARCHAR) AS corrects_id, CASE WHEN event_id % 29 = 0 THEN 'inactive' ELSE 'active' END AS status, regexp_extract(props, '"k": ([0-9]+)', 1) AS k, event_id
  FROM events),
usage_records AS (
  SELECT * FROM base_usage UNION ALL
  SELECT 'c' || event_id, tenant_id, gts_id, kind, -(value // 2), created_at, resource_id, resource_type, subject_id, 'x' || idempotency_key, id, status, k, event_id
  FROM base_usage WHERE event_id % 10 = 9 AND gts_id <> 'error')""",
    "journal_entries": """journal_entries AS (
  SELECT o_orderkey AS entry_id, 't' || (o_custkey % 10) AS tenant_id, strftime(o_orderdate, '%Y%m') AS period_id, o_orderdate AS posted_at,
         CASE WHEN o_orderkey % 13 = 5 THEN o_orderkey - 1 END AS reverses_entry_id, o_orderkey AS created_seq, o_custkey AS payer_id FROM orders)""",
    "journal_lines": """debit_lines AS (
  SELECT l_orderkey AS entry_id, 't' || (o_custkey % 10) AS tenant_id, o_custkey AS payer_id, 'DR' AS side, 'AR' AS account_class, cast(round(l_extendedprice * 100) AS BIGINT) AS amount_minor,
         CASE WHEN o_custkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency, l_suppkey AS stream FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
journal_lines AS (
  SELECT * FROM debit_lines UNION ALL
  SELECT entry_id, tenant_id, payer_id, 'CR', 'REVENUE', cast(sum(amount_minor) - CASE WHEN entry_id % 97 = 0 THEN 1 ELSE 0 END AS BIGINT), currency, NULL
  FROM debit_lines GROUP BY entry_id, tenant_id, payer_id, currency)""",
    "invoices": """invoices AS (
  SELECT o_orderkey AS invoice_id, o_custkey AS payer_id, cast(round(o_totalprice * 100) AS BIGINT) AS open_minor, cast(o_orderdate AS DATE) AS due_date, o_orderdate AS posted_at,
         o_orderstatus = 'F' AS settled FROM orders)""",
    "tenants": """tenants AS (
  SELECT 'root' AS id, cast(NULL AS VARCHAR) AS parent_id, false AS self_managed, 1 AS status UNION ALL
  SELECT 'r' || r_regionkey, 'root', false, 1 FROM region UNION ALL
  SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey % 7 = 0, CASE WHEN n_nationkey % 11 = 3 THEN 2 ELSE 1 END FROM nation UNION ALL
  SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey % 17 = 0, CASE WHEN c_custkey % 9 = 4 THEN 2 ELSE 1 END FROM customer)""",
    "closure": """RECURSIVE_closure AS (
  SELECT id AS ancestor_id, id AS descendant_id, 0 AS barrier, 0 AS depth, self_managed AS top FROM tenants UNION ALL
  SELECT t.parent_id, c.descendant_id, CASE WHEN c.barrier = 1 OR c.top THEN 1 ELSE 0 END, c.depth + 1, p.self_managed
  FROM RECURSIVE_closure c JOIN tenants t ON c.ancestor_id = t.id JOIN tenants p ON t.parent_id = p.id),
closure AS (SELECT ancestor_id, descendant_id, barrier, depth FROM RECURSIVE_closure)""",
    "messages": """messages AS (
  SELECT conv_id || '-' || turn AS message_id, conv_id AS session_id, turn, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent_id, role, text AS content,
         turn % 7 = 6 AS hidden, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id * 10 + turn) AS created_at FROM conversations)""",
}
_NEEDS = {"closure": ("tenants",)}


def sql(text: str) -> str:
    """The query with the table expressions that it names put before it."""
    used: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            need(other)
        if name not in used:
            used.append(name)

    for name in _CTES:
        if re.search(rf"\b{name}\b", text):
            need(name)
    body = text.strip()
    recursive = "closure" in used
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if own:
        recursive |= bool(own[1])
        body = ", ".join([*(_CTES[n] for n in used), body[own.end() :]])
        return f"WITH {'RECURSIVE ' * recursive}{body}"
    if not used:
        return body
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(_CTES[n] for n in used)} {body}"
