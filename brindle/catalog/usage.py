"""Queries of usage metering."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from brindle.catalog.book import Book
from brindle.functions.ids import record_id
from brindle.operators import usage
from brindle.operators.scopes import Scope, apply_scope
from brindle.operators.usage import RECORDS, Spec, aggregate
from brindle.plans import syntax
from brindle.plans.schema import bind

book = Book()
QUERIES = book.queries
WINDOW = "created_at ge 2024-01-05T00:00:00Z and created_at lt 2024-01-20T00:00:00Z"
_IN = "status = 'active' AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-20'"
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def run(t, spec, scope=None, text=WINDOW):
    """Every group: the queries' SQL has no bucket cap."""
    node = syntax.parse(text)
    usage.check_window(node)
    rows = apply_scope(t.usage_records(), scope or Scope.allow_all())
    return aggregate(rows, replace(spec, max_buckets=None), bind(RECORDS, node))


@book("usage_sum_by_type", f"SELECT resource_type, cast(sum(value) AS BIGINT) AS result FROM usage_records WHERE {_IN} AND gts_id = 'purchase' AND tenant_id IN ('t1', 't2', 't3', 't4', 't5', 't6') GROUP BY resource_type")
def _(t):
    return run(t, Spec("purchase", "counter", "SUM", ("resource_type",)), Scope.tenants(*[f"t{i}" for i in range(1, 7)])).select("resource_type", F.col("result").cast("bigint").alias("result"))


@book("usage_count_by_tenant", f"SELECT tenant_id, resource_id, count(*) FILTER (WHERE corrects_id IS NULL) AS result FROM usage_records WHERE {_IN} AND gts_id = 'view' GROUP BY tenant_id, resource_id")
def _(t):
    return run(t, Spec("view", "counter", "COUNT", ("tenant_id", "resource_id")))


@book("usage_min_max", f"SELECT subject_id, min(value) AS least, max(value) AS most FROM usage_records WHERE {_IN} AND gts_id = 'error' GROUP BY subject_id")
def _(t):
    low, high = (run(t, Spec("error", "gauge", op, ("subject_id",))) for op in ("MIN", "MAX"))
    return low.select(F.col("subject_id").alias("s"), F.col("result").alias("least")).join(high, F.col("s").eqNullSafe(F.col("subject_id"))).select("subject_id", "least", F.col("result").alias("most"))


@book("usage_avg", f"SELECT resource_type, cast(cast((2 * cast(sum(value) AS HUGEINT) * 1000000 + count(*)) // (2 * count(*)) AS BIGINT) AS BIGINT) AS micro FROM usage_records WHERE {_IN} AND gts_id = 'error' GROUP BY resource_type")
def _(t):
    return run(t, Spec("error", "gauge", "AVG", ("resource_type",))).select("resource_type", (F.col("result") * 1_000_000).cast("bigint").alias("micro"))


@book("usage_total", f"SELECT cast(sum(value) AS BIGINT) AS result FROM usage_records WHERE {_IN} AND gts_id = 'no_such'")
def _(t):
    return run(t, Spec("no_such", "counter", "SUM")).select(F.col("result").cast("bigint").alias("result"))


@book("usage_by_metadata", f"SELECT k AS metadata_k, cast(sum(value) AS BIGINT) AS result FROM usage_records WHERE {_IN} AND gts_id = 'signup' GROUP BY k")
def _(t):
    return run(t, Spec("signup", "counter", "SUM", ("metadata/k",))).select("metadata_k", F.col("result").cast("bigint").alias("result"))


@book("usage_netting", "SELECT tenant_id, cast(sum(value) AS BIGINT) AS net, cast(coalesce(sum(value) FILTER (WHERE corrects_id IS NULL), 0) AS BIGINT) AS gross, count(*) FILTER (WHERE corrects_id IS NOT NULL) AS corrections FROM usage_records WHERE status = 'active' AND kind = 'counter' GROUP BY tenant_id")
def _(t):
    rows = t.usage_records().filter("status = 'active' AND kind = 'counter'")
    return rows.groupBy("tenant_id").agg(F.sum("value").alias("net"), F.coalesce(F.sum(F.when(F.col("corrects_id").isNull(), F.col("value"))), F.lit(0)).alias("gross"), F.count("corrects_id").alias("corrections"))


def _batch(t):
    """Events squeezed onto a few identities: some repeats agree, some differ."""
    e = t.usage_records().filter("corrects_id IS NULL")
    return e.select(
        F.col("event_id").alias("ordinal"), "tenant_id", "gts_id", F.concat(F.lit("k"), (F.col("event_id") % 13).cast("string")).alias("idempotency_key"), F.date_trunc("DAY", "created_at").alias("created_at"),
        (F.col("event_id") % 2).alias("value"), F.concat_ws("/", "tenant_id", "gts_id").alias("id"), F.lit("r").alias("resource_id"),
    )


@book("usage_ingest", """WITH b AS (SELECT event_id AS ordinal, event_id % 2 AS value, tenant_id, gts_id, event_id % 13 AS k, date_trunc('day', created_at) AS d FROM usage_records WHERE corrects_id IS NULL),
r AS (SELECT ordinal, row_number() OVER w AS n, value = first_value(value) OVER w AS same FROM b WINDOW w AS (PARTITION BY tenant_id, gts_id, k, d ORDER BY ordinal))
SELECT ordinal, CASE WHEN n = 1 THEN 'inserted' WHEN same THEN 'absorbed' ELSE 'conflict' END AS outcome FROM r""")
def _(t):
    return usage.ingest(_batch(t)).select("ordinal", "outcome")


@book("usage_value_faults", """SELECT id, CASE WHEN kind = 'counter' AND corrects_id IS NULL AND v < 0 THEN 'negative_counter' WHEN kind = 'counter' AND corrects_id IS NOT NULL AND v >= 0 THEN 'correction_not_negative'
WHEN kind <> 'counter' AND corrects_id IS NOT NULL THEN 'gauge_correction' END AS fault FROM (SELECT *, value - 500 AS v FROM usage_records)""")
def _(t):
    return t.usage_records().withColumn("value", F.col("value") - 500).select("id", usage.value_fault().alias("fault"))


@book("usage_correction_faults", """SELECT r.id, CASE WHEN o.id IS NULL THEN 'target_missing' WHEN o.corrects_id IS NOT NULL THEN 'target_is_correction'
WHEN r.tenant_id IS DISTINCT FROM o.tenant_id OR r.resource_id IS DISTINCT FROM o.resource_id OR r.subject_id IS DISTINCT FROM o.subject_id OR r.gts_id IS DISTINCT FROM o.gts_id OR r.resource_type IS DISTINCT FROM o.resource_type THEN 'identity_mismatch'
WHEN o.status <> 'active' THEN 'target_inactive' END AS fault
FROM (SELECT id, CASE WHEN event_id % 8 = 1 THEN 'gone' WHEN event_id % 8 = 3 THEN id ELSE corrects_id END AS corrects_id, tenant_id, gts_id, CASE WHEN event_id % 8 = 5 THEN 'other' ELSE resource_id END AS resource_id, resource_type, subject_id FROM usage_records WHERE corrects_id IS NOT NULL) r
LEFT JOIN usage_records o ON r.corrects_id = o.id""")
def _(t):
    rows = t.usage_records()
    bad = F.when(F.col("event_id") % 8 == 1, "gone").when(F.col("event_id") % 8 == 3, F.col("id")).otherwise(F.col("corrects_id"))
    odd = rows.filter("corrects_id IS NOT NULL").withColumns({"corrects_id": bad, "resource_id": F.when(F.col("event_id") % 8 == 5, "other").otherwise(F.col("resource_id"))})
    return usage.correction_faults(rows.filter("corrects_id IS NULL").unionByName(odd)).select("id", "fault")


@book("usage_deactivate", """SELECT id, CASE WHEN status = 'active' AND hit THEN 'inactive' ELSE status END AS status, status = 'active' AND hit AS changed
FROM (SELECT id, status, event_id % 20 = 9 AS hit FROM usage_records)""")
def _(t):
    rows = t.usage_records()
    return usage.deactivate(rows, rows.filter("event_id % 20 = 9 AND corrects_id IS NULL")).select("id", "status", "changed")


@book("usage_unreferenced_types", "SELECT * FROM (VALUES ('unused'), ('never')) v(gts_id)")
def _(t):
    rows = t.usage_records()
    types = rows.select("gts_id").distinct().unionByName(t.spark.createDataFrame([("unused",), ("never",)], "gts_id string"))
    return usage.unreferenced(types, rows)


@book("usage_expired", "SELECT id FROM usage_records WHERE created_at < TIMESTAMP '2024-01-31' - INTERVAL 20 DAY")
def _(t):
    return usage.expired(t.usage_records(), 20 * 86400, F.lit("2024-01-31 00:00:00").cast("timestamp")).select("id")


@book("usage_metadata_faults", "SELECT id, CASE WHEN event_id % 2 = 0 THEN 'undeclared_key' END AS fault FROM usage_records")
def _(t):
    declared = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("other"))).otherwise(F.array(F.lit("k"), F.lit("other")))
    return t.usage_records().select("id", usage.metadata_fault(F.col("metadata"), declared).alias("fault"))


@book("usage_record_ids", f"""WITH h AS (SELECT id, sha1(from_hex('{NAMESPACE.replace("-", "")}') || encode(concat_ws(chr(31), tenant_id, gts_id, cast(epoch_us(created_at) AS VARCHAR), idempotency_key))) AS h FROM usage_records)
SELECT id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (strpos('0123456789abcdef', h[17:17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS record_id FROM h""")
def _(t):
    return t.usage_records().select("id", record_id(NAMESPACE, F.col("tenant_id"), F.col("gts_id"), F.col("created_at"), F.col("idempotency_key")).alias("record_id"))


@book("usage_distinct_tenants", "SELECT gts_id, count(DISTINCT tenant_id) AS tenants, count(*) FILTER (WHERE status = 'inactive') AS inactive FROM usage_records GROUP BY gts_id")
def _(t):
    return t.usage_records().groupBy("gts_id").agg(F.countDistinct("tenant_id").alias("tenants"), F.count_if(F.col("status") == "inactive").alias("inactive"))
