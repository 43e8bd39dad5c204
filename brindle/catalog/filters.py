"""Queries of the filter, paging and projection language."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalog.book import Book
from brindle.operators.durable import durable
from brindle.operators.usage import RECORDS
from brindle.plans import paging
from brindle.plans.paging import Query
from brindle.plans.schema import Resource, ResourceField

book = Book()
QUERIES = book.queries

ORDERS = Resource(
    "orders",
    {
        "id": ResourceField("o_orderkey", "i64"), "customer": ResourceField("o_custkey", "i64"), "status": ResourceField("o_orderstatus", "string"), "total": ResourceField("o_totalprice", "f64"),
        "ordered_on": ResourceField("o_day", "date"), "priority": ResourceField("o_orderpriority", "string"), "large": ResourceField("o_large", "bool"),
    },
    tiebreak=("id", "asc"),
)
CUSTOMERS = Resource("customers", {"id": ResourceField("c_custkey", "i64"), "name": ResourceField("c_name", "string"), "address/nation": ResourceField("c_nationkey", "i64"), "balance": ResourceField("c_acctbal", "f64"), "segment": ResourceField("c_mktsegment", "string")})


def orders(t):
    return t.raw("orders").withColumns({"o_day": F.col("o_orderdate").cast("date"), "o_large": F.col("o_totalprice") > 200000})


@book("filter_window", "SELECT id, value FROM usage_records WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-20'")
def _(t):
    return paging.filtered(t.usage_records(), RECORDS, Query().where("created_at ge 2024-01-05T00:00:00Z and created_at lt 2024-01-19T22:00:00-02:00")).select("id", "value")


@book("filter_in_not", "SELECT id FROM usage_records WHERE gts_id IN ('click', 'view') AND NOT (resource_type = 'compute' OR status = 'inactive')")
def _(t):
    return paging.filtered(t.usage_records(), RECORDS, Query().where("gts_id in ('click', 'view') and not (resource_type eq 'compute' or status eq 'inactive')")).select("id")


@book("filter_nullable", "SELECT id, subject_id FROM usage_records WHERE NOT (subject_id = 's1') AND subject_id <> 's2'")
def _(t):
    return paging.filtered(t.usage_records(), RECORDS, Query().where("not (subject_id eq 's1') and subject_id ne 's2'")).select("id", "subject_id")


@book("filter_text", "SELECT c_custkey FROM customer WHERE contains(c_name, '0001') AND NOT ends_with(c_name, '7') OR starts_with(c_mktsegment, 'BUILD') AND contains(c_name, '%') ")
def _(t):
    return paging.filtered(t.raw("customer"), CUSTOMERS, Query().where("contains(name, '0001') and not endswith(name, '7') or startswith(segment, 'BUILD') and contains(name, '%')")).select("c_custkey")


@book("filter_metadata", "SELECT id, k FROM usage_records WHERE k = '7'")
def _(t):
    return paging.filtered(t.usage_records(), RECORDS, Query().where("metadata/k eq '7'")).select("id", F.col("metadata")["k"].alias("k"))


@book("filter_types", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000.25 AND cast(o_orderdate AS DATE) <= DATE '1998-06-30' AND (o_totalprice > 200000) = true AND o_custkey <> 42")
def _(t):
    return paging.filtered(orders(t), ORDERS, Query().where("total gt 150000.25 and ordered_on le 1998-06-30 and large eq TRUE and customer ne 42")).select("o_orderkey")


@book("filter_path_field", "SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7) AND c_acctbal < 0 OR c_acctbal >= 9000")
def _(t):
    return paging.filtered(t.raw("customer"), CUSTOMERS, Query().where("Nation in (3, 7) and balance lt 0 or address/nation ge 0 and balance ge 9000")).select("c_custkey")


def _keep(df, limit):
    return df.limit(limit)


@book("page_first", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_custkey DESC, o_orderkey LIMIT 40")
def _(t):
    plan, _, limit, _ = paging.plan_page(orders(t), ORDERS, Query().where("status eq 'F'").order_by("customer desc").page_size(40))
    return _keep(plan, limit).select("o_orderkey", "o_custkey")


@book("page_next", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_custkey DESC, o_orderkey LIMIT 40 OFFSET 40")
def _(t):
    q = Query().where("status eq 'F'").page_size(40)
    first = paging.fetch(orders(t), ORDERS, q.order_by("customer desc"))
    plan, _, limit, _ = paging.plan_page(orders(t), ORDERS, q.starting(first.next_cursor))
    return _keep(plan, limit).select("o_orderkey", "o_custkey")


@book("page_back", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_custkey DESC, o_orderkey LIMIT 40")
def _(t):
    q = Query().where("status eq 'F'").page_size(40)
    first = paging.fetch(orders(t), ORDERS, q.order_by("customer desc"))
    second = paging.fetch(orders(t), ORDERS, q.starting(first.next_cursor))
    plan, _, limit, _ = paging.plan_page(orders(t), ORDERS, q.starting(second.prev_cursor))
    return _keep(plan, limit).select("o_orderkey", "o_custkey")


@book("page_keyset_tail", "SELECT id FROM usage_records WHERE created_at > TIMESTAMP '2024-01-15 12:00:00' OR created_at = TIMESTAMP '2024-01-15 12:00:00' AND id > 'e5'")
def _(t):
    return t.usage_records().filter(paging.after(RECORDS, (("created_at", "asc"), ("id", "asc")), ("1705320000000000", "e5"))).select("id")


@book("page_offset", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 30")
def _(t):
    return paging.offset_page(t.raw("customer"), [F.col("c_acctbal").desc(), F.col("c_custkey")], skip=30, top=80).select("c_custkey")


@book("order_nulls", "SELECT id, subject_id, row_number() OVER (ORDER BY subject_id DESC NULLS FIRST, id) - 1 AS place FROM usage_records")
def _(t):
    ordered = t.usage_records().orderBy(*paging.sort_columns(RECORDS, paging.with_tiebreak(paging.parse_order("subject_id desc"), RECORDS))).select("id", "subject_id")
    # Partitions follow one another in order, so a row's place is its number in its partition after the rows of those before.
    held = durable(ordered.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = held.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = sizes.alias("x").join(F.broadcast(sizes.alias("y")), F.col("y.__p") < F.col("x.__p"), "left").groupBy("x.__p").agg(F.coalesce(F.sum("y.__n"), F.lit(0)).alias("__before"))
    return held.withColumn("__p", part).join(F.broadcast(before), "__p").select("id", "subject_id", (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


@book("select_projection", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t):
    return paging.project(t.raw("orders"), paging.parse_select("O_ORDERKEY, o_orderstatus, no_such_field"))


@book("select_nested", "SELECT conv_id, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def _(t):
    listed = t.raw("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("messages"))
    return paging.project(listed, paging.parse_select("conv_id, messages.turn")).select("conv_id", F.col("messages.turn").alias("turns"))
