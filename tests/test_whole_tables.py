"""Queries over whole tables leave no id out."""

import pytest

from brindle import catalog
from tests.test_catalog import DATA, pytestmark  # noqa: F401

LEDGER = {
    "ledger_reverse": ("lineitem", "l_orderkey", "entry_id"), "ledger_translate_entry": ("lineitem", "l_orderkey", "entry_id"), "ledger_pick_rate": ("orders", "o_orderkey", "id"),
    "ledger_periods": ("orders", "o_orderkey", "entry_id"), "ledger_straight_line": ("orders", "o_orderkey", "invoice_id"), "ledger_audit_rows": ("orders", "o_orderkey", "entry_id"),
}


@pytest.mark.parametrize("name", LEDGER)
def test_every_id(spark, name):
    table, key, column = LEDGER[name]
    want = spark.read.parquet(f"{DATA}/{table}.parquet").selectExpr(f"{key} AS k").distinct()
    assert want.exceptAll(catalog.queries()[name](spark, DATA).selectExpr(f"{column} AS k").distinct()).count() == 0


def test_all_links_messages_and_sessions(spark):
    q, raw = catalog.queries(), lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    linked = raw("lineitem").selectExpr("l_partkey AS attachment_id").distinct()
    alone = q["content_unreferenced"](spark, DATA)
    assert alone.count() > 0 and alone.join(linked, "attachment_id").count() == 0
    assert q["content_attachments"](spark, DATA).count() == raw("lineitem").filter("l_partkey % 7 <> 0").count()
    assert q["content_message_counts"](spark, DATA).count() == raw("conversations").select("conv_id").distinct().count()


def test_all_rows_ordered_projected_walked_and_dealt(spark):
    q, n = catalog.queries(), lambda t: spark.read.parquet(f"{DATA}/{t}.parquet").count()
    places = sorted(r.place for r in q["order_nulls"](spark, DATA).select("place").collect())
    assert places == list(range(len(places))) and len(places) >= n("events")
    assert q["select_projection"](spark, DATA).count() == n("orders")
    assert q["tree_ancestors_all"](spark, DATA).select("start_id").distinct().count() == n("customer") + n("nation") + n("region")
    assert q["stream_rebalance"](spark, DATA).select("member_id").distinct().count() == n("supplier")


@pytest.mark.parametrize("name, kind", [("usage_count_by_tenant", "view"), ("usage_by_metadata", "signup")])
def test_all_groups_of_usage(spark, tmp_path, name, kind):
    """12,001 groups, for tenants the null one among them, are more than the aggregate allows by default."""
    import duckdb

    spark.range(12_001).selectExpr(
        "id * 29 + 1 AS event_id", "timestamp '2024-01-06' AS ts", "nullif(id, 12000) AS user_id", f"'{kind}' AS event_type", "1.5D AS value", """concat('{"k": ', id, '}') AS props""",
    ).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df = catalog.queries()[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert len(want) == 12_001 and sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
