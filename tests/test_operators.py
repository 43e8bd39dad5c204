"""Ledger, trees, scopes, logs and files on small tables."""

import io
import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brindle.operators import hierarchy, ledger, usage
from brindle.operators.scopes import Scope, admits_tenant, apply_scope, compile_decision
from brindle.plans.syntax import QueryError, parse
from brindle.sources import blocks, sinks
from brindle.streaming import log, structured


def shares(spark, total, weights, residual):
    df = spark.createDataFrame([(1, i, total, w) for i, w in enumerate(weights)], "k int, i int, t long, w long")
    return [r.share_minor for r in ledger.allocate(df, ["k"], "t", "w", "i", residual).orderBy("i").collect()]


def test_allocate(spark):
    assert shares(spark, 100, [1, 1, 1], "last") == [33, 33, 34]
    assert shares(spark, 100, [1, 1, 1], "largest") == [34, 33, 33]
    assert shares(spark, -100, [1, 1, 1], "last") == [-33, -33, -34]
    assert shares(spark, 100, [0, 0], "last") == [None, None]


def test_validate_order_of_faults(spark):
    entries = spark.createDataFrame([(i, "EUR") for i in range(8)], "entry_id int, entry_currency string")
    L = lambda e, side, a, p=1, c="EUR", s=2, f=None: (e, p, side, a, c, s, f)
    lines = spark.createDataFrame(
        [L(1, "DR", 5), L(1, "CR", 5), L(2, "DR", -5), L(2, "CR", 5, 2), L(3, "DR", 5), L(3, "CR", 5, 2), L(4, "DR", 5, 1, "USD"), L(4, "CR", 5, 1, "USD"), L(5, "DR", 5, s=2), L(5, "CR", 5, s=3), L(6, "DR", 5, f=5), L(6, "CR", 5), L(7, "DR", 5, f=5), L(7, "CR", 5, f=6)],
        "entry_id int, payer_id int, side string, amount_minor long, currency string, currency_scale int, functional_amount_minor long",
    )
    got = {r.entry_id: r.verdict for r in ledger.validate(entries, lines).collect()}
    assert got == {0: "empty", 1: "ok", 2: "amount_out_of_range", 3: "mixed_payer", 4: "currency_mismatch", 5: "inconsistent_scale", 6: "functional_partial", 7: "functional_unbalanced"}


def test_fill(spark):
    day = datetime(2024, 1, 1)
    inv = spark.createDataFrame([(1, "a", 60, day), (1, "b", 70, day + timedelta(1)), (1, "c", 10, None)], "payer_id int, invoice_id string, open_minor long, posted_at timestamp")
    lump = spark.createDataFrame([(1, 100)], "payer_id int, lump_minor long")
    assert {r.invoice_id: r.give_minor for r in ledger.fill(inv, lump).collect()} == {"a": 60, "b": 40}
    assert {r.invoice_id: r.give_minor for r in ledger.fill(inv, lump, highest=True).collect()} == {"b": 70, "a": 30}


def test_chain(spark):
    rows = spark.createDataFrame([(f"t{i % 2}", i, f"v{i}") for i in range(20)], "tenant_id string, entry_id long, v string")
    chain = ledger.build_chain(rows, ["entry_id", "v"], "entry_id").cache()
    assert ledger.verify_chain(chain).count() == 0
    assert {(r.entry_id, r.fault) for r in ledger.verify_chain(chain.filter("entry_id <> 6")).select("entry_id", "fault").collect()} == {(8, "link")}


def test_closure_of_random_trees(spark):
    random.seed(4)
    rows = [("n0", None, False, 1)] + [(f"n{i}", f"n{random.randrange(i)}", random.random() < 0.3, 1) for i in range(1, 30)]
    tree = spark.createDataFrame(rows, "id string, parent_id string, self_managed boolean, status int")
    parent, own = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    want = set()
    for x in parent:
        want.add((x, x, 0, 0))
        top, barrier, depth = x, 0, 0
        while parent[top]:
            barrier |= own[top]
            top, depth = parent[top], depth + 1
            want.add((top, x, int(barrier), depth))
    assert {tuple(r) for r in hierarchy.closure(tree).collect()} == want


def test_integrity_finds_cycles_and_orphans(spark):
    tree = spark.createDataFrame([("a", None, False, 1), ("b", "a", False, 1), ("x", "y", False, 1), ("y", "x", False, 1), ("o", "gone", False, 1)], "id string, parent_id string, self_managed boolean, status int")
    stored = hierarchy.closure(tree, levels=4).withColumn("descendant_status", F.lit(1))
    got = {(r.category, r.id) for r in hierarchy.integrity(tree, stored, 4).collect()}
    assert {("orphan", "o"), ("cycle", "x"), ("cycle", "y")} <= got and not any(c == "cycle" and i in "abo" for c, i in got)


def test_closure_has_no_depth_limit_and_ends_on_cycles(spark):
    schema = "id string, parent_id string, self_managed boolean, status int"
    line = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None, False, 1) for i in range(12)], schema).coalesce(1)
    assert hierarchy.closure(line).filter("descendant_id = 'n11'").count() == 12
    rows = [("a", None, False, 1), ("b", "a", False, 1), ("c", "b", False, 1), ("x", "y", False, 1), ("y", "x", False, 1), ("z", "y", False, 1), ("w", "z", False, 1)]
    tree = spark.createDataFrame(rows, schema).coalesce(1)
    stored = hierarchy.closure(tree).withColumn("descendant_status", F.lit(1))
    got = {(r.ancestor_id, r.descendant_id) for r in stored.collect()}
    assert got == {(c, c) for c in "abcwxyz"} | {("a", "b"), ("b", "c"), ("a", "c")}
    assert hierarchy.descendants(tree, "a").count() == 2
    assert {r.id for r in hierarchy.integrity(tree, stored).filter("category = 'cycle'").collect()} == set("wxyz")


def test_too_many_groups_are_refused(spark):
    rows = spark.range(30).selectExpr("concat('t', id) AS tenant_id", "'g' AS gts_id", "'active' AS status", "id AS value", "cast(null AS string) AS corrects_id")
    spec = lambda most: usage.Spec("g", "counter", "COUNT", ("tenant_id",), most)
    assert usage.aggregate(rows, spec(30)).count() == 30
    with pytest.raises(QueryError):
        usage.aggregate(rows, spec(29))


def test_scope_decisions(spark):
    assert admits_tenant(Scope.tenants("t1"), "t1") and not admits_tenant(Scope.tenants("t1"), "t2")
    df = spark.createDataFrame([("t1",), ("t2",)], "tenant_id string")
    assert apply_scope(df, compile_decision({"allow": False})).count() == 0
    assert apply_scope(df, compile_decision({"allow": True, "constraints": [[]]})).count() == 2
    assert apply_scope(df, compile_decision({"allow": True, "constraints": [[{"type": "eq", "property": "other", "value": 1}], [{"type": "eq", "property": "tenant_id", "value": "t2"}]]})).count() == 1


def test_usage_guards():
    usage.check_window(parse("created_at ge 2024-01-01T00:00:00Z and (created_at lt 2024-02-01T00:00:00Z and a eq 1)"))
    for text in ("created_at ge 2024-01-01T00:00:00Z", "created_at ge 2024-01-01T00:00:00Z or created_at lt 2024-02-01T00:00:00Z", "not (created_at lt 2024-02-01T00:00:00Z) and created_at gt 2024-01-01T00:00:00Z"):
        with pytest.raises(QueryError):
            usage.check_window(parse(text))
    with pytest.raises(QueryError):
        usage.aggregate(None, usage.Spec("x", "gauge", "SUM"))


def test_ingest_against_stored(spark):
    at = datetime(2024, 1, 1)
    schema = "ordinal long, id string, tenant_id string, gts_id string, value long, idempotency_key string, created_at timestamp"
    batch = spark.createDataFrame([(0, "a", "t", "g", 1, "k1", at), (1, "a", "t", "g", 1, "k1", at), (2, "b", "t", "g", 2, "k2", at), (3, "c", "t", "g", 3, "k3", at)], schema)
    stored = spark.createDataFrame([(9, "b", "t", "g", 5, "k2", at), (9, "a", "t", "g", 1, "k1", at)], schema)
    assert [r.outcome for r in usage.ingest(batch, stored).orderBy("ordinal").collect()] == ["absorbed", "absorbed", "conflict", "inserted"]


def test_producers_on_a_stream(spark, tmp_path):
    """The keyed state over several micro-batches gives what the batch query gives."""
    random.seed(2)
    rows = [("top", 0, f"p{i % 3}", i, random.randint(0, 40), None) for i in range(60)]
    df = spark.createDataFrame(rows, "topic string, partition int, producer_id string, arrival long, sequence long, previous long")
    for i in range(3):
        df.filter((F.col("arrival") >= 20 * i) & (F.col("arrival") < 20 * i + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = structured.producer_outcomes(structured.read_log(spark, str(tmp_path / "in"), df.schema), "monotonic")
    q = stream.writeStream.format("memory").queryName("outcomes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.arrival, r.outcome) for r in spark.table("outcomes").collect()}
    assert got == {(r.arrival, r.outcome) for r in log.monotonic(df, ["producer_id"], "arrival").collect()}


def test_process_writes_dead_letters(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "event_id")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    handler = lambda b: b.withColumns({"result": F.when(F.col("event_id") % 4 == 0, "reject").otherwise("success"), "error": F.lit("e")})
    structured.process(structured.read_log(spark, str(tmp_path / "in"), df.schema), handler, str(tmp_path / "out"), str(tmp_path / "dead"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7 and spark.read.parquet(str(tmp_path / "dead")).count() == 3


def test_token_bucket(spark):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t0 + timedelta(seconds=s)) for s in (0, 0, 0, 1, 10, 10, 10)], "k string, t timestamp")
    assert [r.admitted for r in log.token_bucket(df, "k", "t", 1.0, 2.0).collect()] == [True, True, False, True, True, True, False]


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{s}{chr(34)}/>" if s else ""}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files_to_markdown(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\nlines")
    (tmp_path / "b.html").write_text("<h2>T &amp; x</h2><p>p <b>q</b></p><ul><li>i<ul><li>j</li></ul></li></ul><table><tr><td>1</td><td>a|b</td></tr></table><script>no</script><pre>x\n y</pre>")
    (tmp_path / "c.docx").write_bytes(docx([("Heading1", "Head"), ("", "Para"), ("Quote", "Said")]))
    (tmp_path / "d.gif").write_bytes(b"GIF89a")
    (tmp_path / "e.xyz").write_bytes(b"?")
    (tmp_path / "f.docx").write_bytes(b"broken")
    rows = {r.path.rsplit("/", 1)[1]: r for r in blocks.read_files(spark, str(tmp_path)).withColumn("md", blocks.markdown(F.col("blocks"))).collect()}
    assert rows["a.txt"].md == "one\n\ntwo\nlines"
    assert rows["b.html"].md == "## T & x\n\np q\n\n- i\n\n  - j\n\n| 1 | a\\|b |\n\n```\nx\n y\n```"
    assert rows["c.docx"].md == "# Head\n\nPara\n\n> Said"
    assert rows["d.gif"].md == "![data:image/gif;base64,R0lGODlh]()"
    assert "unsupported" in rows["e.xyz"].md and rows["f.docx"].error


def test_audit_csv(spark, tmp_path):
    e = spark.createDataFrame([(1, '=x"y'), (2, "b")], "entry_id long, note string")
    lines = spark.createDataFrame([(1, "DR")], "entry_id long, side string")
    sinks.write_csv(sinks.audit_rows(e, lines, e).coalesce(1).orderBy("entry_id"), str(tmp_path / "o"))
    got = "".join(p.read_text() for p in (tmp_path / "o").glob("*.csv"))
    assert got.splitlines() == ["entry_id,note,side", '1,"\'=x""y",DR', "2,b,"]
