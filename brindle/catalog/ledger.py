"""Queries of the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalog.book import Book
from brindle.functions import money, periods
from brindle.operators import ledger, versions
from brindle.operators.tables import not_listed
from brindle.sources import sinks

book = Book()
QUERIES = book.queries


def _even(n: str, d: str) -> str:
    """SQL for half-even division of whole numbers, d > 0."""
    n, d = f"cast({n} AS HUGEINT)", f"cast({d} AS HUGEINT)"
    rest = f"((({n}) % {d} + {d}) % {d})"
    q = f"((({n}) - {rest}) // {d})"
    return f"cast({q} + CASE WHEN 2 * {rest} > {d} OR 2 * {rest} = {d} AND {q} % 2 <> 0 THEN 1 ELSE 0 END AS BIGINT)"


@book("ledger_validate", """SELECT e.entry_id, count(l.entry_id) AS n_lines, CASE WHEN count(l.entry_id) = 0 THEN 'empty' WHEN sum(CASE WHEN side = 'DR' THEN amount_minor ELSE -amount_minor END) <> 0 THEN 'unbalanced' ELSE 'ok' END AS verdict
FROM journal_entries e LEFT JOIN journal_lines l ON e.entry_id = l.entry_id GROUP BY e.entry_id""")
def _(t):
    return ledger.validate(t.journal_entries(), t.journal_lines())


@book("ledger_validate_functional", """WITH f AS (SELECT entry_id, side, amount_minor AS a, CASE WHEN entry_id % 5 IN (1, 3) OR entry_id % 5 = 2 AND side = 'DR' THEN 2 * amount_minor + CASE WHEN entry_id % 5 = 3 AND side = 'CR' THEN 1 ELSE 0 END END AS f FROM journal_lines),
s AS (SELECT entry_id, count(*) AS n, sum(CASE WHEN side = 'DR' THEN a ELSE -a END) AS net, count(f) AS fn, sum(CASE WHEN side = 'DR' THEN f ELSE -f END) AS fnet FROM f GROUP BY entry_id)
SELECT e.entry_id, coalesce(n, 0) AS n_lines, CASE WHEN n IS NULL THEN 'empty' WHEN net <> 0 THEN 'unbalanced' WHEN fn > 0 AND fn < n THEN 'functional_partial' WHEN fn = n AND fnet <> 0 THEN 'functional_unbalanced' ELSE 'ok' END AS verdict FROM journal_entries e LEFT JOIN s ON e.entry_id = s.entry_id""")
def _(t):
    # Functional amounts on some entries: on all lines, on the debit lines alone, and with a credit that is one too much.
    rest, debit = F.col("entry_id") % 5, F.col("side") == "DR"
    amount = 2 * F.col("amount_minor") + F.when((rest == 3) & ~debit, 1).otherwise(0)
    lines = t.journal_lines().withColumn("functional_amount_minor", F.when(rest.isin(1, 3) | ((rest == 2) & debit), amount))
    return ledger.validate(t.journal_entries(), lines)


for _grain, _keys in ledger.GRAINS.items():
    if _grain in ledger.CLASS_OF:
        continue

    @book(f"ledger_balance_{_grain}", f"SELECT {', '.join(_keys)}, cast(sum(amount_minor) AS BIGINT) AS balance_minor FROM journal_lines GROUP BY {', '.join(_keys)}")
    def _(t, grain=_grain):
        return ledger.project_balances(t.journal_lines(), grain)


@book("ledger_tie_out", """WITH f AS (SELECT tenant_id, account_class, currency, cast(sum(amount_minor) AS BIGINT) AS folded FROM journal_lines GROUP BY ALL)
SELECT tenant_id, account_class, currency, folded + 5 AS cached, folded, cast(5 AS BIGINT) AS variance FROM f WHERE tenant_id IN ('t1', 't3') AND currency = 'USD'
UNION ALL SELECT tenant_id, account_class, currency, 0, folded, -folded FROM f WHERE tenant_id = 't2'""")
def _(t):
    cache = ledger.project_balances(t.journal_lines(), "account").filter("tenant_id <> 't2'")
    off = (F.col("tenant_id").isin("t1", "t3")) & (F.col("currency") == "USD")
    return ledger.tie_out(cache.withColumn("balance_minor", F.col("balance_minor") + F.when(off, 5).otherwise(0)), t.journal_lines(), "account")


@book("ledger_tie_out_incremental", "SELECT tenant_id, account_class, currency, cast(sum(amount_minor) AS BIGINT) AS balance_minor FROM journal_lines GROUP BY ALL")
def _(t):
    lines = t.journal_lines().withColumn("created_seq", F.col("entry_id"))
    return ledger.tie_out_from(ledger.project_balances(lines.filter("created_seq <= 5000"), "account"), 5000, lines, "account")


@book("ledger_first_stamp", "SELECT tenant_id, payer_id, min(entry_id) AS entry_id FROM journal_entries GROUP BY ALL")
def _(t):
    return ledger.first_stamp(t.journal_entries(), ["tenant_id", "payer_id"], "entry_id", "created_seq")


@book("ledger_entry_lines", "SELECT e.entry_id, e.period_id, l.side, l.amount_minor FROM journal_entries e LEFT JOIN journal_lines l ON e.entry_id = l.entry_id WHERE e.tenant_id = 't7'")
def _(t):
    return ledger.entries_with_lines(t.journal_entries().filter("tenant_id = 't7'"), t.journal_lines()).select("entry_id", "period_id", "side", "amount_minor")


@book("ledger_entries_by_line", "SELECT entry_id FROM journal_entries WHERE entry_id IN (SELECT entry_id FROM journal_lines WHERE account_class = 'AR' AND amount_minor > 9000000)")
def _(t):
    return ledger.entries_matching(t.journal_entries(), t.journal_lines(), (F.col("account_class") == "AR") & (F.col("amount_minor") > 9000000)).select("entry_id")


@book("ledger_reversals", """WITH x AS (SELECT entry_id, reverses_entry_id AS r FROM journal_entries WHERE reverses_entry_id IN (SELECT entry_id FROM journal_entries))
SELECT entry_id, r AS related_id, 'reverses' AS relation FROM x UNION SELECT r, entry_id, 'reversed_by' FROM x""")
def _(t):
    return ledger.reversal_links(t.journal_entries())


@book("ledger_uncovered", """SELECT entry_id FROM journal_entries e WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT tenant_id, s * 1000 AS a, s * 1000 + 600 AS b FROM journal_entries, generate_series(0, 200) g(s)) c
WHERE c.tenant_id = e.tenant_id AND e.created_seq BETWEEN c.a AND c.b)""")
def _(t):
    e = t.journal_entries()
    spans = e.select("tenant_id").distinct().withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(200)))).select("tenant_id", (F.col("s") * 1000).cast("long").alias("from_seq"), (F.col("s") * 1000 + 600).cast("long").alias("to_seq"))
    return ledger.uncovered(e, spans).select("entry_id")


@book("ledger_effective_policy", """SELECT o_orderkey AS id, (SELECT max(v) FROM generate_series(1995, 2001, 2) g(v) WHERE make_date(v, 1, 1) <= cast(o_orderdate AS DATE)) AS threshold_minor FROM orders""")
def _(t):
    rows = t.raw("orders").select(F.lit("t").alias("tenant_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    versions = t.spark.range(1995, 2002, 2).select(F.lit("t").alias("tenant_id"), F.make_timestamp(F.col("id").cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("effective_from"), F.col("id").alias("threshold_minor"))
    salted = lambda df: df.withColumn("tenant_id", F.lit("t"))
    return ledger.effective_at(salted(rows), salted(versions), ["tenant_id"], "created_at").select("id", "threshold_minor")


_FILL = """WITH l AS (SELECT payer_id, cast(sum(open_minor) // 3 AS BIGINT) AS lump FROM invoices GROUP BY payer_id),
p AS (SELECT i.*, l.lump, coalesce(sum(open_minor) OVER (PARTITION BY payer_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM invoices i JOIN l USING (payer_id) WHERE open_minor > 0)
SELECT invoice_id, cast(greatest(0, least(open_minor, lump - prior)) AS BIGINT) AS give_minor FROM p WHERE least(open_minor, lump - prior) > 0"""


def _lumps(t):
    return t.invoices().groupBy("payer_id").agg(F.expr("sum(open_minor) div 3").alias("lump_minor"))


@book("ledger_fill_oldest", _FILL.format(order="posted_at, invoice_id"))
def _(t):
    return ledger.fill(t.invoices(), _lumps(t)).select("invoice_id", "give_minor")


@book("ledger_fill_highest", _FILL.format(order="open_minor DESC, invoice_id"))
def _(t):
    return ledger.fill(t.invoices(), _lumps(t), highest=True).select("invoice_id", "give_minor")


@book("ledger_fill_hint", _FILL.replace("SELECT payer_id, cast", "SELECT payer_id, max(invoice_id) AS h, cast").replace("l.lump,", "l.lump, l.h,").format(order="CASE WHEN invoice_id = h THEN 0 ELSE 1 END, posted_at, invoice_id"))
def _(t):
    lumps = t.invoices().groupBy("payer_id").agg(F.expr("sum(open_minor) div 3").alias("lump_minor"), F.max("invoice_id").alias("hint"))
    return ledger.fill(t.invoices(), lumps, hint="hint").select("invoice_id", "give_minor")


@book("ledger_wallet_fill", """WITH w AS (SELECT payer_id, invoice_id, open_minor, sum(open_minor) OVER (PARTITION BY payer_id) AS total, coalesce(sum(open_minor) OVER (PARTITION BY payer_id ORDER BY invoice_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior,
 cast(payer_id * 40000 AS BIGINT) AS debit FROM invoices)
SELECT invoice_id, total >= debit AS covered, cast(CASE WHEN total >= debit THEN greatest(0, least(open_minor, debit - prior)) ELSE 0 END AS BIGINT) AS draw_minor FROM w""")
def _(t):
    wallets = t.invoices().select("payer_id", "invoice_id", F.col("open_minor").alias("balance_minor"))
    debits = wallets.select("payer_id").distinct().withColumn("debit_minor", F.col("payer_id") * 40000)
    return ledger.wallet_fill(wallets, debits, "payer_id", "invoice_id").select("invoice_id", "covered", "draw_minor")


def _share_sql(place: str) -> str:
    return f"""WITH s AS (SELECT l_orderkey, l_linenumber, cast(l_quantity AS BIGINT) AS w, sum(cast(l_quantity AS BIGINT)) OVER k AS total_w, row_number() OVER ({place}) AS r
 FROM lineitem WINDOW k AS (PARTITION BY l_orderkey)),
h AS (SELECT *, {_even('(100003 * w)', 'total_w')} AS share FROM s)
SELECT l_orderkey, l_linenumber, cast(share + CASE WHEN r = 1 THEN 100003 - sum(share) OVER (PARTITION BY l_orderkey) ELSE 0 END AS BIGINT) AS share_minor FROM h"""


def _weights(t):
    # Repeated line numbers are made distinct by the part, so that the order is total on both sides.
    rows = t.raw("lineitem").withColumns({"w": F.col("l_quantity").cast("long"), "total": F.lit(100003).cast("long")})
    return rows.withColumn("o", F.col("l_linenumber").cast("long") * 10_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey"))


_O = "l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey"


@book("ledger_allocate_last", f"SELECT l_orderkey, cast(sum(share_minor) AS BIGINT) AS total, max(share_minor) AS most FROM ({_share_sql(f'PARTITION BY l_orderkey ORDER BY {_O} DESC')}) GROUP BY l_orderkey")
def _(t):
    shares = ledger.allocate(_weights(t), ["l_orderkey"], "total", "w", "o").select("l_orderkey", "share_minor")
    return shares.groupBy("l_orderkey").agg(F.sum("share_minor").alias("total"), F.max("share_minor").alias("most"))


@book("ledger_allocate_largest", f"SELECT l_orderkey, cast(sum(share_minor) AS BIGINT) AS total, max(share_minor) AS most FROM ({_share_sql(f'PARTITION BY l_orderkey ORDER BY cast(l_quantity AS BIGINT) DESC, {_O}')}) GROUP BY l_orderkey")
def _(t):
    shares = ledger.allocate(_weights(t), ["l_orderkey"], "total", "w", "o", "largest").select("l_orderkey", "share_minor")
    return shares.groupBy("l_orderkey").agg(F.sum("share_minor").alias("total"), F.max("share_minor").alias("most"))


@book("ledger_aging", """WITH d AS (SELECT payer_id, open_minor, DATE '1998-12-01' - due_date AS days FROM invoices WHERE NOT settled),
r AS (SELECT payer_id, open_minor, CASE WHEN days <= 0 THEN 0 WHEN days <= 30 THEN 1 WHEN days <= 60 THEN 2 WHEN days <= 90 THEN 3 ELSE 4 END AS rank FROM d WHERE open_minor > 0)
SELECT payer_id, rank, cast(sum(open_minor) AS BIGINT) AS amount_minor, ['current', '1-30', '31-60', '61-90', '90+'][rank + 1] AS bucket FROM r GROUP BY payer_id, rank""")
def _(t):
    return ledger.aging(t.invoices().filter("NOT settled"), F.lit("1998-12-01").cast("date"), [30, 60, 90], ["payer_id"])


@book("ledger_straight_line", f"""WITH s AS (SELECT invoice_id, open_minor AS total, 1 + invoice_id % 14 AS months, date_trunc('month', due_date) AS d, {_even('open_minor', '(1 + invoice_id % 14)')} AS share FROM invoices)
SELECT invoice_id, cast(i AS INTEGER) AS segment, strftime(d + to_months(cast(i - 1 AS INTEGER)), '%Y%m') AS period_id, cast(CASE WHEN i < months THEN share ELSE total - share * (months - 1) END AS BIGINT) AS amount_minor
FROM s, generate_series(1, 14) g(i) WHERE i <= months""")
def _(t):
    s = t.invoices().select("invoice_id", F.col("open_minor").alias("total_minor"), (F.col("invoice_id") % 14 + 1).alias("months"), periods.period_of(F.col("due_date")).alias("start_period"))
    return ledger.straight_line(s).select("invoice_id", "segment", "period_id", "amount_minor")


@book("ledger_release_due", "SELECT entry_id, period_id, '199806' AS run_period FROM journal_entries WHERE period_id <= '199806' AND entry_id % 3 <> 0")
def _(t):
    seg = t.journal_entries().select("entry_id", "period_id", F.when(F.col("entry_id") % 3 == 0, "DONE").otherwise("PENDING").alias("status"))
    return ledger.release_due(seg, "199806").select("entry_id", "period_id", "run_period")


_RATES = "(SELECT 't' AS tenant_id, 'EUR' AS base, 'USD' AS quote, p AS provider, f AS fallback_order, 1000000 + 1000 * d + f * 7 AS rate_micro, TIMESTAMP '1996-01-01' + to_days(cast(d * 10 + f AS INTEGER)) AS as_of FROM (VALUES ('ecb', 1), ('ecb', 0), ('bank', 0)) v(p, f), generate_series(0, 220) g(d) WHERE NOT (p = 'ecb' AND d % 3 = 0))"


@book("ledger_pick_rate", f"""WITH r AS {_RATES}, q AS (SELECT entry_id AS id, posted_at AS asked FROM journal_entries),
j AS (SELECT id, provider, rate_micro, row_number() OVER (PARTITION BY id ORDER BY CASE provider WHEN 'ecb' THEN 1 ELSE 3 END, fallback_order, provider, as_of DESC) AS n FROM q JOIN r ON as_of <= asked AND asked - as_of <= INTERVAL 12 DAY)
SELECT q.id, j.provider, cast(j.rate_micro AS BIGINT) AS rate_micro FROM q LEFT JOIN j ON q.id = j.id AND j.n = 1""")
def _(t):
    days = t.spark.range(0, 221).crossJoin(F.broadcast(t.spark.createDataFrame([("ecb", 1), ("ecb", 0), ("bank", 0)], "provider string, fallback_order int"))).filter("NOT (provider = 'ecb' AND id % 3 = 0)")
    rates = days.select(F.lit("t").alias("tenant_id"), F.lit("EUR").alias("base"), F.lit("USD").alias("quote"), "provider", "fallback_order", (F.col("id") * 1000 + 1_000_000 + F.col("fallback_order") * 7).alias("rate_micro"),
                        F.expr("timestamp'1996-01-01 00:00:00' + make_dt_interval(cast(id * 10 + fallback_order as int))").alias("as_of"))
    asked = t.journal_entries().select(F.col("entry_id").alias("id"), F.lit("t").alias("tenant_id"), F.lit("EUR").alias("base"), F.lit("USD").alias("quote"), F.col("posted_at").alias("at"))
    return ledger.pick_rate(asked, rates, ["ecb", "other"], 12 * 86400).select("id", "provider", "rate_micro")


@book("ledger_translate", f"SELECT invoice_id, {_even('open_minor * (900000 + invoice_id % 300001)', '1000000')} AS functional_minor FROM invoices")
def _(t):
    return t.invoices().select("invoice_id", money.translate(F.col("open_minor"), F.col("invoice_id") % 300001 + 900000).alias("functional_minor"))


@book("ledger_translate_entry", "SELECT DISTINCT entry_id, cast(0 AS BIGINT) AS net FROM journal_lines")
def _(t):
    lines = t.journal_lines().withColumns({"rate_micro": F.col("entry_id") + 987_001, "line_no": F.monotonically_increasing_id()})
    done = ledger.translate_entry(lines)
    return done.groupBy("entry_id").agg(F.sum(money.signed(F.col("side"), F.col("functional_minor"))).alias("net"))


@book("ledger_realized_fx", f"""WITH s AS (SELECT invoice_id, open_minor AS o, open_minor // 2 AS s, {_even('open_minor * 1100001', '1000000')} AS c, {_even('(open_minor // 2) * (1050000 + (invoice_id % 7) * 20000)', '1000000')} AS f FROM invoices WHERE open_minor > 1),
r AS (SELECT invoice_id, {_even('c * s', 'o')} AS relief, f FROM s)
SELECT invoice_id, relief AS relief_minor, CASE WHEN f - relief < 0 THEN 'DR' WHEN f - relief > 0 THEN 'CR' END AS plug_side, abs(f - relief) AS plug_minor FROM r""")
def _(t):
    s = t.invoices().filter("open_minor > 1").withColumn("settled_minor", F.expr("open_minor div 2"))
    s = s.withColumns({"carried_minor": money.translate(F.col("open_minor"), F.lit(1_100_001)), "settled_functional_minor": money.translate(F.col("settled_minor"), F.col("invoice_id") % 7 * 20000 + 1_050_000)})
    return ledger.realized_fx(s).select("invoice_id", "relief_minor", "plug_side", "plug_minor")


@book("ledger_remeasure", f"""WITH b AS (SELECT tenant_id, account_class, currency, cast(sum(amount_minor) AS BIGINT) AS b FROM journal_lines GROUP BY ALL),
d AS (SELECT tenant_id, account_class, currency, {_even('b * 1030000', '1000000')} - {_even('b * (1000000 + length(currency) * 20000 - CASE WHEN tenant_id < $$t5$$ THEN 60000 ELSE 0 END)', '1000000')} AS d FROM b)
SELECT tenant_id, account_class, currency, abs(d) AS delta_minor, CASE WHEN d = 0 THEN NULL WHEN (account_class = 'AR') = (d > 0) THEN 'DR' ELSE 'CR' END AS side FROM d""")
def _(t):
    b = ledger.project_balances(t.journal_lines(), "account")
    old = F.length("currency") * 20000 + 1_000_000 - F.when(F.col("tenant_id") < "t5", 60000).otherwise(0)
    return ledger.remeasure(b.withColumns({"functional_minor": money.translate(F.col("balance_minor"), old), "rate_micro": F.lit(1_030_000)})).select("tenant_id", "account_class", "currency", "delta_minor", "side")


@book("ledger_credit_notes", """WITH s AS (SELECT l_orderkey AS i, l_linenumber AS sid, cast(l_quantity AS BIGINT) AS rem FROM lineitem WHERE l_orderkey % 5 <> 4), g AS (SELECT i, count(*) AS n, sum(rem) AS rem, list(sid) AS ids FROM s GROUP BY i),
n AS (SELECT o_orderkey AS i, cast(o_orderkey % 120 AS BIGINT) AS amt, CASE WHEN o_orderkey % 2 = 0 THEN 2 END AS sid FROM orders)
SELECT n.i AS invoice_id, CASE WHEN g.n IS NULL THEN 'no_schedule' WHEN amt > rem THEN 'excess' WHEN g.n = 1 THEN 'single' WHEN amt = rem THEN 'drain_all' WHEN coalesce(list_contains(ids, n.sid), false) THEN 'target' ELSE 'ambiguous' END AS mode FROM n LEFT JOIN g ON n.i = g.i""")
def _(t):
    schedules = t.raw("lineitem").filter("l_orderkey % 5 <> 4").select(F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("schedule_id"), F.col("l_quantity").cast("long").alias("remaining_minor"))
    notes = t.raw("orders").select(F.col("o_orderkey").alias("invoice_id"), (F.col("o_orderkey") % 120).alias("note_minor"), F.when(F.col("o_orderkey") % 2 == 0, 2).alias("schedule_id"))
    return ledger.split_credit_note(notes, schedules).select("invoice_id", "mode")


@book("ledger_invoice_lines", """SELECT invoice_id, side, account_class, amount_minor FROM (SELECT invoice_id, 'DR' AS side, 'AR' AS account_class, open_minor + open_minor // 5 AS amount_minor FROM invoices
UNION ALL SELECT invoice_id, 'CR', 'CONTRACT_LIABILITY', open_minor FROM invoices UNION ALL SELECT invoice_id, 'CR', 'TAX_PAYABLE', open_minor // 5 FROM invoices) WHERE amount_minor <> 0""")
def _(t):
    return ledger.build_entry(t.invoices().select("invoice_id", "open_minor"), ledger.invoice_legs(F.col("open_minor"), F.expr("open_minor div 5"))).drop("open_minor")


@book("ledger_entry_kinds", """WITH l AS (SELECT invoice_id AS i, open_minor AS m FROM invoices WHERE open_minor <> 0)
SELECT kind, side, account_class, count(*) AS n, cast(sum(m) AS BIGINT) AS amount_minor FROM l, (VALUES ('settlement', 'DR', 'CASH_CLEARING'), ('settlement', 'CR', 'UNALLOCATED'), ('allocation', 'DR', 'UNALLOCATED'), ('allocation', 'CR', 'AR'),
 ('credit_note', 'DR', 'CONTRACT_LIABILITY'), ('credit_note', 'CR', 'AR'), ('debit_note', 'CR', 'CONTRACT_LIABILITY'), ('debit_note', 'DR', 'AR'), ('chargeback', 'DR', 'DISPUTE_HOLD'), ('chargeback', 'CR', 'CASH_CLEARING')) v(kind, side, account_class) GROUP BY ALL""")
def _(t):
    rows, m = t.invoices().select("invoice_id", "open_minor"), F.col("open_minor")
    kinds = {"settlement": ledger.settlement_legs(m), "allocation": ledger.allocation_legs(m), "credit_note": ledger.note_legs(m, True), "debit_note": ledger.note_legs(m, False), "chargeback": ledger.chargeback_legs(m)}
    out = None
    for kind, legs in kinds.items():
        part = ledger.build_entry(rows, legs).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind", "side", "account_class").agg(F.count("*").alias("n"), F.sum("amount_minor").alias("amount_minor"))


@book("ledger_credit_entries", """WITH r AS (SELECT payer_id, open_minor AS m, open_minor // 50 AS fee FROM invoices WHERE open_minor <> 0), p AS (SELECT payer_id, sum(open_minor) AS m FROM invoices GROUP BY payer_id),
l AS (SELECT 'grant' AS kind, 'DR' AS side, 'UNALLOCATED' AS account_class, NULL AS bucket, m FROM r UNION ALL SELECT 'grant', 'CR', 'REUSABLE_CREDIT', NULL, m FROM r UNION ALL SELECT 'return', 'DR', 'UNALLOCATED', NULL, m FROM r
 UNION ALL SELECT 'return', 'CR', 'CASH_CLEARING', NULL, m - fee FROM r UNION ALL SELECT 'return', 'CR', 'PSP_FEE_EXPENSE', NULL, fee FROM r WHERE fee <> 0
 UNION ALL SELECT 'apply', 'DR', 'REUSABLE_CREDIT', 'promo', m // 2 FROM p UNION ALL SELECT 'apply', 'DR', 'REUSABLE_CREDIT', 'refund', m - m // 2 FROM p UNION ALL SELECT 'apply', 'CR', 'AR', NULL, open_minor FROM invoices)
SELECT kind, side, account_class, bucket, count(*) AS n, cast(sum(m) AS BIGINT) AS amount_minor FROM l GROUP BY ALL""")
def _(t):
    rows, m = t.invoices().select("invoice_id", "open_minor"), F.col("open_minor")
    kinds = {"grant": ledger.grant_legs(m), "return": ledger.return_legs(m, F.expr("open_minor div 50"))}
    parts = [ledger.build_entry(rows, legs).select(F.lit(k).alias("kind"), "side", "account_class", F.lit(None).cast("string").alias("bucket"), "amount_minor") for k, legs in kinds.items()]
    # Each payer's receivables are paid from two buckets of credit.
    owed = t.invoices().groupBy(F.col("payer_id").alias("entry_id")).agg(F.sum("open_minor").alias("m"))
    buckets = F.array(F.struct(F.lit("promo").alias("b"), F.expr("m div 2").alias("a")), F.struct(F.lit("refund").alias("b"), F.expr("m - m div 2").alias("a")))
    drawn = owed.select("entry_id", F.explode(buckets).alias("x")).select("entry_id", F.col("x.b").alias("credit_grant_event_type"), F.col("x.a").alias("amount_minor"))
    paid = t.invoices().select(F.col("payer_id").alias("entry_id"), "invoice_id", F.col("open_minor").alias("amount_minor"))
    lines = ledger.apply_lines(drawn, paid)
    parts.append(lines.select(F.lit("apply").alias("kind"), "side", "account_class", F.col("credit_grant_event_type").alias("bucket"), "amount_minor"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind", "side", "account_class", "bucket").agg(F.count("*").alias("n"), F.sum("amount_minor").alias("amount_minor"))


@book("ledger_reverse", "SELECT entry_id, CASE side WHEN 'DR' THEN 'CR' ELSE 'DR' END AS side, amount_minor FROM journal_lines")
def _(t):
    return ledger.reverse_lines(t.journal_lines()).select("entry_id", "side", "amount_minor")


@book("ledger_chain_build", """WITH RECURSIVE r AS (SELECT tenant_id, entry_id, row_number() OVER (PARTITION BY tenant_id ORDER BY created_seq) AS i,
 sha256(strlen(entry_id::VARCHAR) || ':' || entry_id || '|' || strlen(period_id) || ':' || period_id || '|' || strlen(payer_id::VARCHAR) || ':' || payer_id || '#') AS body FROM journal_entries),
c AS (SELECT tenant_id, entry_id, i, sha256(body || sha256('GENESIS|' || tenant_id)) AS row_hash FROM r WHERE i = 1 UNION ALL SELECT r.tenant_id, r.entry_id, r.i, sha256(r.body || c.row_hash) FROM c JOIN r ON r.tenant_id = c.tenant_id AND r.i = c.i + 1)
SELECT tenant_id, entry_id, row_hash FROM c""")
def _(t):
    return ledger.build_chain(t.journal_entries(), ["entry_id", "period_id", "payer_id"], "created_seq").select("tenant_id", "entry_id", "row_hash")


@book("ledger_chain_verify", "SELECT entry_id, 'hash' AS fault FROM journal_entries WHERE entry_id % 1000 = 77")
def _(t):
    chain = ledger.build_chain(t.journal_entries(), ["entry_id", "period_id", "payer_id"], "created_seq")
    return ledger.verify_chain(chain.withColumn("body", F.when(F.col("entry_id") % 1000 == 77, "changed").otherwise(F.col("body")))).select("entry_id", "fault")


@book("ledger_claim_keys", """WITH r AS (SELECT entry_id, entry_id % 700 AS k, entry_id // 700 % 3 AS p FROM journal_entries)
SELECT entry_id, CASE WHEN row_number() OVER w = 1 THEN 'claimed' WHEN p = first_value(p) OVER w THEN 'replayed' ELSE 'payload_mismatch' END AS claim FROM r WINDOW w AS (PARTITION BY k ORDER BY entry_id)""")
def _(t):
    r = t.journal_entries().select("entry_id", (F.col("entry_id") % 700).alias("k"), F.expr("string(entry_id div 700 % 3)").alias("p"))
    return ledger.claim_keys(r, ["k"], "entry_id", "p").select("entry_id", "claim")


@book("ledger_open_periods", """WITH c AS (SELECT DISTINCT tenant_id FROM journal_entries), w AS (SELECT tenant_id, p AS period_id FROM c, (VALUES ('199812'), ('199901')) v(p) WHERE tenant_id <> 't9')
SELECT tenant_id, period_id FROM w EXCEPT SELECT tenant_id, period_id FROM journal_entries WHERE tenant_id < 't4'""")
def _(t):
    e = t.journal_entries()
    calendars = e.select("tenant_id", F.when(F.col("tenant_id") == "t9", "WEEK").otherwise("MONTH").alias("granularity")).distinct()
    return ledger.periods_to_open(calendars, e.filter("tenant_id < 't4'"), F.lit("199812"))


@book("ledger_approval", """SELECT entry_id, CASE WHEN a < 5000 THEN 'not_required' WHEN entry_id % 4 = 0 THEN 'pending' WHEN entry_id % 4 = 1 THEN 'self_approval' ELSE 'approved' END AS approval FROM (SELECT entry_id, entry_id % 10000 AS a FROM journal_entries WHERE posted_at >= TIMESTAMP '1997-01-01')
UNION ALL SELECT entry_id, 'not_required' FROM journal_entries WHERE posted_at < TIMESTAMP '1997-01-01'""")
def _(t):
    e = t.journal_entries()
    asked = e.select("tenant_id", "entry_id", F.col("posted_at").alias("created_at"), (F.col("entry_id") % 10000).alias("amount_minor"), F.lit("a").alias("requester_id"), F.when(F.col("entry_id") % 4 == 1, "a").when(F.col("entry_id") % 4 > 1, "b").alias("approver_id"))
    policy = e.select("tenant_id").distinct().select("tenant_id", F.lit("1997-01-01 00:00:00").cast("timestamp").alias("effective_from"), F.lit(5000).alias("threshold_minor"))
    return ledger.approval(asked, policy).select("entry_id", "approval")


@book("ledger_half_even", f"SELECT entry_id, {_even('entry_id * 7 - 40000', '(2 * (1 + entry_id % 9))')} AS q FROM journal_entries")
def _(t):
    return t.journal_entries().select("entry_id", money.half_even(F.col("entry_id") * 7 - 40000, (F.col("entry_id") % 9 + 1) * 2).alias("q"))


@book("ledger_periods", """SELECT entry_id, strftime(date_trunc('month', posted_at) + INTERVAL 5 MONTH, '%Y%m') AS later, strftime(date_trunc('month', posted_at) - INTERVAL 1 MONTH, '%Y%m') AS earlier, cast(date_trunc('month', posted_at) AS DATE) AS first_day, last_day(posted_at) AS last_day,
cast((SELECT count(*) FROM generate_series(1, 40) g(i) WHERE i <= entry_id % 40 AND isodow(cast(posted_at AS DATE) + cast(i AS INTEGER)) < 6) AS INTEGER) AS workdays FROM journal_entries""")
def _(t):
    p, day = F.col("period_id"), F.col("posted_at").cast("date")
    return t.journal_entries().select(
        "entry_id", periods.period_add(p, 5).alias("later"), periods.period_add(p, -1).alias("earlier"), periods.period_start(p).alias("first_day"), periods.period_end(p).alias("last_day"),
        periods.business_days(day, F.date_add(day, (F.col("entry_id") % 40).cast("int"))).alias("workdays"),
    )


@book("ledger_scalars", """SELECT invoice_id, open_minor % 3000 * 100 <= open_minor AND open_minor % 3000 <= 2000 AS small, CASE WHEN invoice_id % 3 = 0 THEN 0 ELSE greatest(0, open_minor - 20000000) END AS remainder,
cast((open_minor * 1500 + 999999) // 1000000 + (open_minor // 2 * 2500 + 999999) // 1000000 AS BIGINT) AS credits, cast((((open_minor + 3) // 4 + 10) * 120 + 99) // 100 AS BIGINT) AS estimate, CASE invoice_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 2 END AS scale FROM invoices""")
def _(t):
    m = F.col("open_minor")
    return t.invoices().select(
        "invoice_id", money.immaterial(m % 3000, m, 2000).alias("small"), money.releasable(m, F.lit(20000000), F.when(F.col("invoice_id") % 3 == 0, "DONE").otherwise("ACTIVE")).alias("remainder"),
        money.credits(m, F.expr("open_minor div 2"), F.lit(1500), F.lit(2500)).alias("credits"), money.token_estimate(m, 4, 10, 20).alias("estimate"),
        money.currency_scale(F.when(F.col("invoice_id") % 3 == 0, "JPY").when(F.col("invoice_id") % 3 == 1, "KWD").otherwise("EUR")).alias("scale"),
    )


@book("ledger_policy_versions", "SELECT entry_id FROM journal_entries WHERE NOT (payer_id % 7 = 3) AND period_id IS NOT NULL")
def _(t):
    rows = t.journal_entries().select("entry_id", "period_id", (F.col("payer_id") % 7).alias("v"), F.lit(None).cast("string").alias("x"))
    return not_listed(rows, rows.filter("v = 3").select("period_id", "v", "x").distinct(), ["period_id", "v", "x"]).select("entry_id")


@book("ledger_audit_rows", "SELECT e.entry_id, l.side, l.amount_minor, CASE WHEN e.entry_id % 2 = 0 THEN '''=1+' || e.entry_id ELSE 'plain' END AS note FROM journal_entries e LEFT JOIN journal_lines l ON e.entry_id = l.entry_id")
def _(t):
    e = t.journal_entries().select("entry_id", F.when(F.col("entry_id") % 2 == 0, F.concat(F.lit("=1+"), "entry_id")).otherwise("plain").alias("note"))
    return sinks.audit_rows(e, t.journal_lines().select("entry_id", "side", "amount_minor"), e)


_CLASSED = """c AS (SELECT *, CASE entry_id % 5 WHEN 0 THEN 'TAX_PAYABLE' WHEN 1 THEN 'UNALLOCATED' WHEN 2 THEN 'REUSABLE_CREDIT' WHEN 3 THEN 'DISPUTE_HOLD' ELSE account_class END AS class,
 'J' || entry_id % 3 AS tax_jurisdiction, 'P' || entry_id % 2 AS tax_filing_period, 'G' || entry_id % 4 AS credit_grant_event_type FROM journal_lines)"""


def _classed(t):
    """Journal lines whose class, and the dimensions of the special classes, follow from the entry's number."""
    n = F.col("entry_id") % 5
    names = F.when(n == 0, "TAX_PAYABLE").when(n == 1, "UNALLOCATED").when(n == 2, "REUSABLE_CREDIT").when(n == 3, "DISPUTE_HOLD").otherwise(F.col("account_class"))
    tag = lambda letter, k: F.concat(F.lit(letter), (F.col("entry_id") % k).cast("string"))
    return t.journal_lines().withColumns({"account_class": names, "tax_jurisdiction": tag("J", 3), "tax_filing_period": tag("P", 2), "credit_grant_event_type": tag("G", 4)})


for _grain, _class in ledger.CLASS_OF.items():
    _keys = ", ".join(ledger.GRAINS[_grain])

    @book(
        f"ledger_balance_{_grain}",
        f"WITH {_CLASSED} SELECT {_keys.replace('account_class', 'class AS account_class')}, cast(sum(CASE side WHEN '{'DR' if _class == 'DISPUTE_HOLD' else 'CR'}' THEN amount_minor ELSE -amount_minor END) AS BIGINT) AS balance_minor "
        f"FROM c WHERE class = '{_class}' GROUP BY {_keys.replace('account_class', 'class')}",
    )
    def _(t, grain=_grain):
        return ledger.project_balances(_classed(t), grain)


@book("ledger_control_feed", """WITH p AS (SELECT tenant_id, period_id, count(*) AS posted FROM journal_entries GROUP BY ALL), f AS (SELECT tenant_id, period_id, posted + CASE WHEN period_id LIKE '%1' THEN 2 WHEN period_id LIKE '%2' THEN -1 ELSE 0 END AS expected FROM p WHERE tenant_id <> 't4')
SELECT p.tenant_id, p.period_id, f.expected, p.posted, CASE WHEN f.expected IS NULL THEN 'unannounced' WHEN p.posted < f.expected THEN 'short' WHEN p.posted > f.expected THEN 'over' ELSE 'matched' END AS state FROM p LEFT JOIN f ON p.tenant_id = f.tenant_id AND p.period_id = f.period_id""")
def _(t):
    e = t.journal_entries()
    off = F.when(F.col("period_id").endswith("1"), 2).when(F.col("period_id").endswith("2"), -1).otherwise(0)
    feed = e.filter("tenant_id <> 't4'").groupBy("tenant_id", "period_id").agg(F.count("*").alias("n")).select("tenant_id", "period_id", (F.col("n") + off).alias("expected"))
    return ledger.control_feed(feed, e)


@book("ledger_next_version", """WITH v AS (SELECT payer_id, max(entry_id % 9) AS m FROM journal_entries WHERE payer_id % 3 <> 0 GROUP BY payer_id)
SELECT DISTINCT e.payer_id, coalesce(v.m + 1, 0) AS next_version FROM journal_entries e LEFT JOIN v ON e.payer_id = v.payer_id""")
def _(t):
    e = t.journal_entries()
    return versions.next_version(e, e.filter("payer_id % 3 <> 0").select("payer_id", (F.col("entry_id") % 9).alias("version")), ["payer_id"])


@book("ledger_dispute_reopen", """WITH o AS (SELECT DISTINCT payer_id FROM journal_entries WHERE payer_id % 2 = 0), c AS (SELECT payer_id, max(entry_id) AS cycle, count(*) AS n FROM journal_entries WHERE payer_id % 3 = 0 GROUP BY payer_id)
SELECT coalesce(o.payer_id, c.payer_id) AS payer_id, coalesce(c.cycle, 0) AS cycle, CASE WHEN c.cycle IS NULL THEN 'closed' ELSE 'open' END AS state, cast(CASE WHEN o.payer_id IS NULL THEN c.n - 1 ELSE 4 + coalesce(c.n, 0) END AS BIGINT) AS version FROM o FULL JOIN c ON o.payer_id = c.payer_id""")
def _(t):
    e = t.journal_entries()
    current = e.filter("payer_id % 2 = 0").select("payer_id").distinct().select("payer_id", F.lit(0).cast("long").alias("cycle"), F.lit("closed").alias("state"), F.lit(4).cast("long").alias("version"))
    changes = e.filter("payer_id % 3 = 0").select("payer_id", F.col("entry_id").alias("cycle"), F.lit("open").alias("state"))
    return versions.upsert_bumped(current, changes, ["payer_id"], "cycle")


@book("ledger_payer_has_balance", """SELECT DISTINCT payer_id, payer_id IN (SELECT payer_id FROM (SELECT payer_id, entry_id, sum(CASE side WHEN 'DR' THEN amount_minor ELSE -amount_minor END) AS b FROM journal_lines GROUP BY ALL) WHERE b <> 0) AS found FROM journal_entries""")
def _(t):
    net = t.journal_lines().groupBy("payer_id", "entry_id").agg(F.sum(money.signed(F.col("side"), F.col("amount_minor"))).alias("b"))
    return versions.exists_for(t.journal_entries().select("payer_id").distinct(), net, ["payer_id"], F.col("b") != 0)


@book("ledger_exceptions", """SELECT entry_id AS exception_id, CASE WHEN entry_id % 4 = 0 THEN 'RESOLVED' WHEN entry_id % 6 = 0 THEN 'WAIVED' ELSE 'OPEN' END AS state,
CASE WHEN entry_id % 4 = 0 THEN 'old' WHEN entry_id % 6 = 0 THEN 'first' END AS resolved_by FROM journal_entries""")
def _(t):
    closed = F.col("entry_id") % 4 == 0
    queue = t.journal_entries().select(F.col("entry_id").alias("exception_id"), F.when(closed, "RESOLVED").otherwise("OPEN").alias("state"), F.when(closed, "old").alias("resolved_by"))
    named = queue.filter("exception_id % 6 = 0").select("exception_id")
    acts = [named.select("exception_id", F.lit(o).alias("outcome"), F.lit(a).alias("actor"), F.lit(at).alias("resolved_at")) for o, a, at in (("RESOLVED", "second", 2), ("WAIVED", "first", 1))]
    return versions.resolve_exceptions(queue, acts[0].unionByName(acts[1])).select("exception_id", "state", "resolved_by")
