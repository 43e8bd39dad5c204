"""Double-entry ledger: validation, balances, tie-out, inquiry, allocation, aging, currency and schedules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.money import half_even, product, signed, translate
from brindle.functions.periods import bucket_labels, bucket_rank, days_past_due, period_add

#: Account classes whose balance is normally on the debit side.
DEBIT_NORMAL = ("AR", "CASH_CLEARING", "DISPUTE_HOLD", "CONTRA_REVENUE", "GOODWILL", "DISPUTE_LOSS_EXPENSE", "PSP_FEE_EXPENSE")
GRAINS = {
    "account": ("tenant_id", "account_class", "currency"),
    "ar_payer": ("tenant_id", "payer_id", "account_class", "currency"),
    "ar_invoice": ("tenant_id", "payer_id", "account_class", "entry_id"),
    "stream": ("tenant_id", "account_class", "stream"),
    "disputed": ("tenant_id", "payer_id", "account_class", "entry_id"),
    "tax": ("tenant_id", "account_class", "tax_jurisdiction", "tax_filing_period"),
    "unallocated": ("tenant_id", "payer_id", "currency"),
    "reusable_credit": ("tenant_id", "payer_id", "currency", "credit_grant_event_type"),
}
#: Grains that have lines of one account class only.
CLASS_OF = {"disputed": "DISPUTE_HOLD", "tax": "TAX_PAYABLE", "unallocated": "UNALLOCATED", "reusable_credit": "REUSABLE_CREDIT"}


def normal_amount(account_class: Column, side: Column, amount: Column) -> Column:
    """Positive on the class's normal side."""
    return F.when(account_class.isin(*DEBIT_NORMAL), signed(side, amount)).otherwise(-signed(side, amount))


def validate(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Every entry with its first fault in a fixed order, or ``ok``: empty, amount_out_of_range, mixed_payer,
    currency_mismatch, inconsistent_scale, unbalanced, functional_partial, functional_unbalanced.

    Optional columns: entry_currency of entries; currency_scale and functional_amount_minor of lines.
    """
    functional = F.col("functional_amount_minor") if "functional_amount_minor" in lines.columns else F.lit(None).cast("bigint")
    scale = F.col("currency_scale") if "currency_scale" in lines.columns else F.lit(2)
    head = entries.select("entry_id", F.col("entry_currency") if "entry_currency" in entries.columns else F.lit(None).cast("string").alias("entry_currency"))
    facts = lines.select("entry_id", "payer_id", "side", F.col("amount_minor").alias("a"), F.col("currency").alias("c"), functional.alias("f"), scale.alias("s"))
    only_functional = (F.col("a") == 0) & (F.coalesce("f", F.lit(0)) > 0)
    # Net and scale by (entry, currency) first; the entry's row is folded from those few.
    by_currency = facts.groupBy("entry_id", "c").agg(
        F.count("*").alias("n"), F.count_if((F.col("a") < 0) | ((F.col("a") == 0) & ~only_functional)).alias("bad"), F.min("payer_id").alias("p0"), F.max("payer_id").alias("p1"),
        F.count_if(~only_functional).alias("own"), F.min("s").alias("s0"), F.max("s").alias("s1"), F.sum(signed(F.col("side"), F.col("a")).cast("decimal(38,0)")).alias("net"),
        F.count("f").alias("fn"), F.sum(signed(F.col("side"), F.coalesce("f", F.lit(0))).cast("decimal(38,0)")).alias("fnet"),
    )
    one = head.join(by_currency, "entry_id", "left").groupBy("entry_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("bad").alias("bad"), F.min("p0").alias("p0"), F.max("p1").alias("p1"),
        F.count_if((F.col("entry_currency") != F.col("c")) & (F.col("own") > 0)).alias("foreign"), F.max(F.col("s0") != F.col("s1")).alias("scales"),
        F.count_if(F.col("net") != 0).alias("nets"), F.sum("fn").alias("fn"), F.sum("fnet").alias("fnet"),
    )
    fault = (
        F.when(F.col("n") == 0, "empty").when(F.col("bad") > 0, "amount_out_of_range").when(F.col("p0") != F.col("p1"), "mixed_payer").when(F.col("foreign") > 0, "currency_mismatch")
        .when(F.col("scales"), "inconsistent_scale").when(F.col("nets") > 0, "unbalanced").when((F.col("fn") > 0) & (F.col("fn") < F.col("n")), "functional_partial")
        .when((F.col("fn") == F.col("n")) & (F.col("fnet") != 0), "functional_unbalanced").otherwise("ok")
    )
    return one.select("entry_id", F.col("n").alias("n_lines"), fault.alias("verdict"))


def project_balances(lines: DataFrame, grain: str) -> DataFrame:
    """The balance of each key of a grain, on its normal side."""
    keys = GRAINS[grain]
    if grain in CLASS_OF:
        lines = lines.filter(F.col("account_class") == CLASS_OF[grain])
    return lines.groupBy(*keys).agg(F.sum(normal_amount(F.col("account_class"), F.col("side"), F.col("amount_minor"))).alias("balance_minor"))


def control_feed(feed: DataFrame, entries: DataFrame) -> DataFrame:
    """What the outside says of each (tenant, period) next to what was posted: expected and posted numbers of entries,
    and ``state``: matched, short, over, or unannounced where nothing was expected."""
    posted = entries.groupBy("tenant_id", "period_id").agg(F.count("*").alias("posted"))
    both = feed.select("tenant_id", "period_id", "expected").join(posted, ["tenant_id", "period_id"], "full_outer").withColumn("posted", F.coalesce("posted", F.lit(0)))
    state = F.when(F.col("expected").isNull(), "unannounced").when(F.col("posted") < F.col("expected"), "short").when(F.col("posted") > F.col("expected"), "over").otherwise("matched")
    return both.withColumn("state", state)


def tie_out(cache: DataFrame, lines: DataFrame, grain: str) -> DataFrame:
    """Keys whose cached balance differs from the fold of the lines; a missing side counts as 0."""
    keys = list(GRAINS[grain])
    left = cache.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("balance_minor").alias("cached"))
    right = project_balances(lines, grain).withColumnRenamed("balance_minor", "folded")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = right.join(left, same, "full_outer").select(*[F.coalesce(F.col(k), F.col(f"__{k}")).alias(k) for k in keys], F.coalesce("cached", F.lit(0)).alias("cached"), F.coalesce("folded", F.lit(0)).alias("folded"))
    return out.withColumn("variance", F.col("cached") - F.col("folded")).filter("variance <> 0")


def tie_out_from(baseline: DataFrame, watermark: int, lines: DataFrame, grain: str, seq: str = "created_seq") -> DataFrame:
    """Balances from a verified baseline and the lines after its watermark."""
    keys = list(GRAINS[grain])
    fresh = project_balances(lines.filter(F.col(seq) > watermark), grain)
    return baseline.select(*keys, "balance_minor").unionByName(fresh).groupBy(*keys).agg(F.sum("balance_minor").alias("balance_minor"))


def first_stamp(lines: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """The value that was written first for each key."""
    return lines.groupBy(*keys).agg(F.min_by(value, seq).alias(value))


def entries_with_lines(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Every entry with all its lines; one row, with null line columns, for an entry without."""
    extra = [c for c in lines.columns if c not in entries.columns]
    return entries.join(lines.select("entry_id", *extra), "entry_id", "left")


def entries_matching(entries: DataFrame, lines: DataFrame, condition: Column) -> DataFrame:
    """Entries with at least one line that fits."""
    return entries.join(lines.filter(condition).select("entry_id"), "entry_id", "left_semi")


def reversal_links(entries: DataFrame) -> DataFrame:
    """(entry_id, related_id, relation) both ways between an entry and what reverses it."""
    there = entries.select("entry_id")
    link = entries.filter("reverses_entry_id IS NOT NULL").select("entry_id", "reverses_entry_id").join(there.select(F.col("entry_id").alias("reverses_entry_id")), "reverses_entry_id", "left_semi")
    down = link.select("entry_id", F.col("reverses_entry_id").alias("related_id"), F.lit("reverses").alias("relation"))
    up = link.select(F.col("reverses_entry_id").alias("entry_id"), F.col("entry_id").alias("related_id"), F.lit("reversed_by").alias("relation"))
    return down.unionByName(up).dropDuplicates()


def uncovered(entries: DataFrame, checkpoints: DataFrame, seq: str = "created_seq") -> DataFrame:
    """Entries whose sequence lies in no checkpoint [from_seq, to_seq] of their tenant.

    Checkpoints and entries go into one order; the greatest end of a checkpoint that started at or before an entry
    tells whether it is covered, so there is no range join.
    """
    marks = checkpoints.select("tenant_id", F.col("from_seq").alias("__seq"), F.lit(0).alias("__kind"), F.col("to_seq").alias("__to"))
    rows = entries.withColumns({"__seq": F.col(seq), "__kind": F.lit(1), "__to": F.lit(None).cast("bigint")})
    w = Window.partitionBy("tenant_id").orderBy("__seq", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.unionByName(marks, allowMissingColumns=True).withColumn("__reach", F.max("__to").over(w))
    return out.filter("__kind = 1 AND (__reach IS NULL OR __reach < __seq)").select(*entries.columns)


def effective_at(rows: DataFrame, versions: DataFrame, keys: list[str], at: str, since: str = "effective_from") -> DataFrame:
    """Each row with the latest version of its key that took effect at or before ``at``; null columns without one."""
    extra = [c for c in versions.columns if c not in keys]
    v = versions.select(*keys, F.col(since).alias("__t"), F.lit(0).alias("__kind"), F.struct(*extra).alias("__v"))
    r = rows.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.struct(*rows.columns).alias("__r"))
    w = Window.partitionBy(*keys).orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    out = v.unionByName(r, allowMissingColumns=True).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).filter("__kind = 1")
    return out.select("__r.*", *[F.col("__v").getField(c).alias(c) for c in extra])


def fill(invoices: DataFrame, lumps: DataFrame, key: str = "payer_id", highest: bool = False, hint: str | None = None) -> DataFrame:
    """Spread each key's lump over its open invoices: oldest first (posted_at, nulls last, then id) or highest
    first; the invoice that ``hint`` names goes to the front.  Only rows that receive something come back."""
    first = [F.when(F.col("invoice_id") == F.col(hint), 0).otherwise(1)] if hint else []
    order = [*first, F.col("open_minor").desc(), F.col("invoice_id")] if highest else [*first, F.col("posted_at").asc_nulls_last(), F.col("invoice_id")]
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = invoices.filter("open_minor > 0").join(lumps, key).withColumn("__prior", F.coalesce(F.sum("open_minor").over(w), F.lit(0)))
    give = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("open_minor"), F.col("lump_minor") - F.col("__prior")))
    return rows.withColumn("give_minor", give).filter("give_minor > 0").drop("__prior")


def wallet_fill(wallets: DataFrame, debits: DataFrame, key: str, order: str) -> DataFrame:
    """Draw each debit from the key's wallets in order; ``covered`` is false where they do not hold enough."""
    w = Window.partitionBy(key).orderBy(order)
    prior = F.coalesce(F.sum("balance_minor").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("balance_minor").over(Window.partitionBy(key))
    rows = wallets.join(debits, key).withColumns({"__prior": prior, "covered": total >= F.col("debit_minor")})
    draw = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("balance_minor"), F.col("debit_minor") - F.col("__prior")))
    return rows.withColumn("draw_minor", F.when(F.col("covered"), draw).otherwise(0)).drop("__prior")


def allocate(rows: DataFrame, key: list[str], total: str, weight: str, order: str, residual: str = "last") -> DataFrame:
    """Share a total by weights, each share half even; what is left over goes to the last row or to the first of the
    largest weight.  A key with a negative weight or weights of sum 0 gets null shares."""
    whole = Window.partitionBy(*key)
    rows = rows.withColumns({"__sum": F.sum(F.col(weight).cast("decimal(38,0)")).over(whole), "__min": F.min(weight).over(whole), "__n": F.row_number().over(whole.orderBy(F.col(order).desc())), "__big": F.row_number().over(whole.orderBy(F.col(weight).desc(), F.col(order)))})
    good = (F.col("__min") >= 0) & (F.col("__sum") > 0)
    rows = rows.withColumn("__share", F.when(good, half_even(product(F.col(total), F.col(weight)), F.when(good, F.col("__sum")).otherwise(1))))
    left = F.col(total) - F.sum("__share").over(whole)
    place = F.col("__n") == 1 if residual == "last" else F.col("__big") == 1
    return rows.withColumn("share_minor", F.col("__share") + F.when(place, left).otherwise(0)).drop("__sum", "__min", "__n", "__big", "__share")


def aging(balances: DataFrame, today: Column, bounds: list[int], keys: list[str]) -> DataFrame:
    """Open balances by age of their due date; balances that are not positive are left out."""
    labels = F.array(*[F.lit(x) for x in bucket_labels(bounds)])
    rank = bucket_rank(days_past_due(F.col("due_date"), today), bounds)
    rows = balances.filter("open_minor > 0").withColumn("rank", rank)
    return rows.groupBy(*keys, "rank").agg(F.sum("open_minor").alias("amount_minor")).withColumn("bucket", F.element_at(labels, F.col("rank") + 1))


def straight_line(schedules: DataFrame, total: str = "total_minor", months: str = "months", start: str = "start_period") -> DataFrame:
    """Equal monthly segments from the first period; each is half even and the last one takes what is left."""
    share = half_even(F.col(total), F.col(months))
    rows = schedules.withColumn("segment", F.explode(F.sequence(F.lit(1), F.col(months).cast("int"))))
    amount = F.when(F.col("segment") < F.col(months), share).otherwise(F.col(total) - share * (F.col(months) - 1))
    return rows.withColumns({"period_id": period_add(F.col(start), F.col("segment") - 1), "amount_minor": amount.cast("bigint")})


def release_due(segments: DataFrame, current: str) -> DataFrame:
    """Segments of the current period and of earlier ones that are not released yet, by the period they run in."""
    return segments.filter((F.col("period_id") <= current) & (F.col("status") == "PENDING")).withColumn("run_period", F.lit(current))


def pick_rate(requests: DataFrame, rates: DataFrame, providers: list[str], max_age_seconds: int) -> DataFrame:
    """Each request (id, tenant_id, base, quote, at) with its rate: by provider order, then fallback_order, then
    provider; rates that are not positive, later than the request or too old do not count."""
    place = F.array_position(F.array(*[F.lit(p) for p in providers]), F.col("provider"))
    rank = F.when(place > 0, place).otherwise(len(providers) + 1)
    age = F.unix_micros("at") - F.unix_micros("as_of")
    joined = requests.join(rates.withColumn("__rank", rank), ["tenant_id", "base", "quote"]).filter((F.col("rate_micro") > 0) & (age >= 0) & (age <= max_age_seconds * 1_000_000))
    best = joined.groupBy("id").agg(F.min(F.struct("__rank", "fallback_order", "provider", (-F.unix_micros("as_of")).alias("__late"), "rate_micro")).alias("b"))
    return requests.join(best.select("id", F.col("b.provider").alias("provider"), F.col("b.rate_micro").alias("rate_micro")), "id", "left")


def translate_entry(lines: DataFrame, rate: str = "rate_micro", order: str = "line_no") -> DataFrame:
    """Functional amounts by line, and the entry's rounding residual closed on its last line."""
    whole = Window.partitionBy("entry_id")
    rows = lines.withColumn("__f", translate(F.col("amount_minor"), F.col(rate)))
    net = F.sum(signed(F.col("side"), F.col("__f"))).over(whole)
    last = F.row_number().over(whole.orderBy(F.col(order).desc())) == 1
    return rows.withColumn("functional_minor", F.col("__f") - F.when(last, F.when(F.col("side") == "DR", net).otherwise(-net)).otherwise(0)).drop("__f")


def realized_fx(settled: DataFrame) -> DataFrame:
    """Carried amount relieved pro rata (half even) against what was settled; the difference is a loss (DR) or gain (CR)."""
    relief = half_even(product(F.col("carried_minor"), F.col("settled_minor")), F.col("open_minor"))
    net = F.col("settled_functional_minor") - relief
    return settled.withColumns({"relief_minor": relief, "plug_side": F.when(net < 0, "DR").when(net > 0, "CR"), "plug_minor": F.abs(net)})


def remeasure(balances: DataFrame, rate: str = "rate_micro") -> DataFrame:
    """The change of a balance's functional value at a new rate, on its normal side or, where it falls, opposite."""
    delta = translate(F.col("balance_minor"), F.col(rate)) - F.col("functional_minor")
    up = F.col("account_class").isin(*DEBIT_NORMAL) == (delta > 0)
    return balances.withColumns({"delta_minor": F.abs(delta), "side": F.when(delta == 0, None).when(up, "DR").otherwise("CR"), "plug_side": F.when(delta == 0, None).when(up, "CR").otherwise("DR")})


def split_credit_note(notes: DataFrame, schedules: DataFrame) -> DataFrame:
    """Where a credit note of an invoice goes: it drains its only stream's remainder, drains all when it equals the
    whole, hits the single schedule it names, or is ambiguous; ``excess`` when it is more than what is left."""
    left = schedules.groupBy("invoice_id").agg(F.count("*").alias("n"), F.sum("remaining_minor").alias("remaining"), F.collect_set("schedule_id").alias("ids"))
    named = F.array_contains(F.col("ids"), F.col("schedule_id"))
    rows = notes.join(left, "invoice_id", "left")
    mode = (
        F.when(F.col("n").isNull(), "no_schedule").when(F.col("note_minor") > F.col("remaining"), "excess").when(F.col("n") == 1, "single")
        .when(F.col("note_minor") == F.col("remaining"), "drain_all").when(F.coalesce(named, F.lit(False)), "target").otherwise("ambiguous")
    )
    return rows.withColumn("mode", mode).drop("ids", "n", "remaining")


def build_entry(rows: DataFrame, legs: list[tuple[str, str, Column]]) -> DataFrame:
    """Balanced lines from one row each: a list of (side, account class, amount); legs of amount 0 are left out."""
    parts = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(a).alias("account_class"), m.cast("bigint").alias("amount_minor")) for s, a, m in legs])
    return rows.withColumn("__leg", F.explode(F.filter(parts, lambda x: x["amount_minor"] != 0))).select(*rows.columns, "__leg.*")


def invoice_legs(total: Column, tax: Column) -> list[tuple[str, str, Column]]:
    return [("DR", "AR", total + tax), ("CR", "CONTRACT_LIABILITY", total), ("CR", "TAX_PAYABLE", tax)]


def settlement_legs(paid: Column, fee: Column | None = None) -> list[tuple[str, str, Column]]:
    """A payment of ``paid``, of which the provider keeps ``fee``."""
    fee = F.lit(0) if fee is None else fee
    return [("DR", "CASH_CLEARING", paid - fee), ("DR", "PSP_FEE_EXPENSE", fee), ("CR", "UNALLOCATED", paid)]


def return_legs(returned: Column, fee: Column | None = None) -> list[tuple[str, str, Column]]:
    """A settlement given back, with its share of the fee."""
    return [("CR" if side == "DR" else "DR", account, amount) for side, account, amount in settlement_legs(returned, fee)]


def grant_legs(amount: Column) -> list[tuple[str, str, Column]]:
    return [("DR", "UNALLOCATED", amount), ("CR", "REUSABLE_CREDIT", amount)]


def apply_lines(debits: DataFrame, targets: DataFrame) -> DataFrame:
    """Lines of entries that apply credit: a debit for each bucket drawn (entry_id, credit_grant_event_type,
    amount_minor), a credit for each receivable paid (entry_id, invoice_id, amount_minor)."""
    columns = ["entry_id", "side", "account_class", "credit_grant_event_type", "invoice_id", "amount_minor"]
    drawn = debits.withColumns({"side": F.lit("DR"), "account_class": F.lit("REUSABLE_CREDIT"), "invoice_id": F.lit(None).cast(targets.schema["invoice_id"].dataType)})
    paid = targets.withColumns({"side": F.lit("CR"), "account_class": F.lit("AR"), "credit_grant_event_type": F.lit(None).cast("string")})
    return drawn.select(*columns).unionByName(paid.select(*columns))


def allocation_legs(given: Column) -> list[tuple[str, str, Column]]:
    return [("DR", "UNALLOCATED", given), ("CR", "AR", given)]


def note_legs(amount: Column, credit: bool) -> list[tuple[str, str, Column]]:
    sides = ("DR", "CR") if credit else ("CR", "DR")
    return [(sides[0], "CONTRACT_LIABILITY", amount), (sides[1], "AR", amount)]


def chargeback_legs(amount: Column) -> list[tuple[str, str, Column]]:
    return [("DR", "DISPUTE_HOLD", amount), ("CR", "CASH_CLEARING", amount)]


def reverse_lines(lines: DataFrame) -> DataFrame:
    """The same lines on the other side."""
    return lines.withColumn("side", F.when(F.col("side") == "DR", "CR").otherwise("DR"))


def row_hash(fields: Column, prev: Column) -> Column:
    """SHA-256 over length-prefixed fields (a null has no length) and the previous hash, as hex."""
    framed = F.array_join(F.transform(fields, lambda x: F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x))), "|")
    return F.sha2(F.concat(framed, F.lit("#"), prev), 256)


def genesis(tenant: Column) -> Column:
    return F.sha2(F.concat(F.lit("GENESIS|"), tenant), 256)


def build_chain(entries: DataFrame, fields: list[str], order: str) -> DataFrame:
    """Chain the entries of each tenant in order.  Sequential by nature: one tenant's hashes are worked out in one
    task, fed sorted and in batches, and only digests of the entries travel."""
    import hashlib

    framed = row_hash(F.array(*[F.col(f).cast("string") for f in fields]), F.lit(""))
    rows = entries.select("tenant_id", "entry_id", F.col(order).alias("seq"), framed.alias("body")).repartition("tenant_id").sortWithinPartitions("tenant_id", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, prev = None, ""
        for pdf in batches:
            prevs, hashes = [], []
            for t, body in zip(pdf["tenant_id"], pdf["body"], strict=True):
                if t != tenant:
                    tenant, prev = t, hashlib.sha256(f"GENESIS|{t}".encode()).hexdigest()
                prevs.append(prev)
                prev = hashlib.sha256((body + prev).encode()).hexdigest()
                hashes.append(prev)
            yield pdf.assign(prev_hash=prevs, row_hash=hashes)

    return rows.mapInPandas(run, "tenant_id string, entry_id long, seq long, body string, prev_hash string, row_hash string")


def verify_chain(chain: DataFrame) -> DataFrame:
    """Rows whose hash does not follow from their body and stored previous hash, or whose previous hash is not their
    predecessor's.  Every row is checked on its own."""
    w = Window.partitionBy("tenant_id").orderBy("seq")
    want = F.sha2(F.concat("body", "prev_hash"), 256)
    before = F.coalesce(F.lag("row_hash").over(w), genesis(F.col("tenant_id")))
    return chain.withColumn("fault", F.when(F.col("row_hash") != want, "hash").when(F.col("prev_hash") != before, "link")).filter("fault IS NOT NULL")


def claim_keys(requests: DataFrame, keys: list[str], order: str, payload: str) -> DataFrame:
    """Idempotency claims: the first request of a key owns it, others replay it when their payload agrees."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = F.sha2(payload, 256) == F.first(F.sha2(payload, 256)).over(w)
    return requests.withColumn("claim", F.when(F.row_number().over(w) == 1, "claimed").when(same, "replayed").otherwise("payload_mismatch"))


def periods_to_open(calendars: DataFrame, existing: DataFrame, current: Column) -> DataFrame:
    """The current and the next period of every monthly calendar that are not there yet."""
    want = calendars.filter("granularity = 'MONTH'").select("tenant_id", F.explode(F.array(current, period_add(current, 1))).alias("period_id"))
    return want.join(existing.select("tenant_id", "period_id"), ["tenant_id", "period_id"], "left_anti")


def approval(requests: DataFrame, policy: DataFrame, at: str = "created_at") -> DataFrame:
    """Dual control: which requests need a second person under the policy in force, and whether they have one."""
    rows = effective_at(requests, policy, ["tenant_id"], at)
    need = F.col("threshold_minor").isNotNull() & (F.col("amount_minor") >= F.col("threshold_minor"))
    state = F.when(~need, "not_required").when(F.col("approver_id").isNull(), "pending").when(F.col("approver_id") == F.col("requester_id"), "self_approval").otherwise("approved")
    return rows.withColumn("approval", state)
