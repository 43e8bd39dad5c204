"""Event-log operators as batch queries; ``structured`` runs the stateful ones on streams.

An event has topic, partition, tenant_id, producer_id, sequence and occurred_at; a log adds ``offset``, from 0 within
each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import type_matches

#: The states of a dead letter.
PENDING, REPROCESSING, RESOLVED, DISCARDED = "pending", "reprocessing", "resolved", "discarded"


def assign_offsets(events: DataFrame, order: list[str], base: DataFrame | None = None) -> DataFrame:
    """Next offsets within each (topic, partition), after the log's last one (``next_offset`` of ``base``)."""
    w = Window.partitionBy("topic", "partition").orderBy(*order)
    rows = events.withColumn("offset", (F.row_number().over(w) - 1).cast("long"))
    if base is None:
        return rows
    return rows.join(base.select("topic", "partition", "next_offset"), ["topic", "partition"], "left").withColumn("offset", F.col("offset") + F.coalesce("next_offset", F.lit(0))).drop("next_offset")


def sequence(claims: DataFrame, last: DataFrame, order: list[str]) -> DataFrame:
    """Sequence numbers of claimed rows of each partition, from its last one on."""
    w = Window.partitionBy("partition").orderBy(*order)
    return claims.withColumn("__i", F.row_number().over(w)).join(last, "partition", "left").withColumn("sequence", F.coalesce("last_seq", F.lit(0)) + F.col("__i")).drop("__i", "last_seq")


def monotonic(events: DataFrame, keys: list[str], arrival: str, seq: str = "sequence") -> DataFrame:
    """``accepted`` or ``duplicate``: a sequence at or below the greatest accepted before it is a duplicate.

    The greatest accepted so far is the greatest seen so far, since what is not accepted is not greater.
    """
    w = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(seq).over(w)
    return events.withColumn("outcome", F.when(F.col(seq) <= seen, "duplicate").otherwise("accepted"))


def seek_exact(log: DataFrame, processed: Column | int) -> DataFrame:
    """From the event after the last processed one."""
    return log.filter(F.col("offset") > processed)


def seek_time(log: DataFrame, at: Column) -> DataFrame:
    """For each partition, from the first offset whose event occurred at or after ``at``."""
    first = log.filter(F.col("occurred_at") >= at).groupBy("topic", "partition").agg(F.min("offset").alias("__from"))
    return log.join(first, ["topic", "partition"]).filter(F.col("offset") >= F.col("__from")).drop("__from")


def frontier(log: DataFrame, condition: Column) -> DataFrame:
    """How far a filtered reader has come: the last offset of a partition, matched or not, and how many matched."""
    return log.groupBy("topic", "partition").agg(F.max("offset").alias("position"), F.count_if(condition).alias("matched"))


def resume(log: DataFrame, offsets: DataFrame, fallback: str = "earliest") -> DataFrame:
    """What a consumer group reads next: after its committed offset, or all / nothing where it has none."""
    rows = log.join(offsets.select("topic", "partition", F.col("offset").alias("__done")), ["topic", "partition"], "left")
    start = F.coalesce("__done", F.lit(-1 if fallback == "earliest" else (1 << 62)).cast("long"))
    return rows.filter(F.col("offset") > start).drop("__done")


def interest(log: DataFrame, topic: str, patterns: list[str], tenants: DataFrame | None = None) -> DataFrame:
    """Events of a topic whose type fits one of the patterns and whose tenant is in the given set."""
    fits = F.lit(False)
    for p in patterns:
        fits = fits | type_matches(F.col("type_id"), p)
    rows = log.filter((F.col("topic") == topic) & fits)
    return rows if tenants is None else rows.join(tenants.select("tenant_id").distinct(), "tenant_id", "left_semi")


def interest_tenants(closed: DataFrame, tenant: str, depth: int | None = 0, respect_barriers: bool = True) -> DataFrame:
    """The tenants that an interest covers: the tenant itself (depth 0), its descendants down to ``depth``, or all of
    them (None); respecting barriers, self-managed ones and all below them are left out.  ``closed`` is a closure."""
    rows = closed.filter(F.col("ancestor_id") == tenant)
    if depth is not None:
        rows = rows.filter(F.col("depth") <= depth)
    if respect_barriers:
        rows = rows.filter("barrier = 0")
    return rows.select(F.col("descendant_id").alias("tenant_id"))


def rebalance(members: DataFrame, partitions: int) -> DataFrame:
    """(member_id, partition): contiguous blocks to members by (created_at, id); the first ones take one more.  With
    more members than partitions the rest idle."""
    order = Window.orderBy("created_at", "member_id")
    ranked = members.withColumns({"__i": F.row_number().over(order) - 1, "__n": F.count("*").over(Window.partitionBy())})
    base, more = F.expr(f"cast({partitions} div __n as int)"), F.expr(f"cast({partitions} % __n as int)")
    start = F.col("__i") * base + F.least(F.col("__i"), more)
    size = base + F.when(F.col("__i") < more, 1).otherwise(0)
    spans = ranked.withColumns({"__a": start, "__b": start + size}).filter("__b > __a")
    return spans.select("member_id", F.explode(F.sequence(F.col("__a"), F.col("__b") - 1)).alias("partition")).withColumn("partition", F.col("partition").cast("int"))


def micro_batches(log: DataFrame, max_events: int) -> DataFrame:
    """The batch number of each event within its partition."""
    return log.withColumn("batch", F.expr(f"offset div {max_events}"))


def paused(levels: DataFrame, keys: list[str], order: list[str], level: str, high: int, low: int) -> DataFrame:
    """``paused`` after each row: set once the level is at ``high`` or more, cleared once it is at ``low`` or less, else as
    it was; not paused at first."""
    mark = F.when(F.col(level) >= high, True).when(F.col(level) <= low, False)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return levels.withColumn("paused", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)))


def dead_letters(attempts: DataFrame, max_attempts: int) -> DataFrame:
    """Rejected events, and those that failed ``max_attempts`` times, with their last error; all others drop out."""
    last = attempts.groupBy("event_id").agg(F.count_if(F.col("result") != "success").alias("failures"), F.max_by(F.struct("result", "error"), "attempt").alias("l"))
    dead = (F.col("l.result") == "reject") | ((F.col("l.result") == "retry") & (F.col("failures") >= max_attempts))
    return last.filter(dead).select("event_id", "failures", F.col("l.error").alias("error"), F.lit(PENDING).alias("state"))


def fold_dead_letters(letters: DataFrame, commands: DataFrame) -> DataFrame:
    """The state of each dead letter after its commands in order: replay takes pending to reprocessing, resolve and
    reject act on reprocessing, discard on pending; a command that does not fit is ignored."""
    listed = commands.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("seq", "command"))).alias("__c"))

    def step(s: Column, c: Column) -> Column:
        cmd = c["command"]
        return (
            F.when((s == PENDING) & (cmd == "replay"), REPROCESSING).when((s == REPROCESSING) & (cmd == "resolve"), RESOLVED)
            .when((s == REPROCESSING) & (cmd == "reject"), PENDING).when((s == PENDING) & (cmd == "discard"), DISCARDED).otherwise(s)
        )

    rows = letters.join(listed, "event_id", "left")
    return rows.withColumn("state", F.when(F.col("__c").isNull(), F.col("state")).otherwise(F.aggregate("__c", F.col("state"), step))).drop("__c")


def vacuum(rows: DataFrame, processed: DataFrame) -> DataFrame:
    """What remains once every partition drops what it has processed."""
    kept = rows.join(processed.select("partition", "processed_seq"), "partition", "left")
    return kept.filter("processed_seq IS NULL OR sequence > processed_seq").drop("processed_seq")


def join_bodies(outgoing: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outgoing rows with their bodies, and those whose body is missing, which is an error to the caller."""
    return outgoing.join(bodies, "body_id"), outgoing.join(bodies.select("body_id"), "body_id", "left_anti")


def due_queue(queue: DataFrame, now: Column, limit: int) -> DataFrame:
    """The oldest queued rows that are due."""
    return queue.filter((F.col("state") == "queued") & (F.col("due_at") <= now)).orderBy("due_at", "id").limit(limit)


def claim(queue: DataFrame, now: Column, limit: int, owner: str, lease_seconds: int) -> DataFrame:
    """The oldest due rows that nobody holds, now held by ``owner``: rows without ``claimed_until``, or past it.  The sort
    and the limit are one top-k, so each task hands on ``limit`` rows at most; the write that records the claims decides
    between owners that claim at the same time."""
    free = F.col("claimed_until").isNull() | (F.col("claimed_until") <= now)
    held = due_queue(queue.filter(free), now, limit)
    return held.withColumns({"claimed_by": F.lit(owner), "claimed_until": now + F.make_dt_interval(secs=F.lit(lease_seconds).cast("decimal(18,6)"))})


def overdue(queue: DataFrame, now: Column, after_seconds: int) -> DataFrame:
    """By partition key, how many queued rows have been due for ``after_seconds`` or longer and the oldest of them: what
    an out-of-order queue raises an alarm for."""
    late = F.col("due_at") <= now - F.make_dt_interval(secs=F.lit(after_seconds).cast("decimal(18,6)"))
    return queue.filter((F.col("state") == "queued") & late).groupBy("key").agg(F.count("*").alias("late"), F.min("due_at").alias("oldest"))


def committed_offsets(processed: DataFrame, mode: str, every_seconds: int = 20) -> DataFrame:
    """(topic, partition, offset) that a consumer group has committed after ``processed`` (topic, partition, offset,
    processed_at, committed).

    ``transaction``: every processed event's, since its result and its offset are written together.  ``manual``: the
    greatest that the handler named by ``committed``.  ``auto``: the greatest processed by the last whole interval since
    the partition's first event.  Partitions without a commit have no row.
    """
    if mode == "auto":
        w = Window.partitionBy("topic", "partition")
        us = F.unix_micros("processed_at")
        ticked = processed.withColumns({"__us": us, "__first": F.min(us).over(w), "__last": F.max(us).over(w)})
        step = every_seconds * 1_000_000
        rows = ticked.withColumn("__tick", F.expr(f"__first + (__last - __first) div {step} * {step}")).filter("__tick > __first AND __us <= __tick")
    elif mode in ("transaction", "manual"):
        rows = processed if mode == "transaction" else processed.filter("committed")
    else:
        raise ValueError("mode must be auto, transaction or manual")
    return rows.groupBy("topic", "partition").agg(F.max("offset").alias("offset"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, change): what a watcher sees between two snapshots of a key-value table."""
    a, b = before.select(F.col(key), F.col(value).alias("__a"), F.lit(1).alias("__x")), after.select(F.col(key), F.col(value).alias("__b"), F.lit(1).alias("__y"))
    change = F.when(F.col("__x").isNull(), "added").when(F.col("__y").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return a.join(b, key, "full_outer").withColumn("change", change).filter("change IS NOT NULL").select(key, "change")


def token_bucket(requests: DataFrame, key: str, at: str, per_second: float, burst: float, ties: tuple[str, ...] = ()) -> DataFrame:
    """``admitted`` by request under a token bucket per key.  The level depends on each earlier decision, so a key's
    requests are walked in order (of ``at``, then ``ties``) within one task, fed sorted and in batches."""
    schema = requests.schema
    rows = requests.repartition(key).sortWithinPartitions(key, at, *ties)

    def run(batches):
        current, level, last = None, burst, None
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf[at], strict=True):
                if k != current:
                    current, level, last = k, burst, None
                if last is not None:
                    level = min(burst, level + (t - last).total_seconds() * per_second)
                last = t
                out.append(level >= 1)
                level -= 1 if level >= 1 else 0
            yield pdf.assign(admitted=out)

    return rows.mapInPandas(run, type(schema)([*schema.fields]).add("admitted", "boolean"))
