"""Queries of event logs; each is the batch twin of what runs on a stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.catalog.book import Book
from brindle.functions.ids import partition_of
from brindle.functions.text import backoff
from brindle.operators import hierarchy
from brindle.streaming import deltas, log, outbox

book = Book()
QUERIES = book.queries
_EVENTS = "e AS (SELECT event_id, 'top' || (event_id % 2) AS topic, cast(user_id % 8 AS INTEGER) AS partition, 't' || user_id AS tenant_id, event_type AS type_id, ts AS occurred_at FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY topic, partition ORDER BY event_id) - 1 AS off FROM e)"


def events(t):
    return t.events().select("event_id", F.concat(F.lit("top"), (F.col("event_id") % 2).cast("string")).alias("topic"), (F.col("user_id") % 8).cast("int").alias("partition"), F.concat(F.lit("t"), "user_id").alias("tenant_id"), F.col("event_type").alias("type_id"), F.col("ts").alias("occurred_at"), "user_id")


def logged(t):
    return log.assign_offsets(events(t), ["event_id"])


@book("stream_offsets", f"WITH {_EVENTS} SELECT event_id, off + CASE WHEN topic = 'top1' THEN 100 ELSE 0 END AS \"offset\" FROM l")
def _(t):
    base = events(t).filter("topic = 'top1'").select("topic", "partition").distinct().withColumn("next_offset", F.lit(100).cast("long"))
    return log.assign_offsets(events(t), ["event_id"], base).select("event_id", "offset")


@book("stream_sequence", f"WITH {_EVENTS} SELECT event_id, row_number() OVER (PARTITION BY partition ORDER BY event_id) + 10 * partition AS sequence FROM e")
def _(t):
    last = t.spark.range(1, 8).select(F.col("id").cast("int").alias("partition"), (F.col("id") * 10).alias("last_seq"))
    return log.sequence(events(t), last, ["event_id"]).select("event_id", "sequence")


@book("stream_monotonic", """WITH p AS (SELECT event_id, user_id AS producer_id, (event_id * 7919) % 10007 AS sequence FROM events), m AS (SELECT event_id, sequence, max(sequence) OVER (PARTITION BY producer_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p)
SELECT event_id, CASE WHEN sequence <= seen THEN 'duplicate' ELSE 'accepted' END AS outcome FROM m""")
def _(t):
    p = t.events().select("event_id", F.col("user_id").alias("producer_id"), (F.col("event_id") * 7919 % 10007).alias("sequence"))
    return log.monotonic(p, ["producer_id"], "event_id").select("event_id", "outcome")


@book("stream_seek_exact", f"WITH {_EVENTS} SELECT event_id FROM l WHERE off > 500")
def _(t):
    return log.seek_exact(logged(t), 500).select("event_id")


@book("stream_seek_time", f"WITH {_EVENTS}, f AS (SELECT topic, partition, min(off) AS first FROM l WHERE occurred_at >= TIMESTAMP '2024-01-20' GROUP BY ALL) SELECT event_id FROM l JOIN f USING (topic, partition) WHERE off >= first")
def _(t):
    return log.seek_time(logged(t), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id")


@book("stream_frontier", f"WITH {_EVENTS} SELECT topic, partition, max(off) AS position, count(*) FILTER (WHERE type_id = 'click') AS matched FROM l GROUP BY ALL")
def _(t):
    return log.frontier(logged(t), F.col("type_id") == "click")


@book("stream_resume", f"WITH {_EVENTS} SELECT event_id FROM l WHERE topic = 'top0' AND off > 300 OR topic = 'top1'")
def _(t):
    done = logged(t).filter("topic = 'top0'").select("topic", "partition").distinct().withColumn("offset", F.lit(300).cast("long"))
    return log.resume(logged(t), done).select("event_id")


@book("stream_interest", f"WITH {_EVENTS} SELECT event_id FROM e WHERE topic = 'top1' AND (starts_with(type_id, 'p') OR type_id = 'view') AND tenant_id IN ('t1', 't2', 't3')")
def _(t):
    tenants = t.spark.createDataFrame([("t1",), ("t2",), ("t3",)], "tenant_id string")
    return log.interest(events(t), "top1", ["p*", "view"], tenants).select("event_id")


@book("stream_interest_subtree", "SELECT event_id, root FROM (SELECT event_id, 'c' || user_id AS tenant_id FROM events) e JOIN (SELECT 'near' AS root, descendant_id FROM closure WHERE ancestor_id = 'r1' AND barrier = 0 AND depth <= 2 UNION ALL SELECT 'all', descendant_id FROM closure WHERE ancestor_id = 'r2') c ON e.tenant_id = c.descendant_id")
def _(t):
    # One interest respects barriers down to two levels, the other takes the whole subtree.
    closed = hierarchy.closure(t.tenants(), levels=3)
    e = t.events().select("event_id", F.lit("all").alias("topic"), F.concat(F.lit("c"), "user_id").alias("tenant_id"), F.col("event_type").alias("type_id"))
    wanted = {"near": log.interest_tenants(closed, "r1", 2), "all": log.interest_tenants(closed, "r2", None, respect_barriers=False)}
    near, whole = (log.interest(e, "all", ["*"], ids).select("event_id", F.lit(k).alias("root")) for k, ids in wanted.items())
    return near.unionByName(whole)


@book("stream_paused", """WITH l AS (SELECT event_id, user_id % 8 AS partition, sum(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END) OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS level FROM events)
SELECT event_id, coalesce(last_value(CASE WHEN level >= 6 THEN true WHEN level <= 2 THEN false END IGNORE NULLS) OVER (PARTITION BY partition ORDER BY event_id ROWS UNBOUNDED PRECEDING), false) AS paused FROM l""")
def _(t):
    w = Window.partitionBy("partition").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    change = F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1)
    levels = t.events().withColumn("partition", F.col("user_id") % 8).withColumn("level", F.sum(change).over(w))
    return log.paused(levels, ["partition"], ["event_id"], "level", 6, 2).select("event_id", "paused")


@book("stream_batch_sizes", """WITH RECURSIVE p AS (SELECT event_id, user_id, CASE event_type WHEN 'signup' THEN 'retry' WHEN 'error' THEN 'reject' ELSE 'success' END AS result, greatest(1, CASE WHEN event_id % 5 = 4 THEN 1 ELSE event_id % 5 END) AS low, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
w AS (SELECT cast(NULL AS BIGINT) AS event_id, user_id, cast(0 AS BIGINT) AS i, cast(16 AS BIGINT) AS size, 0 AS failures FROM (SELECT DISTINCT user_id FROM events) UNION ALL
 SELECT p.event_id, p.user_id, p.i, CASE result WHEN 'success' THEN least(16, size * 2) WHEN 'reject' THEN low WHEN 'retry' THEN CASE WHEN failures >= 1 THEN low ELSE size END END, CASE result WHEN 'retry' THEN failures + 1 ELSE 0 END FROM w JOIN p ON p.user_id = w.user_id AND p.i = w.i + 1)
SELECT event_id, cast(size AS INTEGER) AS batch_size FROM w WHERE i > 0""")
def _(t):
    result = F.when(F.col("event_type") == "signup", "retry").when(F.col("event_type") == "error", "reject").otherwise("success")
    done = F.when(F.col("event_id") % 5 != 4, F.col("event_id") % 5)
    return outbox.batch_sizes(t.events().select("event_id", "user_id", result.alias("result"), done.alias("processed")), ["user_id"], ["event_id"], 16, 2).select("event_id", "batch_size")


_WIRE = """WITH e AS (SELECT event_id, user_id, event_type, count(*) FILTER (WHERE event_type = 'click') OVER w AS chunks, count(*) FILTER (WHERE event_type = 'view') OVER w AS views FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT *, min(views) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id) AS place FROM e),
x AS (SELECT event_id, user_id, 0 AS i, 'message.part.add' AS type, 'parts/' || (CASE event_type WHEN 'click' THEN place ELSE views - 1 + CASE WHEN chunks > 0 THEN 1 ELSE 0 END END) AS path FROM f WHERE event_type = 'view' OR event_type = 'click' AND chunks = 1
 UNION ALL SELECT event_id, user_id, 1, 'message.text.delta', 'parts/' || place || '/content/text' FROM f WHERE event_type = 'click' UNION ALL SELECT event_id, user_id, 0, 'message.file_citation.add', 'parts/0/file_citations' FROM f WHERE event_type = 'purchase' AND event_id % 2 = 0
 UNION ALL SELECT event_id, user_id, 1, 'message.reference.add', 'parts/0/references' FROM f WHERE event_type = 'purchase' UNION ALL SELECT event_id, user_id, 0, 'message.status.changed', NULL FROM f WHERE event_type = 'signup'
 UNION ALL SELECT event_id, user_id, 0, 'message.link_citation.add', 'parts/' || CASE WHEN chunks > 0 THEN place ELSE 0 END || '/link_citations' FROM f WHERE event_type = 'error' UNION ALL SELECT event_id, user_id, 1, 'message.complete', NULL FROM f WHERE event_type = 'error')
SELECT event_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY event_id, i) - 1 AS INTEGER) AS seq, type, path FROM x"""


@book("stream_deltas", _WIRE)
def _(t):
    kinds = {"click": "chunk", "view": "part", "purchase": "citation", "signup": "status", "error": "complete"}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    one = F.array(F.lit("a"))
    e = t.events().select(
        "event_id", "user_id", kind.alias("kind"), F.col("props").alias("value"), F.lit(0).alias("part_number"), F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 2 == 0), one).alias("file_citations"),
        F.when(F.col("event_type") == "error", one).alias("link_citations"), F.when(F.col("event_type") == "purchase", one).alias("references"),
    )
    return deltas.project(e, ["user_id"], "event_id").select("event_id", "seq", "type", "path")


@book("stream_rebalance", """WITH m AS (SELECT s_suppkey AS member_id, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier)
SELECT member_id, cast(p AS INTEGER) AS partition FROM m, generate_series(0, 2500) g(p) WHERE p BETWEEN i * (2501 // n) + least(i, 2501 % n) AND i * (2501 // n) + least(i, 2501 % n) + 2501 // n + CASE WHEN i < 2501 % n THEN 1 ELSE 0 END - 1""")
def _(t):
    return log.rebalance(t.raw("supplier").select(F.col("s_suppkey").alias("member_id"), F.lit(0).alias("created_at")), 2501)


@book("stream_micro_batches", f"WITH {_EVENTS} SELECT topic, partition, off // 100 AS batch, count(*) AS n FROM l GROUP BY ALL")
def _(t):
    return log.micro_batches(logged(t), 100).groupBy("topic", "partition", "batch").agg(F.count("*").alias("n"))


def attempts(t):
    """Up to four attempts of an event; what happens follows from its number."""
    e = t.events().select("event_id", F.explode(F.sequence(F.lit(1), (F.col("event_id") % 4 + 1).cast("int"))).alias("attempt"))
    last = F.col("attempt") == F.col("event_id") % 4 + 1
    result = F.when(last & (F.col("event_id") % 7 == 0), "reject").when(last & (F.col("event_id") % 3 != 0), "success").otherwise("retry")
    return e.withColumns({"result": result, "error": F.when(result != "success", F.concat(F.lit("e"), "attempt"))})


_DEAD = """d AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN event_id % 4 + 1 WHEN event_id % 3 <> 0 THEN event_id % 4 ELSE event_id % 4 + 1 END AS failures, 'e' || (event_id % 4 + 1) AS error
 FROM events WHERE event_id % 7 = 0 OR event_id % 3 = 0 AND event_id % 4 + 1 >= 3)"""


@book("stream_dead_letters", f"WITH {_DEAD} SELECT event_id, failures, error, 'pending' AS state FROM d")
def _(t):
    return log.dead_letters(attempts(t), 3)


@book("stream_dead_letter_states", f"""WITH {_DEAD} SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN 'discarded' WHEN 2 THEN 'pending' WHEN 3 THEN 'reprocessing' ELSE 'pending' END AS state FROM d""")
def _(t):
    dead = log.dead_letters(attempts(t), 3)
    plans = {0: ["replay", "resolve", "discard"], 1: ["resolve", "discard", "replay"], 2: ["replay", "reject"], 3: ["replay", "discard"]}
    rows = t.spark.createDataFrame([(k, i, c) for k, cs in plans.items() for i, c in enumerate(cs)], "k long, seq int, command string")
    commands = dead.select("event_id", (F.col("event_id") % 5).alias("k")).join(F.broadcast(rows), "k").drop("k")
    return log.fold_dead_letters(dead, commands).select("event_id", "state")


@book("stream_vacuum", f"WITH {_EVENTS}, s AS (SELECT event_id, partition, row_number() OVER (PARTITION BY partition ORDER BY event_id) AS q FROM e) SELECT event_id FROM s WHERE NOT (partition < 4 AND q <= 1000)")
def _(t):
    last = t.spark.range(0, 8).select(F.col("id").cast("int").alias("partition"), F.lit(0).cast("long").alias("last_seq"))
    done = t.spark.range(0, 4).select(F.col("id").cast("int").alias("partition"), F.lit(1000).cast("long").alias("processed_seq"))
    return log.vacuum(log.sequence(events(t), last, ["event_id"]), done).select("event_id")


@book("stream_missing_bodies", "SELECT event_id FROM events WHERE event_id % 11 = 3")
def _(t):
    out = t.events().select("event_id", F.col("event_id").alias("body_id"))
    bodies = t.events().filter("event_id % 11 <> 3").select(F.col("event_id").alias("body_id"), "props")
    return log.join_bodies(out, bodies)[1].select("event_id")


@book("stream_due_queue", "SELECT event_id AS id FROM events WHERE event_id % 2 = 0 AND ts <= TIMESTAMP '2024-01-10' ORDER BY ts, event_id LIMIT 200")
def _(t):
    q = t.events().select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "queued").otherwise("done").alias("state"), F.col("ts").alias("due_at"))
    return log.due_queue(q, F.lit("2024-01-10 00:00:00").cast("timestamp"), 200).select("id")


def queue(t):
    """Rows of a queue, some held until an hour after they became due."""
    held = F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.make_dt_interval(hours=F.lit(1)))
    return t.events().select(F.col("event_id").alias("id"), F.concat(F.lit("p"), (F.col("user_id") % 8).cast("string")).alias("key"), F.when(F.col("event_id") % 2 == 0, "queued").otherwise("done").alias("state"), F.col("ts").alias("due_at"), held.alias("claimed_until"))


@book("stream_claim", "SELECT event_id AS id, 'w1' AS claimed_by, TIMESTAMP '2024-01-10 00:00:30' AS claimed_until FROM events WHERE event_id % 2 = 0 AND ts <= TIMESTAMP '2024-01-10' AND (event_id % 3 <> 0 OR ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-10') ORDER BY ts, event_id LIMIT 200")
def _(t):
    return log.claim(queue(t), F.lit("2024-01-10 00:00:00").cast("timestamp"), 200, "w1", 30).select("id", "claimed_by", "claimed_until")


@book("stream_overdue", "SELECT 'p' || (user_id % 8) AS key, count(*) AS late, min(ts) AS oldest FROM events WHERE event_id % 2 = 0 AND ts <= TIMESTAMP '2024-01-09' GROUP BY ALL")
def _(t):
    return log.overdue(queue(t), F.lit("2024-01-10 00:00:00").cast("timestamp"), 86_400)


def processed(t):
    return logged(t).withColumns({"processed_at": F.col("occurred_at"), "committed": F.col("event_id") % 5 == 0})


@book("stream_commit_transaction", f"WITH {_EVENTS} SELECT topic, partition, max(off) AS \"offset\" FROM l GROUP BY ALL")
def _(t):
    return log.committed_offsets(processed(t), "transaction")


@book("stream_commit_manual", f"WITH {_EVENTS} SELECT topic, partition, max(off) AS \"offset\" FROM l WHERE event_id % 5 = 0 GROUP BY ALL")
def _(t):
    return log.committed_offsets(processed(t), "manual")


@book("stream_commit_auto", f"""WITH {_EVENTS}, s AS (SELECT topic, partition, min(epoch_us(occurred_at)) AS first, max(epoch_us(occurred_at)) AS last FROM l GROUP BY ALL),
k AS (SELECT topic, partition, first, first + (last - first) // 86400000000 * 86400000000 AS tick FROM s)
SELECT topic, partition, max(off) AS "offset" FROM l JOIN k USING (topic, partition) WHERE tick > first AND epoch_us(occurred_at) <= tick GROUP BY ALL""")
def _(t):
    return log.committed_offsets(processed(t), "auto", 86_400)


@book("stream_watch_diff", "SELECT event_id AS key, CASE WHEN event_id % 5 = 0 THEN 'removed' WHEN event_id % 5 = 1 THEN 'added' ELSE 'changed' END AS change FROM events WHERE event_id % 5 < 2 OR event_id % 5 = 2 AND event_id % 3 = 0")
def _(t):
    e = t.events().select(F.col("event_id").alias("key"), "value")
    before = e.filter("key % 5 <> 1")
    after = e.filter("key % 5 <> 0").withColumn("value", F.when((F.col("key") % 5 == 2) & (F.col("key") % 3 == 0), F.col("value") + 1).otherwise(F.col("value")))
    return log.snapshot_diff(before, after)


#: Murmur3 of ASCII keys: whole blocks of four bytes are folded in, then the rest, then the finaliser.
_MURMUR = """WITH k AS (SELECT DISTINCT 't' || user_id AS key FROM events),
b AS (SELECT key, cast(length(key) AS UBIGINT) AS n, list_transform(generate_series(0, (length(key) - 1) // 4), lambda i: list_sum(list_transform(generate_series(0, 3), lambda j: CASE WHEN 4 * i + j < length(key) THEN cast(ord(substr(key, 4 * i + j + 1, 1)) AS BIGINT) * cast(pow(256, j) AS BIGINT) ELSE 0 END))) AS raw FROM k),
m AS (SELECT key, n, list_transform(list_transform(raw, lambda x: (cast(x AS UBIGINT) * 3432918353::UBIGINT) & 4294967295::UBIGINT), lambda x: ((((x << 15) | (x >> 17)) & 4294967295::UBIGINT) * 461845907::UBIGINT) & 4294967295::UBIGINT) AS x FROM b),
f AS (SELECT key, n, x, list_reduce(list_prepend(0::UBIGINT, x[1:cast(n // 4 AS BIGINT)]), lambda h, c: ((((xor(h, c) << 13) | (xor(h, c) >> 19)) & 4294967295::UBIGINT) * 5::UBIGINT + 3864292196::UBIGINT) & 4294967295::UBIGINT) AS h FROM m),
g AS (SELECT key, xor(CASE WHEN n % 4 > 0 THEN xor(h, x[cast(n // 4 + 1 AS BIGINT)]) ELSE h END, n) AS h FROM f),
u AS (SELECT key, (xor(h, h >> 16) * 2246822507::UBIGINT) & 4294967295::UBIGINT AS h FROM g),
v AS (SELECT key, (xor(h, h >> 13) * 3266489909::UBIGINT) & 4294967295::UBIGINT AS h FROM u)
SELECT event_id, cast((xor(h, h >> 16) & 2147483647::UBIGINT) % 16 AS INTEGER) AS partition FROM events JOIN v ON key = 't' || user_id"""


@book("stream_partition_of_key", _MURMUR)
def _(t):
    return t.events().select("event_id", partition_of(F.concat(F.lit("t"), "user_id"), 16).alias("partition"))


@book("stream_token_bucket", """WITH RECURSIVE p AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT event_id, user_id, us, i, cast(2 AS DOUBLE) AS level, true AS admitted FROM p WHERE i = 1 UNION ALL
 SELECT event_id, user_id, us, i, l - CASE WHEN l >= 1 THEN 1 ELSE 0 END, l >= 1 FROM (SELECT p.event_id, p.user_id, p.us, p.i, least(3.0::DOUBLE, w.level + ((p.us - w.us) / 1000000.0::DOUBLE) * (1.0::DOUBLE / 7200.0::DOUBLE)) AS l FROM w JOIN p ON p.user_id = w.user_id AND p.i = w.i + 1))
SELECT event_id, admitted FROM w""")
def _(t):
    return log.token_bucket(t.events().select("event_id", "user_id", "ts"), "user_id", "ts", 1 / 7200, 3.0, ("event_id",)).select("event_id", "admitted")


@book("stream_backoff", "SELECT event_id, cast(least(100 * pow(2, greatest(event_id % 12 - 1, 0)), 30000) AS BIGINT) AS wait_ms FROM events")
def _(t):
    return t.events().select("event_id", backoff(F.col("event_id") % 12, 100, 30000).alias("wait_ms"))


@book("stream_stats", "SELECT event_type, cast(round(avg(cast(round(value * 100) AS BIGINT)), 3) AS DOUBLE) AS avg_minor, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    m = F.round(F.col("value") * 100).cast("long")
    return t.events().groupBy("event_type").agg(F.round(F.avg(m), 3).alias("avg_minor"), F.count("*").alias("n"))


@book("stream_outbox", "SELECT event_id, user_id % 4 AS partition, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) + CASE WHEN user_id % 4 = 2 THEN 70 ELSE 0 END AS sequence FROM events")
def _(t):
    # The key's checksum is undone here, so that SQL can tell the partition: keys are chosen to have the user's remainder.
    users = t.events().select("user_id").distinct()
    tries = users.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(199)))).withColumn("key", F.concat_ws("-", "user_id", "i"))
    fits = tries.filter("pmod(crc32(cast(key AS binary)), 4) = user_id % 4").groupBy("user_id").agg(F.min("key").alias("key"))
    last = t.spark.range(2, 3).select(F.col("id").cast("int").alias("partition"), F.lit(70).cast("long").alias("last_seq"))
    queued = outbox.enqueue(t.events().select("event_id", "user_id").join(fits, "user_id"), 4, last, ["event_id"])
    return queued.select("event_id", F.col("partition").cast("long").alias("partition"), "sequence")


@book("stream_payloads", """SELECT event_id, CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'type_unknown' WHEN event_type = 'click' AND user_id % 3 = 0 THEN 'subject_type' WHEN event_type = 'error' AND event_id % 7 < 3 THEN 'payload' END AS fault FROM events""")
def _(t):
    field = "array<struct<name:string,kind:string,required:boolean>>"
    k, none = [("k", "number", True)], []
    types = t.spark.createDataFrame([("a", "click", ["user"], k), ("a", "view", none, k), ("a", "purchase", none, k), ("a", "error", none, k)], f"topic string, type_id string, allowed array<string>, fields {field}")
    n = F.col("event_id") % 7
    data = F.when(F.col("event_type") != "error", F.col("props")).when(n == 0, "{}").when(n == 1, '{"k": "x"}').when(n == 2, "[1]").when(n > 3, F.col("props"))
    topic = F.when((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 1), "free").otherwise("a")
    e = t.events().select("event_id", topic.alias("topic"), F.col("event_type").alias("type_id"), F.when(F.col("user_id") % 3 == 0, "host").otherwise("user").alias("subject_type"), data.alias("data"))
    return outbox.payload_faults(e, types).select("event_id", "fault")


@book("stream_chained", """WITH p AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sequence FROM events), f AS (SELECT user_id, min(sequence) AS bad FROM p WHERE event_id % 997 = 500 GROUP BY user_id),
s AS (SELECT p.event_id, p.user_id, sequence, 0 AS again FROM p UNION ALL SELECT event_id, user_id, sequence, 1 FROM p WHERE event_id % 5 = 0)
SELECT s.event_id, again, CASE WHEN sequence >= coalesce(bad, sequence + 1) THEN 'violation' WHEN again = 1 THEN 'duplicate' ELSE 'accepted' END AS outcome FROM s LEFT JOIN f ON s.user_id = f.user_id""")
def _(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    p = t.events().select("event_id", "user_id", (F.row_number().over(w) - 1).alias("sequence"))
    p = p.withColumn("previous", F.when(F.col("event_id") % 997 == 500, -7).otherwise(F.col("sequence") - 1))
    sent = p.withColumn("again", F.lit(0)).unionByName(p.filter("event_id % 5 = 0").withColumn("again", F.lit(1)))
    return outbox.chained(sent, ["user_id"], ["event_id", "again"]).select("event_id", "again", "outcome")
