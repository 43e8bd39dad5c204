"""Conversations: trees of messages, search, context, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import search_term, snippet
from brindle.operators.durable import durable


def search(messages: DataFrame, term: str, radius: int = 60) -> DataFrame:
    """Visible messages that contain the term, in any case, newest first, with a snippet and rank 0."""
    wanted = search_term(F.lit(term))
    hit = F.contains(F.lower("content"), F.lower(wanted)) & (F.char_length(wanted) > 0)
    rows = messages.filter(~F.col("hidden") & hit)
    return rows.select("message_id", "session_id", "turn", "created_at", snippet(F.col("content"), wanted, radius).alias("snippet"), F.lit(0.0).alias("rank")).orderBy(F.col("created_at").desc(), F.col("message_id").desc())


def context(messages: DataFrame, hits: DataFrame, radius: int = 1) -> DataFrame:
    """Each hit with the ids of up to ``radius`` visible messages before and after it."""
    w = Window.partitionBy("session_id").orderBy("turn")
    around = lambda a, b: F.collect_list("message_id").over(w.rowsBetween(a, b))
    rows = messages.filter("NOT hidden").withColumns({"before": around(-radius, -1), "after": around(1, radius)})
    return rows.join(hits.select("message_id"), "message_id", "left_semi").select("message_id", "before", "after")


def chain(messages: DataFrame, starts: DataFrame, guard: int = 10_000, levels: int | None = None) -> DataFrame:
    """(start_id, message_id, distance) from each start up its parents, at most ``guard`` steps."""
    up = messages.select(F.col("message_id").alias("__id"), F.col("parent_id").alias("__up"))
    level = starts.select(F.col("message_id").alias("start_id"), F.col("message_id"), F.lit(0).alias("distance"))
    out = level
    for step in range(1, (levels if levels is not None else guard) + 1):
        level = level.join(up, F.col("message_id") == F.col("__id")).filter("__up IS NOT NULL").select("start_id", F.col("__up").alias("message_id"), F.lit(step).alias("distance"))
        if levels is None:
            level = durable(level)
            if level.isEmpty():
                break
        out = out.unionByName(level)
    return out


def descendants(messages: DataFrame, starts: DataFrame, levels: int | None = None) -> DataFrame:
    """(start_id, message_id, distance) of all messages below each start, within its session; without ``levels`` the
    walk goes on until a level is empty."""
    down = messages.select(F.col("session_id").alias("__s"), F.col("parent_id").alias("__up"), F.col("message_id").alias("__id"))
    level = starts.select(F.col("message_id").alias("start_id"), "session_id", "message_id", F.lit(0).alias("distance"))
    out = level.filter(F.lit(False))
    step = 0
    while levels is None or step < levels:
        step += 1
        found = level.join(down, (F.col("session_id") == F.col("__s")) & (F.col("message_id") == F.col("__up")))
        level = found.select("start_id", "session_id", F.col("__id").alias("message_id"), F.lit(step).alias("distance"))
        if levels is None:
            level = durable(level)
            if level.isEmpty():
                break
        out = out.unionByName(level)
    return out.drop("session_id")


def siblings(messages: DataFrame) -> DataFrame:
    """Variants of one parent with their index and number."""
    w = Window.partitionBy("session_id", "parent_id")
    return messages.withColumns({"variant": F.row_number().over(w.orderBy("created_at", "message_id")) - 1, "n_variants": F.count("*").over(w)})


def activate(messages: DataFrame, on: DataFrame, off: DataFrame) -> DataFrame:
    """Active flags after a path switch; an id in both lists becomes active."""
    a, b = on.select("message_id", F.lit(True).alias("__on")).distinct(), off.select("message_id", F.lit(True).alias("__off")).distinct()
    return messages.join(a, "message_id", "left").join(b, "message_id", "left").withColumn("is_active", F.when(F.col("__on"), True).when(F.col("__off"), False).otherwise(F.col("is_active"))).drop("__on", "__off")


def latest(messages: DataFrame, keys: list[str], at: str = "created_at", tie: str = "message_id") -> DataFrame:
    """The newest row of each key."""
    return messages.groupBy(*keys).agg(F.max_by(F.struct(*messages.columns), F.struct(at, tie)).alias("r")).select("r.*")


def recent(messages: DataFrame, n: int) -> DataFrame:
    """The newest n messages of each session, oldest first within it."""
    w = Window.partitionBy("session_id").orderBy(F.col("created_at").desc(), F.col("message_id").desc())
    return messages.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r").orderBy("session_id", "created_at", "message_id")


def after_base(messages: DataFrame, base: tuple[Column, Column], target: tuple[Column, Column]) -> DataFrame:
    """Messages in (base, target] by (created_at, message_id)."""
    at, key = F.col("created_at"), F.col("message_id")
    later = (at > base[0]) | ((at == base[0]) & (key > base[1]))
    upto = (at < target[0]) | ((at == target[0]) & (key <= target[1]))
    return messages.filter(later & upto)


def quota_usage(deltas: DataFrame) -> DataFrame:
    """Counters by tenant, user, period and bucket; tokens count on the bucket ``total`` alone."""
    tokens = F.sum(F.when(F.col("bucket") == "total", F.col("tokens")).otherwise(0))
    return deltas.groupBy("tenant_id", "user_id", "period_type", "period_start", "bucket").agg(F.sum("spent_credits").alias("spent_credits"), F.sum("reserved_credits").alias("reserved_credits"), F.count("*").alias("calls"), tokens.alias("tokens"))


def attach(messages: DataFrame, links: DataFrame, attachments: DataFrame) -> DataFrame:
    """Live attachments of messages, in order."""
    live = attachments.filter("deleted_at IS NULL")
    return messages.select("message_id").join(links, "message_id").join(live, "attachment_id").orderBy("message_id", "attachment_id")


def unreferenced(attachments: DataFrame, links: DataFrame) -> DataFrame:
    return attachments.join(links, "attachment_id", "left_anti")


def reactions_of(reactions: DataFrame, users: DataFrame) -> DataFrame:
    """The last reaction of each of the users to each message; one that was taken back is not there."""
    rows = reactions.join(users.select("user_id").distinct(), "user_id", "left_semi")
    # Within a struct a null is a value, so that the last reaction counts also where it was taken back.
    last = rows.groupBy("user_id", "message_id").agg(F.max_by(F.struct("reaction"), "reacted_at")["reaction"].alias("reaction"))
    return last.filter("reaction IS NOT NULL")


def cite(citations: DataFrame, files: DataFrame) -> DataFrame:
    """Citations by provider file with the attachment that the file belongs to; unknown files keep a null."""
    return citations.join(files.select("file_id", "attachment_id"), "file_id", "left")


def retrieval_mode(disabled: Column, ready_documents: Column) -> Column:
    """none while search is switched off or the chat has no document that is ready, else the whole chat."""
    return F.when(disabled | (F.coalesce(ready_documents, F.lit(0)) == 0), "none").otherwise("unrestricted")


def storage_used(attachments: DataFrame) -> DataFrame:
    """Bytes of attachments that are neither failed nor deleted, 0 without any."""
    live = attachments.filter("status <> 'failed' AND deleted_at IS NULL")
    return live.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("used_bytes"))
