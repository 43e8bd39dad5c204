"""Versioned rows: next numbers, upserts that count revisions, existence tests, queues of exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_version(asked: DataFrame, rows: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Each asked key with the version that its next row takes: one more than the greatest, 0 for a new key."""
    most = rows.groupBy(*keys).agg(F.max(version).alias("__most"))
    return asked.select(*keys).distinct().join(most, keys, "left").select(*keys, F.coalesce(F.col("__most") + 1, F.lit(0)).alias("next_version"))


def upsert_bumped(current: DataFrame, changes: DataFrame, keys: list[str], order: str, version: str = "version") -> DataFrame:
    """``current`` after its changes: a key has the values of its last change, and its version rises by one a change;
    the first row of a new key has version 0."""
    values = [c for c in current.columns if c not in (*keys, version)]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("__v"), F.count("*").alias("__n"))
    both = current.withColumn("__old", F.struct(*values)).select(*keys, F.col(version).alias("__version"), "__old").join(last, keys, "full_outer")
    chosen = F.coalesce("__v", "__old")
    number = F.coalesce(F.col("__version") + F.coalesce("__n", F.lit(0)), F.col("__n") - 1)
    return both.select(*keys, *[chosen[c].alias(c) for c in values], number.alias(version))


def exists_for(asked: DataFrame, rows: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """``asked`` with ``found``: whether a row with the same keys meets the condition."""
    hit = rows.filter(condition).select(*keys).distinct().withColumn("__hit", F.lit(True))
    return asked.join(hit, keys, "left").withColumn("found", F.coalesce("__hit", F.lit(False))).drop("__hit")


def resolve_exceptions(queue: DataFrame, resolutions: DataFrame, key: str = "exception_id") -> DataFrame:
    """The queue after its resolutions: open entries that are named get the first resolution's state and actor;
    closed entries stay as they are."""
    first = resolutions.groupBy(key).agg(F.min_by(F.struct("outcome", "actor"), "resolved_at").alias("__r"))
    acts = (F.col("state") == "OPEN") & F.col("__r").isNotNull()
    out = queue.join(first, key, "left")
    return out.select(
        *[F.col(c) for c in queue.columns if c not in ("state", "resolved_by")],
        F.when(acts, F.col("__r.outcome")).otherwise(F.col("state")).alias("state"), F.when(acts, F.col("__r.actor")).otherwise(F.col("resolved_by")).alias("resolved_by"),
    )
