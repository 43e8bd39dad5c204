"""What a producer's side does: queueing, payload checks, chained sequences and batch sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.streaming.log import sequence


def enqueue(messages: DataFrame, partitions: int, last: DataFrame, order: list[str], key: str = "key") -> DataFrame:
    """Messages with the queue partition of their key and the next sequence number there; ``last`` has the last number
    of each partition that has any."""
    placed = messages.withColumn("partition", F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(partitions)).cast("int"))
    return sequence(placed, last, order)


def payload_faults(events: DataFrame, types: DataFrame) -> DataFrame:
    """``events`` with ``fault``: type_unknown, subject_type, payload, or null.

    ``types`` has topic, type_id, allowed (an array of subject types, empty for any) and fields (an array of name, kind
    and required; kinds: number, string, boolean, any).  A topic without registered types takes every event.  A payload
    that is null is not checked; one that is not a JSON object, lacks a required field, or has one of another kind, fails.
    """
    known = types.groupBy("topic").agg(F.count("*").alias("__types"))
    rows = events.join(types.select("topic", "type_id", "allowed", "fields"), ["topic", "type_id"], "left").join(known, "topic", "left")
    data = F.from_json("data", "map<string,string>")
    kinds = {"number": lambda v: v.try_cast("double").isNotNull(), "boolean": lambda v: v.isin("true", "false")}

    def wrong(f):
        v = F.get(F.map_values(F.map_filter(F.col("__data"), lambda k, _: k == f["name"])), F.lit(0))
        bad = F.lit(False)
        for kind, fits in kinds.items():
            bad = bad | ((f["kind"] == kind) & v.isNotNull() & ~fits(v))
        return (f["required"] & v.isNull()) | bad

    fault = (
        F.when(F.col("allowed").isNull(), F.when(F.col("__types").isNotNull(), "type_unknown"))
        .when((F.size("allowed") > 0) & ~F.coalesce(F.array_contains("allowed", F.col("subject_type")), F.lit(False)), "subject_type")
        .when(F.col("data").isNotNull() & (F.col("__data").isNull() | F.exists("fields", wrong)), "payload")
    )
    return rows.withColumn("__data", data).withColumn("fault", fault).drop("__data", "__types", "allowed", "fields")


def _walk(rows: DataFrame, keys: list[str], order: list[str], begin: Callable, step: Callable, column: str, kind: str) -> DataFrame:
    """``rows`` with a column from a fold over each key's rows in order.  Every step depends on the one before, so a
    key's rows are walked within one task, fed sorted and in batches; nothing but the fold's state is held."""
    schema = StructType([*rows.schema.fields]).add(column, kind)
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        current, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                key = tuple(row[k] for k in keys)
                if key != current:
                    current, state = key, begin()
                state, value = step(state, row)
                out.append(value)
            yield pdf.assign(**{column: out})

    return ordered.mapInPandas(run, schema)


def chained(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``accepted``, ``duplicate`` (a sequence at or below the last accepted one) or ``violation`` (``previous`` is not
    the last accepted one, -1 at first); only an accepted event moves the last sequence."""

    def step(last, row):
        if row["sequence"] <= last:
            return last, "duplicate"
        return (row["sequence"], "accepted") if row["previous"] == last else (last, "violation")

    return _walk(events, keys, order, lambda: -1, step, "outcome", "string")


def batch_sizes(results: DataFrame, keys: list[str], order: list[str], full: int, threshold: int) -> DataFrame:
    """The batch size after each result (success, retry, reject; ``processed`` is null where it is not known).

    A retry that is at least the ``threshold``-th in a row, and any reject, bring the size down to what was processed,
    1 at least; each success after that doubles it up to ``full``.
    """

    def step(state, row):
        size, failures = state
        done = row["processed"]
        low = 1 if done is None or done != done else max(1, int(done))
        match row["result"]:
            case "success":
                size, failures = min(full, size * 2), 0
            case "retry":
                failures += 1
                size = low if failures >= threshold else size
            case "reject":
                size, failures = low, 0
        return (size, failures), size

    return _walk(results, keys, order, lambda: (full, 0), step, "batch_size", "integer")
