"""The same operators on Structured Streaming: keyed producer state, idempotent sinks and dead letters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType


def read_log(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, a bounded number of files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def producer_outcomes(stream: DataFrame, mode: str, arrival: str = "arrival") -> DataFrame:
    """``outcome`` of every event by its producer's state: ``monotonic`` (a sequence at or below the last is a
    duplicate) or ``chained`` (besides, ``previous`` must be the last sequence, else it is a violation).

    Only accepted events move the state.  Events of a producer within one batch are taken in arrival order.
    """
    if mode not in ("monotonic", "chained"):
        raise ValueError(mode)
    out = StructType([*stream.schema.fields, StructField("outcome", StringType())])
    names = stream.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(arrival)
        outcomes = []
        for r in rows.itertuples():
            if last is not None and r.sequence <= last:
                outcomes.append("duplicate")
            elif mode == "chained" and last is not None and r.previous != last:
                outcomes.append("violation")
            else:
                outcomes.append("accepted")
                last = int(r.sequence)
        if last is not None:
            state.update((last,))
        yield rows[names].assign(outcome=outcomes)

    return stream.groupBy("topic", "partition", "producer_id").applyInPandasWithState(step, out, StructType([StructField("last", LongType())]), "append", GroupStateTimeout.NoTimeout)


def distinct_events(stream: DataFrame, key: str = "event_id", at: str = "occurred_at", late: str = "1 hour") -> DataFrame:
    """Stateless producers: drop repeated ids that come within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def process(stream: DataFrame, handler: Callable[[DataFrame], DataFrame], out: str, dead: str, checkpoint: str, **trigger: Any):
    """Run a handler that adds ``result`` (success, retry or reject) and ``error`` to a batch; accepted rows and dead
    letters are written by batch number, so a batch that is run again replaces what it wrote."""

    def batch(df: DataFrame, number: int) -> None:
        done = handler(df).persist()
        try:
            done.filter("result = 'success'").drop("result", "error").write.mode("overwrite").parquet(f"{out}/batch={number}")
            done.filter("result <> 'success'").withColumn("state", F.lit("pending")).write.mode("overwrite").parquet(f"{dead}/batch={number}")
        finally:
            done.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def publish_batch(spark: SparkSession, events: DataFrame, path: str) -> None:
    """Append events of one topic and partition as one file; several are refused before anything is written."""
    targets = events.select("topic", "partition").distinct().limit(2).count()
    if targets > 1:
        raise ValueError("a batch goes to one topic and partition")
    events.coalesce(1).write.mode("append").parquet(path)
