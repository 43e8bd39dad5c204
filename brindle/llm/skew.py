"""Joining a table of keys to many rows where one key may hold a third of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is hot; its rows are spread over tasks of about as many.
HOT_ROWS = 10_000
#: So many hot keys are broadcast; beyond that every row is salted.
BROADCAST_KEYS = 1_000_000
SALTS = 64


def attach(rows: DataFrame, table: DataFrame, keys: list[str], size: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key, on ``keys`` without nulls.

    ``size``, a column of ``table``, is the number of rows with that key, at least roughly.  A hot key's row is
    repeated size / HOT_ROWS times and its rows are dealt over these copies.  ``table`` is read more than once, so it
    should be staged; ``total``, where known, is the number of rows: without a hot key the join is a plain one.
    """
    if total is not None and total <= HOT_ROWS:
        return rows.join(table, keys, how)
    hot = table.filter(F.col(size) > HOT_ROWS).select(*keys, F.ceil(F.col(size) / HOT_ROWS).cast("int").alias("__salts"))
    n_hot = hot.count()
    if not n_hot:
        return rows.join(table, keys, how)
    # Rows that are equal in all columns still differ by their partition.
    mixed = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns], F.spark_partition_id())
    if n_hot <= BROADCAST_KEYS:
        marked = rows.join(F.broadcast(hot), keys, "left")
        salted = marked.withColumn("__salt", F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(mixed, F.col("__salts")).cast("int"))).drop("__salts")
        copies = F.when(F.col(size) > HOT_ROWS, F.ceil(F.col(size) / HOT_ROWS).cast("int")).otherwise(1)
    else:
        salted, copies = rows.withColumn("__salt", F.pmod(mixed, F.lit(SALTS)).cast("int")), F.lit(SALTS)
    spread = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return salted.join(spread, [*keys, "__salt"], how).drop("__salt")
