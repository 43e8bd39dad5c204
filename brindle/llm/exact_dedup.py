"""Exact duplicates by skew-safe combining, all in DataFrame operations.

Texts are equal when identical after deleting ASCII white space (0x20, 0x09-0x0D).  Copies meet in three
rounds, and every round groups by the digest *and* the whole normalised text:

1. locally: the map-side half of the first aggregation folds the copies of one input partition into one row;
2. salted: the reduce-side half merges the rows of one (digest, salt), the salt being the input partition
   modulo ``salts``, so a text that fills a third of the table is spread over ``salts`` reducers;
3. globally: the salt winners of a digest, at most ``salts`` a text, are merged.

Rows find their winner by digest alone only where round 3 proved that the digest stands for one text;
any other digest (a collision) is looked up by content.  That last join is salted too: the winner of a large group is
repeated, and the group's rows are dealt over its copies (``skew``).

Null text counts as empty; empty texts are equal to each other.  Ties in length go to the smallest doc_id,
a null doc_id last.  Rows that share the winner's doc_id are all kept only where they also share its original text's
length; a shorter one is dropped in favour of the row with its own doc_id.  An empty table gives an empty result.
Texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import read_table, stage, text_or_empty
from brindle.llm.skew import attach

WHITE = " \t\n\x0b\x0c\r"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(docs: DataFrame, salts: int = 16, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    text = text_or_empty()
    norm = F.translate(text, WHITE, "")
    rows = docs.select("doc_id", norm.alias("norm"), F.char_length(text).alias("n")).withColumn("key", digest(F.col("norm")))
    # Of (length, ~doc_id) the largest is the longest text with the smallest id; ~ cannot overflow.
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("key", "salt", "norm")
        .agg(F.max(F.struct("n", F.bitwise_not("doc_id").alias("inv"))).alias("best"), F.count("*").alias("size"))
    )
    merged = salted.groupBy("key", "norm").agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    winners = stage(
        merged.select("key", F.bitwise_not("best.inv").alias("keep_id"), F.col("best.n").alias("keep_n"), F.col("size").alias("group_size")),
        "exact-winners",
    )
    shared = winners.groupBy("key").count().filter("count > 1").select("key")
    light = docs.select("doc_id", F.char_length(text).alias("n"), digest(norm).alias("key"), F.sha2(norm, 256).alias("text_sha256"))
    if shared.isEmpty():
        out = attach(light, winners, ["key"], "group_size")
    else:
        found = F.bitwise_not("best.inv").alias("keep_id"), F.col("best.n").alias("keep_n"), F.col("size").alias("group_size")
        several = stage(merged.join(shared, "key", "left_semi").select("key", "norm", *found), "exact-collisions")
        by_text = attach(rows.select("doc_id", "n", "key", "norm"), several, ["key", "norm"], "group_size")
        alone = attach(light, stage(winners.join(shared, "key", "left_anti"), "exact-alone"), ["key"], "group_size")
        columns = ["doc_id", "n", "keep_id", "keep_n", "group_size", "text_sha256"]
        out = alone.select(columns).unionByName(by_text.withColumn("text_sha256", F.sha2("norm", 256)).select(columns))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, {'a': -n, 'b': doc_id}) AS keep_id FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
