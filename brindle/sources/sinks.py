"""Writers: audit rows as CSV, conversations as JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import safe_cell


def audit_rows(entries: DataFrame, lines: DataFrame, matching: DataFrame) -> DataFrame:
    """Matching entries with all of their lines (one row for an entry without), text cells made safe for spreadsheets."""
    extra = [c for c in lines.columns if c not in entries.columns]
    rows = entries.join(matching.select("entry_id"), "entry_id", "left_semi").join(lines.select("entry_id", *extra), "entry_id", "left")
    text = {f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"}
    return rows.select(*[safe_cell(F.col(c)).alias(c) if c in text else F.col(c) for c in rows.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted as RFC 4180 asks: fields in quotes where needed, quotes doubled."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def conversations(messages: DataFrame, include_hidden: bool = False) -> DataFrame:
    """(session_id, n_messages, json, markdown) of every session, messages in order."""
    rows = messages if include_hidden else messages.filter("NOT hidden")
    one = F.array_sort(F.collect_list(F.struct("turn", "message_id", "role", "content")))
    listed = rows.groupBy("session_id").agg(one.alias("m"))
    mark = F.array_join(F.transform("m", lambda m: F.concat(F.lit("**"), F.initcap(m["role"]), F.lit("**\n\n"), m["content"])), "\n\n---\n\n")
    return listed.select("session_id", F.size("m").cast("long").alias("n_messages"), F.to_json(F.struct(F.col("session_id"), F.col("m").alias("messages"))).alias("json"), mark.alias("markdown"))
