"""The client's view of an answer that is being written: plugin events as numbered changes of a message document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Event types on the wire and operations on the document.
START, PART, TEXT = "message.start", "message.part.add", "message.text.delta"
CITATIONS = {"file_citations": "message.file_citation.add", "link_citations": "message.link_citation.add", "references": "message.reference.add"}
OTHERS = {"status": "message.status.changed", "error": "message.error"}
COMPLETE = "message.complete"


def project(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Wire events (seq, type, op, path, value) of each message, with the keys and the order of their source.

    ``events`` has kind (start, chunk, part, citation, status, complete, error), value, part_number and an array of
    strings for each list of ``CITATIONS``.  The first chunk opens the text part; parts are numbered in arrival order.
    Citations name their part, those of a complete event go to the text part (0 without one); empty and null lists give
    no event, and neither does another kind.  Everything is windows over one sort by key and order.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chunk = F.col("kind") == "chunk"
    rows = events.withColumn("__opens", chunk & (F.count_if(chunk).over(w) == 1))
    rows = rows.withColumn("__part", F.count_if(F.col("__opens") | (F.col("kind") == "part")).over(w) - 1)
    rows = rows.withColumn("__text", F.max(F.when(F.col("__opens"), F.col("__part"))).over(w))

    def out(type_: str, op: str | None, path: Column | None, value: Column | None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(type_).alias("type"), F.lit(op).cast("string").alias("op"), (none if path is None else path).alias("path"), (none if value is None else value).alias("value"))

    def at(n: Column, *rest: str) -> Column:
        return F.concat_ws("/", F.lit("parts"), n.cast("string"), *map(F.lit, rest))

    def cited(n: Column) -> Column:
        lists = F.array(*[F.when(F.size(name) > 0, out(type_, "append", at(n, name), F.to_json(name))) for name, type_ in CITATIONS.items()])
        return F.filter(lists, lambda x: x.isNotNull())

    opened = F.array(out(PART, "add", at(F.col("__part")), F.lit("")))
    text = F.array(out(TEXT, "append", at(F.col("__text"), "content", "text"), F.col("value")))
    made = (
        F.when(F.col("kind") == "start", F.array(out(START, None, None, None))).when(F.col("__opens"), F.concat(opened, text)).when(chunk, text)
        .when(F.col("kind") == "part", F.array(out(PART, "add", at(F.col("__part")), F.col("value")))).when(F.col("kind") == "citation", cited(F.col("part_number")))
        .when(F.col("kind") == "complete", F.concat(cited(F.coalesce("__text", F.lit(0))), F.array(out(COMPLETE, "stop", None, F.col("value")))))
    )
    for kind, type_ in OTHERS.items():
        made = made.when(F.col("kind") == kind, F.array(out(type_, None, None, F.col("value"))))
    wire = rows.select(*keys, order, F.posexplode(made).alias("__i", "__e"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "__i")) - 1
    return wire.withColumn("seq", number).select(*keys, order, "seq", "__e.*")
