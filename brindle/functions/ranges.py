"""Byte ranges of stored objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPEC = r"^\s*bytes=\s*(\d*)\s*-\s*(\d*)\s*$"


def byte_range(header: Column, size: Column) -> Column:
    """(status, first, last) of a request for an object of ``size`` bytes.

    ``first-last``, ``first-`` and ``-suffix`` are understood; an absent or other header, several ranges included, asks
    for the whole object (200).  A range past the end, an empty suffix or first > last cannot be met (416, nulls); the
    last byte is cut to the object's.
    """
    a, b = (F.nullif(F.regexp_extract(header, _SPEC, k), F.lit("")).try_cast("long") for k in (1, 2))
    known = F.coalesce(header.rlike(_SPEC), F.lit(False)) & (a.isNotNull() | b.isNotNull())
    first = F.when(a.isNull(), F.greatest(F.lit(0), size - b)).otherwise(a)
    last = F.when(a.isNull() | b.isNull(), size - 1).otherwise(F.least(b, size - 1))
    met = (first < size) & (last >= first) & ~(a.isNull() & (b == 0)) & ~(a.isNotNull() & b.isNotNull() & (b < a))
    whole = F.struct(F.lit(200).alias("status"), F.lit(0).cast("long").alias("first"), (size - 1).cast("long").alias("last"))
    part = F.struct(F.lit(206).alias("status"), first.cast("long").alias("first"), last.cast("long").alias("last"))
    none = F.struct(F.lit(416).alias("status"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    return F.when(~known, whole).when(met, part).otherwise(none)


def read_range(content: Column, span: Column) -> Column:
    """The bytes that a range names, null where it cannot be met."""
    return F.when(span["status"] != 416, F.substring(content, span["first"].cast("int") + 1, (span["last"] - span["first"] + 1).cast("int")))
