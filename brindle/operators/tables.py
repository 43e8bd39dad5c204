"""Table operators that several services share: upserts, set operations, related rows, layered settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_latest(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest version of each key."""
    rows = current.unionByName(changes)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), version).alias("r")).select("r.*")


def upsert_add(current: DataFrame, deltas: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    return current.unionByName(deltas).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def insert_absent(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is new."""
    return rows.join(current.select(*keys), keys, "left_anti")


def compare_and_set(current: DataFrame, changes: DataFrame, key: str, expected: str, actual: str, value: str) -> DataFrame:
    """Values after updates that name the version they saw; ``applied`` tells which went through."""
    rows = current.join(changes.select(key, F.col(expected).alias("__e"), F.col(value).alias("__v")), key, "left")
    ok = F.col("__e").isNotNull() & F.col("__e").eqNullSafe(F.col(actual))
    return rows.withColumns({value: F.when(ok, F.col("__v")).otherwise(F.col(value)), actual: F.when(ok, F.col(actual) + 1).otherwise(F.col(actual)), "applied": ok}).drop("__e", "__v")


def merge_by_id(parts: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """One table from several, a row per id, sorted."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates([key]).orderBy(*order)


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti")


def related(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Each parent with its children as a sorted array, empty without any."""
    extra = [c for c in children.columns if c != key]
    listed = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*extra))).alias("children"))
    return parents.join(listed, key, "left").withColumn("children", F.coalesce("children", F.array().cast(listed.schema["children"].dataType)))


def not_listed(rows: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose tuple of keys, nulls being equal, is not listed; tuples of nulls alone are left out."""
    some = F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull()
    same = F.lit(True)
    other = listed.select(*[F.col(k).alias(f"__{k}") for k in keys])
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.filter(some).join(other, same, "left_anti")


def patch(current: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fields that a change names replace the old ones; nulls keep them."""
    other = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return current.join(other, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def expire(rows: DataFrame, now: Column, active: tuple[str, ...] = ("PENDING", "ACTIVE")) -> DataFrame:
    """Live rows past their time become EXPIRED."""
    return rows.withColumn("status", F.when(F.col("status").isin(*active) & (F.col("expires_at") <= now), "EXPIRED").otherwise(F.col("status")))


def layered(layers: DataFrame) -> DataFrame:
    """Settings of each start merged from the root (greatest depth) to the leaf (depth 0).

    sharing by layer: private values count on their own tenant alone, inherit gives a value that lower layers may
    replace, enforce fixes it for all below.  Rate limits take the least of what is set; tags are united.
    """
    rows = layers.filter("depth = 0 OR sharing <> 'private'")
    seen = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("o"), "sharing", "value", "rate", "tags")))
    one = rows.groupBy("start_id").agg(seen.alias("l"))
    start = F.struct(F.lit(None).cast("string").alias("value"), F.lit(False).alias("fixed"))
    value = F.aggregate("l", start, lambda a, x: F.struct(
        F.when(a["fixed"] | x["value"].isNull(), a["value"]).otherwise(x["value"]).alias("value"), (a["fixed"] | ((x["sharing"] == "enforce") & x["value"].isNotNull())).alias("fixed")))
    return one.select(
        "start_id", value["value"].alias("value"), F.array_min(F.transform("l", lambda x: x["rate"])).alias("rate"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("l", lambda x: F.coalesce(x["tags"], F.array().cast("array<string>")))))).alias("tags"),
    )


def latest_keys(log: DataFrame, now: Column) -> DataFrame:
    """A versioned key-value table from its change log: the newest version of a key, unless deleted or past its time."""
    w = Window.partitionBy("key").orderBy(F.col("version").desc())
    return log.withColumn("__r", F.row_number().over(w)).filter((F.col("__r") == 1) & ~F.col("deleted") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))).drop("__r")


def scan_prefix(table: DataFrame, prefix: str) -> DataFrame:
    return table.filter(F.startswith("key", F.lit(prefix))).select("key")
