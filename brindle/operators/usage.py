"""Usage metering: ingest with idempotency, validation, grouped aggregation, deactivation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.plans.schema import Resource, ResourceField
from brindle.plans.syntax import Compare, Field, Node, QueryError, conjuncts

RECORDS = Resource(
    "usage_records",
    {
        "id": ResourceField("id", "string"), "tenant_id": ResourceField("tenant_id", "string"), "gts_id": ResourceField("gts_id", "string"), "created_at": ResourceField("created_at", "datetime"),
        "resource_id": ResourceField("resource_id", "string"), "resource_type": ResourceField("resource_type", "string"), "subject_id": ResourceField("subject_id", "string", True),
        "subject_type": ResourceField("subject_type", "string", True), "status": ResourceField("status", "string"),
    },
    tiebreak=("id", "asc"), functions=(), kinds=("string", "i64", "f64", "bool", "uuid", "datetime", "decimal"), maps={"metadata": "metadata"},
)
TYPES = Resource("usage_types", {"gts_id": ResourceField("gts_id", "string"), "kind": ResourceField("kind", "string")}, tiebreak=("gts_id", "asc"), functions=())
ALLOWED = {"counter": ("SUM", "COUNT"), "gauge": ("COUNT", "MIN", "MAX", "AVG")}
DIMENSIONS = ("tenant_id", "resource_id", "resource_type", "subject_id", "subject_type")
IDENTITY = ["tenant_id", "gts_id", "idempotency_key", "created_at"]
CANONICAL = ["id", "tenant_id", "gts_id", "value", "resource_id", "resource_type", "subject_id", "subject_type", "idempotency_key", "corrects_id", "metadata"]
MAX_BUCKETS, MAX_METADATA = 10_000, 8192


def check_window(node: Node | None) -> None:
    """The top-level conjuncts must bound created_at from below and from above."""
    ops = {n.op for n in conjuncts(node) if isinstance(n, Compare) and isinstance(n.left, Field) and n.left.name.lower() == "created_at"}
    if not (ops & {"gt", "ge", "eq"} and ops & {"lt", "le", "eq"}):
        raise QueryError("unbounded_window")


@dataclass(frozen=True)
class Spec:
    """What to aggregate: the type, its kind, the operation, and dimensions (``metadata/<key>`` for a metadata key).

    ``max_buckets`` is for answers to single requests, which the caller holds whole; None allows any number of groups.
    """

    gts_id: str
    kind: str
    op: str
    group_by: tuple[str, ...] = ()
    max_buckets: int | None = MAX_BUCKETS


def _dimension(name: str) -> Column:
    if name.startswith("metadata/"):
        return F.col("metadata")[name.split("/", 1)[1]].alias(name.replace("/", "_"))
    if name not in DIMENSIONS:
        raise QueryError("unknown_dimension", name)
    return F.col(name)


def measure(op: str, value: str = "value") -> Column:
    """SUM nets corrections with what they correct; the others look at original records only."""
    own = F.when(F.col("corrects_id").isNull(), F.col(value))
    match op:
        case "SUM":
            return F.sum(F.col(value).cast("decimal(38,10)"))
        case "COUNT":
            return F.count(own)
        case "MIN":
            return F.min(own)
        case "MAX":
            return F.max(own)
        case "AVG":
            return F.round(F.avg(own.cast("decimal(28,10)")), 6)
    raise QueryError("unknown_operation", op)


def aggregate(records: DataFrame, spec: Spec, condition: Column | None = None) -> DataFrame:
    """One row per group.  More than ``max_buckets`` groups are refused; that bounds what the driver holds here.
    Without that bound every group is returned, lazily, and the driver holds none.
    Without dimensions there is one row even when nothing fits.  A null dimension is a group of its own."""
    if spec.op not in ALLOWED.get(spec.kind, ()):
        raise QueryError("operation_not_allowed", f"{spec.op} of {spec.kind}")
    rows = records.filter((F.col("gts_id") == spec.gts_id) & (F.col("status") == "active"))
    if condition is not None:
        rows = rows.filter(condition)
    result = measure(spec.op).alias("result")
    if not spec.group_by:
        return rows.agg(result)
    grouped = rows.groupBy(*[_dimension(d) for d in spec.group_by]).agg(result)
    if spec.max_buckets is None:
        return grouped
    found = grouped.limit(spec.max_buckets + 1).collect()
    if len(found) > spec.max_buckets:
        raise QueryError("too_many_buckets", f"more than {spec.max_buckets}")
    return records.sparkSession.createDataFrame(found, grouped.schema)


def ingest(batch: DataFrame, stored: DataFrame | None = None, ordinal: str = "ordinal") -> DataFrame:
    """The batch with an outcome by row: inserted, absorbed (an exact retry) or conflict (same identity, other content).

    The representative of an identity is the stored record, else the first of the batch by ``ordinal``.  Equality
    covers the record's id and content but not created_at, which the identity has at microseconds already.
    """
    content = F.sha2(F.to_json(F.struct(*[F.col(c) for c in CANONICAL if c in batch.columns]), {"ignoreNullFields": "false"}), 256)
    rows = batch.withColumn("__content", content).withColumn("__stored", F.lit(False))
    if stored is not None:
        old = stored.select(*IDENTITY, content.alias("__content")).withColumns({"__stored": F.lit(True), ordinal: F.lit(-1).cast("long")})
        rows = rows.unionByName(old, allowMissingColumns=True)
    w = Window.partitionBy(*IDENTITY).orderBy(F.col("__stored").desc(), ordinal)
    first, rank = F.first("__content").over(w), F.row_number().over(w)
    outcome = F.when(F.col("__rank") == 1, "inserted").when(F.col("__content") == F.col("__first"), "absorbed").otherwise("conflict")
    return rows.withColumns({"__first": first, "__rank": rank}).filter(~F.col("__stored")).withColumn("outcome", outcome).drop("__first", "__rank", "__content", "__stored")


def value_fault(kind: str = "kind") -> Column:
    """Why a value is refused, or null: counters are not negative unless they correct, corrections of counters are
    negative, gauges take any value and no correction."""
    counter, corrects = F.col(kind) == "counter", F.col("corrects_id").isNotNull()
    return (
        F.when(counter & ~corrects & (F.col("value") < 0), "negative_counter")
        .when(counter & corrects & (F.col("value") >= 0), "correction_not_negative")
        .when(~counter & corrects, "gauge_correction")
    )


def correction_faults(records: DataFrame) -> DataFrame:
    """Every correction with its fault or null: the target must exist, be no correction, be active, and agree in
    tenant, type, resource and subject, nulls included."""
    same = ["tenant_id", "gts_id", "resource_id", "resource_type", "subject_id"]
    target = records.select(F.col("id").alias("__id"), F.col("corrects_id").alias("__corrects"), F.col("status").alias("__status"), *[F.col(c).alias(f"__{c}") for c in same])
    agree = F.lit(True)
    for c in same:
        agree = agree & F.col(c).eqNullSafe(F.col(f"__{c}"))
    fault = F.when(F.col("__id").isNull(), "target_missing").when(F.col("__corrects").isNotNull(), "target_is_correction").when(~agree, "identity_mismatch").when(F.col("__status") != "active", "target_inactive")
    return records.filter("corrects_id IS NOT NULL").join(target, F.col("corrects_id") == F.col("__id"), "left").withColumn("fault", fault).select(*records.columns, "fault")


def metadata_fault(metadata: Column, declared: Column) -> Column:
    size = F.octet_length(F.to_json(metadata))
    return F.when(F.size(F.array_except(F.map_keys(metadata), declared)) > 0, "undeclared_key").when(size > MAX_METADATA, "metadata_too_large")


def deactivate(records: DataFrame, targets: DataFrame, key: str = "id") -> DataFrame:
    """The table with the targets and their active corrections, one level deep, inactive; ``changed`` marks them."""
    ids = targets.select(F.col(key).alias("__target")).distinct()
    out = records.join(ids, F.col("id") == F.col("__target"), "left").withColumnRenamed("__target", "__self")
    out = out.join(ids, F.col("corrects_id") == F.col("__target"), "left").withColumnRenamed("__target", "__cause")
    changed = F.col("status").eqNullSafe("active") & (F.col("__self").isNotNull() | F.col("__cause").isNotNull())
    return out.withColumn("changed", changed).withColumn("status", F.when(changed, "inactive").otherwise(F.col("status"))).drop("__self", "__cause")


def unreferenced(types: DataFrame, records: DataFrame) -> DataFrame:
    """Catalog entries that no record uses, and so may be deleted."""
    return types.join(records.select("gts_id"), "gts_id", "left_anti")


def expired(records: DataFrame, seconds: int, now: Column) -> DataFrame:
    """Rows older than the retention, which a partition drop would remove."""
    return records.filter(F.col("created_at") < now - F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)")))
