"""Row-level access scopes.

A scope is a list of constraints, any of which admits a row; a constraint is a list of predicates, all of which
must hold.  An empty constraint admits everything; a constraint that names an unknown property is dropped; with no
constraint left nothing is admitted.  Group and subtree predicates compare against key sets that come from tables,
so they become existence joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Eq:
    prop: str
    value: object


@dataclass(frozen=True)
class In:
    prop: str
    values: tuple


@dataclass(frozen=True)
class InGroup:
    """The property is a member of one of the groups."""

    prop: str
    groups: tuple


@dataclass(frozen=True)
class InGroupSubtree:
    """The property is a member of a group at or below one of the groups."""

    prop: str
    groups: tuple


@dataclass(frozen=True)
class InTenantSubtree:
    """The property is a tenant at or below the root; its own row always counts, others by barrier and status."""

    prop: str
    root: str
    respect_barriers: bool = True
    statuses: tuple = ()


@dataclass(frozen=True)
class Scope:
    constraints: tuple[tuple, ...] = ()

    @staticmethod
    def allow_all() -> Scope:
        return Scope(((),))

    @staticmethod
    def deny_all() -> Scope:
        return Scope()

    @staticmethod
    def tenants(*ids: str, prop: str = "tenant_id") -> Scope:
        return Scope(((In(prop, ids),),))


@dataclass(frozen=True)
class Lookups:
    """Tables for set predicates: membership(group_id, resource_id), groups(ancestor_id, descendant_id) and
    tenants(ancestor_id, descendant_id, barrier, descendant_status)."""

    membership: DataFrame | None = None
    groups: DataFrame | None = None
    tenants: DataFrame | None = None
    props: dict[str, str] = field(default_factory=dict)


def _keys(predicate, lookups: Lookups) -> DataFrame:
    match predicate:
        case InGroup(_, groups):
            return lookups.membership.filter(F.col("group_id").isin(*groups)).select(F.col("resource_id").alias("__key"))
        case InGroupSubtree(_, groups):
            below = lookups.groups.filter(F.col("ancestor_id").isin(*groups)).select(F.col("descendant_id").alias("group_id"))
            return lookups.membership.join(below, "group_id", "left_semi").select(F.col("resource_id").alias("__key"))
        case InTenantSubtree(_, root, respect, statuses):
            rows = lookups.tenants.filter(F.col("ancestor_id") == root)
            keep = F.lit(True)
            if respect:
                keep = keep & (F.col("barrier") == 0)
            if statuses:
                keep = keep & F.col("descendant_status").isin(*statuses)
            return rows.filter(keep | (F.col("descendant_id") == root)).select(F.col("descendant_id").alias("__key"))
    raise TypeError(predicate)


def apply_scope(df: DataFrame, scope: Scope, lookups: Lookups | None = None) -> DataFrame:
    """The rows of ``df`` that the scope admits, with its columns.

    Set predicates under ``or`` become flags from left joins on distinct keys, so no row is counted twice and a
    chain of semi-joins, which would mean ``and``, is not used.  Key sets are joined, not collected; Spark
    broadcasts those that are small when it runs.
    """
    lookups = lookups or Lookups()
    props = {c: c for c in df.columns} | lookups.props
    live = [c for c in scope.constraints if all(p.prop in props for p in c)]
    if not live:
        return df.filter(F.lit(False))
    if any(not c for c in live):
        return df
    sets: dict[object, str] = {}
    out = df
    if len(live) == 1:
        for p in live[0]:
            out = out.filter(_plain(p, props)) if isinstance(p, (Eq, In)) else out.join(_keys(p, lookups).distinct(), F.col(props[p.prop]) == F.col("__key"), "left_semi")
        return out

    def flag(p) -> Column:
        nonlocal out
        if isinstance(p, (Eq, In)):
            return _plain(p, props)
        if p not in sets:
            sets[p] = name = f"__in{len(sets)}"
            keys = _keys(p, lookups).distinct().select(F.col("__key").alias(f"__k{name}"), F.lit(True).alias(name))
            out = out.join(keys, F.col(props[p.prop]) == F.col(f"__k{name}"), "left")
        return F.coalesce(F.col(sets[p]), F.lit(False))

    admit = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [flag(p) for p in c]) for c in live])
    return out.filter(admit).select(*df.columns)


def _plain(p, props: dict[str, str]) -> Column:
    column = F.col(props[p.prop])
    return column == F.lit(p.value) if isinstance(p, Eq) else column.isin(*p.values)


def admits_tenant(scope: Scope, tenant: str, prop: str = "tenant_id") -> bool:
    """Whether some constraint is made of Eq and In on the owner tenant alone and fits the tenant."""
    for c in scope.constraints:
        if all(isinstance(p, (Eq, In)) and p.prop == prop for p in c) and all(tenant == p.value if isinstance(p, Eq) else tenant in p.values for p in c):
            return True
    return False


def compile_decision(decision: dict) -> Scope:
    """A scope from a policy decision: {"allow": bool, "constraints": [[{"type", "property", ...}]]}.

    A refusal, a missing list and a predicate that is not understood all close access.
    """
    if not decision.get("allow") or not isinstance(decision.get("constraints"), list):
        return Scope.deny_all()
    out = []
    for constraint in decision["constraints"]:
        made = []
        for p in constraint:
            match p:
                case {"type": "eq", "property": prop, "value": value}:
                    made.append(Eq(prop, value))
                case {"type": "in", "property": prop, "values": values}:
                    made.append(In(prop, tuple(values)))
                case {"type": "in_group", "property": prop, "groups": groups}:
                    made.append(InGroup(prop, tuple(groups)))
                case {"type": "in_group_subtree", "property": prop, "groups": groups}:
                    made.append(InGroupSubtree(prop, tuple(groups)))
                case {"type": "in_tenant_subtree", "property": prop, "root": root}:
                    made.append(InTenantSubtree(prop, root, p.get("respect_barriers", True), tuple(p.get("statuses", ()))))
                case _:
                    break
        else:
            out.append(tuple(made))
    return Scope(tuple(out))


def guarded_insert(rows: DataFrame, scope: Scope, prop: str = "tenant_id") -> tuple[DataFrame, DataFrame]:
    """Rows that may be inserted, and those refused: no tenant, or one outside the scope."""
    inside = apply_scope(rows.filter(F.col(prop).isNotNull()), scope)
    return inside, rows.exceptAll(inside)


def guarded_update(current: DataFrame, changes: DataFrame, scope: Scope, key: str = "id", prop: str = "tenant_id") -> DataFrame:
    """Changes with a verdict: applied, out_of_scope (the row is not visible), or tenant_change."""
    seen = apply_scope(current, scope).select(F.col(key), F.col(prop).alias("__tenant"))
    verdict = F.when(F.col("__tenant").isNull(), "out_of_scope").when(~F.coalesce(F.col(prop), F.col("__tenant")).eqNullSafe(F.col("__tenant")), "tenant_change").otherwise("applied")
    return changes.join(seen, key, "left").withColumn("verdict", verdict).drop("__tenant")


def cross_tenant_reads(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Reads of another tenant's rows: own ones pass; others need a grant (reader_id, tenant_id) and leave an audit mark."""
    held = grants.select("reader_id", "tenant_id", F.lit(True).alias("__held")).distinct()
    own = F.col("reader_id") == F.col("tenant_id")
    return (
        requests.join(held, ["reader_id", "tenant_id"], "left")
        .withColumn("allowed", own | F.coalesce("__held", F.lit(False)))
        .withColumn("audited", ~own)
        .drop("__held")
    )
