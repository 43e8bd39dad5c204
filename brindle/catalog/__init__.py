"""Every query of the engine's own operators by name, with its checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from brindle.catalog import content, datasets, filters, hierarchy, ledger, registry, scopes, streams, usage

FAMILIES = (filters, scopes, usage, ledger, hierarchy, streams, content, registry)


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for family in FAMILIES:
        out |= {name: run for name, (run, _) in family.QUERIES.items()}
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for family in FAMILIES:
        out |= {name: datasets.sql(text) for name, (_, text) in family.QUERIES.items() if text}
    return out
