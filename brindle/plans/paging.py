"""Ordering, keyset cursors, pages and projection."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from brindle.plans import syntax
from brindle.plans.schema import Resource, bind, cast_type
from brindle.plans.syntax import Node, QueryError

DEFAULT_PAGE, MAX_PAGE = 25, 1000
MAX_ORDER, MAX_SELECT, MAX_SELECT_TEXT = 10, 100, 2048
Order = tuple[tuple[str, str], ...]


def parse_order(text: str) -> Order:
    """``f [asc|desc], ...`` of at most ten keys."""
    out = []
    for part in text.split(","):
        words = part.split()
        if not words or len(words) > 2 or len(words) == 2 and words[1].lower() not in ("asc", "desc"):
            raise QueryError("invalid_orderby", part.strip())
        out.append((words[0], words[1].lower() if len(words) == 2 else "asc"))
    if len(out) > MAX_ORDER:
        raise QueryError("invalid_orderby", "too many keys")
    return tuple(out)


def with_tiebreak(order: Order, resource: Resource) -> Order:
    name, direction = resource.tiebreak
    return order if any(f.lower() == name.lower() for f, _ in order) else (*order, (name, direction))


def tokens(order: Order) -> str:
    """Signed field names, ``+a,-b``."""
    return ",".join(("+" if d == "asc" else "-") + f for f, d in order)


def from_tokens(text: str) -> Order:
    parts = text.split(",")
    if not all(re.fullmatch(r"[+-]\S+", p) for p in parts):
        raise QueryError("cursor_invalid_fields")
    return tuple((p[1:], "asc" if p[0] == "+" else "desc") for p in parts)


def reverse(order: Order) -> Order:
    return tuple((f, "desc" if d == "asc" else "asc") for f, d in order)


def sort_columns(resource: Resource, order: Order) -> list[Column]:
    """Sort keys; nulls come last ascending and first descending."""
    out = []
    for name, direction in order:
        column, _ = resource.resolve(name)
        out.append(column.asc_nulls_last() if direction == "asc" else column.desc_nulls_first())
    if not out:
        raise QueryError("invalid_orderby", "no key")
    return out


@dataclass(frozen=True)
class Cursor:
    """Where a page ended: key values as text, the order as signed tokens, the filter's hash, and the direction."""

    keys: tuple[str, ...]
    order: str
    filter: str | None = None
    direction: str = "fwd"

    def encode(self) -> str:
        body: dict[str, Any] = {"v": 1, "k": list(self.keys), "o": "desc" if self.order.startswith("-") else "asc", "s": self.order}
        if self.filter is not None:
            body["f"] = self.filter
        body["d"] = self.direction
        return base64.urlsafe_b64encode(json.dumps(body, separators=(",", ":"), ensure_ascii=False).encode()).decode().rstrip("=")

    @staticmethod
    def decode(token: str) -> Cursor:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", token) or len(token) % 4 == 1:
            raise QueryError("cursor_invalid_base64")
        try:
            raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
        except binascii.Error as e:
            raise QueryError("cursor_invalid_base64") from e
        try:
            body = json.loads(raw)
        except ValueError as e:
            raise QueryError("cursor_invalid_json") from e
        if not isinstance(body, dict) or not isinstance(body.get("v"), int) or not isinstance(body.get("s"), str) or not isinstance(body.get("o"), str):
            raise QueryError("cursor_invalid_json")
        keys, hashed = body.get("k"), body.get("f")
        if not isinstance(keys, list) or not all(isinstance(k, str) for k in keys) or not (hashed is None or isinstance(hashed, str)):
            raise QueryError("cursor_invalid_json")
        if body["v"] != 1:
            raise QueryError("cursor_invalid_version")
        direction = body.get("d", "fwd")
        if body["o"] not in ("asc", "desc") or direction not in ("fwd", "bwd"):
            raise QueryError("cursor_invalid_direction")
        if not keys:
            raise QueryError("cursor_invalid_keys")
        if not body["s"].strip():
            raise QueryError("cursor_invalid_fields")
        return Cursor(tuple(keys), body["s"], hashed, direction)

    def check(self, order: Order, hashed: str | None) -> None:
        """The order must be the query's; the filter's hash too, where both have one."""
        if self.order != tokens(order):
            raise QueryError("order_mismatch")
        if self.filter is not None and hashed is not None and self.filter != hashed:
            raise QueryError("filter_mismatch")


def _key(resource: Resource, name: str, text: str) -> Column:
    _, f = resource.resolve(name)
    if f.kind == "datetime":
        if not re.fullmatch(r"-?\d+", text):
            raise QueryError("cursor_invalid_keys")
        return F.timestamp_micros(F.lit(int(text)))
    return F.lit(text).cast(cast_type(f.kind))


def _text(value: Any) -> str:
    if hasattr(value, "timestamp"):
        return str(round(value.timestamp() * 1_000_000))
    return str(value).lower() if isinstance(value, bool) else str(value)


def after(resource: Resource, order: Order, keys: tuple[str, ...], uniform: bool = False) -> Column:
    """Rows that come after the keys: c1 > a or (c1 = a and c2 > b) or ..., each by its direction.

    ``uniform``: refuse mixed directions, as stores that compare whole tuples do.  Nullable keys are refused.
    """
    if len(keys) != len(order):
        raise QueryError("cursor_invalid_keys")
    if uniform and len({d for _, d in order}) > 1:
        raise QueryError("mixed_direction")
    out, equal = F.lit(False), F.lit(True)
    for (name, direction), text in zip(order, keys, strict=True):
        column, f = resource.resolve(name)
        if f.nullable:
            raise QueryError("nullable_key", name)
        value = _key(resource, name, text)
        out = out | (equal & (column > value if direction == "asc" else column < value))
        equal = equal & (column == value)
    return out


@dataclass(frozen=True)
class Query:
    """What a caller asks for; built step by step and checked when run."""

    filter: Node | None = None
    order: Order = ()
    select: tuple[str, ...] = ()
    limit: int | None = None
    cursor: Cursor | None = None
    scope: Column | None = None

    def where(self, condition: Node | str) -> Query:
        node = syntax.parse(condition) if isinstance(condition, str) else condition
        return replace(self, filter=node if self.filter is None else syntax.And(self.filter, node))

    def order_by(self, text: str) -> Query:
        return replace(self, order=parse_order(text))

    def columns(self, text: str) -> Query:
        return replace(self, select=parse_select(text))

    def page_size(self, n: int) -> Query:
        return replace(self, limit=n)

    def starting(self, token: str) -> Query:
        return replace(self, cursor=Cursor.decode(token))

    def scoped(self, scope: Column) -> Query:
        """A row-level scope, joined by ``and`` after the filter's hash is taken."""
        return replace(self, scope=scope if self.scope is None else self.scope & scope)


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    next_cursor: str | None
    prev_cursor: str | None
    limit: int


def filtered(df: DataFrame, resource: Resource, query: Query) -> DataFrame:
    if query.scope is not None:
        df = df.filter(query.scope)
    return df if query.filter is None else df.filter(bind(resource, query.filter))


def plan_page(df: DataFrame, resource: Resource, query: Query, max_page: int = MAX_PAGE, uniform: bool = False) -> tuple[DataFrame, Order, int, bool]:
    """The rows of a page and one more, its order, its size, and whether it runs backwards."""
    if query.limit == 0:
        raise QueryError("invalid_limit")
    if query.cursor and query.order:
        raise QueryError("order_with_cursor")
    order = from_tokens(query.cursor.order) if query.cursor else with_tiebreak(query.order, resource)
    limit = min(query.limit or DEFAULT_PAGE, max_page)
    out = filtered(df, resource, query)
    back = bool(query.cursor) and query.cursor.direction == "bwd"
    walk = reverse(order) if back else order
    if query.cursor:
        query.cursor.check(order, syntax.filter_hash(query.filter))
        out = out.filter(after(resource, walk, query.cursor.keys, uniform))
    return out.orderBy(*sort_columns(resource, walk)).limit(limit + 1), order, limit, back


def fetch(df: DataFrame, resource: Resource, query: Query, max_page: int = MAX_PAGE) -> Page:
    """One page, with cursors from its last and first rows; at most ``max_page`` + 1 rows reach the driver."""
    planned, order, limit, back = plan_page(df, resource, query, max_page)
    rows = planned.collect()
    more = len(rows) > limit
    rows = rows[:limit]
    if back:
        rows.reverse()
    hashed = syntax.filter_hash(query.filter)

    def at(row: Row, direction: str) -> str:
        return Cursor(tuple(_text(row[resource.resolve(f)[1].column]) for f, _ in order), tokens(order), hashed, direction).encode()

    has_next, has_prev = (bool(query.cursor), more) if back else (more, bool(query.cursor))
    return Page(rows, at(rows[-1], "fwd") if rows and has_next else None, at(rows[0], "bwd") if rows and has_prev else None, limit)


def pages(run: Callable[[str | None], Page]) -> Iterator[Page]:
    """Follow next cursors until there is none."""
    token = None
    while True:
        page = run(token)
        yield page
        token = page.next_cursor
        if token is None:
            return


def items(run: Callable[[str | None], Page]) -> Iterator[Row]:
    for page in pages(run):
        yield from page.rows


def offset_page(df: DataFrame, keys: list[Column], skip: int = 0, top: int | None = None, default: int = 20, most: int = 50) -> DataFrame:
    """Skip and take, for ranked lists."""
    return df.orderBy(*keys).offset(max(0, skip)).limit(min(top or default, most))


def parse_select(text: str) -> tuple[str, ...]:
    if len(text) > MAX_SELECT_TEXT:
        raise QueryError("invalid_select", "too long")
    names = tuple(n.strip().lower() for n in text.split(",") if n.strip())
    if not names:
        raise QueryError("invalid_select", "no field")
    if len(names) > MAX_SELECT:
        raise QueryError("invalid_select", "too many fields")
    if len(set(names)) != len(names):
        raise QueryError("invalid_select", "a field twice")
    return names


def project(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Selected columns in the table's order, without regard to case; a dotted name keeps that part of a struct (or of
    each struct of an array), and names that do not exist are left out."""
    from pyspark.sql import types as T

    def part(column: Column, kind: T.DataType, wanted: list[str]) -> Column | None:
        if "" in wanted:
            return column
        if isinstance(kind, T.ArrayType):
            if part(F.lit(None), kind.elementType, wanted) is None:
                return None
            return F.transform(column, lambda x: part(x, kind.elementType, wanted))
        if not isinstance(kind, T.StructType):
            return None
        kept = [(f.name, part(column.getField(f.name), f.dataType, below(wanted, f.name))) for f in kind.fields if below(wanted, f.name)]
        kept = [c.alias(n) for n, c in kept if c is not None]
        return F.when(column.isNotNull(), F.struct(*kept)) if kept else None

    def below(wanted: list[str], name: str) -> list[str]:
        low = name.lower()
        return ["" if w == low else w[len(low) + 1 :] for w in wanted if w == low or w.startswith(low + ".")]

    out = []
    for f in df.schema.fields:
        wanted = below(list(names), f.name)
        column = part(F.col(f"`{f.name}`"), f.dataType, wanted) if wanted else None
        if column is not None:
            out.append(column.alias(f.name))
    return df.select(*out)
