"""Resources that can be queried, and binding of filters to Columns.

A resource lists its fields by name, column, kind and nullability; no text of a caller ever becomes SQL.  Kinds:
string, i64, f64, bool, uuid, datetime, date, time, decimal.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import date, datetime, time
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.plans.syntax import And, Call, Compare, Field, In, Literal, Node, Not, Or, QueryError

_TYPES = {"string": "string", "i64": "bigint", "f64": "double", "bool": "boolean", "uuid": "string", "datetime": "timestamp", "date": "date", "time": "time", "decimal": "decimal(38,10)"}
_ACCEPTS = {"string": ("string",), "i64": ("number",), "f64": ("number",), "decimal": ("number",), "bool": ("bool",), "uuid": ("uuid", "string"), "datetime": ("datetime",), "date": ("date",), "time": ("time",)}
_FLIP = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}
_KIND_OF = ((type(None), "null"), (bool, "bool"), ((int, float, Decimal), "number"), (uuid.UUID, "uuid"), (datetime, "datetime"), (date, "date"), (time, "time"), (str, "string"))
TEXT_FUNCTIONS = ("contains", "startswith", "endswith")


@dataclass(frozen=True)
class ResourceField:
    column: str
    kind: str
    nullable: bool = False


@dataclass(frozen=True)
class Ref:
    """A field of a resource, for filters written in Python: ``ref.ge(5) & ~other.is_in("a", "b")``.  A value whose kind
    the field does not take is refused."""

    name: str
    kind: str

    def _value(self, value) -> Literal:
        kind = next((k for types, k in _KIND_OF if isinstance(value, types)), None)
        if kind not in (*_ACCEPTS[self.kind], "null"):
            raise QueryError("type_mismatch", f"{self.name} does not take {value!r}")
        if kind == "datetime" and value.tzinfo is None:
            raise QueryError("type_mismatch", f"{value!r} has no time zone")
        return Literal(kind, Decimal(str(value)) if kind == "number" else value)

    def _compare(self, op: str, value) -> Compare:
        return Compare(Field(self.name), op, self._value(value))

    def eq(self, value) -> Compare:
        return self._compare("eq", value)

    def ne(self, value) -> Compare:
        return self._compare("ne", value)

    def gt(self, value) -> Compare:
        return self._compare("gt", value)

    def ge(self, value) -> Compare:
        return self._compare("ge", value)

    def lt(self, value) -> Compare:
        return self._compare("lt", value)

    def le(self, value) -> Compare:
        return self._compare("le", value)

    def is_in(self, *values) -> In:
        return In(Field(self.name), tuple(map(self._value, values)))

    def _text(self, function: str, value: str) -> Call:
        if self.kind != "string":
            raise QueryError("type_mismatch", f"{self.name} is not text")
        return Call(function, (Field(self.name), self._value(value)))

    def contains(self, value: str) -> Call:
        return self._text("contains", value)

    def startswith(self, value: str) -> Call:
        return self._text("startswith", value)

    def endswith(self, value: str) -> Call:
        return self._text("endswith", value)


@dataclass(frozen=True)
class Resource:
    """``ops`` and ``functions`` restrict what the store behind the resource can evaluate."""

    name: str
    fields: dict[str, ResourceField]
    tiebreak: tuple[str, str] = ("id", "desc")
    functions: tuple[str, ...] = TEXT_FUNCTIONS
    kinds: tuple[str, ...] = tuple(_ACCEPTS)
    null_tests: bool = False
    maps: dict[str, str] = field(default_factory=dict)  # a field prefix whose next path step is a key of a map column

    def ref(self, name: str) -> Ref:
        return Ref(name, self.resolve(name)[1].kind)

    def resolve(self, name: str) -> tuple[Column, ResourceField]:
        """A field by name without regard to case: the whole name first, else its last path step where only one fits."""
        low = name.lower()
        exact = [k for k in self.fields if k.lower() == low]
        if not exact:
            head, _, rest = low.partition("/")
            if rest and head in self.maps:
                return F.col(self.maps[head])[name.split("/", 1)[1]], ResourceField(self.maps[head], "string", True)
            exact = [k for k in self.fields if k.lower().rsplit("/", 1)[-1] == low.rsplit("/", 1)[-1]]
        if len(exact) != 1:
            raise QueryError("unknown_field", name)
        f = self.fields[exact[0]]
        return F.col(f.column), f


def _value(resource: Resource, f: ResourceField, literal: Node) -> Column:
    if not isinstance(literal, Literal):
        raise QueryError("type_mismatch", "a literal must stand on the right")
    if f.kind not in resource.kinds or literal.kind not in _ACCEPTS[f.kind]:
        raise QueryError("type_mismatch", f"{literal.kind} for {f.kind}")
    v = literal.value
    if f.kind == "i64":
        if v != v.to_integral_value() or not -(1 << 63) <= v < 1 << 63:
            raise QueryError("type_mismatch", "not a 64-bit whole number")
        return F.lit(int(v)).cast("bigint")
    if f.kind == "f64":
        return F.lit(float(v))
    if f.kind == "decimal":
        return F.lit(Decimal(v))
    if f.kind == "uuid":
        return F.lit(str(v).lower())
    if f.kind == "time":
        return F.lit(v.isoformat()).cast("time")
    if f.kind == "datetime":
        return F.timestamp_micros(F.lit(round(v.timestamp()) * 1_000_000 + v.microsecond if not v.microsecond else int(v.timestamp()) * 1_000_000 + v.microsecond))
    return F.lit(v)


def _left(resource: Resource, node: Node) -> tuple[Column, ResourceField]:
    if not isinstance(node, Field):
        raise QueryError("invalid_filter", "a field must stand on the left")
    return resource.resolve(node.name)


def bind(resource: Resource, node: Node) -> Column:
    """The Column of a filter; every comparison is a typed field against a literal of its kind."""
    match node:
        case And(a, b):
            return bind(resource, a) & bind(resource, b)
        case Or(a, b):
            return bind(resource, a) | bind(resource, b)
        case Not(a):
            return ~bind(resource, a)
        case Compare(a, op, b):
            column, f = _left(resource, a)
            if isinstance(b, Literal) and b.kind == "null":
                if resource.null_tests and op in ("eq", "ne"):
                    return column.isNull() if op == "eq" else column.isNotNull()
                raise QueryError("type_mismatch", "null")
            return _FLIP[op](column, _value(resource, f, b))
        case In(a, items):
            column, f = _left(resource, a)
            if not items:
                raise QueryError("invalid_filter", "an empty list")
            return column.isin(*[_value(resource, f, x) for x in items])
        case Call(name, args):
            low = name.lower()
            if low not in resource.functions or low not in TEXT_FUNCTIONS:
                raise QueryError("unsupported_function", name)
            if len(args) != 2:
                raise QueryError("invalid_filter", f"{name} takes two arguments")
            column, f = _left(resource, args[0])
            if f.kind != "string":
                raise QueryError("type_mismatch", f"{name} on {f.kind}")
            return getattr(F, low)(column, _value(resource, f, args[1]))
    raise QueryError("invalid_filter", "a bare field or literal")


def cast_type(kind: str) -> str:
    return _TYPES[kind]
