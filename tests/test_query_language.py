"""Filter text to tree to Column, hashes, cursors, pages."""

import random
from datetime import UTC, datetime
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.plans import paging, syntax
from brindle.plans.paging import Cursor, Query
from brindle.plans.schema import Resource, ResourceField, bind
from brindle.plans.syntax import And, Compare, Field, In, Literal, Not, Or, QueryError, canonical, filter_hash, parse

PEOPLE = Resource("people", {"id": ResourceField("id", "i64"), "name": ResourceField("name", "string"), "score": ResourceField("score", "i64"), "nick": ResourceField("nick", "string", True)}, tiebreak=("id", "asc"))


def test_precedence_and_words():
    a, b, c = (Compare(Field(x), "eq", Literal("number", Decimal(1))) for x in "abc")
    assert parse("a eq 1 or b eq 1 and c eq 1") == Or(a, And(b, c))
    assert parse("not a eq 1 and b eq 1") == And(Not(a), b)
    assert parse("(a eq 1 or b eq 1) and c eq 1") == And(Or(a, b), c)
    # Keywords end at a word boundary: these are fields, not keywords.
    assert parse("notes eq 1") == Compare(Field("notes"), "eq", Literal("number", Decimal(1)))
    assert parse("trueish eq 1").left == Field("trueish")


def test_literals():
    lit = lambda t: parse(f"x eq {t}").right
    assert lit("'it''s'").value == "it's"
    assert lit("TRUE").value is True
    assert lit("null").kind == "null"
    assert lit("-12.50").value == Decimal("-12.50")
    assert lit("2024-01-05").kind == "date"
    assert lit("9:30").kind == "time"
    assert lit("2024-01-05T01:02:03.5+02:30").value == datetime(2024, 1, 4, 22, 32, 3, 500000, UTC)
    assert lit("2024-10-27T01:30:00 Europe/London").value == datetime(2024, 10, 27, 0, 30, tzinfo=UTC)  # ambiguous: the earlier
    assert lit("6ba7b811-9dad-11d1-80b4-00c04fd430c8").kind == "uuid"
    assert parse("x in (1, 2)") == In(Field("x"), (Literal("number", Decimal(1)), Literal("number", Decimal(2))))


@pytest.mark.parametrize("text", ["", "a eq", "a eq 1 b", "(a eq 1", "a eq 'x", "eq eq 1", "a ~ 1", "x eq 2024-13-40", "a eq 2024-01-01T00:00:00 No/Zone"])
def test_refused_text(text):
    with pytest.raises(QueryError):
        parse(text)


def test_limits():
    with pytest.raises(QueryError, match="filter_too_long"):
        parse("a eq '" + "x" * 9000 + "'")
    with pytest.raises(QueryError, match="nested"):
        parse("(" * 300 + "a eq 1" + ")" * 300)


def test_hash_ignores_case_of_names_and_form_of_numbers():
    assert filter_hash(parse("Name eq 1.50")) == filter_hash(parse("name eq 1.5"))
    assert filter_hash(parse("name eq 'A'")) != filter_hash(parse("name eq 'a'"))
    assert filter_hash(None) is None
    assert canonical(parse("CONTAINS(Name, 'x')")) == "FN(contains,ID(name),STR(x))"
    assert f"{syntax.fnv1a(b'a'):016x}" == "af63dc4c8601ec8c"


@pytest.mark.parametrize("text", ["name eq 1", "score eq 'x'", "score eq 1.5", "unknown eq 1", "1 eq name", "name eq score", "name", "name in ()", "contains(score, 'x')", "lower(name)", "nick eq null"])
def test_typed_binding(spark, text):
    with pytest.raises(QueryError):
        bind(PEOPLE, parse(text))


def test_cursor_round_trip_and_faults():
    c = Cursor(("a", "é"), "+name,-id", "00ff", "bwd")
    assert Cursor.decode(c.encode()) == c
    import base64

    wire = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    for token, code in [("***", "base64"), (wire("{"), "json"), (wire('{"v":2,"k":["1"],"o":"asc","s":"+id"}'), "version"), (wire('{"v":1,"k":[],"o":"asc","s":"+id"}'), "keys"), (wire('{"v":1,"k":["1"],"o":"asc","s":" "}'), "fields"), (wire('{"v":1,"k":["1"],"o":"asc","s":"+id","d":"up"}'), "direction")]:
        with pytest.raises(QueryError, match=code):
            Cursor.decode(token)
    assert Cursor.decode(wire('{"v":1,"k":["1"],"o":"asc","s":"+id"}')).direction == "fwd"


@settings(max_examples=50)
@given(st.lists(st.text(min_size=1, max_size=8).filter(lambda s: s.isprintable()), min_size=1, max_size=4))
def test_cursor_keeps_any_key(keys):
    c = Cursor(tuple(keys), "+id")
    assert Cursor.decode(c.encode()) == c


@pytest.fixture(scope="module")
def people(spark):
    random.seed(1)
    rows = [(i, random.choice("abcd"), random.randint(0, 5), None if i % 3 else "n") for i in range(37)]
    return spark.createDataFrame(rows, "id long, name string, score long, nick string")


@pytest.mark.parametrize("order", ["score desc, name", "name desc", "id"])
def test_pages_make_one_sorted_scan(people, order):
    q = Query().where("score ge 1").page_size(5)
    run = lambda token: paging.fetch(people, PEOPLE, q.order_by(order) if token is None else q.starting(token))
    whole = paging.filtered(people, PEOPLE, q).orderBy(*paging.sort_columns(PEOPLE, paging.with_tiebreak(paging.parse_order(order), PEOPLE))).collect()
    all_pages = list(paging.pages(run))
    assert [r for p in all_pages for r in p.rows] == whole
    back = paging.fetch(people, PEOPLE, q.starting(all_pages[2].prev_cursor))
    assert back.rows == all_pages[1].rows
    assert paging.fetch(people, PEOPLE, q.starting(back.prev_cursor)).prev_cursor is None


def test_page_faults(people):
    q = Query().page_size(3)
    token = paging.fetch(people, PEOPLE, q.order_by("name")).next_cursor
    with pytest.raises(QueryError, match="order_with_cursor"):
        paging.fetch(people, PEOPLE, q.order_by("name").starting(token))
    with pytest.raises(QueryError, match="invalid_limit"):
        paging.fetch(people, PEOPLE, Query().page_size(0))
    other = paging.fetch(people, PEOPLE, q.where("score gt 1").order_by("name")).next_cursor
    with pytest.raises(QueryError, match="filter_mismatch"):
        paging.fetch(people, PEOPLE, q.where("score gt 2").starting(other))
    with pytest.raises(QueryError, match="nullable_key"):
        paging.after(PEOPLE, (("nick", "asc"),), ("x",))
    with pytest.raises(QueryError, match="mixed_direction"):
        paging.after(PEOPLE, (("name", "asc"), ("id", "desc")), ("x", "1"), uniform=True)
    with pytest.raises(QueryError, match="too many"):
        paging.parse_order(",".join("abcdefghijk"))
    with pytest.raises(QueryError, match="twice"):
        paging.parse_select("a,A")


def test_nested_projection(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('x', 1, 'y', named_struct('z', 2, 'w', 3)) AS s, array(named_struct('p', 1, 'q', 2)) AS l")
    got = paging.project(df, paging.parse_select("S.y.z, l.q, none")).collect()[0].asDict(recursive=True)
    assert got == {"s": {"y": {"z": 2}}, "l": [{"q": 2}]}


def test_filters_written_in_python():
    name, score = PEOPLE.ref("name"), PEOPLE.ref("score")
    written = (score.ge(5) | name.startswith("a")) & ~name.is_in("x", "y") & score.ne(7)
    assert written == parse("(score ge 5 or startswith(name, 'a')) and not (name in ('x', 'y')) and score ne 7")
    times = Resource("times", {"at": ResourceField("at", "datetime"), "on": ResourceField("on", "date"), "ok": ResourceField("ok", "bool")})
    assert times.ref("at").lt(datetime(2024, 1, 1, tzinfo=UTC)) == parse("at lt 2024-01-01T00:00:00Z")
    assert times.ref("ok").eq(True) == parse("ok eq true")
    wrong = [lambda: score.eq("a"), lambda: score.eq(True), lambda: name.eq(1), lambda: score.contains("1"), lambda: times.ref("on").eq(datetime(2024, 1, 1, tzinfo=UTC)), lambda: times.ref("at").gt(datetime(2024, 1, 1)), lambda: PEOPLE.ref("none")]
    for call in wrong:
        with pytest.raises(QueryError):
            call()
