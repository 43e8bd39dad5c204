"""Money, ids, periods and text against known values."""

import uuid
from datetime import date, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from brindle.functions import ids, money, periods, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_half_even(spark):
    cases = [(n, d) for n in (*range(-30, 31), 14999999999, 15000000000, 15000000001, -(10**17) - 1) for d in (1, 2, 3, 4, 10, 10**10)]
    rows = spark.createDataFrame(cases, "n long, d long").withColumn("q", money.half_even(F.col("n"), F.col("d"))).collect()
    assert [r.q for r in rows] == [round(Fraction(r.n, r.d)) for r in rows]


def test_money_helpers(spark):
    assert one(spark, money.translate(F.lit(250), F.lit(1_100_000))) == 275
    assert one(spark, money.translate(F.lit(250), F.lit(0))) is None
    assert one(spark, money.ceil_div(F.lit(7), 2)) == 4
    assert [one(spark, money.currency_scale(F.lit(c))) for c in ("JPY", "KWD", "EUR")] == [0, 3, 2]


def test_uuid5(spark):
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    names = [f"name-{i}é" for i in range(50)]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(ids.uuid5(ns, F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(ns), n)) for n in names]


def test_murmur3_known_values():
    assert ids.murmur3([b"", b"test", b"Hello, world!", b"The quick brown fox jumps over the lazy dog"]).tolist() == [0, 0xBA6BD213, 0xC0363E43, 0x2E4FF723]


def test_periods(spark):
    assert one(spark, periods.period_add(F.lit("199911"), 3)) == "200002"
    assert one(spark, periods.period_end(F.lit("202402"))) == date(2024, 2, 29)
    start = date(2024, 1, 1)
    for n in range(-3, 25):
        end = start + timedelta(days=n)
        want = sum((start + timedelta(days=i)).weekday() < 5 for i in range(1, n + 1))
        assert one(spark, periods.business_days(F.lit(start), F.lit(end))) == want


def test_bucket_labels():
    assert periods.bucket_labels([30, 60, 90]) == ["current", "1-30", "31-60", "61-90", "90+"]
    with pytest.raises(ValueError):
        periods.bucket_labels([30, 30])


def test_text(spark):
    assert one(spark, text.paragraphs(F.lit("a\n\n\n b \r\n\r\nc\nd"))) == ["a", "b", "c\nd"]
    assert one(spark, text.like_escape(F.lit("5%_\\"))) == "5\\%\\_\\\\"
    assert [one(spark, text.safe_cell(F.lit(x))) for x in ("=1", "+1", "-1", "@x", "\tx", "x=1")] == ["'=1", "'+1", "'-1", "'@x", "'\tx", "x=1"]
    assert one(spark, text.alias(F.lit(" WWW.Example.com:8080 "))) == "example.com"
    assert one(spark, text.common_suffix(F.array(F.lit("a.b.com"), F.lit("c.b.com")))) == "b.com"
    assert one(spark, text.common_suffix(F.array(F.lit("a.com"), F.lit("b.com")))) == ""
    assert one(spark, text.media_by_content(F.lit(b"\x89PNG\r\n\x1a\n123"))) == "image/png"
    assert one(spark, text.data_uri(F.lit("image/gif"), F.lit(b"GIF8"))) == "data:image/gif;base64,R0lGOA=="
    assert one(spark, text.backoff(F.lit(5), 100, 1000)) == 1000


def test_batch_sizes_degrade_and_ramp(spark):
    from brindle.streaming import outbox

    rows = [("success", None), ("retry", 5), ("retry", 5), ("success", None), ("reject", None), ("success", None), ("success", None), ("success", None), ("success", None), ("retry", None)]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "p int, i int, result string, processed int")
    got = [r.batch_size for r in outbox.batch_sizes(df, ["p"], ["i"], 16, 2).orderBy("i").collect()]
    assert got == [16, 16, 5, 10, 1, 2, 4, 8, 16, 16]


def test_read_range(spark):
    from brindle.functions import ranges

    df = spark.createDataFrame([("bytes=1-2",), ("bytes=-2",), ("bytes=9-",), ("bytes=3-1",), ("bytes=-0",), ("lines=1-2",), ("bytes=-",), (None,), ("bytes=2-99",)], "h string")
    span = ranges.byte_range(F.col("h"), F.lit(5).cast("long"))
    got = [(bytes(r.b) if r.b is not None else None, r.s) for r in df.select(ranges.read_range(F.lit(b"abcde"), span).alias("b"), span["status"].alias("s")).collect()]
    assert got == [(b"bc", 206), (b"de", 206), (None, 416), (None, 416), (None, 416), (b"abcde", 200), (b"abcde", 200), (b"abcde", 200), (b"cde", 206)]
