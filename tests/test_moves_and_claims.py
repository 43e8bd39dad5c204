"""Moves of subtrees, missing rows of a closure, claims and commit modes on small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from brindle.operators import hierarchy
from brindle.streaming import log

DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tree(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "a"), ("f", None)]
    return spark.createDataFrame([(i, p, False, 1) for i, p in rows], "id string, parent_id string, self_managed boolean, status int")


def moves(spark, *pairs):
    return spark.createDataFrame(pairs, "id string, new_parent_id string")


def test_move_equals_a_new_closure(spark, tree):
    closed = hierarchy.closure(tree)
    got = hierarchy.move_subtrees(closed, moves(spark, ("c", "e"), ("b", "f")).filter("id = 'c'"))
    moved = tree.withColumn("parent_id", F.when(F.col("id") == "c", "e").otherwise(F.col("parent_id")))
    want = hierarchy.closure(moved).select("ancestor_id", "descendant_id", "depth")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("pairs", [[("b", "d")], [("b", "b")], [("b", "e"), ("d", "f")], [("b", "e"), ("e", "d")]])
def test_moves_that_meet_are_refused(spark, tree, pairs):
    with pytest.raises(ValueError):
        hierarchy.move_subtrees(hierarchy.closure(tree), moves(spark, *pairs))


def test_no_moves_leave_the_closure(spark, tree):
    closed = hierarchy.closure(tree).select("ancestor_id", "descendant_id", "depth")
    got = hierarchy.move_subtrees(closed, spark.createDataFrame([], "id string, new_parent_id string"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, closed.collect()))


def test_missing_rows(spark, tree):
    closed = hierarchy.closure(tree)
    assert hierarchy.unhydrated(closed, tree.filter("id <> 'c'")).collect() == [("c",)]
    with pytest.raises(ValueError):
        hierarchy.hydrated(closed, tree.filter("id <> 'c'"))
    assert hierarchy.hydrated(closed, tree).count() == closed.count()


def test_claims_leave_what_is_held(spark):
    rows = [(1, "queued", DAY, None), (2, "queued", DAY, DAY + datetime.timedelta(hours=2)), (3, "done", DAY, None), (4, "queued", DAY, DAY), (5, "queued", DAY + datetime.timedelta(days=1), None)]
    queue = spark.createDataFrame(rows, "id long, state string, due_at timestamp, claimed_until timestamp")
    got = log.claim(queue, F.lit("2024-01-01 01:00:00").cast("timestamp"), 10, "w", 60).orderBy("id").collect()
    assert [(r["id"], r["claimed_by"], r["claimed_until"]) for r in got] == [(i, "w", DAY + datetime.timedelta(hours=1, minutes=1)) for i in (1, 4)]


def test_commit_modes(spark):
    rows = [("t", 0, i, DAY + datetime.timedelta(seconds=9 * i), i == 1) for i in range(6)] + [("t", 1, 0, DAY, False)]
    done = spark.createDataFrame(rows, "topic string, partition int, offset long, processed_at timestamp, committed boolean")
    got = {mode: sorted(map(tuple, log.committed_offsets(done, mode).collect())) for mode in ("auto", "manual", "transaction")}
    assert got == {"auto": [("t", 0, 4)], "manual": [("t", 0, 1)], "transaction": [("t", 0, 5), ("t", 1, 0)]}
    with pytest.raises(ValueError):
        log.committed_offsets(done, "never")
