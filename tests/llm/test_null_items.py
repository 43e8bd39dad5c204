"""Benchmark items without an id."""

import pytest

from brindle.llm import decontaminate


@pytest.mark.parametrize("block", [250_000, 1])
def test_null_items_hit(spark, block):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "five six"), (3, "seven")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "two three"), (None, "four"), (9, "five six"), (None, "five six"), (None, None)], "item_id long, text string")
    found = {r.doc_id: (sum(h["last"] - h["first"] + 1 for h in r.hits), r["items"]) for r in decontaminate.find_benchmark(docs, bench, block_windows=block).collect()}
    assert found == {1: (3, [None]), 2: (2, ["9", None]), 3: (0, [])}
