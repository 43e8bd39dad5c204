"""The pipeline's stages against brute force, each on what its predecessor kept."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus_operators import brute_hits, brute_lines, brute_near


@pytest.fixture(scope="module")
def made(spark, corpus, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    docs = corpus.withColumns({"lang": F.when(F.col("doc_id") % 3 == 0, "xx").otherwise("yy"), "source": F.lit("s")}).drop("kept", "row", "score").dropDuplicates(["doc_id"])
    docs.write.parquet(f"{root}/documents.parquet")
    text = docs.filter("length(text) > 300").select("text").first()[0].split()
    spark.createDataFrame([(1, " ".join(text[3:20])), (2, "nothing like it")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    steps, read = [spark.read.parquet(f"{root}/documents.parquet")], None
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, steps[-1], root).write.parquet(read := f"{root}/step{i}")
        steps.append(spark.read.parquet(read))
    return root, steps


def texts(df):
    return sorted((r["doc_id"], r["text"] or "") for r in df.collect())


def test_stages(made):
    _, (docs, known, lines, near, clean, packed) = made
    assert all(df.columns == docs.columns for df in (known, lines, near, clean))
    assert texts(known) == [(d, t) for d, t in texts(docs) if any(c.isalpha() for c in t)]
    assert texts(lines) == sorted((d, t) for d, _, _, t in brute_lines(texts(known)))
    assert lines.filter("n_chars <> length(text)").count() == 0
    keep = {d for d, _, _, kept in brute_near(texts(lines), 5, 80) if kept}
    assert texts(near) == [(d, t) for d, t in texts(lines) if d in keep]
    items = [(r["item_id"], r["text"]) for r in docs.sparkSession.read.parquet(f"{made[0]}/benchmark.parquet").collect()]
    hit = {d for d, _, n, _ in brute_hits(texts(near), items) if n}
    assert texts(clean) == [(d, t) for d, t in texts(near) if d not in hit]
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {d for d, _ in texts(clean)}


def test_run_gives_the_last_stage(spark, made):
    root, steps = made
    assert corpus_pipeline.run(spark, root).drop("sequence_id").exceptAll(steps[-1].drop("sequence_id")).count() == 0


def test_only_sql_operations_in_line_dedup():
    import inspect

    from brindle.llm import line_dedup

    assert not re.search(r"mapIn|applyIn|udf|\.rdd|pandas|pyarrow", inspect.getsource(line_dedup))
