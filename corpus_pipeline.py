"""A corpus from raw documents to packed sequences, as stages that each call one corpus operator.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of
documents; the last returns packed pieces.  Between stages the rows are written as Parquet and read again.

- language_id: documents without an identified language go.
- line_dedup: lines that stand earlier in the corpus, or within one edit of one that does, are cut out.
- near_dedup: of each group of near duplicates (five-word shingles, similarity 0.8) the least doc_id stays.
- decontaminate: documents with a benchmark passage go.
- packing: pieces of power-of-two length with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import common, decontaminate, language_id, line_dedup, near_dedup, packing

BROADCAST_ROWS = 1_000_000


def _like(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from an operator's ``row`` and ``text``, with n_chars brought up to date."""
    return found.select(*[_column(c) for c in docs.columns])


def _column(name: str):
    if name == "text":
        return F.col("text")
    if name == "n_chars":
        return F.char_length("text").cast("long").alias("n_chars")
    return F.col("row").getField(name).alias(name)


def _without(docs: DataFrame, gone: DataFrame, label: str) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text hash) is not in ``gone``; the short list is broadcast only while it is short."""
    a, b = common.fresh(docs.columns, "gone_id"), common.fresh(docs.columns, "gone_rk")
    listed = common.stage(gone.select(F.col("doc_id").alias(a), F.col("rk").alias(b)).distinct(), label)
    few = listed.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(listed) if few else listed, F.col("doc_id").eqNullSafe(F.col(a)) & (common.row_key() == F.col(b)), "left_anti")


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = language_id.learn(docs.filter(language_id.remainder(5) != 0))
    return _like(language_id.identify(docs, profiles, keep_text=True).filter("lang_pred <> 'und'"), docs)


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like(line_dedup.line_dedup(docs), docs)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    a = common.fresh(docs.columns, "gone_id")
    gone = common.stage(near_dedup.near_dedup(docs).filter("NOT kept").select(F.col("doc_id").alias(a)).distinct(), "pipeline-near")
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col(a), "left_anti")


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(docs, common.read_table(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter(F.size("hits") > 0), "pipeline-hits")


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", stage_language_id),
    ("line_dedup", stage_line_dedup),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("packing", stage_packing),
]

#: Language identification and tokenising are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    mark = common.staged()
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.release(mark, but=docs)  # what the stage and its predecessor wrote is read no more
    return STAGES[-1][1](spark, docs, sf_dir)
