"""Cutting a lineage with a table in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Where it is unset: a temporary folder in local mode, and one under
    the warehouse, which executors share, elsewhere."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        key = spark.sparkContext.applicationId
        if key not in _LOCAL:
            _LOCAL[key] = tempfile.mkdtemp(prefix="brindle-")
            atexit.register(shutil.rmtree, _LOCAL[key], ignore_errors=True)
        return f"file://{_LOCAL[key]}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tables"


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once and read back, so that every later use, also after an executor is lost, reads files."""
    path = f"{folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete what ``durable`` wrote; call it once the results that read it are written."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
