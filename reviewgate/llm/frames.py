"""Reading the tables and sending text through Arrow in small batches."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts can be long, so a batch holds few of them.
BATCH_ROWS = 256


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Keep what a Python worker holds at once small, and let workers on machines that have
    this folder import the package from it; elsewhere it is installed or shipped."""
    root, environment = str(Path(__file__).parents[2]), spark.sparkContext.environment
    paths = [x for x in environment.get("PYTHONPATH", "").split(":") if x]
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([*paths, root])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once per row.

    Naming an array again inside a lambda would compute it again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
