"""Reading review submissions, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewgate.functions.collections import blank_to_null
from reviewgate.functions.responses import whole_json
from reviewgate.schemas import SUBMISSION

c = F.col


def submissions(raw: DataFrame) -> DataFrame:
    """Request rows to review rows: the request id is the review id (a new one
    is made when it is absent), empty values are absent values."""
    request = F.coalesce(blank_to_null(c("api_request_id")), blank_to_null(c("review_id")))
    return raw.select(
        F.coalesce(request, F.uuid()).alias("review_id"),
        *[
            blank_to_null(c(x)).alias(x)
            for x in ("product_id", "user_id", "content", "rating", "region")
        ],
        *[
            blank_to_null(c(x)).alias(x)
            for x in ("product_category", "compliance_mode", "source_ip", "user_agent")
        ],
    )


def split_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Submissions, and the lines that are none with the reason and their file.

    ``lines`` has ``value`` and ``source_file``, one JSON object per line. Blank lines are
    neither. Text that is no JSON, a value that is no object, and text after the object
    make a line malformed; it is kept as it came.
    """
    bare = F.btrim("value", F.lit(" \t\n\r"))
    error = F.when(whole_json(c("value")).isNull(), "MALFORMED_JSON").when(
        ~bare.startswith("{"), "NOT_AN_OBJECT"
    )
    checked = lines.filter(bare != "").withColumn("error", error)
    bad = checked.filter(c("error").isNotNull()).select(
        c("value").alias("line"), "error", "source_file"
    )
    doc = F.from_json("value", SUBMISSION).alias("doc")
    good = checked.filter(c("error").isNull()).select(doc).select("doc.*")
    return submissions(good), bad


def _lines(reader, path: str) -> DataFrame:
    return reader.text(path).select("value", c("_metadata.file_path").alias("source_file"))


def read_json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Submissions of a folder of JSON lines, and its malformed lines."""
    return split_lines(_lines(spark.read, path))


def stream_json_lines(
    spark: SparkSession, path: str, max_files: int | None = None
) -> DataFrame:
    """Arriving lines for ``streaming.moderation.start_json_moderation``."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _lines(reader, path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Submissions only. A malformed line becomes a row without values here; see
    ``read_json_lines``, which sets it aside."""
    return submissions(spark.read.schema(SUBMISSION).json(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return submissions(spark.read.schema(SUBMISSION).parquet(path))


def stream_json(
    spark: SparkSession, path: str, max_files: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(SUBMISSION)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return submissions(reader.json(path))
