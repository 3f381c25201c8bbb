"""Reviews, responses and calls derived from the test tables.

Every column is an expression of the document's number and text, so the SQL in
``oracle.py`` can derive the same rows on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewgate.operators.audit import audit_records
from reviewgate.operators.scoring import model_cost
from reviewgate.plans.moderation import decide, prepare_input

c = F.col
REGIONS = ["us-east-1", "us-west-2", "eu-west-1", "eu-central-1", "ap-southeast-1"]
CATEGORIES = [
    "electronics",
    "clothing",
    "books",
    "toys",
    "health",
    "food",
    "other",
    "children_toys",
    "healthcare",
]
MODES = ["mild", "mild", "standard", "standard", "strict", "strict", "strict"]
FUNCTIONS = ["review-auditor", "policy-validator", "review-summarizer", "audit-logger"]
START = "2024-01-01 00:00:00"
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{sf}/documents.parquet")


def stream_table(spark: SparkSession, sf: str, name: str, schema) -> DataFrame:
    """A test table as a file stream; the pattern matches a file or a folder."""
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet*")


def stream_documents(spark: SparkSession, sf: str) -> DataFrame:
    return stream_table(spark, sf, "documents", DOCUMENTS)


def _score(factor: int) -> Column:
    return (c("k") * factor % 101).cast("double") / F.lit(10.0)


def with_review_columns(docs: DataFrame) -> DataFrame:
    k = c("k")
    return docs.withColumn("k", c("doc_id")).select(
        "k",
        F.concat(F.lit("rev-"), k.cast("string")).alias("review_id"),
        F.concat(F.lit("prod-"), (k % 50).cast("string")).alias("product_id"),
        F.concat(F.lit("user-"), (k % 97).cast("string")).alias("user_id"),
        c("text").alias("content"),
        (1 + (k % 13) % 5).cast("int").alias("rating"),
        pick(REGIONS, k % 5).alias("region"),
        pick(CATEGORIES, k % 9).alias("product_category"),
        pick(MODES, k % 7).alias("compliance_mode"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(START).cast("timestamp")) + k * 60).alias(
            "timestamp"
        ),
        pick(["PENDING", "APPROVED", "REJECTED", "PROCESSING", "FAILED"], k % 5).alias(
            "status"
        ),
        c("lang").alias("language"),
        _score(7).alias("toxicity_score"),
        _score(13).alias("bias_score"),
        _score(29).alias("hallucination_score"),
        F.floor(c("n_chars") / 4).cast("int").alias("input_tokens"),
        (50 + k % 100).cast("int").alias("output_tokens"),
        F.when(k % 17 == 0, 0).otherwise(k * 37 % 5000).cast("int").alias(
            "processing_duration_ms"
        ),
    )


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return with_review_columns(documents(spark, sf))


def analysis_of(df: DataFrame) -> DataFrame:
    """Reviews with their three scores as an analysis struct."""
    return df.withColumn(
        "analysis",
        F.struct(
            "toxicity_score",
            "bias_score",
            "hallucination_score",
            F.create_map(F.lit("toxicity"), F.concat(F.lit("level "), c("k").cast("string")))
            .cast("map<string,string>")
            .alias("explanations"),
            F.lit(None).cast("map<string,double>").alias("confidence_scores"),
        ),
    )


def with_gaps(df: DataFrame) -> DataFrame:
    """Some scores absent, some limits hit, some modes unknown."""
    k = c("k")
    return df.withColumns(
        {
            "toxicity_score": F.when(k % 17 != 3, c("toxicity_score")),
            "bias_score": F.when(k % 19 != 4, c("bias_score")),
            "compliance_mode": F.when(k % 23 == 5, F.lit("lenient")).otherwise(
                c("compliance_mode")
            ),
        }
    )


def with_responses(df: DataFrame) -> DataFrame:
    """A model response per review: plain, or in one of seven other shapes."""
    k = c("k")

    def text(name: str) -> Column:
        return c(name).cast("string")

    toxicity = F.concat(F.lit('"toxicity_score": '), text("toxicity_score"))
    quoted = F.concat(F.lit('"toxicity_score": "'), text("toxicity_score"), F.lit('"'))
    bias = F.concat(F.lit('"bias_score": '), text("bias_score"))
    hallucination = F.concat(
        F.lit('"hallucination_score": '), text("hallucination_score")
    )
    notes = F.concat(
        F.lit('"explanations": {"toxicity": "level '),
        k.cast("string"),
        F.lit('", "bias": "none seen"}'),
    )
    plain = F.concat(
        F.lit("{"), F.concat_ws(", ", toxicity, bias, hallucination, notes), F.lit("}")
    )
    shape = k % 11
    response = (
        F.when(shape == 0, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(shape == 1, F.concat(F.lit("My reading:\n```json\n"), plain, F.lit("\n```")))
        .when(
            shape == 2,
            F.concat(F.lit("{"), F.concat_ws(", ", toxicity, hallucination, notes), F.lit("}")),
        )
        .when(
            shape == 3,
            F.concat(
                F.lit("{"), F.concat_ws(", ", quoted, bias, hallucination, notes), F.lit("}")
            ),
        )
        .when(shape == 4, F.lit("This is not JSON content"))
        .when(shape == 5, F.concat(plain, F.lit("\nThat is my {honest} view.")))
        .when(shape == 6, F.concat(F.lit("```json\n"), plain, F.lit("\n```\nI hope it helps.")))
        .otherwise(plain)
    )
    return df.withColumn("raw_response", response)


def with_summary_responses(df: DataFrame, key: str = "k") -> DataFrame:
    n = c(key).cast("string")
    shape = c(key) % 5
    full = F.concat(
        F.lit('{"summary": "Buyers speak of item '),
        n,
        F.lit('.", "sentiment": "positive", "key_themes": ["price", "size"], '),
        F.lit('"confidence": 0.8}'),
    )
    return df.withColumn(
        "summary_response",
        F.when(shape == 0, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(shape == 1, F.concat(F.lit('{"sentiment": "negative", "n": '), n, F.lit("}")))
        .when(shape == 2, F.concat(F.lit("No summary of "), n))
        .when(shape == 3, F.concat(F.lit("["), n, F.lit("]")))
        .otherwise(full),
    )


def with_aspect_responses(df: DataFrame) -> DataFrame:
    """One response per aspect; shapes by the document's number."""
    k = c("k")
    lists = {
        "toxicity": ', "detected_issues": ["insult"]',
        "bias": ', "bias_types": ["age"], "problematic_phrases": []',
        "hallucination": ', "questionable_claims": ["size"]',
    }

    def response(aspect: str, shape: Column) -> Column:
        score = c(f"{aspect}_score").cast("string")
        head = F.lit(f'{{"{aspect}_score": ')
        tail = F.concat(
            F.lit(', "explanation": "'),
            F.lit(f"{aspect} of "),
            k.cast("string"),
            F.lit('", "confidence": 0.9'),
            F.lit(lists[aspect]),
            F.lit("}"),
        )
        plain = F.concat(head, score, tail)
        return (
            F.when(shape == 0, F.concat(F.lit("Result:\n```json\n"), plain, F.lit("\n```\n")))
            .when(shape == 1, F.concat(F.lit("I think "), plain, F.lit(" fits.")))
            .when(shape == 2, F.lit('{"confidence": 0.2}'))
            .when(shape == 3, F.concat(head, F.lit('"'), score, F.lit('"'), tail))
            .when(shape == 4, F.lit("This is not JSON content"))
            .when(shape == 5, F.concat(head, F.lit("15.5"), tail))
            .when(shape == 6, F.concat(head, F.lit("-2"), tail))
            .when(shape == 7, F.concat(head, F.lit("null"), tail))
            .when(shape == 8, F.concat(head, F.lit('"high"'), tail))
            .otherwise(plain)
        )

    return df.withColumns(
        {
            "toxicity_response": response("toxicity", k % 23),
            "bias_response": response("bias", k % 29),
            "hallucination_response": response("hallucination", k % 31),
        }
    )


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    """Raw requests, some of them breaking a rule."""
    k = c("k")
    return reviews(spark, sf).select(
        "k",
        "review_id",
        F.when(k % 41 == 1, F.lit(""))
        .when(k % 41 == 2, F.repeat(F.lit("p"), 101))
        .otherwise(c("product_id"))
        .alias("product_id"),
        F.when(k % 43 != 1, c("user_id")).alias("user_id"),
        F.when(k % 37 == 1, F.lit(" \t\n  ")).otherwise(c("content")).alias("content"),
        F.when(k % 47 == 1, F.lit("4.5"))
        .when(k % 47 == 2, F.lit("six"))
        .when(k % 47 == 3, F.lit(None).cast("string"))
        .otherwise((k % 7).cast("string"))
        .alias("rating"),
        F.when(k % 53 == 1, F.lit("mars-1"))
        .when(k % 53 == 2, F.lit(None).cast("string"))
        .otherwise(c("region"))
        .alias("region"),
        F.when(k % 59 == 1, F.lit(None).cast("string"))
        .otherwise(c("product_category"))
        .alias("product_category"),
        F.when(k % 61 == 1, F.lit("lenient")).otherwise(c("compliance_mode")).alias(
            "compliance_mode"
        ),
        "timestamp",
        "language",
    )


def decided(df: DataFrame) -> DataFrame:
    """Decided reviews from their responses (strict reader, mode policy)."""
    prepared = prepare_input(
        with_summary_responses(with_responses(df)),
        c("timestamp"),
        "run-1",
        ["raw_response", "summary_response", "processing_duration_ms", "input_tokens",
         "output_tokens"],
    )
    return decide(prepared, summary_response="summary_response")


def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    """The audit log of all reviews, at their own times."""
    return audit_of(reviews(spark, sf))


def audit_of(df: DataFrame) -> DataFrame:
    return audit_records(
        model_cost(decided(df)), event_time=c("timestamp"), suffix_chars=32
    )


def versions(df: DataFrame) -> DataFrame:
    """Three deliveries per review id, the last one in time is the newest."""
    return df.withColumn(
        "review_id", F.concat(F.lit("rev-"), (c("k") - c("k") % 3).cast("string"))
    )


def calls(events: DataFrame) -> DataFrame:
    """Function calls from the events table."""
    return events.select(
        pick(FUNCTIONS, c("user_id") % 4).alias("function"),
        c("ts").cast("timestamp").alias("ts"),
        (c("event_type") == "error").alias("is_error"),
        F.floor(c("value") * 10000).cast("long").alias("duration_ms"),
    )


def call_events(spark: SparkSession, sf: str) -> DataFrame:
    return calls(spark.read.parquet(f"{sf}/events.parquet"))


def policy_summary_rows(df: DataFrame) -> DataFrame:
    """Summary policy inputs per review."""
    k = c("k")
    return df.select(
        "k",
        "review_id",
        F.when(k % 11 != 0, k % 10).alias("reviews_excluded"),
        F.when(k % 13 != 0, k % 12).alias("total_reviews"),
        F.when(k % 7 != 0, c("toxicity_score")).alias("quality_score"),
    )
