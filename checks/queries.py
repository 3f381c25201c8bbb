"""Registered queries: one per operator, over the whole test tables.

Each takes (spark, table folder) and returns flat columns: arrays are joined to
text, structs are spread, times are ISO text.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import fixtures as X
from reviewgate import constants as K
from reviewgate.functions import responses as R
from reviewgate.functions.numbers import clamp
from reviewgate.functions.text import isoformat
from reviewgate.operators import analysis, items, lookups, metrics, prompts, routing
from reviewgate.operators import summaries, validation
from reviewgate.operators.audit import audit_records, expire_audit, ttl_stamp
from reviewgate.operators.policy import (
    PolicySet,
    content_policy,
    policy_entry,
    summary_policy,
    threshold_policy,
    unknown_modes,
)
from reviewgate.operators.policy_history import PolicyHistory
from reviewgate.operators.scoring import mock_scores, model_cost
from reviewgate.plans import analysis as analysis_plans
from reviewgate.plans import reports, rollup
from reviewgate.plans.moderation import (
    decide,
    log_decisions,
    prepare_input,
    run_moderation,
    scored_reviews,
)
from reviewgate.plans.summaries import (
    stored_summaries,
    summarise_tree,
    summarise_within_limits,
)
from reviewgate.schemas import REVIEW
from reviewgate.session import scratch_path, tune
from reviewgate.sources import reviews as review_source
from reviewgate.sources import tables
from reviewgate.streaming import alarms as stream_alarm_jobs
from reviewgate.streaming import moderation as stream_moderation_jobs
from reviewgate.streaming import statistics as stream_statistics_jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
c = F.col
SCORES = ["toxicity_score", "bias_score", "hallucination_score"]
PERIOD = ("2024-01-01T00:00:00Z", "2025-12-31T23:59:59Z")
NOW = "2024-06-01 00:00:00"


def query(run: Query) -> Query:
    def pinned(spark: SparkSession, sf: str) -> DataFrame:
        return run(tune(spark), sf)

    QUERIES[run.__name__] = pinned
    return run


def joined(name: str, alias: str | None = None) -> Column:
    return F.array_join(name, "|").alias(alias or name.split(".")[-1])


def iso(name: str = "timestamp") -> Column:
    return isoformat(c(name)).alias(name)


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def policy_columns(*extra: str) -> list[Column]:
    return [
        c("policy_result.decision").alias("decision"),
        joined("policy_result.reasons"),
        c("policy_result.explanation").alias("explanation"),
        *[c(x) for x in extra],
    ]


# --- sources, sinks, schema conversion --------------------------------------
@query
def read_reviews(spark, sf):
    path = scratch_path(spark, "submissions")
    raw = X.submissions(spark, sf).drop("timestamp", "language", "k")
    raw.write.json(path)
    read = review_source.read_json(spark, path)
    return read.drop("source_ip", "user_agent")


@query
def prepare_input_rows(spark, sf):
    rows = prepare_input(X.reviews(spark, sf), c("timestamp"), "run-1")
    return rows.withColumn("timestamp", iso())


def _label_updates(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(
        c("doc_id").alias("k"), "toxic"
    )
    return (
        X.reviews(spark, sf)
        .join(labels, "k")
        .withColumns(
            {
                "status": F.when(c("toxic") == 1, "REJECTED").otherwise("APPROVED"),
                "timestamp": c("timestamp") + F.expr("INTERVAL 30 DAYS"),
            }
        )
        .drop("toxic")
    )


@query
def upsert_reviews(spark, sf):
    path = scratch_path(spark, "reviews")
    tables.put_by_key(path, X.reviews(spark, sf), "review_id", "timestamp")
    tables.put_by_key(path, _label_updates(spark, sf), "review_id", "timestamp")
    return spark.read.parquet(path).select(
        "review_id", "product_id", "content", "rating", "status", iso()
    )


@query
def upsert_same_version(spark, sf):
    """A put of the stored version replaces it, as every put does."""
    path = scratch_path(spark, "reviews")
    tables.put_by_key(path, X.reviews(spark, sf), "review_id", "timestamp")
    again = _label_updates(spark, sf).withColumn(
        "timestamp", c("timestamp") - F.expr("INTERVAL 30 DAYS")
    )
    tables.put_by_key(path, again, "review_id", "timestamp")
    return tables.read_by_key(spark, path).select("review_id", "content", "status", iso())


@query
def upsert_narrow_update(spark, sf):
    """Two updates per id in one put, of two columns only: the later one counts and the other
    columns stay."""
    path = scratch_path(spark, "reviews")
    tables.put_by_key(path, X.reviews(spark, sf), "review_id", "timestamp", buckets=16)
    new = _label_updates(spark, sf).select("review_id", "timestamp", "status")
    old = new.withColumns(
        {"timestamp": c("timestamp") - F.expr("INTERVAL 5 DAYS"), "status": F.lit("STALE")}
    )
    tables.put_by_key(path, old.unionByName(new), "review_id", "timestamp")
    return tables.read_by_key(spark, path).select(
        "review_id", "product_id", "content", "rating", "status", iso()
    )


@query
def put_audit_events(spark, sf):
    path = scratch_path(spark, "audit")
    tables.append_audit(X.audit_log(spark, sf), path, "1")
    return tables.read_audit(spark, path).select(
        "audit_id",
        "event_type",
        "review_id",
        F.date_format("event_date", "yyyy-MM-dd").alias("event_date"),
        iso(),
        "ttl",
    )


@query
def upsert_own_bucket_column(spark, sf):
    """Columns named like the folders of the layout are the caller's and stay."""
    path = scratch_path(spark, "own-names")
    rows = X.reviews(spark, sf).select(
        "review_id", "timestamp", c("region").alias("bucket"), c("k").alias("buckets")
    )
    tables.put_by_key(path, rows, "review_id", "timestamp", buckets=4)
    late = rows.filter("buckets % 3 = 0").withColumn("bucket", F.lit("moved"))
    tables.put_by_key(path, late, "review_id", "timestamp")
    return tables.read_by_key(spark, path).select("review_id", "bucket", "buckets")


@query
def grown_table(spark, sf):
    """Made with one row, grown by two puts that split the buckets they fill, then updated."""
    path = scratch_path(spark, "grown")
    rows = X.reviews(spark, sf).select("k", "review_id", "status", "timestamp")
    for part in (rows.filter("k = 1"), rows.filter("k % 2 = 1"), rows):
        tables.put_by_key(path, part, "review_id", "timestamp", buckets=1, bucket_rows=60)
    late = rows.filter("k % 50 = 7").withColumn("status", F.lit("LATE"))
    tables.put_by_key(path, late, "review_id", "timestamp", bucket_rows=60)
    return tables.read_by_key(spark, path).select("k", "review_id", "status")


@query
def audit_rerun_after_expiry(spark, sf):
    """A run whose expired rows were dropped runs again and replaces what is left of it."""
    path = scratch_path(spark, "rerun")
    log = X.audit_log(spark, sf)
    tables.append_audit(log.filter("processing_duration_ms % 2 = 0"), path, "007")
    tables.append_audit(log.filter("processing_duration_ms % 2 = 1"), path, "8")
    tables.drop_expired(spark, path, F.lit("2024-12-31 08:00:00").cast("timestamp"))
    tables.append_audit(log.filter("processing_duration_ms % 2 = 0"), path, "007")
    return tables.read_audit(spark, path).select("audit_id", "run")


def _raw_events(spark, sf):
    k = c("k")
    return X.submissions(spark, sf).select(
        F.concat(F.lit("audit-"), k.cast("string")).alias("audit_id"),
        "timestamp",
        X.pick(K.EVENT_TYPES + ["LOGIN"], k % 7).alias("event_type"),
        "review_id",
        "user_id",
        "product_id",
        "region",
        F.when(k % 29 == 1, -1).otherwise(k % 1000).cast("int").alias(
            "processing_duration_ms"
        ),
        F.when(k % 3 == 0, 0).when(k % 3 == 1, 128).cast("int").alias("memory_used_mb"),
        F.to_date("timestamp").alias("event_date"),
    )


@query
def batch_audit_counts(spark, sf):
    base = scratch_path(spark, "audit-batch")
    return tables.put_audit_batch(
        _raw_events(spark, sf), f"{base}/audit", f"{base}/dead", "1", now()
    )


def _summary_reviews(spark, sf):
    """Reviews with their verdict; a third of them belong to one product."""
    k = c("k")
    return X.reviews(spark, sf).select(
        "k",
        F.when(k % 3 == 0, F.lit("prod-hot"))
        .otherwise(F.concat(F.lit("prod-"), (k - k % 4).cast("string")))
        .alias("product_id"),
        "review_id",
        "content",
        "rating",
        "timestamp",
        F.when(k % 17 == 3, F.lit(None).cast("boolean"))
        .otherwise(c("toxicity_score") < 5)
        .alias("analysis_passed"),
        *SCORES,
    )


def _summary_records(spark, sf):
    stats = summaries.product_stats(_summary_reviews(spark, sf))
    answered = X.with_summary_responses(stats, "reviews_processed")
    return summaries.summary_records(answered)


@query
def put_summaries(spark, sf):
    path = scratch_path(spark, "summaries")
    rows = stored_summaries(_summary_records(spark, sf), "run-1", now())
    tables.put_by_key(path, rows, "summary_id", "generated_at")
    return spark.read.parquet(path).select(
        "summary_id",
        "product_id",
        "summary_text",
        "reviews_processed",
        "reviews_excluded",
        joined("exclusion_reasons"),
        iso("generated_at"),
    )


@query
def summary_history(spark, sf):
    """Summaries of two runs stand beside each other, a repeated run adds nothing."""
    path = scratch_path(spark, "summaries")
    records = _summary_records(spark, sf)
    for run, hours in (("run-1", 0), ("run-2", 5), ("run-1", 0)):
        rows = stored_summaries(records, run, now() + F.expr(f"INTERVAL {hours} HOURS"))
        tables.put_by_key(path, rows, "summary_id", "generated_at")
    return _summary_lookup(
        lookups.summaries_by_product(tables.read_by_key(spark, path), "prod-hot")
    )


@query
def report_sink(spark, sf):
    report = reports.build_report(
        X.audit_log(spark, sf), "compliance_summary", *PERIOD, report_id="report-1"
    )
    out = tables.write_report(report, scratch_path(spark, "reports"))
    return out.select("report_id", "report_type", "records_processed")


@query
def dead_letters(spark, sf):
    _, bad = validation.split(validation.validate_api(X.submissions(spark, sf)))
    rows = tables.write_dead_letters(bad, scratch_path(spark, "dead"), "1", now())
    return rows.select(
        F.get_json_object("row", "$.review_id").alias("review_id"),
        joined("errors"),
        iso("received_at"),
        "ttl",
    )


@query
def corrupt_submissions(spark, sf):
    """Lines of which some are cut, no JSON, or no object: good and bad ones make up all."""
    base = scratch_path(spark, "lines")
    k = c("k")
    line = F.concat(F.lit('{"review_id": "'), c("review_id"), F.lit('", "rating": 4}'))
    lines = X.reviews(spark, sf).select(
        F.when(k % 7 == 3, F.left(line, F.lit(22)))
        .when(k % 7 == 5, F.concat(F.lit("no json "), k))
        .when(k % 11 == 4, F.concat(F.lit("["), k, F.lit("]")))
        .when(k % 13 == 6, "")
        .otherwise(line)
        .alias("value")
    )
    lines.write.text(f"{base}/in")
    good, bad = review_source.read_json_lines(spark, f"{base}/in")
    tables.write_corrupt_lines(bad, f"{base}/dead", "run-1", now())
    dead = tables.read_dead_letters(spark, f"{base}/dead")
    return good.select(
        "review_id", "rating", F.lit(None).cast("string").alias("line"),
        F.lit("").alias("errors"), F.lit(False).alias("has_file"),
    ).unionByName(
        dead.select(
            F.lit(None).cast("string").alias("review_id"),
            F.lit(None).cast("string").alias("rating"),
            c("row").alias("line"), joined("errors"),
            c("source_file").contains(f"{base}/in").alias("has_file"),
        )
    )


def _stored_reviews(spark, sf):
    k = c("k")
    return X.reviews(spark, sf).withColumns(
        {
            "processing_errors": F.when(k % 4 == 0, F.array(F.lit("late"))).otherwise(
                F.array().cast("array<string>")
            ),
            "source_ip": F.when(k % 3 == 0, "").otherwise(
                F.concat(F.lit("10.0.0."), (k % 250).cast("string"))
            ),
            "user_agent": F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise("app"),
            "language": F.when(k % 6 == 0, F.lit(None).cast("string")).otherwise(
                c("language")
            ),
            "timestamp": F.when(
                k % 2 == 0, c("timestamp") + F.expr("INTERVAL 250123 MICROSECONDS")
            ).otherwise(c("timestamp")),
        }
    )


@query
def review_to_item(spark, sf):
    rows = items.review_to_item(_stored_reviews(spark, sf))
    return rows.withColumn("processing_errors", joined("processing_errors"))


@query
def review_roundtrip(spark, sf):
    rows = items.item_to_review(items.review_to_item(_stored_reviews(spark, sf)))
    return rows.select(
        "review_id",
        "content",
        "rating",
        iso(),
        "language",
        "source_ip",
        F.size("processing_errors").alias("n_errors"),
        joined("item_errors"),
    )


def _summary_rows(spark, sf):
    k = c("k")
    return X.reviews(spark, sf).select(
        F.concat(F.lit("summary-"), k.cast("string")).alias("summary_id"),
        "product_id",
        F.when(k % 31 == 1, "").otherwise("Fine.").alias("summary_text"),
        (k % 5 - F.when(k % 37 == 1, 3).otherwise(0)).cast("long").alias("reviews_processed"),
        (k % 3).cast("long").alias("reviews_excluded"),
        F.array(F.lit("HIGH_TOXICITY")).alias("exclusion_reasons"),
        F.when(k % 4 != 0, c("toxicity_score")).alias("summary_quality_score"),
        F.when(k % 7 != 0, c("bias_score")).alias("factual_accuracy_score"),
        c("timestamp").alias("generated_at"),
        F.create_map(F.lit("max_toxicity"), F.lit(5.0)).alias("policy_constraints"),
    )


@query
def summary_to_item(spark, sf):
    stored = items.summary_to_item(_summary_rows(spark, sf))
    back = items.item_to_summary(stored)
    return back.select(
        "summary_id",
        "product_id",
        "reviews_processed",
        "reviews_excluded",
        joined("exclusion_reasons"),
        iso("generated_at"),
        c("policy_constraints")["max_toxicity"].alias("max_toxicity"),
        "summary_quality_score",
        "factual_accuracy_score",
    )


@query
def audit_roundtrip(spark, sf):
    events = _raw_events(spark, sf).withColumn(
        "ttl", F.when(c("memory_used_mb") == 0, F.lit(1).cast("long"))
    )
    back = items.item_to_audit(items.audit_to_item(events))
    return back.select(
        "audit_id",
        iso(),
        "event_type",
        "region",
        "processing_duration_ms",
        "memory_used_mb",
        "ttl",
    )


@query
def fill_explanations(spark, sf):
    rows = X.analysis_of(X.reviews(spark, sf)).withColumn(
        "filled", analysis.fill_explanations(c("analysis.explanations"))
    )
    return rows.select(
        "review_id",
        *[c("filled")[a].alias(a) for a in K.ASPECTS],
        F.size("filled").alias("n_keys"),
    )


@query
def search_document(spark, sf):
    return items.search_document(X.audit_log(spark, sf)).withColumnRenamed(
        "@timestamp", "event_time"
    )


@query
def json_roundtrip(spark, sf):
    rows = _stored_reviews(spark, sf).select(
        "review_id", "content", "rating", "timestamp", "processing_errors", "source_ip"
    )
    schema = T.StructType([REVIEW[x] for x in rows.columns])
    back = items.from_json_text(items.to_json_text(rows), schema)
    return back.withColumns(
        {"timestamp": iso(), "processing_errors": joined("processing_errors")}
    )


@query
def decimal_roundtrip(spark, sf):
    rows = X.reviews(spark, sf).select(
        "review_id",
        F.struct("toxicity_score", F.array("bias_score").alias("rest")).alias("scores"),
        F.create_map(F.lit("hallucination"), c("hallucination_score")).alias("more"),
    )
    back = items.decimals_to_floats(items.floats_to_decimals(rows))
    return back.select(
        "review_id",
        c("scores.toxicity_score").alias("toxicity_score"),
        c("scores.rest")[0].alias("bias_score"),
        c("more")["hallucination"].alias("hallucination_score"),
    )


# --- validation -------------------------------------------------------------
@query
def validate_api(spark, sf):
    rows = validation.validate_api(X.submissions(spark, sf))
    return rows.select("review_id", joined("errors"))


@query
def validate_model(spark, sf):
    rows = validation.validate_model(X.submissions(spark, sf))
    return rows.select("review_id", "content", joined("errors"))


def _submitted(spark, sf):
    """Submissions with a response each, read strictly."""
    keys = X.reviews(spark, sf).select("k", *SCORES)
    rows = X.submissions(spark, sf).join(keys, "k")
    return analysis.audit_response(
        validation.input_defaults(X.with_responses(rows)), "raw_response"
    )


def _analysis_columns() -> list[Column]:
    return [c("analysis")[s].alias(s) for s in SCORES]


@query
def auditor_gate(spark, sf):
    return _submitted(spark, sf).select(
        "review_id",
        "status_code",
        "error",
        *_analysis_columns(),
        c("analysis.explanations")["toxicity"].alias("toxicity_note"),
    )


def _stretched(spark, sf):
    rows = X.with_gaps(X.reviews(spark, sf))
    return rows.withColumns({s: c(s) * 1.25 - 1.0 for s in SCORES})


@query
def score_range(spark, sf):
    rows = validation.validate_scores(_stretched(spark, sf))
    return rows.select("review_id", joined("errors"))


@query
def clamp_scores(spark, sf):
    return _stretched(spark, sf).select("review_id", *[clamp(c(s)).alias(s) for s in SCORES])


@query
def validate_summary(spark, sf):
    rows = validation.validate_summary(_summary_rows(spark, sf))
    return rows.select("summary_id", joined("errors"))


@query
def validate_audit(spark, sf):
    rows = validation.validate_audit(_raw_events(spark, sf))
    return rows.select("audit_id", joined("errors"))


@query
def input_defaults(spark, sf):
    rows = validation.input_defaults(X.submissions(spark, sf))
    return rows.select("review_id", "product_category", "rating", "rating_error")


@query
def numeric_ratings(spark, sf):
    """Ratings that arrive as numbers with a fraction are cut to whole ones."""
    k = c("k")
    rating = (k % 7).cast("double") + (k % 2).cast("double") / 2
    rows = validation.input_defaults(
        X.reviews(spark, sf).withColumn("rating", F.when(k % 11 != 0, rating))
    )
    return rows.select("review_id", "rating", "rating_error")


@query
def suffixed_numbers(spark, sf):
    """Numbers in texts, as Python's float reads them."""
    texts = ["7d", "7", "3.5F", "1e3", " 2.5 ", "seven", "0x10"]
    text = X.pick(texts, c("k") % len(texts))
    return X.reviews(spark, sf).select(
        "review_id", R.number(F.concat(F.lit('"'), text, F.lit('"'))).alias("value")
    )


# --- scoring and response parsing -------------------------------------------
@query
def analysis_prompt(spark, sf):
    return prompts.analysis_prompt(X.reviews(spark, sf)).select("review_id", "prompt")


@query
def aspect_prompts(spark, sf):
    return prompts.aspect_prompts(X.reviews(spark, sf)).select(
        "review_id", *[f"{a}_prompt" for a in K.ASPECTS]
    )


def length_scorer(more: int = 0):
    """A stand-in model: scores follow the prompt's length, some calls fail."""

    def score(prompt: str) -> str:
        n = len(prompt) + more
        if n % 13 == 0:
            raise RuntimeError("model unavailable")
        return (
            f'{{"toxicity_score": {n % 101 / 10}, "bias_score": {n % 89 / 10}, '
            f'"hallucination_score": {n % 97 / 10}}}'
        )

    return score


@query
def score_reviews(spark, sf):
    """Texts repeat across documents, so fewer calls than rows are made."""
    rows = scored_reviews(X.reviews(spark, sf), length_scorer(), base_delay=0.0)
    read = analysis.audit_response(
        validation.input_defaults(rows), "raw_response", "call_error"
    )
    return read.select("review_id", "call_error", "status_code", *_analysis_columns())


@query
def rescored_reviews(spark, sf):
    """Half of the reviews, then all of them by a model that answers differently: answers of
    the first run come from the store, its failed calls are made again."""
    rows = X.reviews(spark, sf)
    kept = {"path": scratch_path(spark, "responses"), "model": "length"}
    options = {"base_delay": 0.0}
    first = kept | {"run_id": "1"}
    scored_reviews(rows.filter("k % 2 = 0"), length_scorer(), store=first, **options)
    second = kept | {"run_id": "2"}
    again = scored_reviews(rows, length_scorer(more=1), store=second, **options)
    read = analysis.audit_response(
        validation.input_defaults(again), "raw_response", "call_error"
    )
    return read.select("review_id", "call_error", "status_code", *_analysis_columns())


@query
def parse_strict(spark, sf):
    rows = validation.input_defaults(X.with_responses(X.reviews(spark, sf)))
    return analysis.audit_response(rows).select(
        "review_id",
        "status_code",
        "error",
        *_analysis_columns(),
        c("analysis.explanations")["toxicity"].alias("toxicity_note"),
        c("analysis.explanations")["hallucination"].alias("hallucination_note"),
    )


@query
def parse_tolerant(spark, sf):
    rows = analysis.parse_tolerant(X.with_responses(X.reviews(spark, sf)))
    return rows.select(
        "review_id",
        *[R.as_text(R.member(c("parsed"), s)).alias(s) for s in SCORES],
        "error",
        "raw_content",
    )


def _aspects(spark, sf):
    return X.with_aspect_responses(X.reviews(spark, sf)).drop(*SCORES)


@query
def comprehensive_analysis(spark, sf):
    rows = analysis.comprehensive_analysis(_aspects(spark, sf))
    return rows.select(
        "review_id",
        *_analysis_columns(),
        *[
            c("analysis.explanations")[a].alias(f"{a}_note")
            for a in K.ASPECTS
        ],
        c("analysis.confidence_scores")["bias"].alias("bias_confidence"),
        joined("toxicity.detected_issues"),
        c("bias.threshold_exceeded").alias("bias_exceeded"),
        "analysis_error",
    )


@query
def batch_analysis(spark, sf):
    rows = analysis.batch_analysis(_aspects(spark, sf))
    return rows.select(
        "review_id",
        *_analysis_columns(),
        c("analysis.explanations")["toxicity"].alias("toxicity_note"),
    )


def aspect_scorer():
    """A stand-in model that answers single-aspect prompts."""

    def score(prompt: str) -> str:
        n = len(prompt)
        for aspect, modulus in (("toxicity", 101), ("bias", 89), ("hallucination", 97)):
            if f'"{aspect}_score"' in prompt[-600:]:
                if n % 19 == 0:
                    raise RuntimeError("model unavailable")
                return (
                    f'{{"{aspect}_score": {n % modulus / 10}, '
                    f'"explanation": "{n} characters", "confidence": 0.75}}'
                )
        return ""

    return score


@query
def analyze_content(spark, sf):
    """Three prompts per review, one scoring pass, tolerant reading, risk."""
    rows = analysis_plans.analyze_content(
        X.reviews(spark, sf).drop(*SCORES), aspect_scorer(), base_delay=0.0
    )
    return rows.select(
        "review_id",
        *_analysis_columns(),
        c("analysis.explanations")["bias"].alias("bias_note"),
        "analysis_error",
        *_risk_columns(),
    )


def _risk_columns() -> list[Column]:
    return [
        c("risk.risk_level").alias("risk_level"),
        c("risk.max_score").alias("max_score"),
        joined("risk.threshold_violations"),
        c("risk.should_approve").alias("should_approve"),
    ]


@query
def risk_summary(spark, sf):
    rows = analysis.risk_summary(X.analysis_of(X.reviews(spark, sf)))
    return rows.select("review_id", *_risk_columns())


@query
def analyze_reviews(spark, sf):
    rows = _aspects(spark, sf).withColumn(
        "processing_errors", F.array().cast("array<string>")
    )
    done = analysis.analyze_reviews(rows)
    return done.select("review_id", "status", joined("processing_errors"))


@query
def analyzer_thresholds(spark, sf):
    limits = analysis.update_thresholds(toxicity=15.0, bias=-1.0, hallucination=4.5)
    rows = analysis.risk_summary(X.analysis_of(X.reviews(spark, sf)), limits)
    return rows.select("review_id", *_risk_columns())


@query
def model_cost_rows(spark, sf):
    return model_cost(X.reviews(spark, sf)).select(
        "review_id",
        "cost_usd",
        c("model_metadata.model_id").alias("model_id"),
        c("model_metadata.inference_config")["maxTokens"].alias("max_tokens"),
    )


@query
def mock_scores_rows(spark, sf):
    return mock_scores(X.reviews(spark, sf).drop(*SCORES)).select(
        "review_id",
        *_analysis_columns(),
        c("analysis.explanations")["bias"].alias("bias_note"),
        "processing_time_ms",
    )


# --- policy -----------------------------------------------------------------
def _scored(spark, sf):
    return X.analysis_of(X.with_gaps(X.reviews(spark, sf)))


@query
def unknown_mode_rows(spark, sf):
    rows = unknown_modes(_scored(spark, sf))
    return rows.select("review_id", "compliance_mode", "policy_error")


@query
def join_stages(spark, sf):
    base = X.decided(X.reviews(spark, sf))
    stages = lookups.join_stages(
        X.reviews(spark, sf).select("review_id", "rating"),
        base.select("review_id", "analysis"),
        base.select("review_id", "policy_result"),
    )
    return stages.select(
        "review_id", "rating", *_analysis_columns(), c("policy_result.decision").alias("decision")
    )


@query
def threshold_policy_rows(spark, sf):
    rows = threshold_policy(_scored(spark, sf))
    limits = [c("policy_result.thresholds_applied")[a].alias(f"{a}_limit") for a in K.ASPECTS]
    return rows.select("review_id", *policy_columns(), *limits)


@query
def content_policy_rows(spark, sf):
    rows = content_policy(_scored(spark, sf))
    return rows.select("review_id", *policy_columns("policy_error"))


@query
def half_defined_modes(spark, sf):
    """A mode with one limit of three is no mode; the rows' own columns stay."""
    half = PolicySet().updated({"toxicity": {"lenient": 9.0}})
    rows = _scored(spark, sf).withColumns({"credit_limit": c("k"), "x_max_y": c("k") + 1})
    unknown = unknown_modes(rows, half).select("review_id", F.lit(True).alias("_unknown"))
    judged = content_policy(rows, policies=half).join(unknown, "review_id", "left")
    return judged.select(
        "review_id",
        c("policy_result.decision").alias("decision"),
        "policy_error",
        "credit_limit",
        "x_max_y",
        F.coalesce("_unknown", F.lit(False)).alias("is_unknown"),
    )


@query
def summary_policy_rows(spark, sf):
    reviews = X.reviews(spark, sf)
    context = ["region", "product_category", "compliance_mode"]
    rows = summary_policy(X.policy_summary_rows(reviews).join(reviews.select("k", *context), "k"))
    stated = [c(f"policy_result.metadata.context.{x}").alias(x) for x in context]
    return rows.select("review_id", *policy_columns(), *stated)


POLICY_UPDATES = {
    "toxicity": {"standard": 7.0, "lenient": 9.0},
    "bias": {"lenient": 9.0},
    "hallucination": {"lenient": 9.5},
    "regional_compliance": {"eu-west-1": {"max_toxicity": 6.0}},
    "category_restrictions": {"books": {"max_bias": 3.0}},
    "shipping": {"late": 1.0},
}


@query
def update_policies(spark, sf):
    """Decisions of all reviews before and after a policy update."""
    before = content_policy(_scored(spark, sf)).withColumnRenamed("policy_result", "old")
    after = content_policy(
        before.drop("policy_error"), policies=PolicySet().updated(POLICY_UPDATES)
    )
    return after.select(
        "review_id",
        c("old.decision").alias("old_decision"),
        *policy_columns("policy_error"),
    )


#: Minutes from the first review on, and what changes then.
POLICY_VERSIONS = {
    100: POLICY_UPDATES,
    400: {
        "toxicity": {"standard": 4.0},
        "regional_compliance": {"eu-west-1": {"max_bias": 1.5}},
        "category_restrictions": {"books": {"max_toxicity": 2.5}},
    },
}


def _policy_history(spark) -> PolicyHistory:
    path = scratch_path(spark, "policies")
    for minute in sorted(POLICY_VERSIONS, reverse=True):  # the later one is registered first
        at = datetime.fromisoformat(X.START) + timedelta(minutes=minute)
        tables.write_policy_update(spark, path, POLICY_VERSIONS[minute], at, f"update-{minute}")
    return tables.read_policy_history(spark, path)


@query
def policy_versions(spark, sf):
    """Both policies with the limits that were in force when a review came."""
    history = _policy_history(spark)
    content = content_policy(_scored(spark, sf), policies=history)
    both = threshold_policy(
        content.withColumnRenamed("policy_result", "full"), policies=history
    )
    limits = [c("policy_result.thresholds_applied")[a].alias(f"{a}_limit") for a in K.ASPECTS]
    return both.select(
        "review_id",
        c("full.decision").alias("content_decision"),
        joined("full.reasons", "content_reasons"),
        c("full.explanation").alias("content_explanation"),
        "policy_error",
        c("policy_result.decision").alias("threshold_decision"),
        *limits,
    )


@query
def policy_listing(spark, sf):
    """Every policy rule with the number of reviews it governs."""
    pairs = F.array(
        *[
            F.struct(F.lit(kind).alias("key_kind"), c(name).alias("policy_key"))
            for kind, name in (
                ("mode", "compliance_mode"),
                ("region", "region"),
                ("category", "product_category"),
            )
        ]
    )
    counts = (
        X.reviews(spark, sf)
        .select(F.explode(pairs).alias("_p"))
        .select("_p.*")
        .groupBy("key_kind", "policy_key")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    kind = (
        F.when(c("policy_type") == "regional_compliance", "region")
        .when(c("policy_type") == "category_restrictions", "category")
        .otherwise("mode")
    )
    rules = PolicySet().listing(spark).withColumn("key_kind", kind)
    return (
        rules.join(counts, ["key_kind", "policy_key"], "left")
        .withColumn("n_reviews", F.coalesce("_n", F.lit(0)))
        .drop("_n", "key_kind")
    )


def _decided(spark, sf):
    return X.decided(X.reviews(spark, sf))


@query
def audit_sink_failure(spark, sf):
    """No audit log can be written: the flow goes on and all decisions are set aside."""
    out = scratch_path(spark, "no-audit")
    blocked = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/audit")
    # A file stands where the log's folder would be.
    blocked.getFileSystem(spark._jsc.hadoopConfiguration()).create(blocked).close()
    decided = tables.write_rows(model_cost(_decided(spark, sf)), f"{out}/decisions", "run-1")
    logged = log_decisions(decided, out, "run-1", now())
    answered = tables.write_rows(routing.responses(decided), f"{out}/responses", "run-1")
    aside = tables.read_dead_letters(spark, f"{out}/audit_dead_letters")
    fields = {
        "review_id": "$.review_id",
        "decision": "$.policy_result.decision",
        "execution_id": "$.execution_id",
    }
    rows = aside.select(
        *[F.get_json_object("row", path).alias(name) for name, path in fields.items()],
        joined("errors"),
        (F.lit(logged is None)).alias("is_unlogged"),
    )
    return rows.join(answered.select("review_id", "status_code"), "review_id")


@query
def route_approved(spark, sf):
    return routing.route_approved(_decided(spark, sf)).select(
        "review_id", *_analysis_columns(), "summary"
    )


@query
def route_rejected(spark, sf):
    return routing.route_rejected(_decided(spark, sf)).select(
        "review_id", *_analysis_columns(), *policy_columns()
    )


def _response_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "status_code",
        "result",
        "review_id",
        "product_id",
        "policy_decision",
        "analysis_summary.*",
        joined("policy_reasons"),
        "summary",
        "rejection_explanation",
        c("processing_metadata.execution_id").alias("execution_id"),
        isoformat(c("processing_metadata.timestamp")).alias("timestamp"),
        c("processing_metadata.audit_logged").alias("audit_logged"),
    )


@query
def moderate_reviews(spark, sf):
    return _response_columns(routing.responses(_decided(spark, sf)))


@query
def error_fallbacks(spark, sf):
    """Stages that failed for some reviews are replaced by their fallbacks."""
    rows = threshold_policy(_scored(spark, sf)).withColumn("summary", F.lit("A summary."))
    done = routing.error_fallbacks(
        rows, c("k") % 5 == 1, c("k") % 7 == 2, c("k") % 11 == 3
    )
    return done.select(
        "review_id",
        *_analysis_columns(),
        c("analysis.explanations")["bias"].alias("bias_note"),
        *policy_columns("summary", "error_type"),
        c("summary_metadata.reviews_excluded").alias("reviews_excluded"),
    )


# --- summaries --------------------------------------------------------------
@query
def product_summary_stats(spark, sf):
    return summaries.product_stats(_summary_reviews(spark, sf))


@query
def all_rejected_products(spark, sf):
    rows = summaries.rejected_products(summaries.product_stats(_summary_reviews(spark, sf)))
    return rows.withColumns(
        {
            "key_themes": joined("key_themes"),
            "exclusion_reasons": joined("exclusion_reasons"),
        }
    )


@query
def summary_prompt(spark, sf):
    reviews = _summary_reviews(spark, sf)
    hot = lookups.hot_keys(reviews, ["product_id"], share=0.05)
    return summaries.summary_prompts(reviews, hot).select(
        "product_id", "reviews_included", "prompt"
    )


@query
def parse_summary(spark, sf):
    rows = summaries.parse_summary(X.with_summary_responses(X.reviews(spark, sf)))
    return rows.select(
        "review_id", "summary", "sentiment", "confidence", joined("key_themes"), "status_code"
    )


@query
def summary_records(spark, sf):
    rows = _summary_records(spark, sf)
    return rows.withColumns(
        {
            "key_themes": joined("key_themes"),
            "exclusion_reasons": joined("exclusion_reasons"),
        }
    )


@query
def products_without_reviews(spark, sf):
    products = spark.read.parquet(f"{sf}/part.parquet").select(
        F.concat(F.lit("prod-"), c("p_partkey").cast("string")).alias("product_id")
    )
    return summaries.products_without_reviews(products, X.reviews(spark, sf))


@query
def constrained_prompt(spark, sf):
    rows = summaries.review_parts(_summary_reviews(spark, sf))
    return prompts.constrained_prompt(rows).select(
        "product_id", "part", "parts", "prompt", "max_tokens"
    )


def counting_summariser():
    """A stand-in model that tells what it was sent."""

    def summarise(prompt: str, max_tokens: int) -> str:
        return (
            f'{{"summary": "{len(prompt)} characters", "confidence": 0.5, '
            f'"sources_used": {max_tokens}}}'
        )

    return summarise


@query
def limited_summaries(spark, sf):
    """Every part of every product's reviews through the scorer, with the token budget."""
    rows = summarise_within_limits(_summary_reviews(spark, sf), counting_summariser())
    return rows.select("product_id", "part", "summary", "confidence", "sources_used", "error")


def adding_summariser():
    """A stand-in model that counts the reviews of a part, or adds up those behind summaries."""

    def summarise(prompt: str, max_tokens: int) -> str:
        import re

        below = re.findall(r"(?m)^Summary of (\d+) reviews: \1 reviews", prompt)
        n = sum(map(int, below)) or len(re.findall(r"(?m)^Rating: \d/5 - ", prompt))
        return f'{{"summary": "{n} reviews", "confidence": 0.5, "sources_used": {n}}}'

    return summarise


@query
def product_summary_tree(spark, sf):
    """One summary per product from parts of 5,000 characters, three at a time."""
    rows = summarise_tree(
        _summary_reviews(spark, sf), adding_summariser(), part_chars=5000, fan_in=3
    )
    return rows.select(
        "product_id", "summary", "confidence", "sources_used", "n_parts", "failed_parts", "error"
    )


@query
def constrained_summary(spark, sf):
    rows = X.with_summary_responses(X.reviews(spark, sf))
    return summaries.read_constrained_summary(rows).select(
        "review_id", "summary", "confidence", "error", "raw_content"
    )


# --- reports ----------------------------------------------------------------
@query
def audit_statistics(spark, sf):
    rows = reports.audit_statistics(X.audit_log(spark, sf), *PERIOD)
    return rows.select(
        "total_events",
        *[
            F.coalesce(c("events_by_type")[t], F.lit(0)).alias(f"n_{t.lower()}")
            for t in ("ANALYSIS", "POLICY_DECISION")
        ],
        "policy_violations",
        "average_processing_time",
        "total_cost",
    )


@query
def events_by_type(spark, sf):
    rows = reports.events_by_type(X.audit_log(spark, sf), *PERIOD)
    return rows.withColumn("cost", c("cost").cast("double"))


ROLLUP_PERIOD = ("2024-01-03T05:00:00Z", "2024-01-08T10:00:00Z")
EXPIRY = "2025-01-03 08:00:00"


@query
def rollup_statistics(spark, sf):
    """Daily sums of three runs, compacted, one run repeated, then expired: read for a period
    that begins and ends within a day."""
    log, path = scratch_path(spark, "rolled-log"), scratch_path(spark, "rolled-sums")
    days = F.pmod(c("processing_duration_ms"), F.lit(10)).cast("int")
    rows = X.audit_log(spark, sf).withColumns(
        {
            "timestamp": c("timestamp") + F.make_dt_interval(days),
            "ttl": c("ttl") + days * 86400,
            "event_date": F.date_add("event_date", days),
        }
    )
    part = F.pmod(c("processing_duration_ms"), F.lit(3))
    for run in (0, 1, 2, 1):
        written = tables.append_audit(rows.filter(part == run), log, run)
        rollup.append_rollup(written, path, run, log)
        if run == 2:
            rollup.compact_rollup(spark, path, datetime(2024, 1, 6).date())
    rollup.expire(spark, log, path, F.lit(EXPIRY).cast("timestamp"))
    sums = rollup.type_sums(spark, log, path, *ROLLUP_PERIOD)
    return sums.select(
        "event_type", "events", "violations", "duration_ms", c("cost").cast("double").alias("cost"),
        "analysed", "time_min", "time_max", c("time_sum").cast("double").alias("time_sum"), "time_n",
        "toxicity_min", "toxicity_max", "toxicity_n",
    )


@query
def compliance_summary(spark, sf):
    rows = reports.compliance_summary(
        reports.audit_statistics(X.audit_log(spark, sf), *PERIOD)
    )
    return rows.select(
        "summary.*",
        c("event_breakdown")["ANALYSIS"].alias("n_analysis"),
        c("compliance_metrics.approved_content").alias("approved_content"),
        c("compliance_metrics.rejection_rate_percent").alias("rejection_rate_percent"),
        c("performance_metrics.total_processing_time_ms").alias("total_processing_time_ms"),
        c("performance_metrics.cost_per_event_usd").alias("cost_per_event_usd"),
    )


def _violations(spark, sf):
    return reports.violations(X.audit_log(spark, sf), *PERIOD)


@query
def violations_summary(spark, sf):
    return reports.violations_summary(_violations(spark, sf))


@query
def violation_breakdown(spark, sf):
    return reports.violation_breakdown(_violations(spark, sf))


@query
def violations_detail(spark, sf):
    rows = reports.violations_detail(_violations(spark, sf))
    return rows.withColumns(
        {"timestamp": iso(), "violation_reasons": joined("violation_reasons")}
    )


@query
def top_violation_types(spark, sf):
    return reports.top_violation_types(reports.violation_breakdown(_violations(spark, sf)))


@query
def processing_stats(spark, sf):
    rows = reports.processing_stats(X.audit_log(spark, sf), *PERIOD)
    times = c("processing_performance.processing_times_ms")
    toxicity = c("content_analysis_scores.toxicity_scores")
    return rows.select(
        "summary.*",
        *[times[x].alias(f"time_{x}") for x in ("min", "max", "avg", "count")],
        *[toxicity[x].alias(f"toxicity_{x}") for x in ("min", "max", "avg", "count")],
        c("processing_performance.total_cost_usd").alias("total_cost_usd"),
        c("processing_performance.average_cost_per_event").alias("average_cost_per_event"),
        c("event_type_distribution")["POLICY_DECISION"].alias("n_policy_decision"),
    )


@query
def report_envelope(spark, sf):
    """All three reports as JSON, reduced to members SQL can compute too."""
    audit = X.audit_log(spark, sf)
    rows = None
    for kind, member in (
        ("compliance_summary", "$.summary.policy_violations"),
        ("policy_violations", "$.summary.total_violations"),
        ("processing_stats", "$.summary.total_events_processed"),
    ):
        one = reports.build_report(
            audit, kind, *PERIOD, report_id=f"r-{kind}", generated_at=datetime(2026, 1, 1)
        ).select(
            "report_id",
            "report_type",
            "records_processed",
            F.get_json_object("report_json", member).cast("long").alias("headline"),
            F.get_json_object("report_json", "$.report_metadata.period.start_date").alias(
                "start_date"
            ),
            F.get_json_object("report_json", "$.report_metadata.filters").alias("filters"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


# --- lookups ----------------------------------------------------------------
def _audit_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "audit_id",
        iso(),
        "event_type",
        "review_id",
        "user_id",
        "product_id",
        c("policy_decision.decision").alias("decision"),
        "processing_duration_ms",
    )


@query
def audit_by_key(spark, sf):
    log = X.audit_log(spark, sf)
    # The audit id of review 17, which is logged at 00:17.
    return _audit_columns(
        lookups.audit_event(
            log,
            "audit-20240101-001700-0eb3ae5608c2a826bc1913099c79dcbb",
            datetime(2024, 1, 1, 0, 17),
        )
    )


@query
def audit_by_review(spark, sf):
    return _audit_columns(lookups.audit_by_review(X.audit_log(spark, sf), "rev-17"))


@query
def audit_by_user(spark, sf):
    return _audit_columns(lookups.audit_by_user(X.audit_log(spark, sf), "user-5"))


@query
def audit_by_product(spark, sf):
    return _audit_columns(lookups.audit_by_product(X.audit_log(spark, sf), "prod-7"))


@query
def audit_by_type(spark, sf):
    return _audit_columns(lookups.audit_by_type(X.audit_log(spark, sf), "POLICY_DECISION"))


@query
def lookup_layout(spark, sf):
    """A lookup through the stored copy that is laid out by its key."""
    path = scratch_path(spark, "audit-by-user")
    tables.write_access_path(X.audit_log(spark, sf), path, "user_id", buckets=16)
    rows = tables.read_access_path(spark, path, "user_id", "user-5")
    return _audit_columns(lookups.audit_by_user(rows, "user-5"))


def _review_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "review_id", "product_id", "user_id", "status", "rating", iso(), "content"
    )


@query
def review_by_id(spark, sf):
    return _review_columns(lookups.review_by_id(X.reviews(spark, sf), "rev-42"))


@query
def reviews_by_product(spark, sf):
    return _review_columns(lookups.reviews_by_product(X.reviews(spark, sf), "prod-7"))


@query
def reviews_by_user(spark, sf):
    return _review_columns(lookups.reviews_by_user(X.reviews(spark, sf), "user-5"))


@query
def reviews_by_status(spark, sf):
    return _review_columns(lookups.reviews_by_status(X.reviews(spark, sf), "REJECTED"))


def _summary_lookup(rows: DataFrame) -> DataFrame:
    return rows.select(
        "summary_id", "product_id", "reviews_processed", iso("generated_at")
    )


@query
def summary_by_id(spark, sf):
    return _summary_lookup(lookups.summary_by_id(_summary_rows(spark, sf), "summary-42"))


@query
def summaries_by_product(spark, sf):
    return _summary_lookup(lookups.summaries_by_product(_summary_rows(spark, sf), "prod-7"))


@query
def update_status(spark, sf):
    reviews = X.reviews(spark, sf).withColumn(
        "processing_errors", F.array(F.lit("earlier"))
    )
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(
        F.concat(F.lit("rev-"), c("doc_id").cast("string")).alias("review_id"),
        F.when(c("toxic") == 1, "REJECTED").otherwise("APPROVED").alias("status"),
        F.when(c("quality") == 0, F.array(F.lit("low quality")))
        .otherwise(F.array().cast("array<string>"))
        .alias("processing_errors"),
    )
    rows = lookups.update_status(reviews, labels)
    return rows.select("review_id", "status", joined("processing_errors"))


@query
def latest_n_per_key(spark, sf):
    reviews = _summary_reviews(spark, sf)
    hot = lookups.hot_keys(reviews, ["product_id"], share=0.05)
    rows = lookups.latest_n_per_key(reviews, "product_id", 5, hot=hot)
    return rows.select("product_id", "review_id", iso(), "rank")


@query
def latest_per_key(spark, sf):
    rows = lookups.latest_per_key(X.versions(X.reviews(spark, sf)), "review_id", "timestamp")
    return rows.select("review_id", "k", "status", iso())


# --- audit log --------------------------------------------------------------
@query
def audit_records_rows(spark, sf):
    rows = audit_records(_decided(spark, sf), event_time=c("timestamp"))
    return rows.select(
        "audit_id",
        iso(),
        "event_type",
        "review_id",
        "user_id",
        "product_id",
        "region",
        *[c("analysis_results")[s].alias(s) for s in SCORES],
        c("policy_decision.approved").alias("approved"),
        joined("policy_decision.policy_violations"),
        joined("policy_decision.reasons"),
        c("policy_decision.decision_rationale").alias("decision_rationale"),
        "processing_duration_ms",
        "ttl",
    )


@query
def ttl_stamp_rows(spark, sf):
    rows = X.reviews(spark, sf).withColumn(
        "ttl", F.when(c("k") % 9 == 0, F.lit(1).cast("long"))
    )
    return rows.select(
        "review_id",
        ttl_stamp(c("timestamp"), K.LOG_RETENTION_DAYS, c("ttl")).alias("ttl"),
        ttl_stamp(c("timestamp"), K.MODEL_RETENTION_DAYS).alias("model_ttl"),
    )


@query
def expire_audit_rows(spark, sf):
    path = scratch_path(spark, "unexpired")
    moment = F.lit("2024-12-31 08:00:00").cast("timestamp")
    kept = tables.rewrite_unexpired(X.audit_log(spark, sf), path, moment)
    return expire_audit(kept, moment).select("audit_id", "ttl")


@query
def drop_expired_rows(spark, sf):
    """Expired days are dropped from the stored log; rows without an expiry stay."""
    path = scratch_path(spark, "expiring")
    lasting = F.when(c("user_id") != "user-5", c("ttl"))
    tables.append_audit(X.audit_log(spark, sf).withColumn("ttl", lasting), path, "1")
    tables.drop_expired(spark, path, F.lit("2024-12-31 08:00:00").cast("timestamp"))
    return tables.read_audit(spark, path).select("audit_id", "ttl")


@query
def moderation_job(spark, sf):
    """The whole batch job with a scorer: answers, audit rows and refused rows."""
    done = run_moderation(
        X.reviews(spark, sf).drop(*SCORES, "timestamp"),
        length_scorer(),
        scratch_path(spark, "moderation"),
        run_id="run-1",
        entered_at=datetime(2024, 6, 1),
        base_delay=0.0,
    )
    logged = done["audit"].select("review_id", "event_type")
    answered = done["responses"].select("review_id", c("result").alias("outcome"))
    refused = done["dead_letters"].select(
        F.get_json_object("row", "$.review_id").alias("review_id"),
        F.lit("REFUSED").alias("outcome"),
        F.lit(None).cast("string").alias("event_type"),
    )
    return answered.join(logged, "review_id").unionByName(refused)


# --- metrics, alarms, streams -----------------------------------------------
@query
def metrics_5min(spark, sf):
    rows = metrics.function_metrics(X.call_events(spark, sf))
    return rows.withColumns({"window_start": iso("window_start"), "window_end": iso("window_end")})


@query
def metrics_hourly(spark, sf):
    rows = metrics.hourly_invocations(X.call_events(spark, sf))
    return rows.withColumn("window_start", iso("window_start"))


HOURLY_RULES = [
    ("review-auditor-errors", "review-auditor", "errors", 3.0, 2),
    ("review-auditor-duration", "review-auditor", "mean_duration_ms", 240000.0, 2),
    ("workflow-failures", "workflow", "errors", 5.0, 2),
    ("policy-validator-errors", "policy-validator", "errors", 2.0, 2),
    ("review-summarizer-errors", "review-summarizer", "errors", 2.0, 2),
    ("audit-logger-errors", "audit-logger", "errors", 1.0, 3),
]


@query
def alarms(spark, sf):
    """The alarm rules over hourly windows, with thresholds the events can reach."""
    values = metrics.metric_values(metrics.function_metrics(X.call_events(spark, sf), "1 hour"))
    rows = metrics.alarms(values, 3600, HOURLY_RULES)
    return rows.withColumn("alarm_window", iso("alarm_window"))


@query
def alarms_5min(spark, sf):
    """The alarm rules as they stand, over their own windows."""
    values = metrics.metric_values(metrics.function_metrics(X.call_events(spark, sf)))
    return metrics.alarms(values).withColumn("alarm_window", iso("alarm_window"))


@query
def alarm_transitions(spark, sf):
    """States of the hourly alarms over a stream of all calls; a last call a day later closes
    every window."""
    base = scratch_path(spark, "alarm-states")
    rows = X.call_events(spark, sf)
    last = rows.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(
        F.lit("none").alias("function"), "ts", F.lit(False).alias("is_error"),
        F.lit(0).cast("long").alias("duration_ms"),
    )
    rows.unionByName(last).write.parquet(f"{base}/in")
    arriving = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    stream_alarm_jobs.start_alarm_states(
        arriving, f"{base}/out", f"{base}/checkpoint", "1 hour", "1 hour", HOURLY_RULES
    ).awaitTermination()
    changes = spark.read.parquet(f"{base}/out").withColumn("alarm_window", iso("alarm_window"))
    return changes.select("alarm", "alarm_window", "state_before", "state")


@query
def stream_moderation(spark, sf):
    base = scratch_path(spark, "stream")
    arriving = X.with_summary_responses(
        X.with_responses(X.with_review_columns(X.stream_documents(spark, sf)))
    )

    def decide_rows(rows):
        prepared = prepare_input(
            rows, c("timestamp"), "run-1", ["raw_response", "summary_response"]
        )
        return decide(prepared, summary_response="summary_response")

    stream_moderation_jobs.start_moderation(
        arriving, base, f"{base}/checkpoint", decide_rows
    ).awaitTermination()
    return _response_columns(spark.read.parquet(f"{base}/responses"))


@query
def stream_audit_stats(spark, sf):
    base = scratch_path(spark, "stream-stats")
    log = X.audit_of(X.with_review_columns(X.stream_documents(spark, sf)))
    stream_statistics_jobs.start_audit_statistics(
        log, f"{base}/out", f"{base}/checkpoint"
    ).awaitTermination()
    rows = stream_statistics_jobs.read_statistics(spark, f"{base}/out")
    return rows.withColumns({"window_start": iso("window_start"), "window_end": iso("window_end")})


@query
def stream_metrics(spark, sf):
    base = scratch_path(spark, "stream-metrics")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    events = X.stream_table(spark, sf, "events", schema)
    stream_statistics_jobs.start_function_metrics(
        X.calls(events), f"{base}/out", f"{base}/checkpoint"
    ).awaitTermination()
    rows = stream_statistics_jobs.read_metrics(spark, f"{base}/out")
    return rows.withColumns({"window_start": iso("window_start"), "window_end": iso("window_end")})


@query
def stream_redelivery(spark, sf):
    """Of every review the last delivery stays, with its content and status."""
    base = scratch_path(spark, "stream-last")
    arriving = X.versions(X.with_review_columns(X.stream_documents(spark, sf)))
    stream_moderation_jobs.start_upsert(
        arriving, f"{base}/out", f"{base}/checkpoint"
    ).awaitTermination()
    return tables.read_by_key(spark, f"{base}/out").select(
        "review_id", "content", "status", iso()
    )


def approving_summariser():
    def summarise(prompt: str) -> str:
        return '{"summary": "Approved text.", "sentiment": "positive"}'

    return summarise


@query
def stream_scored_moderation(spark, sf):
    """Arriving reviews through a scorer and, once approved, through a summariser."""
    base = scratch_path(spark, "stream-scored")
    arriving = X.with_review_columns(X.stream_documents(spark, sf)).drop(*SCORES)
    decide_rows = stream_moderation_jobs.scoring_decider(
        length_scorer(),
        "run-1",
        datetime(2024, 6, 1),
        summary_scorer=approving_summariser(),
        base_delay=0.0,
    )
    stream_moderation_jobs.start_moderation(
        arriving, base, f"{base}/checkpoint", decide_rows
    ).awaitTermination()
    return spark.read.parquet(f"{base}/responses").select("review_id", "result", "summary")


# --- behaviour described only by tests --------------------------------------
@query
def summary_filter(spark, sf):
    rows = summaries.exclusion_reasons(_summary_reviews(spark, sf))
    return rows.select("review_id", joined("exclusion_reasons"))


@query
def fallback_summary(spark, sf):
    rows = summaries.fallback_summary(summaries.product_stats(_summary_reviews(spark, sf)))
    return rows.select("product_id", "summary")


@query
def normalise_input(spark, sf):
    """Requests wrapped as JSON text, as a struct, or broken."""
    k = c("k")
    fields = X.submissions(spark, sf).select(
        "k",
        F.struct(
            "review_id",
            "product_id",
            "user_id",
            "content",
            "rating",
            "region",
            "product_category",
            "compliance_mode",
            *[F.lit(None).cast("string").alias(x) for x in ("api_request_id", "source_ip")],
            F.lit(None).cast("string").alias("user_agent"),
        ).alias("fields"),
    )
    wrapped = fields.select(
        "k",
        F.when(k % 7 == 0, F.lit("not json"))
        .when(k % 7 < 4, F.to_json("fields"))
        .alias("body"),
        F.when(k % 7 >= 4, c("fields")).alias("input"),
    )
    rows = validation.normalise_input(wrapped)
    return rows.select(
        "k", "review_id", "product_id", "rating", "region", "product_category", "error"
    )


@query
def event_type_default(spark, sf):
    rows = validation.known_event_type(_raw_events(spark, sf))
    return rows.select("audit_id", "event_type")


@query
def minimum_reviews(spark, sf):
    rows = summaries.enough_reviews(
        summaries.product_stats(_summary_reviews(spark, sf)), minimum=2
    )
    return rows.select("product_id", "reviews_included", "summary", "quality_score")


@query
def policy_entry_rows(spark, sf):
    k = c("k")
    rows = (
        _scored(spark, sf)
        .join(X.policy_summary_rows(X.reviews(spark, sf)).drop("review_id"), "k")
        .withColumns(
            {
                "validation_type": X.pick(["content", "summary", "other"], k % 3),
                "region": F.when(k % 10 != 0, c("region")),
                "product_category": F.when(k % 14 != 0, c("product_category")),
            }
        )
        .withColumn(
            "validation_type", F.when(k % 12 != 0, c("validation_type"))
        )
    )
    return policy_entry(rows).select(
        "review_id",
        "validation_type",
        "region",
        "product_category",
        *policy_columns("error"),
    )


@query
def analysis_response(spark, sf):
    rows = _aspects(spark, sf).withColumns(
        {
            "processing_errors": F.array().cast("array<string>"),
            "processing_time_ms": c("processing_duration_ms"),
        }
    )
    done = analysis.analysis_response(
        analysis.analyze_reviews(rows)
    )
    return done.select(
        "success",
        "review_id",
        "status",
        "processing_time_ms",
        *_analysis_columns(),
        c("summary.risk_level").alias("risk_level"),
        c("thresholds.bias_threshold").alias("bias_threshold"),
        joined("errors"),
    )
