"""Declared schemas. Nothing in the package infers a schema from data."""

from pyspark.sql import types as T

S, D, I, L, B, TS = (
    T.StringType(),
    T.DoubleType(),
    T.IntegerType(),
    T.LongType(),
    T.BooleanType(),
    T.TimestampType(),
)
STRINGS = T.ArrayType(S)
TEXT_MAP = T.MapType(S, S)
SCORE_MAP = T.MapType(S, D)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


# A submitted review as it arrives: the gateway quotes every value.
SUBMISSION = _struct(
    review_id=S,
    product_id=S,
    user_id=S,
    content=S,
    rating=S,
    region=S,
    product_category=S,
    compliance_mode=S,
    api_request_id=S,
    source_ip=S,
    user_agent=S,
)

ANALYSIS = _struct(
    toxicity_score=D,
    bias_score=D,
    hallucination_score=D,
    explanations=TEXT_MAP,
    confidence_scores=SCORE_MAP,
)

MODEL_METADATA = _struct(
    model_id=S,
    prompt_version=S,
    inference_config=TEXT_MAP,
    processing_time_ms=I,
    cost_usd=D,
)

POLICY_DECISION = _struct(
    approved=B,
    policy_violations=STRINGS,
    decision_rationale=S,
    policy_version=S,
    evaluated_rules=STRINGS,
    decision=S,
    reasons=STRINGS,
    explanation=S,
)

REVIEW = _struct(
    review_id=S,
    product_id=S,
    user_id=S,
    content=S,
    rating=I,
    timestamp=TS,
    region=S,
    product_category=S,
    compliance_mode=S,
    status=S,
    processing_errors=STRINGS,
    source_ip=S,
    user_agent=S,
    language=S,
    analysis_result=ANALYSIS,
    policy_decision=POLICY_DECISION,
)

# A stored review: the timestamp is ISO text and absent options are NULL.
REVIEW_ITEM = T.StructType(
    [
        T.StructField(f.name, S if f.name == "timestamp" else f.dataType)
        for f in REVIEW
        if f.name != "compliance_mode"
    ]
)

AUDIT_EVENT = _struct(
    audit_id=S,
    timestamp=TS,
    event_type=S,
    review_id=S,
    user_id=S,
    product_id=S,
    region=S,
    analysis_results=ANALYSIS,
    policy_decision=POLICY_DECISION,
    model_metadata=MODEL_METADATA,
    summary_data=S,
    error_details=S,
    processing_duration_ms=I,
    memory_used_mb=I,
    ttl=L,
)

SUMMARY = _struct(
    summary_id=S,
    product_id=S,
    summary_text=S,
    reviews_processed=L,
    reviews_excluded=L,
    exclusion_reasons=STRINGS,
    summary_quality_score=D,
    factual_accuracy_score=D,
    generated_at=TS,
    model_metadata=MODEL_METADATA,
    policy_constraints=SCORE_MAP,
)

# What a scorer stage adds to each row.
SCORER_RESULT = _struct(
    response_text=S,
    call_error=S,
    attempts=I,
    elapsed_ms=L,
    input_tokens=I,
    output_tokens=I,
)
