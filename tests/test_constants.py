"""Values that results must carry, spelled out apart from the module that holds them."""

from reviewgate import constants as K


def test_messages():
    assert K.TOXICITY_REASON == "TOXICITY_THRESHOLD_EXCEEDED"
    assert K.BIAS_REASON == "BIAS_THRESHOLD_EXCEEDED"
    assert K.HALLUCINATION_REASON == "HALLUCINATION_THRESHOLD_EXCEEDED"
    assert K.REGIONAL_REASON == "REGIONAL_COMPLIANCE_VIOLATION"
    assert K.CATEGORY_REASON == "CATEGORY_RESTRICTION_VIOLATION"
    assert K.APPROVED_REASON == "CONTENT_APPROVED"
    assert K.CONTENT_MEETS == "Content meets all policy requirements"
    assert K.SUMMARY_MEETS == "Summary meets all policy requirements"
    assert K.INVALID_CONTENT == "Invalid content - validation failed"
    assert K.SUMMARY_DONE == "Summary generation completed."
    assert K.NO_REVIEWS_ERROR == "No reviews provided for summarization"


def test_limits_and_prices():
    assert K.DEFAULT_POLICIES["toxicity"] == {"mild": 8.0, "standard": 5.0, "strict": 3.0}
    assert K.DEFAULT_POLICIES["bias"] == {"mild": 7.0, "standard": 4.0, "strict": 2.0}
    assert K.DEFAULT_POLICIES["hallucination"] == {"mild": 8.0, "standard": 6.0, "strict": 4.0}
    assert (K.USD_PER_1K_INPUT_TOKENS, K.USD_PER_1K_OUTPUT_TOKENS) == (0.0008, 0.0032)
    assert (K.LOG_RETENTION_DAYS, K.MODEL_RETENTION_DAYS) == (365, 2555)
    assert (K.DEAD_LETTER_RETENTION_DAYS, K.SUMMARY_MAX_TOKENS) == (14, 1500)


def test_enums():
    assert K.STATUSES == ["PENDING", "APPROVED", "REJECTED", "PROCESSING", "FAILED"]
    assert K.EVENT_TYPES[:3] == ["ANALYSIS", "POLICY_DECISION", "SUMMARY_GENERATED"]
    assert K.REGIONS[0] == "us-east-1" and len(K.REGIONS) == 5
