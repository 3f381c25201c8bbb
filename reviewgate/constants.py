"""Enums, limits, messages and prompt texts.

Everything in this module must keep exactly these values for results to be
right, so it is stated as plain text in one place.
"""

# --- closed enums -----------------------------------------------------------
STATUSES = ["PENDING", "APPROVED", "REJECTED", "PROCESSING", "FAILED"]
EVENT_TYPES = [
    "ANALYSIS",
    "POLICY_DECISION",
    "SUMMARY_GENERATED",
    "PII_DETECTION",
    "ERROR",
    "UNKNOWN",
]
CATEGORIES = ["electronics", "clothing", "books", "toys", "health", "food", "other"]
REGIONS = ["us-east-1", "us-west-2", "eu-west-1", "eu-central-1", "ap-southeast-1"]
MODES = ["mild", "standard", "strict"]
ASPECTS = ["toxicity", "bias", "hallucination"]

# --- decisions and reason codes ---------------------------------------------
ALLOW = "ALLOW"
DENY = "DENY"
TOXICITY_REASON = "TOXICITY_THRESHOLD_EXCEEDED"
BIAS_REASON = "BIAS_THRESHOLD_EXCEEDED"
HALLUCINATION_REASON = "HALLUCINATION_THRESHOLD_EXCEEDED"
REGIONAL_REASON = "REGIONAL_COMPLIANCE_VIOLATION"
CATEGORY_REASON = "CATEGORY_RESTRICTION_VIOLATION"
APPROVED_REASON = "CONTENT_APPROVED"
SYSTEM_ERROR = "SYSTEM_ERROR"
UNKNOWN_MODE = "UNKNOWN_MODE"

# --- policy tables ----------------------------------------------------------
POLICY_VERSION = "1.0.0"
POLICY_LAST_UPDATED = "2024-01-01T00:00:00Z"
DEFAULT_POLICIES = {
    "toxicity": {"mild": 8.0, "standard": 5.0, "strict": 3.0},
    "bias": {"mild": 7.0, "standard": 4.0, "strict": 2.0},
    "hallucination": {"mild": 8.0, "standard": 6.0, "strict": 4.0},
    "regional_compliance": {
        "eu-west-1": {"gdpr_required": True, "max_toxicity": 3.0, "max_bias": 2.0},
        "us-east-1": {"gdpr_required": False, "max_toxicity": 5.0, "max_bias": 4.0},
    },
    "category_restrictions": {
        "children_toys": {"max_toxicity": 1.0, "max_bias": 1.0, "max_hallucination": 2.0},
        "healthcare": {"max_toxicity": 2.0, "max_bias": 1.0, "max_hallucination": 1.0},
        "electronics": {"max_toxicity": 5.0, "max_bias": 4.0, "max_hallucination": 6.0},
    },
}
ANALYZER_THRESHOLDS = {"toxicity": 5.0, "bias": 3.0, "hallucination": 6.0}

# --- model constants --------------------------------------------------------
MODEL_ID = "us.amazon.nova-premier-v1:0"
LIBRARY_MODEL_ID = "amazon.nova-premier-v1:0"
PROMPT_VERSION = "2.0"
LIBRARY_PROMPT_VERSION = "1.0"
INFERENCE_CONFIG = {"temperature": "0.1", "max_tokens": "1000"}
LIBRARY_INFERENCE_CONFIG = {"maxTokens": "1000", "temperature": "0.1", "topP": "0.9"}
SUMMARY_MAX_TOKENS = 1500
USD_PER_1K_INPUT_TOKENS = 0.0008
USD_PER_1K_OUTPUT_TOKENS = 0.0032
MOCK_SCORES = {"toxicity": 1.0, "bias": 0.5, "hallucination": 2.0}
MOCK_EXPLANATIONS = {
    "toxicity": "Content appears positive and non-toxic",
    "bias": "No obvious bias indicators detected",
    "hallucination": "Claims appear reasonable for product review",
}
MOCK_PROCESSING_MS = 1500

# --- retention --------------------------------------------------------------
LOG_RETENTION_DAYS = 365
MODEL_RETENTION_DAYS = 7 * 365
DEAD_LETTER_RETENTION_DAYS = 14

# --- messages ---------------------------------------------------------------
NO_EXPLANATION = "No explanation provided"
INVALID_CONTENT = "Invalid content - validation failed"
INVALID_CONTENT_ERROR = "Review content is required and must be at least 5 characters"
PARSE_FAILED = "Analysis parsing failed - using moderate risk score"
CALL_FAILED_PREFIX = "Bedrock API failed: "
CALL_FAILED_SUFFIX = " - defaulting to high risk"
ANALYSIS_FAILED = "Analysis failed - defaulting to high risk"
POLICY_FAILED = "Policy validation failed - defaulting to deny"
SUMMARY_FAILED = "Summary generation failed"
SUMMARY_SYSTEM_ERROR = "Summary generation failed due to system error"
UNPARSED_RESPONSE = "Failed to parse model response"
CONTENT_MEETS = "Content meets all policy requirements"
SUMMARY_MEETS = "Summary meets all policy requirements"
ALL_REJECTED_TEXT = "No approved reviews available for summarization."
ALL_REJECTED_REASON = "ALL_REVIEWS_REJECTED"
NO_REVIEWS_ERROR = "No reviews provided for summarization"
NO_REVIEWS_FALLBACK = "No reviews available for summarization."
SUMMARY_DONE = "Summary generation completed."
SUMMARY_PARSE_FAILED = "Customer reviews provide mixed feedback about this product."
SUMMARY_PARSE_THEMES = ["quality", "value", "functionality"]
SUMMARY_CALL_FAILED_PREFIX = "Unable to generate summary due to system error: "
SUMMARY_CALL_FAILED_THEMES = ["system_error"]

# Characters that count as blank when text is stripped.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Patterns of the tolerant response parser.
FENCED_OBJECT = r"(?sU)```(?:json)?\s*(\{.*?\})\s*```"
OUTER_BRACES = r"(?s)\{.*\}"

# --- alarm rules: name, source, metric, threshold, consecutive windows ------
ALARM_RULES = [
    ("review-auditor-errors", "review-auditor", "errors", 5.0, 2),
    ("review-auditor-duration", "review-auditor", "mean_duration_ms", 240000.0, 2),
    ("workflow-failures", "workflow", "errors", 3.0, 2),
    ("policy-validator-errors", "policy-validator", "errors", 5.0, 2),
    ("review-summarizer-errors", "review-summarizer", "errors", 5.0, 2),
    ("audit-logger-errors", "audit-logger", "errors", 10.0, 3),
]

# --- prompt texts; {name} marks a value to fill in --------------------------
ANALYSIS_PROMPT = """You are an AI content moderation expert. Analyze the following product review for toxicity, bias, and hallucination. Provide scores from 0-10 where:

TOXICITY (0=completely safe, 10=extremely toxic):
- Hate speech, harassment, threats
- Profanity, offensive language
- Personal attacks

BIAS (0=no bias, 10=extremely biased):
- Unfair generalizations
- Discriminatory language
- Prejudiced statements

HALLUCINATION (0=factual, 10=completely false):
- False claims about product features
- Impossible or unrealistic statements
- Contradictory information

REVIEW TO ANALYZE:
Product Category: {product_category}
Rating: {rating}/5
Content: "{content}"

Respond ONLY with valid JSON in this exact format:
{
  "toxicity_score": <number 0-10>,
  "bias_score": <number 0-10>, 
  "hallucination_score": <number 0-10>,
  "explanations": {
    "toxicity": "<brief explanation>",
    "bias": "<brief explanation>",
    "hallucination": "<brief explanation>"
  }
}"""

TOXICITY_PROMPT = """
You are an expert content moderator analyzing product reviews for toxicity. 

Analyze the following product review and provide a toxicity score from 0-10 where:
- 0-2: Clean, respectful content
- 3-4: Mildly negative but acceptable
- 5-6: Moderately toxic, contains harsh criticism or mild profanity
- 7-8: Highly toxic, contains offensive language or personal attacks
- 9-10: Extremely toxic, contains hate speech or severe abuse

Review to analyze: "{content}"

Respond in JSON format:
{
    "toxicity_score": <float between 0-10>,
    "explanation": "<detailed explanation of the score>",
    "confidence": <float between 0-1>,
    "detected_issues": ["<list of specific issues found>"]
}
"""

BIAS_PROMPT = """
You are an expert content moderator analyzing product reviews for bias and discrimination.

Analyze the following product review for bias indicators including:
- Racial or ethnic bias
- Gender bias
- Religious bias
- Age discrimination
- Nationality-based prejudice
- Other forms of discrimination

Provide a bias score from 0-10 where:
- 0-2: No bias detected
- 3-4: Subtle bias or stereotyping
- 5-6: Moderate bias with clear discriminatory language
- 7-8: Strong bias with offensive stereotypes
- 9-10: Extreme bias with hate speech

Review to analyze: "{content}"

Respond in JSON format:
{
    "bias_score": <float between 0-10>,
    "explanation": "<detailed explanation of the score>",
    "confidence": <float between 0-1>,
    "bias_types": ["<list of bias types detected>"],
    "problematic_phrases": ["<specific phrases that indicate bias>"]
}
"""

HALLUCINATION_PROMPT = """
You are an expert content moderator analyzing product reviews for hallucinated or fabricated claims.

Analyze the following product review for claims that appear to be:
- Invented features not typically found in products
- Exaggerated capabilities
- Technical specifications that seem unrealistic
- Claims that contradict common product knowledge

Provide a hallucination score from 0-10 where:
- 0-2: All claims appear realistic and verifiable
- 3-4: Minor exaggerations but generally believable
- 5-6: Some questionable claims that may be exaggerated
- 7-8: Multiple unrealistic claims or significant exaggerations
- 9-10: Clearly fabricated features or impossible claims

Review to analyze: "{content}"

Respond in JSON format:
{
    "hallucination_score": <float between 0-10>,
    "explanation": "<detailed explanation of the score>",
    "confidence": <float between 0-1>,
    "questionable_claims": ["<list of specific claims that seem fabricated>"],
    "realistic_claims": ["<list of claims that seem genuine>"]
}
"""

SUMMARIZATION_PROMPT = """
You are an expert content summarizer creating factual product review summaries.

Create a concise 3-sentence summary of the following product reviews. Follow these guidelines:
- Only include information explicitly mentioned in the reviews
- Do not invent or hallucinate product features
- Exclude any abusive, toxic, or policy-violating content
- Focus on factual observations about the product
- Maintain a neutral, informative tone

Reviews to summarize:
{reviews_content}

Policy constraints applied:
- Maximum toxicity score allowed: {max_toxicity}
- Maximum bias score allowed: {max_bias}
- Maximum hallucination score allowed: {max_hallucination}

Respond in JSON format:
{
    "summary": "<3-sentence factual summary>",
    "confidence": <float between 0-1>,
    "sources_used": <number of reviews used>,
    "excluded_content": ["<reasons for excluding any content>"]
}
"""

PRODUCT_SUMMARY_PROMPT = """You are an expert at analyzing customer reviews and creating concise, helpful summaries. 

Analyze these {approved_count} customer reviews for product {product_id} and create a balanced summary.

REVIEWS TO ANALYZE:
{reviews_text}

AVERAGE RATING: {average_rating}/5

Create a summary that:
1. Reflects the overall sentiment accurately
2. Mentions key themes (quality, value, functionality, etc.)
3. Is 1-2 sentences maximum
4. Is helpful for potential customers
5. Balances positive and negative feedback appropriately

Respond ONLY with valid JSON in this exact format:
{
  "summary": "<1-2 sentence summary>",
  "sentiment": "<positive|mixed|negative>",
  "key_themes": ["<theme1>", "<theme2>", "<theme3>"],
  "confidence": <0.0-1.0>
}"""
