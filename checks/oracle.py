"""The registered queries as SQL over the same tables.

Written from the rules, not from the DataFrame code: reviews, responses, parsed
scores, decisions and audit rows are derived step by step in common table
expressions, and each query selects from the step it needs.
"""

from __future__ import annotations

from reviewgate import constants as K

ORACLE: dict[str, str] = {}
NL = "\n"
B = "'" + K.BLANKS + "'"
PERIOD = "TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2025-12-31 23:59:59'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {B})"


def iso(x: str) -> str:
    return (
        f"CASE WHEN epoch_us({x}) % 1000000 = 0 "
        f"THEN strftime({x}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({x}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


def listed(*pairs: tuple[str, str]) -> str:
    """Texts whose condition holds, in order, as a list."""
    items = ", ".join(f"CASE WHEN {cond} THEN {text} END" for cond, text in pairs)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def bar(x: str) -> str:
    return f"array_to_string({x}, '|')"


def r(x: str, digits: int) -> str:
    return f"CAST(printf('%.{digits}f', CAST({x} AS DOUBLE)) AS DOUBLE)"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def isin(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


CATEGORIES = K.CATEGORIES + ["children_toys", "healthcare"]
MODES = ["mild", "mild", "standard", "standard", "strict", "strict", "strict"]

CTE: dict[str, str] = {}

CTE["reviews"] = f"""
SELECT doc_id AS k, 'rev-' || doc_id AS review_id, 'prod-' || (doc_id % 50) AS product_id,
  'user-' || (doc_id % 97) AS user_id, text AS content,
  CAST(1 + (doc_id % 13) % 5 AS INTEGER) AS rating,
  ({lst(K.REGIONS)})[doc_id % 5 + 1] AS region,
  ({lst(CATEGORIES)})[doc_id % 9 + 1] AS product_category,
  ({lst(MODES)})[doc_id % 7 + 1] AS compliance_mode,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS ts,
  ({lst(K.STATUSES)})[doc_id % 5 + 1] AS status, lang AS language,
  (doc_id * 7 % 101) / 10.0 AS toxicity_score, (doc_id * 13 % 101) / 10.0 AS bias_score,
  (doc_id * 29 % 101) / 10.0 AS hallucination_score,
  CAST(n_chars // 4 AS INTEGER) AS input_tokens,
  CAST(50 + doc_id % 100 AS INTEGER) AS output_tokens,
  CAST(CASE WHEN doc_id % 17 = 0 THEN 0 ELSE doc_id * 37 % 5000 END AS INTEGER)
    AS processing_duration_ms
FROM documents"""

CTE["gaps"] = """
SELECT * REPLACE (CASE WHEN k % 17 <> 3 THEN toxicity_score END AS toxicity_score,
  CASE WHEN k % 19 <> 4 THEN bias_score END AS bias_score,
  CASE WHEN k % 23 = 5 THEN 'lenient' ELSE compliance_mode END AS compliance_mode)
FROM reviews"""

CTE["subs"] = """
SELECT k, review_id, ts, language,
  CASE k % 41 WHEN 1 THEN '' WHEN 2 THEN repeat('p', 101) ELSE product_id END AS product_id,
  CASE WHEN k % 43 <> 1 THEN user_id END AS user_id,
  CASE WHEN k % 37 = 1 THEN ' ' || chr(9) || chr(10) || '  ' ELSE content END AS content,
  CASE k % 47 WHEN 1 THEN '4.5' WHEN 2 THEN 'six' WHEN 3 THEN NULL
    ELSE CAST(k % 7 AS VARCHAR) END AS rating,
  CASE k % 53 WHEN 1 THEN 'mars-1' WHEN 2 THEN NULL ELSE region END AS region,
  CASE WHEN k % 59 = 1 THEN NULL ELSE product_category END AS product_category,
  CASE WHEN k % 61 = 1 THEN 'lenient' ELSE compliance_mode END AS compliance_mode
FROM reviews"""

_NOTES = """'"explanations": {"toxicity": "level ' || k || '", "bias": "none seen"}'"""
_T = """'"toxicity_score": ' || toxicity_score"""
_TQ = """'"toxicity_score": "' || toxicity_score || '"'"""
_BI = """'"bias_score": ' || bias_score"""
_H = """'"hallucination_score": ' || hallucination_score"""


def _object(*parts: str) -> str:
    return "'{' || " + " || ', ' || ".join(parts) + " || '}'"


def responses(table: str) -> str:
    plain = _object(_T, _BI, _H, _NOTES)
    return f"""
SELECT *, CASE k % 11
  WHEN 0 THEN '```json{NL}' || {plain} || '{NL}```'
  WHEN 1 THEN 'My reading:{NL}```json{NL}' || {plain} || '{NL}```'
  WHEN 2 THEN {_object(_T, _H, _NOTES)}
  WHEN 3 THEN {_object(_TQ, _BI, _H, _NOTES)}
  WHEN 4 THEN 'This is not JSON content'
  WHEN 5 THEN {plain} || '{NL}That is my {{honest}} view.'
  WHEN 6 THEN '```json{NL}' || {plain} || '{NL}```{NL}I hope it helps.'
  ELSE {plain} END AS raw_response
FROM {table}"""


CTE["responses"] = responses("reviews")

_SUMMARY_FULL = (
    """'{"summary": "Buyers speak of item ' || %s || '.", "sentiment": "positive", """
    """"key_themes": ["price", "size"], "confidence": 0.8}'"""
)


def summary_response(key: str) -> str:
    full = _SUMMARY_FULL % key
    return f"""CASE {key} % 5 WHEN 0 THEN '```json{NL}' || {full} || '{NL}```'
  WHEN 1 THEN '{{"sentiment": "negative", "n": ' || {key} || '}}'
  WHEN 2 THEN 'No summary of ' || {key}
  WHEN 3 THEN '[' || {key} || ']'
  ELSE {full} END"""


def unfenced(x: str) -> str:
    t = strip(x)
    return f"""CASE
  WHEN starts_with({t}, '```json')
    THEN {strip(f"replace(replace({t}, '```json{NL}', ''), '{NL}```', '')")}
  WHEN starts_with({t}, '```')
    THEN {strip(f"replace(replace({t}, '```{NL}', ''), '{NL}```', '')")}
  ELSE {t} END"""


def strict(table: str) -> dict[str, str]:
    """Strictly read responses of ``table`` (content, rating_error, call_error)."""
    out = {}
    out["cleaned"] = f"SELECT *, {unfenced('raw_response')} AS doc FROM {table}"
    kinds = ", ".join(
        f"CASE WHEN json_valid(doc) THEN json_type(doc, '$.{a}_score') END AS {a}_kind"
        for a in K.ASPECTS
    )
    out["typed"] = f"""
SELECT *, coalesce(json_valid(doc), false) AS ok, {kinds},
  length({strip("coalesce(content, '')")}) < 5 AS short FROM cleaned"""
    out["judged"] = """
SELECT *, coalesce(rating_error, CASE WHEN NOT short AND call_error IS NULL AND ok THEN
  CASE WHEN toxicity_kind IS NULL THEN '''toxicity_score'''
    WHEN bias_kind IS NULL THEN '''bias_score'''
    WHEN hallucination_kind IS NULL THEN '''hallucination_score''' END END) AS system_error
FROM typed"""
    scores = ",\n  ".join(
        f"""CASE WHEN system_error IS NOT NULL OR short THEN 10.0
    WHEN call_error IS NOT NULL THEN 8.0 WHEN NOT ok THEN 5.0
    WHEN {a}_kind IN ('UBIGINT', 'BIGINT', 'DOUBLE')
      AND CAST(json_extract_string(doc, '$.{a}_score') AS DOUBLE) BETWEEN 0 AND 10
      THEN CAST(json_extract_string(doc, '$.{a}_score') AS DOUBLE)
    ELSE 5.0 END AS {a}_score"""
        for a in K.ASPECTS
    )
    keep = "* EXCLUDE (toxicity_score, bias_score, hallucination_score)"
    note = f"""CASE WHEN system_error IS NOT NULL THEN 'System error: ' || system_error
    WHEN short THEN {q(K.INVALID_CONTENT)}
    WHEN call_error IS NOT NULL THEN {q(K.CALL_FAILED_PREFIX)} || call_error
      || {q(K.CALL_FAILED_SUFFIX)}
    WHEN NOT ok THEN {q(K.PARSE_FAILED)} END"""
    out["analysed"] = f"""
SELECT {keep}, {scores}, {note} AS note,
  CASE WHEN system_error IS NOT NULL THEN 500 WHEN short THEN 400 ELSE 200 END
    AS status_code,
  CASE WHEN system_error IS NOT NULL THEN system_error
    WHEN short THEN {q(K.INVALID_CONTENT_ERROR)} END AS error
FROM judged"""
    return out


CTE["inputs"] = """
SELECT *, CAST(NULL AS VARCHAR) AS rating_error, CAST(NULL AS VARCHAR) AS call_error
FROM responses"""
CTE.update(strict("inputs"))

CTE["modes"] = """
SELECT * FROM (VALUES ('mild', 8.0::DOUBLE, 7.0::DOUBLE, 8.0::DOUBLE),
  ('standard', 5.0, 4.0, 6.0), ('strict', 3.0, 2.0, 4.0)) v(mode, tox, bia, hal)"""


def handler_policy(table: str) -> str:
    reasons = listed(
        ("coalesce(toxicity_score, 10.0) >= tox", q(K.TOXICITY_REASON)),
        ("coalesce(bias_score, 10.0) >= bia", q(K.BIAS_REASON)),
        ("coalesce(hallucination_score, 10.0) >= hal", q(K.HALLUCINATION_REASON)),
    )
    return f"""
SELECT *, CASE WHEN len(broken) > 0 THEN 'DENY' ELSE 'ALLOW' END AS decision,
  CASE WHEN len(broken) > 0 THEN broken ELSE ['CONTENT_APPROVED'] END AS reasons,
  'Content ' || CASE WHEN len(broken) > 0 THEN 'rejected' ELSE 'approved' END
    || ' based on ' || compliance_mode || ' compliance mode' AS explanation
FROM (SELECT a.*, tox, bia, hal, {reasons} AS broken
  FROM {table} a JOIN modes m ON m.mode = CASE WHEN compliance_mode IN
    ('mild', 'standard', 'strict') THEN compliance_mode ELSE 'standard' END)"""


CTE["decided"] = handler_policy("analysed")

_SUMMARY_READ = f"""CASE k % 5 WHEN 1 THEN {q(K.SUMMARY_DONE)}
  WHEN 2 THEN {q(K.SUMMARY_PARSE_FAILED)} WHEN 3 THEN {q(K.SUMMARY_SYSTEM_ERROR)}
  ELSE 'Buyers speak of item ' || k || '.' END"""

CTE["audit"] = """
SELECT 'audit-' || strftime(ts, '%Y%m%d-%H%M%S') || '-' || md5(review_id) AS audit_id, ts,
  CASE WHEN decision = 'ALLOW' THEN 'ANALYSIS' ELSE 'POLICY_DECISION' END AS event_type,
  review_id, user_id, product_id, region, toxicity_score, bias_score, hallucination_score,
  decision, reasons, explanation, decision = 'ALLOW' AS approved,
  CASE WHEN decision = 'ALLOW' THEN CAST([] AS VARCHAR[]) ELSE reasons END AS violations,
  processing_duration_ms, CAST(epoch(ts) AS BIGINT) + 365 * 86400 AS ttl,
  input_tokens / 1000.0::DOUBLE * 0.0008::DOUBLE
    + output_tokens / 1000.0::DOUBLE * 0.0032::DOUBLE AS cost_usd
FROM decided"""

CTE["sreviews"] = """
SELECT k, CASE WHEN k % 3 = 0 THEN 'prod-hot' ELSE 'prod-' || (k - k % 4) END AS product_id,
  review_id, content, rating, ts,
  CASE WHEN k % 17 = 3 THEN NULL ELSE toxicity_score < 5 END AS analysis_passed,
  toxicity_score
FROM reviews"""

CTE["stats"] = """
SELECT product_id, count(*) AS reviews_processed,
  count(*) FILTER (WHERE coalesce(analysis_passed, true)) AS reviews_included,
  count(*) FILTER (WHERE NOT coalesce(analysis_passed, true)) AS reviews_excluded,
  coalesce(avg(rating) FILTER (WHERE coalesce(analysis_passed, true)), 0.0)
    AS average_rating, 0::BIGINT AS unreadable_ratings
FROM sreviews GROUP BY product_id"""

CTE["lines"] = f"""
SELECT product_id, string_agg(line, '{NL}' ORDER BY ts, review_id) AS reviews_text
FROM (SELECT product_id, ts, review_id, 'Rating: ' || rating || '/5 - ' || content AS line,
    row_number() OVER (PARTITION BY product_id ORDER BY ts, review_id) AS n
  FROM sreviews WHERE coalesce(analysis_passed, true))
WHERE n <= 10 GROUP BY product_id"""

CTE["srows"] = """
SELECT k, 'summary-' || k AS summary_id, product_id,
  CASE WHEN k % 31 = 1 THEN '' ELSE 'Fine.' END AS summary_text,
  k % 5 - CASE WHEN k % 37 = 1 THEN 3 ELSE 0 END AS reviews_processed,
  k % 3 AS reviews_excluded,
  CASE WHEN k % 4 <> 0 THEN toxicity_score END AS summary_quality_score,
  CASE WHEN k % 7 <> 0 THEN bias_score END AS factual_accuracy_score, ts
FROM reviews"""

CTE["stored"] = """
SELECT *  REPLACE (CASE WHEN k % 6 = 0 THEN NULL ELSE language END AS language,
    CASE WHEN k % 2 = 0 THEN ts + INTERVAL 250123 MICROSECOND ELSE ts END AS ts),
  CASE WHEN k % 4 = 0 THEN 'late' END AS processing_error,
  CASE WHEN k % 3 = 0 THEN '' ELSE '10.0.0.' || (k % 250) END AS source_ip,
  CASE WHEN k % 5 = 0 THEN NULL ELSE 'app' END AS user_agent
FROM reviews"""

CTE["events_raw"] = f"""
SELECT k, 'audit-' || k AS audit_id, ts,
  ({lst(K.EVENT_TYPES + ["LOGIN"])})[k % 7 + 1] AS event_type,
  review_id, user_id, product_id, region,
  CAST(CASE WHEN k % 29 = 1 THEN -1 ELSE k % 1000 END AS INTEGER) AS processing_duration_ms,
  CAST(CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN 128 END AS INTEGER) AS memory_used_mb
FROM subs"""

CTE["calls"] = """
SELECT (['review-auditor', 'policy-validator', 'review-summarizer', 'audit-logger'])
    [user_id % 4 + 1] AS function,
  ts, event_type = 'error' AS is_error,
  CAST(floor(value * 10000) AS BIGINT) AS duration_ms
FROM events"""


def metrics(interval: str) -> str:
    return f"""
SELECT time_bucket(INTERVAL '{interval}', ts) AS w, function, count(*) AS invocations,
  count(*) FILTER (WHERE is_error) AS errors, avg(duration_ms) AS mean_duration_ms
FROM calls GROUP BY ALL"""


CTE["metrics5"] = metrics("5 minutes")
CTE["metrics60"] = metrics("1 hour")

DEPENDS = {
    "gaps": ["reviews"],
    "subs": ["reviews"],
    "responses": ["reviews"],
    "inputs": ["responses"],
    "cleaned": ["inputs"],
    "typed": ["cleaned"],
    "judged": ["typed"],
    "analysed": ["judged"],
    "decided": ["analysed", "modes"],
    "audit": ["decided"],
    "sreviews": ["reviews"],
    "stats": ["sreviews"],
    "lines": ["sreviews"],
    "srows": ["reviews"],
    "stored": ["reviews"],
    "events_raw": ["subs"],
    "metrics5": ["calls"],
    "metrics60": ["calls"],
}


def using(names: str, select: str, extra: dict[str, str] | None = None) -> str:
    """The select with the named steps (and what they need) put before it."""
    steps: dict[str, str] = {}

    def add(name: str) -> None:
        for need in DEPENDS.get(name, []):
            add(need)
        steps.setdefault(name, CTE[name])

    for name in names.split():
        add(name)
    steps.update(extra or {})
    body = ",\n".join(f"{name} AS ({sql})" for name, sql in steps.items())
    return f"WITH {body}\n{select}"


def sql(name: str, steps: str, select: str, extra: dict[str, str] | None = None) -> None:
    ORACLE[name] = using(steps, select, extra)


# --- sources, sinks, schema conversion --------------------------------------
_FIELDS = "product_id user_id content rating region product_category compliance_mode".split()
sql(
    "read_reviews",
    "subs",
    "SELECT review_id, " + ", ".join(f"nullif({f}, '') AS {f}" for f in _FIELDS)
    + " FROM subs",
)
sql(
    "prepare_input_rows",
    "reviews",
    f"""SELECT review_id, {", ".join(_FIELDS)}, {iso("ts")} AS timestamp,
  'run-1' AS execution_id FROM reviews""",
)
sql(
    "upsert_reviews",
    "reviews",
    f"""SELECT review_id, product_id, content, rating,
  CASE WHEN l.doc_id IS NULL THEN status WHEN toxic = 1 THEN 'REJECTED' ELSE 'APPROVED' END
    AS status,
  {iso("CASE WHEN l.doc_id IS NULL THEN ts ELSE ts + INTERVAL 30 DAY END")} AS timestamp
FROM reviews LEFT JOIN labels l ON l.doc_id = k""",
)
sql(
    "upsert_same_version",
    "reviews",
    f"""SELECT review_id, content,
  CASE WHEN l.doc_id IS NULL THEN status WHEN toxic = 1 THEN 'REJECTED' ELSE 'APPROVED' END
    AS status, {iso("ts")} AS timestamp
FROM reviews LEFT JOIN labels l ON l.doc_id = k""",
)
ORACLE["upsert_narrow_update"] = ORACLE["upsert_reviews"]
sql(
    "upsert_own_bucket_column",
    "reviews",
    """SELECT review_id, CASE WHEN k % 3 = 0 THEN 'moved' ELSE region END AS bucket, k AS buckets
FROM reviews""",
)
sql(
    "grown_table",
    "reviews",
    "SELECT k, review_id, CASE WHEN k % 50 = 7 THEN 'LATE' ELSE status END AS status FROM reviews",
)
sql(
    "audit_rerun_after_expiry",
    "audit",
    """SELECT audit_id, CASE WHEN processing_duration_ms % 2 = 0 THEN '007' ELSE '8' END AS run
FROM audit WHERE processing_duration_ms % 2 = 0
  OR ttl > CAST(epoch(TIMESTAMP '2024-12-31 08:00:00') AS BIGINT)""",
)
sql(
    "corrupt_submissions",
    "reviews",
    """SELECT CASE WHEN error = '' THEN review_id END AS review_id,
  CASE WHEN error = '' THEN '4' END AS rating, CASE WHEN error <> '' THEN line END AS line,
  error AS errors, error <> '' AS has_file
FROM (SELECT *, CASE WHEN k % 7 = 3 THEN left('{"review_id": "' || review_id || '", "rating": 4}', 22)
      WHEN k % 7 = 5 THEN 'no json ' || k WHEN k % 11 = 4 THEN '[' || k || ']' END AS line,
    CASE WHEN k % 7 IN (3, 5) THEN 'MALFORMED_JSON' WHEN k % 11 = 4 THEN 'NOT_AN_OBJECT'
      WHEN k % 13 <> 6 THEN '' END AS error FROM reviews)
WHERE error IS NOT NULL""",
)
sql(
    "put_audit_events",
    "audit",
    f"""SELECT audit_id, event_type, review_id, strftime(ts, '%Y-%m-%d') AS event_date,
  {iso("ts")} AS timestamp, ttl FROM audit""",
)
_AUDIT_ERRORS = listed(
    ("coalesce(length(review_id), 0) < 1", "'review_id'"),
    ("coalesce(length(user_id), 0) < 1", "'user_id'"),
    ("coalesce(length(product_id), 0) < 1", "'product_id'"),
    (f"event_type IS NULL OR event_type NOT IN {isin(K.EVENT_TYPES)}", "'event_type'"),
    (f"region IS NULL OR region NOT IN {isin(K.REGIONS)}", "'region'"),
    ("coalesce(processing_duration_ms, 0) < 0", "'processing_duration_ms'"),
)
sql(
    "batch_audit_counts",
    "events_raw",
    f"""SELECT count(*) FILTER (WHERE len(e) = 0) AS events_processed,
  count(*) FILTER (WHERE len(e) > 0) AS events_failed
FROM (SELECT {_AUDIT_ERRORS} AS e FROM events_raw)""",
)

# Summary responses by shape, keyed by the product's number of reviews.
_n = "reviews_processed"
_RECORDS = f"""
SELECT product_id, reviews_processed, reviews_included, reviews_excluded, average_rating,
  CASE WHEN reviews_included = 0 THEN {q(K.ALL_REJECTED_TEXT)}
    WHEN {_n} % 5 = 1 THEN {q(K.SUMMARY_DONE)}
    WHEN {_n} % 5 = 2 THEN {q(K.SUMMARY_PARSE_FAILED)}
    WHEN {_n} % 5 = 3 THEN {q(K.SUMMARY_SYSTEM_ERROR)}
    ELSE 'Buyers speak of item ' || {_n} || '.' END AS summary,
  CASE WHEN reviews_included = 0 THEN 'neutral' WHEN {_n} % 5 = 1 THEN 'negative'
    WHEN {_n} % 5 = 2 THEN 'mixed' WHEN {_n} % 5 = 3 THEN NULL ELSE 'positive' END
    AS sentiment,
  CASE WHEN reviews_included = 0 THEN 0.0 WHEN {_n} % 5 IN (1, 2) THEN 0.5
    WHEN {_n} % 5 = 3 THEN NULL ELSE 0.8 END::DOUBLE AS confidence,
  CASE WHEN reviews_included = 0 OR {_n} % 5 IN (1, 3) THEN ''
    WHEN {_n} % 5 = 2 THEN 'quality|value|functionality' ELSE 'price|size' END
    AS key_themes,
  CASE WHEN reviews_included = 0 THEN 'ALL_REVIEWS_REJECTED' ELSE '' END
    AS exclusion_reasons,
  reviews_included > 0 AS ai_generated,
  CASE WHEN reviews_included > 0 THEN {q(K.MODEL_ID)} END AS model_used
FROM stats"""
sql("summary_records", "stats", _RECORDS)
sql(
    "put_summaries",
    "stats",
    f"""SELECT 'summary-' || md5(product_id || '|run-1') AS summary_id, product_id,
  summary AS summary_text, reviews_processed, reviews_excluded, exclusion_reasons,
  '2024-06-01T00:00:00' AS generated_at FROM ({_RECORDS})""",
)
sql(
    "summary_history",
    "stats",
    """SELECT 'summary-' || md5(product_id || '|' || run) AS summary_id, product_id,
  reviews_processed, moment AS generated_at
FROM stats, (VALUES ('run-1', '2024-06-01T00:00:00'), ('run-2', '2024-06-01T05:00:00')) v(run, moment)
WHERE product_id = 'prod-hot'""",
)
sql(
    "report_sink",
    "audit",
    f"""SELECT 'report-1' AS report_id, 'compliance_summary' AS report_type,
  count(*) AS records_processed FROM audit WHERE ts BETWEEN {PERIOD}""",
)
_WHOLE = "CASE WHEN regexp_full_match(trim(rating), '[+-]?[0-9]+') THEN CAST(rating AS INTEGER) END"
_BAD_RATING = f"coalesce({_WHOLE}, 0) NOT BETWEEN 1 AND 5"
_API_ERRORS = listed(
    ("coalesce(length(product_id), 0) NOT BETWEEN 1 AND 100", "'product_id'"),
    ("coalesce(length(user_id), 0) NOT BETWEEN 1 AND 100", "'user_id'"),
    ("coalesce(length(content), 0) NOT BETWEEN 10 AND 5000", "'content'"),
    (_BAD_RATING, "'rating'"),
    (f"region NOT IN {isin(K.REGIONS)}", "'region'"),
    (f"product_category NOT IN {isin(K.CATEGORIES)}", "'product_category'"),
    (f"compliance_mode NOT IN {isin(K.MODES)}", "'compliance_mode'"),
)
sql("validate_api", "subs", f"SELECT review_id, {bar(_API_ERRORS)} AS errors FROM subs")
sql(
    "dead_letters",
    "subs",
    f"""SELECT review_id, {bar("e")} AS errors, '2024-06-01T00:00:00' AS received_at,
  CAST(epoch(TIMESTAMP '2024-06-01 00:00:00') AS BIGINT) + 14 * 86400 AS ttl
FROM (SELECT review_id, {_API_ERRORS} AS e FROM subs) WHERE len(e) > 0""",
)
sql(
    "review_to_item",
    "stored",
    f"""SELECT review_id, product_id, user_id, content, rating, {iso("ts")} AS timestamp,
  region, product_category, status, processing_error AS processing_errors,
  nullif(source_ip, '') AS source_ip, nullif(user_agent, '') AS user_agent,
  coalesce(nullif(language, ''), 'en') AS language FROM stored""",
)
sql(
    "review_roundtrip",
    "stored",
    f"""SELECT review_id, content, rating, {iso("ts")} AS timestamp,
  coalesce(language, 'en') AS language, nullif(source_ip, '') AS source_ip,
  CASE WHEN processing_error IS NULL THEN 0 ELSE 1 END AS n_errors,
  {bar(listed((f"product_category NOT IN {isin(K.CATEGORIES)}", "'product_category'")))}
    AS item_errors FROM stored""",
)
sql(
    "summary_to_item",
    "srows",
    f"""SELECT summary_id, product_id, reviews_processed, reviews_excluded,
  'HIGH_TOXICITY' AS exclusion_reasons, {iso("ts")} AS generated_at,
  5.0::DOUBLE AS max_toxicity, summary_quality_score, factual_accuracy_score FROM srows""",
)
sql(
    "audit_roundtrip",
    "events_raw",
    f"""SELECT audit_id, {iso("ts")} AS timestamp, event_type, region,
  processing_duration_ms, nullif(memory_used_mb, 0) AS memory_used_mb,
  CASE WHEN memory_used_mb = 0 THEN 1 ELSE CAST(epoch(ts) AS BIGINT) + 2555 * 86400 END AS ttl
FROM events_raw""",
)
sql(
    "fill_explanations",
    "reviews",
    f"""SELECT review_id, 'level ' || k AS toxicity, {q(K.NO_EXPLANATION)} AS bias,
  {q(K.NO_EXPLANATION)} AS hallucination, 3 AS n_keys FROM reviews""",
)
sql(
    "search_document",
    "audit",
    f"""SELECT {iso("ts")} AS event_time, audit_id, review_id, event_type, user_id,
  product_id, region, processing_duration_ms, toxicity_score, bias_score,
  hallucination_score, approved AS policy_approved,
  CAST(len(violations) AS INTEGER) AS policy_violations_count, '1.0.0' AS policy_version,
  {q(K.LIBRARY_MODEL_ID)} AS model_id, '1.0' AS prompt_version,
  nullif(cost_usd, 0) AS cost_usd, CAST(NULL AS INTEGER) AS memory_used_mb FROM audit""",
)
sql(
    "json_roundtrip",
    "stored",
    f"""SELECT review_id, content, rating, {iso("ts")} AS timestamp,
  coalesce(processing_error, '') AS processing_errors, source_ip FROM stored""",
)
sql(
    "decimal_roundtrip",
    "reviews",
    """SELECT review_id, CAST(CAST(toxicity_score AS DECIMAL(18, 6)) AS DOUBLE)
    AS toxicity_score, bias_score, hallucination_score FROM reviews""",
)

# --- validation -------------------------------------------------------------
_MODEL_ERRORS = listed(
    ("coalesce(length(product_id), 0) < 1", "'product_id'"),
    ("coalesce(length(user_id), 0) < 1", "'user_id'"),
    (
        "coalesce(length(content), 0) NOT BETWEEN 1 AND 5000 "
        f"OR length({strip('content')}) = 0",
        "'content'",
    ),
    (_BAD_RATING, "'rating'"),
    (f"region IS NULL OR region NOT IN {isin(K.REGIONS)}", "'region'"),
    (
        f"product_category IS NULL OR product_category NOT IN {isin(K.CATEGORIES)}",
        "'product_category'",
    ),
)
sql(
    "validate_model",
    "subs",
    f"SELECT review_id, {strip('content')} AS content, {bar(_MODEL_ERRORS)} AS errors FROM subs",
)
_RATING_ERROR = (
    f"CASE WHEN rating IS NOT NULL AND {_WHOLE} IS NULL "
    "THEN 'invalid literal for int() with base 10: ''' || rating || '''' END"
)
sql(
    "input_defaults",
    "subs",
    f"""SELECT review_id, coalesce(product_category, 'other') AS product_category,
  CASE WHEN rating IS NULL THEN 3 ELSE {_WHOLE} END AS rating,
  {_RATING_ERROR} AS rating_error FROM subs""",
)
_SUBMITTED = {
    "subs_scored": """
SELECT s.*, toxicity_score, bias_score, hallucination_score
FROM subs s JOIN (SELECT k, toxicity_score, bias_score, hallucination_score FROM reviews)
USING (k)""",
    "subs_answered": responses("subs_scored"),
    "subs_inputs": f"""SELECT *, {_RATING_ERROR} AS rating_error,
  CAST(NULL AS VARCHAR) AS call_error FROM subs_answered""",
    **strict("subs_inputs"),
}
_NOTE = """coalesce(note, CASE WHEN ok THEN json_extract_string(doc,
  '$.explanations.toxicity') END) AS toxicity_note"""
_SCORES = "toxicity_score, bias_score, hallucination_score"
sql(
    "auditor_gate",
    "subs",
    f"SELECT review_id, status_code, error, {_SCORES}, {_NOTE} FROM analysed",
    _SUBMITTED,
)
_STRETCHED = {
    "stretched": "SELECT review_id, "
    + ", ".join(f"{a}_score * 1.25 - 1.0 AS {a}_score" for a in K.ASPECTS)
    + " FROM gaps"
}
sql(
    "score_range",
    "gaps",
    "SELECT review_id, "
    + bar(
        listed(
            *[
                (f"coalesce({a}_score, -1) NOT BETWEEN 0 AND 10", f"'{a}_score'")
                for a in K.ASPECTS
            ]
        )
    )
    + " AS errors FROM stretched",
    _STRETCHED,
)
sql(
    "clamp_scores",
    "gaps",
    "SELECT review_id, "
    + ", ".join(
        f"greatest(0.0::DOUBLE, least(10.0::DOUBLE, coalesce({a}_score, 0.0::DOUBLE))) "
        f"AS {a}_score"
        for a in K.ASPECTS
    )
    + " FROM stretched",
    _STRETCHED,
)
_SUMMARY_ERRORS = listed(
    ("reviews_processed < 0", "'reviews_processed'"),
    ("reviews_excluded < 0", "'reviews_excluded'"),
    ("reviews_processed = 0 AND reviews_excluded = 0", "'review_totals'"),
    ("length(product_id) < 1", "'product_id'"),
    ("length(summary_text) < 1", "'summary_text'"),
)
sql(
    "validate_summary",
    "srows",
    f"SELECT summary_id, {bar(_SUMMARY_ERRORS)} AS errors FROM srows",
)
sql(
    "validate_audit",
    "events_raw",
    f"SELECT audit_id, {bar(_AUDIT_ERRORS)} AS errors FROM events_raw",
)


# --- scoring and response parsing -------------------------------------------
def filled(template: str, **values: str) -> str:
    """The prompt as nested replacements, the review's own text put in last."""
    out = q(template)
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


_PROMPT = filled(
    K.ANALYSIS_PROMPT,
    product_category="product_category",
    rating="CAST(rating AS VARCHAR)",
    content="content",
)
sql("analysis_prompt", "reviews", f"SELECT review_id, {_PROMPT} AS prompt FROM reviews")
_ASPECT_PROMPTS = {
    "toxicity": K.TOXICITY_PROMPT,
    "bias": K.BIAS_PROMPT,
    "hallucination": K.HALLUCINATION_PROMPT,
}
sql(
    "aspect_prompts",
    "reviews",
    "SELECT review_id, "
    + ", ".join(
        f"{filled(text, content='content')} AS {a}_prompt"
        for a, text in _ASPECT_PROMPTS.items()
    )
    + " FROM reviews",
)
_CALLED = {
    "asked": f"SELECT *, length({_PROMPT}) AS n FROM reviews",
    "called": """
SELECT *, CAST(NULL AS VARCHAR) AS rating_error,
  CASE WHEN n % 13 = 0 THEN 'model unavailable' END AS call_error,
  CASE WHEN n % 13 <> 0 THEN '{"toxicity_score": ' || (n % 101) / 10.0
    || ', "bias_score": ' || (n % 89) / 10.0 || ', "hallucination_score": '
    || (n % 97) / 10.0 || '}' END AS raw_response
FROM asked""",
    **strict("called"),
}
sql(
    "score_reviews",
    "reviews",
    f"SELECT review_id, call_error, status_code, {_SCORES} FROM analysed",
    _CALLED,
)
_RESCORED = {
    "asked": f"SELECT *, {_PROMPT} AS prompt_text, length({_PROMPT}) AS n1 FROM reviews",
    "stored": """
SELECT *, n1 + CASE WHEN bool_or(k % 2 = 0 AND n1 % 13 <> 0) OVER (PARTITION BY prompt_text)
  THEN 0 ELSE 1 END AS n FROM asked""",
    "called": _CALLED["called"].replace("FROM asked", "FROM stored"),
    **strict("called"),
}
sql(
    "rescored_reviews",
    "reviews",
    f"SELECT review_id, call_error, status_code, {_SCORES} FROM analysed",
    _RESCORED,
)
sql(
    "parse_strict",
    "analysed",
    f"""SELECT review_id, status_code, error, {_SCORES}, {_NOTE}, note AS hallucination_note
FROM analysed""",
)
_FENCED = "regexp_extract({0}, '(?s)```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1)"
_BRACES = "regexp_extract({0}, '(?s)\\{{.*\\}}', 0)"


def tolerant(x: str) -> str:
    fenced, braces = _FENCED.format(x), _BRACES.format(x)
    return f"""CASE WHEN json_valid({x}) THEN {x} WHEN json_valid({fenced}) THEN {fenced}
  WHEN json_valid({braces}) THEN {braces} END"""


sql(
    "parse_tolerant",
    "responses",
    "SELECT review_id, "
    + ", ".join(
        # A number's text form drops the trailing zero of its decimals.
        f"regexp_replace(json_extract_string(doc, '$.{a}_score'), '\\.0$', "
        f"CASE WHEN json_type(doc, '$.{a}_score') = 'VARCHAR' THEN '.0' ELSE '' END) "
        f"AS {a}_score"
        for a in K.ASPECTS
    )
    + f""", CASE WHEN doc IS NULL THEN {q(K.UNPARSED_RESPONSE)} END AS error,
  CASE WHEN doc IS NULL THEN raw_response END AS raw_content
FROM (SELECT *, {tolerant('raw_response')} AS doc FROM responses)""",
)

_LISTS = {
    "toxicity": ', "detected_issues": ["insult"]',
    "bias": ', "bias_types": ["age"], "problematic_phrases": []',
    "hallucination": ', "questionable_claims": ["size"]',
}


def aspect_response(a: str, modulus: int) -> str:
    head = q('{"' + a + '_score": ')
    tail = (
        f"""', "explanation": "{a} of ' || k || '", "confidence": 0.9' || {q(_LISTS[a])} || '}}'"""
    )
    score = f"{a}_score"
    plain = f"{head} || {score} || {tail}"
    return f"""CASE k % {modulus}
  WHEN 0 THEN 'Result:{NL}```json{NL}' || {plain} || '{NL}```{NL}'
  WHEN 1 THEN 'I think ' || {plain} || ' fits.'
  WHEN 2 THEN '{{"confidence": 0.2}}'
  WHEN 3 THEN {head} || '"' || {score} || '"' || {tail}
  WHEN 4 THEN 'This is not JSON content'
  WHEN 5 THEN {head} || '15.5' || {tail}
  WHEN 6 THEN {head} || '-2' || {tail}
  WHEN 7 THEN {head} || 'null' || {tail}
  WHEN 8 THEN {head} || '"high"' || {tail}
  ELSE {plain} END"""


_MODULI = {"toxicity": 23, "bias": 29, "hallucination": 31}


def _aspect_steps() -> dict[str, str]:
    steps = {
        "answers": "SELECT k, review_id, status, processing_duration_ms, "
        + ", ".join(f"{aspect_response(a, m)} AS {a}_response" for a, m in _MODULI.items())
        + " FROM reviews",
        "docs": "SELECT *, "
        + ", ".join(f"{tolerant(f'{a}_response')} AS {a}_doc" for a in K.ASPECTS)
        + " FROM answers",
    }
    parts = []
    for a in K.ASPECTS:
        text = f"json_extract_string({a}_doc, '$.{a}_score')"
        kind = f"json_type({a}_doc, '$.{a}_score')"
        number = f"TRY_CAST({text} AS DOUBLE)"
        parts += [
            f"""greatest(0.0::DOUBLE, least(10.0::DOUBLE, coalesce({number}, 0.0::DOUBLE)))
    AS {a}_raw""",
            f"""CASE WHEN {kind} = 'NULL' THEN 'Unexpected error in {a} analysis: float() '
      || 'argument must be a string or a real number, not ''NoneType'''
    WHEN {kind} = 'VARCHAR' AND {number} IS NULL THEN 'Unexpected error in {a} analysis: '
      || 'could not convert string to float: ''' || {text} || '''' END AS {a}_error""",
            f"""coalesce(json_extract_string({a}_doc, '$.explanation'),
    {q(K.NO_EXPLANATION)}) AS {a}_text""",
            f"""coalesce(TRY_CAST(json_extract_string({a}_doc, '$.confidence') AS DOUBLE), 0.5)
    AS {a}_sure""",
        ]
    steps["read"] = (
        "SELECT k, review_id, status, processing_duration_ms, toxicity_doc, "
        + ", ".join(parts)
        + " FROM docs"
    )
    steps["whole"] = (
        "SELECT *, coalesce(toxicity_error, bias_error, hallucination_error) AS err FROM read"
    )
    return steps


_ASPECTS = _aspect_steps()
sql(
    "comprehensive_analysis",
    "reviews",
    "SELECT review_id, "
    + ", ".join(f"CASE WHEN err IS NULL THEN {a}_raw END AS {a}_score" for a in K.ASPECTS)
    + ", "
    + ", ".join(f"CASE WHEN err IS NULL THEN {a}_text END AS {a}_note" for a in K.ASPECTS)
    + """, CASE WHEN err IS NULL THEN bias_sure END AS bias_confidence,
  CASE WHEN json_type(toxicity_doc, '$.detected_issues') IS NULL THEN '' ELSE 'insult' END
    AS detected_issues,
  bias_raw > 3 AS bias_exceeded, err AS analysis_error FROM whole""",
    _ASPECTS,
)
sql(
    "batch_analysis",
    "reviews",
    "SELECT review_id, "
    + ", ".join(
        f"CASE WHEN err IS NULL THEN {a}_raw ELSE 0.0 END AS {a}_score" for a in K.ASPECTS
    )
    + """, CASE WHEN err IS NULL THEN toxicity_text ELSE 'Analysis failed: ' || err END
    AS toxicity_note FROM whole""",
    _ASPECTS,
)


def risk(t: str, b: str, h: str, limits: tuple[str, str, str]) -> tuple[str, str, str]:
    """(max score, level, list of violations)."""
    top = f"greatest({t}, {b}, {h})"
    level = (
        f"CASE WHEN {top} >= 8 THEN 'HIGH' WHEN {top} >= 5 THEN 'MEDIUM' "
        f"WHEN {top} >= 3 THEN 'LOW' ELSE 'MINIMAL' END"
    )
    found = listed(
        *[
            (
                f"{x} > {limit}",
                f"'{a} (' || printf('%.1f', {x}) || ' > {limit})'",
            )
            for a, x, limit in zip(K.ASPECTS, (t, b, h), limits)
        ]
    )
    return top, level, found


def _risk_select(limits) -> str:
    top, level, found = risk("toxicity_score", "bias_score", "hallucination_score", limits)
    return f"""SELECT review_id, {level} AS risk_level, {top} AS max_score,
  {bar(found)} AS threshold_violations, len({found}) = 0 AS should_approve FROM reviews"""


sql("risk_summary", "reviews", _risk_select(("5.0", "3.0", "6.0")))
sql("analyzer_thresholds", "reviews", _risk_select(("10.0", "0.0", "4.5")))
_TOP, _LEVEL, _FOUND = risk("toxicity_raw", "bias_raw", "hallucination_raw", ("5.0", "3.0", "6.0"))
_ERRORS = f"""CASE WHEN err IS NOT NULL THEN 'Analysis failed: ' || err
  WHEN len({_FOUND}) > 0 THEN 'Policy violations: ' || array_to_string({_FOUND}, ', ') END"""
sql(
    "analyze_reviews",
    "reviews",
    f"SELECT review_id, status, coalesce({_ERRORS}, '') AS processing_errors FROM whole",
    _ASPECTS,
)
sql(
    "analysis_response",
    "reviews",
    "SELECT true AS success, review_id, status, processing_duration_ms AS processing_time_ms, "
    + ", ".join(f"CASE WHEN err IS NULL THEN {a}_raw END AS {a}_score" for a in K.ASPECTS)
    + f""", CASE WHEN err IS NULL THEN {_LEVEL} END AS risk_level,
  3.0::DOUBLE AS bias_threshold, {_ERRORS} AS errors FROM whole""",
    _ASPECTS,
)
_LENGTHS = {
    "lengths": "SELECT review_id, "
    + ", ".join(
        f"length({filled(text, content='content')}) AS {a}_n"
        for a, text in _ASPECT_PROMPTS.items()
    )
    + " FROM reviews",
    "failures": "SELECT *, coalesce("
    + ", ".join(
        f"CASE WHEN {a}_n % 19 = 0 THEN 'Failed to analyze {a}: model unavailable' END"
        for a in K.ASPECTS
    )
    + ") AS err FROM lengths",
    "results": "SELECT *, "
    + ", ".join(
        f"CASE WHEN err IS NULL THEN ({a}_n % {m}) / 10.0 ELSE 0.0 END AS {a}_score"
        for a, m in (("toxicity", 101), ("bias", 89), ("hallucination", 97))
    )
    + " FROM failures",
}
_TOP3, _LEVEL3, _FOUND3 = risk(
    "toxicity_score", "bias_score", "hallucination_score", ("5.0", "3.0", "6.0")
)
sql(
    "analyze_content",
    "reviews",
    f"""SELECT review_id, {_SCORES}, CASE WHEN err IS NULL THEN bias_n || ' characters'
    ELSE 'Analysis failed: ' || err END AS bias_note, err AS analysis_error,
  {_LEVEL3} AS risk_level, {_TOP3} AS max_score, {bar(_FOUND3)} AS threshold_violations,
  len({_FOUND3}) = 0 AS should_approve FROM results""",
    _LENGTHS,
)
sql(
    "model_cost_rows",
    "reviews",
    f"""SELECT review_id, input_tokens / 1000.0::DOUBLE * 0.0008::DOUBLE
    + output_tokens / 1000.0::DOUBLE * 0.0032::DOUBLE AS cost_usd,
  {q(K.LIBRARY_MODEL_ID)} AS model_id, '1000' AS max_tokens FROM reviews""",
)
sql(
    "mock_scores_rows",
    "reviews",
    f"""SELECT review_id, 1.0::DOUBLE AS toxicity_score, 0.5::DOUBLE AS bias_score,
  2.0::DOUBLE AS hallucination_score, {q(K.MOCK_EXPLANATIONS["bias"])} AS bias_note,
  1500 AS processing_time_ms FROM reviews""",
)

# --- policy -----------------------------------------------------------------
sql(
    "unknown_mode_rows",
    "gaps",
    """SELECT review_id, compliance_mode, 'UNKNOWN_MODE' AS policy_error FROM gaps
WHERE compliance_mode NOT IN ('mild', 'standard', 'strict')""",
)
sql(
    "join_stages",
    "decided",
    f"SELECT review_id, rating, {_SCORES}, decision FROM decided",
)
sql(
    "threshold_policy_rows",
    "gaps modes",
    f"""SELECT review_id, decision, {bar("reasons")} AS reasons, explanation,
  tox AS toxicity_limit, bia AS bias_limit, hal AS hallucination_limit
FROM ({handler_policy("gaps")})""",
)

_REGIONS = "VALUES ('eu-west-1', 3.0::DOUBLE, 2.0::DOUBLE), ('us-east-1', 5.0, 4.0)"
_CATEGORIES = """VALUES ('children_toys', 1.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE),
  ('healthcare', 2.0, 1.0, 1.0), ('electronics', 5.0, 4.0, 6.0)"""
_MODES = """VALUES ('mild', 8.0::DOUBLE, 7.0::DOUBLE, 8.0::DOUBLE),
  ('standard', 5.0, 4.0, 6.0), ('strict', 3.0, 2.0, 4.0)"""


def engine_policy(table, modes=_MODES, regions=_REGIONS, categories=_CATEGORIES) -> str:
    t, b, h = (f"coalesce({a}_score, 0.0::DOUBLE)" for a in K.ASPECTS)

    def over(label: str, x: str, limit: str) -> str:
        return f"'{label} score ' || {x} || ' exceeds threshold ' || {limit}"

    checks = [
        (f"{t} > mt", K.TOXICITY_REASON, over("Toxicity", t, "mt")),
        (f"{b} > mb", K.BIAS_REASON, over("Bias", b, "mb")),
        (f"{h} > mh", K.HALLUCINATION_REASON, over("Hallucination", h, "mh")),
        (f"{t} > rt", K.REGIONAL_REASON, "'Regional toxicity limit exceeded for ' || region"),
        (f"{b} > rb", K.REGIONAL_REASON, "'Regional bias limit exceeded for ' || region"),
    ]
    for name, x, limit in (("toxicity", t, "ct"), ("bias", b, "cb"), ("hallucination", h, "ch")):
        checks.append(
            (
                f"{x} > {limit}",
                K.CATEGORY_REASON,
                f"'Category {name} limit exceeded for ' || product_category",
            )
        )
    reasons = listed(*[(cond, q(reason)) for cond, reason, _ in checks])
    texts = listed(*[(cond, text) for cond, _, text in checks])
    return f"""
SELECT * EXCLUDE (mt), CASE WHEN mt IS NULL THEN NULL WHEN len(rs) > 0 THEN 'DENY'
    ELSE 'ALLOW' END AS decision,
  CASE WHEN mt IS NULL THEN NULL WHEN len(rs) > 0 THEN {bar("rs")}
    ELSE 'CONTENT_APPROVED' END AS reasons,
  CASE WHEN mt IS NULL THEN NULL WHEN len(rs) > 0
    THEN 'Content policy violations: ' || array_to_string(vs, '; ')
    ELSE {q(K.CONTENT_MEETS)} END AS explanation,
  CASE WHEN mt IS NULL THEN 'UNKNOWN_MODE' END AS policy_error
FROM (SELECT g.*, mt, {reasons} AS rs, {texts} AS vs FROM {table} g
  LEFT JOIN ({modes}) m(mode, mt, mb, mh) ON m.mode = g.compliance_mode
  LEFT JOIN ({regions}) r(rkey, rt, rb) ON r.rkey = g.region
  LEFT JOIN ({categories}) ca(ckey, ct, cb, ch) ON ca.ckey = g.product_category)"""


sql(
    "content_policy_rows",
    "gaps",
    f"""SELECT review_id, decision, reasons, explanation, policy_error
FROM ({engine_policy("gaps")})""",
)
_NEW_MODES = """VALUES ('mild', 8.0::DOUBLE, 7.0::DOUBLE, 8.0::DOUBLE),
  ('standard', 7.0, 4.0, 6.0), ('strict', 3.0, 2.0, 4.0), ('lenient', 9.0, 9.0, 9.5)"""
_NEW_REGIONS = "VALUES ('eu-west-1', 6.0::DOUBLE, NULL::DOUBLE), ('us-east-1', 5.0, 4.0)"
_NEW_CATEGORIES = _CATEGORIES + ", ('books', NULL, 3.0, NULL)"
sql(
    "update_policies",
    "gaps",
    f"""SELECT review_id, o.decision AS old_decision, n.decision, n.reasons, n.explanation,
  n.policy_error
FROM ({engine_policy("gaps")}) o
JOIN ({engine_policy("gaps", _NEW_MODES, _NEW_REGIONS, _NEW_CATEGORIES)}) n
USING (review_id)""",
)
_LAST_MODES = """VALUES ('mild', 8.0::DOUBLE, 7.0::DOUBLE, 8.0::DOUBLE),
  ('standard', 4.0, 4.0, 6.0), ('strict', 3.0, 2.0, 4.0), ('lenient', 9.0, 9.0, 9.5)"""
_LAST_REGIONS = "VALUES ('eu-west-1', NULL::DOUBLE, 1.5::DOUBLE), ('us-east-1', 5.0, 4.0)"
_LAST_CATEGORIES = _CATEGORIES + ", ('books', 2.5, NULL, NULL)"


def judged_then(rows: str, modes: str, regions: str, categories: str) -> str:
    """Both policies over some of the reviews."""
    table = f"(SELECT * FROM gaps WHERE {rows})"
    limits = [f"coalesce(m.{x}, s.{x})" for x in ("mt", "mb", "mh")]
    over = " OR ".join(
        f"coalesce({a}_score, 10.0) >= {x}" for a, x in zip(K.ASPECTS, limits)
    )
    shown = ", ".join(f"{x} AS {a}_limit" for a, x in zip(K.ASPECTS, limits))
    return f"""SELECT e.review_id, e.decision AS content_decision, e.reasons AS content_reasons,
  e.explanation AS content_explanation, e.policy_error,
  CASE WHEN {over} THEN 'DENY' ELSE 'ALLOW' END AS threshold_decision, {shown}
FROM ({engine_policy(table, modes, regions, categories)}) e
LEFT JOIN ({modes}) m(mode, mt, mb, mh) ON m.mode = e.compliance_mode
JOIN ({modes}) s(mode, mt, mb, mh) ON s.mode = 'standard'"""


sql(
    "policy_versions",
    "gaps",
    " UNION ALL ".join(
        [
            judged_then("k < 100", _MODES, _REGIONS, _CATEGORIES),
            judged_then("k >= 100 AND k < 400", _NEW_MODES, _NEW_REGIONS, _NEW_CATEGORIES),
            judged_then("k >= 400", _LAST_MODES, _LAST_REGIONS, _LAST_CATEGORIES),
        ]
    ),
)
_SUMMARY_INPUT = {
    "sinput": """
SELECT k, review_id, CASE WHEN k % 11 <> 0 THEN k % 10 END AS reviews_excluded,
  CASE WHEN k % 13 <> 0 THEN k % 12 END AS total_reviews,
  CASE WHEN k % 7 <> 0 THEN toxicity_score END AS quality_score FROM reviews"""
}


def summary_rules(table: str) -> str:
    total = "coalesce(total_reviews, 1)"
    rate = (
        f"CASE WHEN {total} > 0 THEN coalesce(reviews_excluded, 0)::DOUBLE / {total}::DOUBLE "
        "ELSE 0.0 END"
    )
    high = (
        "'High exclusion rate: ' || printf('%.2f', rate * 100) || '% of reviews excluded'"
    )
    low = "'Summary quality score ' || quality || ' below threshold'"
    reasons = listed(
        ("rate > 0.5", q(K.REGIONAL_REASON)), ("quality < 5", q(K.HALLUCINATION_REASON))
    )
    texts = listed(("rate > 0.5", high), ("quality < 5", low))
    return f"""
SELECT *, CASE WHEN len(rs) > 0 THEN 'DENY' ELSE 'ALLOW' END AS decision,
  CASE WHEN len(rs) > 0 THEN {bar("rs")} ELSE 'CONTENT_APPROVED' END AS reasons,
  CASE WHEN len(rs) > 0 THEN 'Summary policy violations: ' || array_to_string(vs, '; ')
    ELSE {q(K.SUMMARY_MEETS)} END AS explanation
FROM (SELECT *, {reasons} AS rs, {texts} AS vs
  FROM (SELECT *, {rate} AS rate, coalesce(quality_score, 10.0::DOUBLE) AS quality
    FROM {table}))"""


sql(
    "summary_policy_rows",
    "reviews",
    "SELECT review_id, decision, reasons, explanation, region, product_category, "
    f"compliance_mode FROM ({summary_rules('sinput')}) JOIN (SELECT k, region, "
    "product_category, compliance_mode FROM reviews) USING (k)",
    _SUMMARY_INPUT,
)
sql(
    "half_defined_modes",
    "gaps",
    f"""SELECT review_id, decision, policy_error, k AS credit_limit, k + 1 AS x_max_y,
  compliance_mode NOT IN ('mild', 'standard', 'strict') AS is_unknown
FROM ({engine_policy("gaps")})""",
)
sql(
    "numeric_ratings",
    "reviews",
    """SELECT review_id, CASE WHEN k % 11 = 0 THEN 3 ELSE CAST(k % 7 AS INTEGER) END AS rating,
  NULL::VARCHAR AS rating_error FROM reviews""",
)
sql(
    "suffixed_numbers",
    "reviews",
    """SELECT review_id, CASE k % 7 WHEN 1 THEN 7.0 WHEN 3 THEN 1000.0 WHEN 4 THEN 2.5
  END::DOUBLE AS value FROM reviews""",
)
_RULES = []
for _kind, _entries in K.DEFAULT_POLICIES.items():
    for _key, _value in _entries.items():
        _pairs = _value.items() if isinstance(_value, dict) else [("threshold", _value)]
        _RULES += [
            f"({q(_kind)}, {q(_key)}, {q(n)}, {float(v)}::DOUBLE)" for n, v in _pairs
        ]
sql(
    "policy_listing",
    "reviews",
    f"""SELECT policy_type, policy_key, limit_name, limit_value, '1.0.0' AS policy_version,
  '2024-01-01T00:00:00Z' AS last_updated,
  (SELECT count(*) FROM reviews WHERE policy_key = CASE policy_type
    WHEN 'regional_compliance' THEN region WHEN 'category_restrictions'
    THEN product_category ELSE compliance_mode END) AS n_reviews
FROM (VALUES {", ".join(_RULES)}) v(policy_type, policy_key, limit_name, limit_value)""",
)
sql(
    "route_approved",
    "decided",
    f"""SELECT review_id, {_SCORES}, {_SUMMARY_READ} AS summary FROM decided
WHERE decision = 'ALLOW'""",
)
sql(
    "route_rejected",
    "decided",
    f"""SELECT review_id, {_SCORES}, decision, {bar("reasons")} AS reasons, explanation
FROM decided WHERE decision <> 'ALLOW'""",
)
sql(
    "audit_sink_failure",
    "decided",
    """SELECT review_id, decision, 'run-1' AS execution_id, 'audit' AS errors,
  true AS is_unlogged, 200 AS status_code FROM decided""",
)
_MODERATED = f"""SELECT 200 AS status_code,
  CASE WHEN decision = 'ALLOW' THEN 'SUCCESS' ELSE 'REJECTED' END AS result,
  review_id, product_id,
  CASE WHEN decision = 'ALLOW' THEN 'APPROVED' ELSE 'DENIED' END AS policy_decision,
  {_SCORES}, {bar("reasons")} AS policy_reasons,
  CASE WHEN decision = 'ALLOW' THEN {_SUMMARY_READ} END AS summary,
  CASE WHEN decision <> 'ALLOW' THEN explanation END AS rejection_explanation,
  'run-1' AS execution_id, {iso("ts")} AS timestamp, true AS audit_logged
FROM decided"""
sql("moderate_reviews", "decided", _MODERATED)
sql(
    "stream_moderation",
    "decided",
    _MODERATED
    + f"""
WHERE length(content) BETWEEN 10 AND 5000 AND product_category IN {isin(K.CATEGORIES)}""",
)
sql(
    "error_fallbacks",
    "gaps modes",
    "SELECT review_id, "
    + ", ".join(f"CASE WHEN k % 5 = 1 THEN 10.0 ELSE {a}_score END AS {a}_score" for a in K.ASPECTS)
    + f""",
  CASE WHEN k % 5 = 1 THEN {q(K.ANALYSIS_FAILED)} END AS bias_note,
  CASE WHEN k % 7 = 2 THEN 'DENY' ELSE decision END AS decision,
  CASE WHEN k % 7 = 2 THEN 'SYSTEM_ERROR' ELSE {bar("reasons")} END AS reasons,
  CASE WHEN k % 7 = 2 THEN {q(K.POLICY_FAILED)} ELSE explanation END AS explanation,
  CASE WHEN k % 11 = 3 THEN {q(K.SUMMARY_FAILED)} ELSE 'A summary.' END AS summary,
  CASE WHEN k % 5 = 1 THEN 'ANALYSIS_FAILED' END AS error_type,
  CASE WHEN k % 11 = 3 THEN 1 END AS reviews_excluded
FROM ({handler_policy("gaps")})""",
)

# --- summaries --------------------------------------------------------------
sql("product_summary_stats", "stats", "SELECT * FROM stats")
sql(
    "all_rejected_products",
    "stats",
    f"""SELECT product_id, {q(K.ALL_REJECTED_TEXT)} AS summary, reviews_processed,
  reviews_included, reviews_excluded, 0.0::DOUBLE AS average_rating,
  'neutral' AS sentiment, 0.0::DOUBLE AS confidence, '' AS key_themes,
  'ALL_REVIEWS_REJECTED' AS exclusion_reasons FROM stats WHERE reviews_included = 0""",
)
sql(
    "summary_prompt",
    "stats lines",
    "SELECT product_id, reviews_included, CASE WHEN reviews_included > 0 THEN "
    + filled(
        K.PRODUCT_SUMMARY_PROMPT,
        approved_count="CAST(reviews_included AS VARCHAR)",
        product_id="product_id",
        average_rating="printf('%.1f', average_rating)",
        reviews_text="reviews_text",
    )
    + " END AS prompt FROM stats LEFT JOIN lines USING (product_id)",
)
_LIMITED = filled(
    K.SUMMARIZATION_PROMPT,
    max_toxicity="'5.0'",
    max_bias="'3.0'",
    max_hallucination="'6.0'",
    reviews_content="reviews_text",
)
_PARTS = {
    "rows": """
SELECT product_id, ts, review_id, 'Rating: ' || rating || '/5 - ' || content AS line
FROM sreviews WHERE coalesce(analysis_passed, true)""",
    "parted": """
SELECT *, ('0x' || substr(md5(review_id), 1, 8))::BIGINT % parts AS part
FROM (SELECT *, CAST(ceil(sum(length(line) + 1) OVER (PARTITION BY product_id) / 100000)
  AS BIGINT) AS parts FROM rows)""",
    "texts": f"""
SELECT product_id, part, parts, string_agg(line, '{NL}' ORDER BY ts, review_id) AS reviews_text
FROM parted GROUP BY product_id, part, parts""",
}
sql(
    "constrained_prompt",
    "sreviews",
    f"SELECT product_id, part, parts, {_LIMITED} AS prompt, 1500 AS max_tokens FROM texts",
    _PARTS,
)
sql(
    "limited_summaries",
    "sreviews",
    f"""SELECT product_id, part, length({_LIMITED}) || ' characters' AS summary,
  0.5::DOUBLE AS confidence, 1500 AS sources_used, NULL::VARCHAR AS error FROM texts""",
    _PARTS,
)
sql(
    "product_summary_tree",
    "sreviews",
    """SELECT product_id, count(*) || ' reviews' AS summary, 0.5::DOUBLE AS confidence,
  CAST(count(*) AS INTEGER) AS sources_used, count(DISTINCT part) AS n_parts,
  0::BIGINT AS failed_parts, NULL::VARCHAR AS error FROM parted GROUP BY product_id""",
    {k: v.replace("100000", "5000") for k, v in _PARTS.items() if k != "texts"},
)
_SDOC = {
    "answered": f"SELECT *, {summary_response('k')} AS answer FROM reviews",
    "sdocs": f"SELECT *, {unfenced('answer')} AS doc FROM answered",
    "styped": """SELECT *, coalesce(json_valid(doc), false) AS ok,
  CASE WHEN json_valid(doc) THEN json_type(doc) END AS kind FROM sdocs""",
}
sql(
    "parse_summary",
    "reviews",
    f"""SELECT review_id,
  CASE WHEN NOT ok THEN {q(K.SUMMARY_PARSE_FAILED)}
    WHEN kind <> 'OBJECT' THEN {q(K.SUMMARY_SYSTEM_ERROR)}
    ELSE coalesce(json_extract_string(doc, '$.summary'), {q(K.SUMMARY_DONE)}) END AS summary,
  CASE WHEN NOT ok THEN 'mixed' WHEN kind = 'OBJECT'
    THEN coalesce(json_extract_string(doc, '$.sentiment'), 'mixed') END AS sentiment,
  CASE WHEN NOT ok THEN 0.5 WHEN kind = 'OBJECT'
    THEN coalesce(CAST(json_extract_string(doc, '$.confidence') AS DOUBLE), 0.5) END
    AS confidence,
  CASE WHEN NOT ok THEN 'quality|value|functionality' WHEN kind <> 'OBJECT' THEN ''
    ELSE coalesce(array_to_string(json_extract_string(doc, '$.key_themes[*]'), '|'), '') END
    AS key_themes,
  CASE WHEN ok AND kind <> 'OBJECT' THEN 500 ELSE 200 END AS status_code FROM styped""",
    _SDOC,
)
sql(
    "constrained_summary",
    "reviews",
    f"""SELECT review_id, CASE WHEN json_type(doc) = 'OBJECT'
    THEN json_extract_string(doc, '$.summary') END AS summary,
  CASE WHEN json_type(doc) = 'OBJECT'
    THEN CAST(json_extract_string(doc, '$.confidence') AS DOUBLE) END AS confidence,
  CASE WHEN doc IS NULL THEN {q(K.UNPARSED_RESPONSE)} END AS error,
  CASE WHEN doc IS NULL THEN answer END AS raw_content
FROM (SELECT *, {tolerant("answer")} AS doc
  FROM (SELECT *, {summary_response("k")} AS answer FROM reviews))""",
)
sql(
    "products_without_reviews",
    "reviews",
    f"""SELECT 'prod-' || p_partkey AS product_id, 400 AS status_code,
  {q(K.NO_REVIEWS_ERROR)} AS error FROM part
WHERE 'prod-' || p_partkey NOT IN (SELECT product_id FROM reviews)""",
)

# --- reports ----------------------------------------------------------------
_IN = f"WHERE ts BETWEEN {PERIOD}"
_COST = "CAST(sum(CAST(cost_usd AS DECIMAL(18, 10))) AS DOUBLE)"
_TOTALS = {
    "totals": f"""
SELECT count(*) AS n, count(*) FILTER (WHERE NOT approved) AS denied,
  count(*) FILTER (WHERE event_type = 'ANALYSIS') AS analysed_n,
  CAST(sum(processing_duration_ms) AS DOUBLE) AS ms, {_COST} AS cost
FROM audit {_IN}"""
}
sql(
    "audit_statistics",
    "audit",
    """SELECT n AS total_events, analysed_n AS n_analysis, n - analysed_n AS n_policy_decision,
  denied AS policy_violations, ms / n AS average_processing_time, cost AS total_cost
FROM totals""",
    _TOTALS,
)
sql(
    "events_by_type",
    "audit",
    f"""SELECT event_type, count(*) AS events,
  count(*) FILTER (WHERE NOT approved) AS violations,
  CAST(sum(processing_duration_ms) AS BIGINT) AS duration_ms, {_COST} AS cost
FROM audit {_IN} GROUP BY event_type""",
)
sql(
    "rollup_statistics",
    "audit",
    """SELECT event_type, count(*) AS events, count(*) FILTER (WHERE NOT approved) AS violations,
  CAST(sum(processing_duration_ms) AS BIGINT) AS duration_ms,
  CAST(sum(CAST(cost_usd AS DECIMAL(18, 10))) AS DOUBLE) AS cost,
  count(*) FILTER (WHERE analysis) AS analysed,
  CAST(min(processing_duration_ms) FILTER (WHERE timed) AS DOUBLE) AS time_min,
  CAST(max(processing_duration_ms) FILTER (WHERE timed) AS DOUBLE) AS time_max,
  CAST(sum(processing_duration_ms) FILTER (WHERE timed) AS DOUBLE) AS time_sum,
  count(*) FILTER (WHERE timed) AS time_n,
  min(toxicity_score) FILTER (WHERE analysis) AS toxicity_min,
  max(toxicity_score) FILTER (WHERE analysis) AS toxicity_max,
  count(toxicity_score) FILTER (WHERE analysis) AS toxicity_n
FROM (SELECT * EXCLUDE (ts), ts + to_days(CAST(processing_duration_ms % 10 AS INTEGER)) AS moved,
        event_type = 'ANALYSIS' AS analysis,
        event_type = 'ANALYSIS' AND processing_duration_ms > 0 AS timed FROM audit)
WHERE moved BETWEEN TIMESTAMP '2024-01-03 05:00:00' AND TIMESTAMP '2024-01-08 10:00:00'
  AND epoch(moved) + 365 * 86400 > epoch(TIMESTAMP '2025-01-03 08:00:00')
GROUP BY event_type""",
)
sql(
    "compliance_summary",
    "audit",
    f"""SELECT n AS total_records, {r("(n - denied) / n * 100", 2)} AS compliance_rate_percent,
  denied AS policy_violations, {r("ms / n", 2)} AS average_processing_time_ms,
  {r("cost", 4)} AS total_cost_usd, analysed_n AS n_analysis,
  n - denied AS approved_content, {r("denied / n * 100", 2)} AS rejection_rate_percent,
  n * (ms / n) AS total_processing_time_ms, {r("cost / n", 6)} AS cost_per_event_usd
FROM totals""",
    _TOTALS,
)
_DENIED = f"{_IN} AND event_type = 'POLICY_DECISION' AND NOT approved"
sql(
    "violations_summary",
    "audit",
    f"""SELECT count(*) AS total_violations,
  count(DISTINCT product_id) AS unique_products_affected,
  count(DISTINCT user_id) AS unique_users_affected,
  (SELECT count(DISTINCT x) FROM (SELECT unnest(violations) AS x FROM audit {_DENIED}))
    AS violation_types_count FROM audit {_DENIED}""",
)
_BREAKDOWN = f"""SELECT reason, count(*) AS violations
FROM (SELECT unnest(violations) AS reason FROM audit {_DENIED}) GROUP BY reason"""
sql("violation_breakdown", "audit", _BREAKDOWN)
sql(
    "top_violation_types",
    "audit",
    f"{_BREAKDOWN} ORDER BY violations DESC, reason LIMIT 10",
)
sql(
    "violations_detail",
    "audit",
    f"""SELECT audit_id AS event_id, {iso("ts")} AS timestamp, review_id, user_id, product_id,
  {bar("violations")} AS violation_reasons, toxicity_score AS toxicity, bias_score AS bias,
  hallucination_score AS hallucination
FROM (SELECT * FROM audit {_DENIED} ORDER BY ts DESC, audit_id LIMIT 100)""",
)
sql(
    "processing_stats",
    "audit",
    """SELECT c AS total_events_processed, 730 AS date_range_days,
  c::DOUBLE / 730.0 AS events_per_day,
  coalesce(lo, 0.0) AS time_min, coalesce(hi, 0.0) AS time_max,
  coalesce(total / nullif(m, 0), 0.0) AS time_avg, m AS time_count,
  coalesce(tlo, 0.0) AS toxicity_min, coalesce(thi, 0.0) AS toxicity_max,
  coalesce(tsum / nullif(c, 0), 0.0) AS toxicity_avg, c AS toxicity_count,
  cost AS total_cost_usd, cost / greatest(c, 1) AS average_cost_per_event,
  n - analysed_n AS n_policy_decision
FROM totals, (SELECT count(*) AS c,
    CAST(min(processing_duration_ms) FILTER (WHERE processing_duration_ms > 0) AS DOUBLE) AS lo,
    CAST(max(processing_duration_ms) FILTER (WHERE processing_duration_ms > 0) AS DOUBLE) AS hi,
    CAST(sum(processing_duration_ms) FILTER (WHERE processing_duration_ms > 0) AS DOUBLE)
      AS total,
    count(*) FILTER (WHERE processing_duration_ms > 0) AS m,
    min(toxicity_score) AS tlo, max(toxicity_score) AS thi,
    CAST(sum(CAST(toxicity_score AS DECIMAL(18, 10))) AS DOUBLE) AS tsum
  FROM audit WHERE event_type = 'ANALYSIS')""",
    _TOTALS,
)
sql(
    "report_envelope",
    "audit",
    """SELECT report_id, report_type, records_processed, headline,
  '2024-01-01T00:00:00' AS start_date,
  '{"product_id":null,"user_id":null}' AS filters
FROM (SELECT 'r-compliance_summary' AS report_id, 'compliance_summary' AS report_type,
    n AS records_processed, denied AS headline FROM totals
  UNION ALL SELECT 'r-policy_violations', 'policy_violations', 0, denied FROM totals
  UNION ALL SELECT 'r-processing_stats', 'processing_stats', 0, analysed_n FROM totals)""",
    _TOTALS,
)

# --- lookups ----------------------------------------------------------------
_AUDIT_ROW = f"""SELECT audit_id, {iso("ts")} AS timestamp, event_type, review_id, user_id,
  product_id, decision, processing_duration_ms"""


def _newest(where: str, limit: int) -> str:
    return f"""{_AUDIT_ROW}
FROM (SELECT * FROM audit WHERE {where} ORDER BY ts DESC, audit_id LIMIT {limit})"""


sql("audit_by_key", "audit", f"{_AUDIT_ROW} FROM audit WHERE review_id = 'rev-17'")
sql("audit_by_review", "audit", _newest("review_id = 'rev-17'", 50))
sql("audit_by_user", "audit", _newest("user_id = 'user-5'", 100))
sql("lookup_layout", "audit", _newest("user_id = 'user-5'", 100))
sql("audit_by_product", "audit", _newest("product_id = 'prod-7'", 100))
sql("audit_by_type", "audit", _newest("event_type = 'POLICY_DECISION'", 100))
_REVIEW_ROW = f"""SELECT review_id, product_id, user_id, status, rating,
  {iso("ts")} AS timestamp, content"""


def _newest_reviews(where: str, limit: int) -> str:
    return f"""{_REVIEW_ROW}
FROM (SELECT * FROM reviews WHERE {where} ORDER BY ts DESC, review_id LIMIT {limit})"""


sql("review_by_id", "reviews", f"{_REVIEW_ROW} FROM reviews WHERE review_id = 'rev-42'")
sql("reviews_by_product", "reviews", _newest_reviews("product_id = 'prod-7'", 100))
sql("reviews_by_user", "reviews", _newest_reviews("user_id = 'user-5'", 50))
sql("reviews_by_status", "reviews", _newest_reviews("status = 'REJECTED'", 100))
_SUMMARY_ROW = f"""SELECT summary_id, product_id, reviews_processed,
  {iso("ts")} AS generated_at"""
sql("summary_by_id", "srows", f"{_SUMMARY_ROW} FROM srows WHERE summary_id = 'summary-42'")
sql(
    "summaries_by_product",
    "srows",
    f"""{_SUMMARY_ROW} FROM (SELECT * FROM srows WHERE product_id = 'prod-7'
ORDER BY ts DESC, summary_id LIMIT 10)""",
)
sql(
    "update_status",
    "reviews",
    """SELECT review_id,
  CASE WHEN l.doc_id IS NULL THEN status WHEN toxic = 1 THEN 'REJECTED' ELSE 'APPROVED' END
    AS status,
  CASE WHEN quality = 0 THEN 'low quality' ELSE 'earlier' END AS processing_errors
FROM reviews LEFT JOIN labels l ON l.doc_id = k""",
)
sql(
    "latest_n_per_key",
    "sreviews",
    f"""SELECT product_id, review_id, {iso("ts")} AS timestamp, CAST(n AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ts DESC, review_id) AS n
  FROM sreviews) WHERE n <= 5""",
)
sql(
    "latest_per_key",
    "reviews",
    f"""SELECT 'rev-' || (k - k % 3) AS review_id, k, status, {iso("ts")} AS timestamp
FROM reviews QUALIFY row_number() OVER (PARTITION BY k - k % 3 ORDER BY ts DESC) = 1""",
)

# --- audit log --------------------------------------------------------------
sql(
    "audit_records_rows",
    "audit",
    f"""SELECT 'audit-' || strftime(ts, '%Y%m%d-%H%M%S') || '-' || left(md5(review_id), 8)
    AS audit_id, {iso("ts")} AS timestamp, event_type, review_id, user_id, product_id, region,
  {_SCORES}, approved, {bar("violations")} AS policy_violations, {bar("reasons")} AS reasons,
  explanation AS decision_rationale, processing_duration_ms, ttl FROM audit""",
)
sql(
    "ttl_stamp_rows",
    "reviews",
    """SELECT review_id, CASE WHEN k % 9 = 0 THEN 1
    ELSE CAST(epoch(ts) AS BIGINT) + 365 * 86400 END AS ttl,
  CAST(epoch(ts) AS BIGINT) + 2555 * 86400 AS model_ttl FROM reviews""",
)
sql(
    "expire_audit_rows",
    "audit",
    """SELECT audit_id, ttl FROM audit
WHERE ttl > CAST(epoch(TIMESTAMP '2024-12-31 08:00:00') AS BIGINT)""",
)


# --- metrics, alarms, streams -----------------------------------------------
def _metric_select(table: str, step: str) -> str:
    return f"""SELECT {iso("w")} AS window_start, {iso(f"w + INTERVAL '{step}'")} AS window_end,
  function, invocations, errors, mean_duration_ms FROM {table}"""


sql("metrics_5min", "metrics5", _metric_select("metrics5", "5 minutes"))
sql(
    "metrics_hourly",
    "metrics60",
    f"SELECT {iso('w')} AS window_start, function, invocations FROM metrics60",
)
sql(
    "drop_expired_rows",
    "audit",
    """SELECT audit_id, CASE WHEN user_id <> 'user-5' THEN ttl END AS ttl FROM audit
WHERE user_id = 'user-5' OR ttl > CAST(epoch(TIMESTAMP '2024-12-31 08:00:00') AS BIGINT)""",
)
_VALID = f"length(content) BETWEEN 10 AND 5000 AND product_category IN {isin(K.CATEGORIES)}"
_JUDGED = {**_CALLED, "judged_calls": handler_policy("analysed")}
sql(
    "moderation_job",
    "reviews modes",
    f"""SELECT review_id, CASE WHEN decision = 'ALLOW' THEN 'SUCCESS' ELSE 'REJECTED' END AS outcome,
  CASE WHEN decision = 'ALLOW' THEN 'ANALYSIS' ELSE 'POLICY_DECISION' END AS event_type
FROM judged_calls WHERE {_VALID}
UNION ALL SELECT review_id, 'REFUSED', NULL FROM reviews WHERE NOT ({_VALID})""",
    _JUDGED,
)
sql(
    "stream_scored_moderation",
    "reviews modes",
    f"""SELECT review_id, CASE WHEN decision = 'ALLOW' THEN 'SUCCESS' ELSE 'REJECTED' END AS result,
  CASE WHEN decision = 'ALLOW' THEN 'Approved text.' END AS summary
FROM judged_calls WHERE {_VALID}""",
    _JUDGED,
)
sql(
    "stream_metrics",
    "metrics5",
    _metric_select("metrics5", "5 minutes")
)


def _alarm_sql(table: str, seconds: int, rules) -> str:
    values = ", ".join(f"({q(n)}, {q(s)}, {q(m)}, {t}::DOUBLE, {p})" for n, s, m, t, p in rules)
    return f"""SELECT alarm, {iso("w")} AS alarm_window, threshold, periods, value
FROM (SELECT b.alarm, b.w, b.threshold, b.periods, b.value,
    (SELECT count(*) FROM breaches p WHERE p.alarm = b.alarm AND p.w <= b.w
      AND p.w > b.w - to_seconds({seconds} * b.periods)) AS hits FROM breaches b)
WHERE hits = periods""", {
        "long": f"""
SELECT function AS source, 'errors' AS metric, w, errors::DOUBLE AS value FROM {table}
UNION ALL SELECT function, 'mean_duration_ms', w, mean_duration_ms FROM {table}
UNION ALL SELECT 'workflow', 'errors', w, sum(errors)::DOUBLE FROM {table} GROUP BY w""",
        "rules": f"SELECT * FROM (VALUES {values}) v(alarm, source, metric, threshold, periods)",
        "breaches": """
SELECT alarm, w, threshold, CAST(periods AS INTEGER) AS periods, value
FROM long JOIN rules USING (source, metric) WHERE value >= threshold""",
    }


_HOURLY = [
    ("review-auditor-errors", "review-auditor", "errors", 3.0, 2),
    ("review-auditor-duration", "review-auditor", "mean_duration_ms", 240000.0, 2),
    ("workflow-failures", "workflow", "errors", 5.0, 2),
    ("policy-validator-errors", "policy-validator", "errors", 2.0, 2),
    ("review-summarizer-errors", "review-summarizer", "errors", 2.0, 2),
    ("audit-logger-errors", "audit-logger", "errors", 1.0, 3),
]
_select, _steps = _alarm_sql("metrics60", 3600, _HOURLY)
sql("alarms", "metrics60", _select, _steps)
_steps["raised"] = _select.replace(iso("w"), "w")
_NEXT = "alarm_window + INTERVAL '1 hour'"
sql(
    "alarm_transitions",
    "metrics60",
    f"""SELECT alarm, {iso("w")} AS alarm_window, state_before, state FROM (
  SELECT alarm, alarm_window AS w, 'OK' AS state_before, 'ALARM' AS state FROM raised
  WHERE (alarm, alarm_window) NOT IN (SELECT (alarm, {_NEXT}) FROM raised)
  UNION ALL
  SELECT alarm, {_NEXT}, 'ALARM', 'OK' FROM raised
  WHERE (alarm, {_NEXT}) NOT IN (SELECT (alarm, alarm_window) FROM raised))""",
    _steps,
)
_select, _steps = _alarm_sql("metrics5", 300, K.ALARM_RULES)
sql("alarms_5min", "metrics5", _select, _steps)
sql(
    "stream_audit_stats",
    "audit",
    f"""SELECT {iso("w")} AS window_start, {iso("w + INTERVAL '1 hour'")} AS window_end,
  event_type, events, violations, duration_ms, total_cost
FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS w, event_type, count(*) AS events,
    count(*) FILTER (WHERE NOT approved) AS violations,
    CAST(sum(processing_duration_ms) AS BIGINT) AS duration_ms, {_COST} AS total_cost
  FROM audit GROUP BY ALL)""",
)
sql(
    "stream_redelivery",
    "reviews",
    f"""SELECT 'rev-' || (k - k % 3) AS review_id, content, status, {iso("ts")} AS timestamp
FROM reviews QUALIFY row_number() OVER (PARTITION BY k - k % 3 ORDER BY ts DESC) = 1""",
)

# --- behaviour described only by tests --------------------------------------
_EXCLUDED = listed(
    ("NOT coalesce(analysis_passed, true)", "'FAILED_POLICY_ANALYSIS'"),
    ("coalesce(toxicity_score, 0.0) > 5.0", "'HIGH_TOXICITY'"),
    ("length(content) < 10", "'CONTENT_TOO_SHORT'"),
    ("length(content) > 2000", "'CONTENT_TOO_LONG'"),
)
sql(
    "summary_filter",
    "sreviews",
    f"SELECT review_id, {bar(_EXCLUDED)} AS exclusion_reasons FROM sreviews",
)
sql(
    "fallback_summary",
    "stats",
    f"""SELECT product_id, CASE WHEN reviews_included > 0 THEN 'Based on ' || reviews_included
    || ' reviews, this product has an average rating of '
    || printf('%.1f', average_rating) || ' stars.'
  ELSE {q(K.NO_REVIEWS_FALLBACK)} END AS summary FROM stats""",
)
sql(
    "normalise_input",
    "subs",
    f"""SELECT k, review_id, product_id,
  CASE WHEN rating IS NULL THEN 3 ELSE {_WHOLE} END AS rating,
  coalesce(region, 'us-east-1') AS region,
  coalesce(product_category, 'other') AS product_category,
  CASE WHEN broken THEN 'Invalid JSON in request body'
    WHEN user_id IS NULL THEN 'Missing required field: user_id'
    WHEN length({strip("content")}) = 0 THEN 'Review content cannot be empty'
    WHEN length(content) > 5000
      THEN 'Review content exceeds maximum length of 5000 characters'
    WHEN rating IS NOT NULL AND {_BAD_RATING} THEN 'Rating must be between 1 and 5' END
    AS error
FROM (SELECT k, k % 7 = 0 AS broken, {", ".join(
    f"CASE WHEN k % 7 <> 0 THEN {f} END AS {f}"
    for f in ["review_id"] + _FIELDS
)} FROM subs)""",
)
sql(
    "event_type_default",
    "events_raw",
    f"""SELECT audit_id, CASE WHEN event_type IN {isin(K.EVENT_TYPES)} THEN event_type
  ELSE 'UNKNOWN' END AS event_type FROM events_raw""",
)
sql(
    "minimum_reviews",
    "stats",
    """SELECT product_id, reviews_included, CASE WHEN reviews_included < 2
    THEN 'Insufficient reviews for summary: ' || reviews_included || ' of 2 required' END
    AS summary, CASE WHEN reviews_included < 2 THEN 0.0::DOUBLE END AS quality_score
FROM stats""",
)
_ENTRY = {
    **_SUMMARY_INPUT,
    "mixed": """
SELECT g.* REPLACE (
    coalesce(CASE WHEN g.k % 10 <> 0 THEN g.region END, 'us-east-1') AS region,
    coalesce(CASE WHEN g.k % 14 <> 0 THEN g.product_category END, 'general')
      AS product_category),
  reviews_excluded, total_reviews, quality_score,
  CASE WHEN g.k % 12 = 0 THEN 'content'
    ELSE (['content', 'summary', 'other'])[g.k % 3 + 1] END AS validation_type
FROM gaps g JOIN sinput s USING (review_id)""",
}
sql(
    "policy_entry_rows",
    "gaps",
    f"""SELECT review_id, c.validation_type, c.region, c.product_category,
  CASE c.validation_type WHEN 'content' THEN c.decision WHEN 'summary' THEN s.decision END
    AS decision,
  CASE c.validation_type WHEN 'content' THEN c.reasons WHEN 'summary' THEN s.reasons END
    AS reasons,
  CASE c.validation_type WHEN 'content' THEN c.explanation
    WHEN 'summary' THEN s.explanation END AS explanation,
  CASE WHEN c.validation_type = 'content' THEN c.policy_error
    WHEN c.validation_type <> 'summary'
    THEN 'Unknown validation type: ' || c.validation_type END AS error
FROM ({engine_policy("mixed")}) c JOIN ({summary_rules("mixed")}) s USING (review_id)""",
    _ENTRY,
)
