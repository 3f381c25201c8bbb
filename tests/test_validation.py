import pytest
from pyspark.sql import functions as F

from reviewgate.functions.text import shorter_than, strip
from reviewgate.operators import validation as V

FIELDS = (
    "id int, product_id string, user_id string, content string, rating string, "
    "region string, product_category string, compliance_mode string"
)
GOOD = ("p1", "u1", "A fine product.", "4", "us-east-1", "books", "mild")


def variants(spark, changes):
    names = [x.split()[0] for x in FIELDS.split(", ")][1:]
    data = []
    for i, change in enumerate(changes):
        row = dict(zip(names, GOOD)) | change
        data.append((i, *[row[n] for n in names]))
    return spark.createDataFrame(data, FIELDS)


def errors(df):
    return [r["errors"] for r in df.orderBy("id").collect()]


def test_api_rules(spark):
    cases = [
        ({}, []),
        ({"content": "Short"}, ["content"]),
        ({"content": "x" * 10}, []),
        ({"content": "x" * 5000}, []),
        ({"content": "x" * 5001}, ["content"]),
        ({"content": " " * 10}, []),
        ({"product_id": "p" * 100}, []),
        ({"product_id": "p" * 101}, ["product_id"]),
        ({"product_id": "", "user_id": None}, ["product_id", "user_id"]),
        ({"rating": "0"}, ["rating"]),
        ({"rating": "6"}, ["rating"]),
        ({"rating": "4.5"}, ["rating"]),
        ({"rating": None}, ["rating"]),
        ({"region": None, "product_category": None, "compliance_mode": None}, []),
        ({"region": "mars-1"}, ["region"]),
        ({"product_category": "children_toys"}, ["product_category"]),
        ({"compliance_mode": "lenient"}, ["compliance_mode"]),
    ]
    assert errors(V.validate_api(variants(spark, [x for x, _ in cases]))) == [e for _, e in cases]


def test_model_rules(spark):
    cases = [
        ({}, []),
        ({"content": ""}, ["content"]),
        ({"content": " \t\n 　"}, ["content"]),
        ({"content": "x"}, []),
        ({"rating": "-1"}, ["rating"]),
        ({"region": None}, ["region"]),
        ({"product_category": "healthcare"}, ["product_category"]),
        ({"product_id": "p" * 500}, []),
    ]
    df = V.validate_model(variants(spark, [x for x, _ in cases]))
    assert errors(df) == [e for _, e in cases]
    stripped = V.validate_model(variants(spark, [{"content": "  good \n"}]))
    assert stripped.first()["content"] == "good"


def test_split_keeps_every_row(spark):
    df = V.validate_api(variants(spark, [{}, {"rating": "9"}, {}]))
    good, bad = V.split(df)
    assert (good.count(), bad.count()) == (2, 1)
    assert "errors" not in good.columns


def test_scores_summary_audit(spark):
    scores = spark.createDataFrame(
        [(0, 0.0, 10.0, 5.0), (1, -1.0, 11.0, 5.0), (2, None, 1.0, 1.0)],
        "id int, toxicity_score double, bias_score double, hallucination_score double",
    )
    assert errors(V.validate_scores(scores)) == [
        [], ["toxicity_score", "bias_score"], ["toxicity_score"],
    ]
    summaries = spark.createDataFrame(
        [(0, "p", "t", 1, 0), (1, "p", "t", -1, 2), (2, "p", "t", 0, 0), (3, "p", "", 1, 1)],
        "id int, product_id string, summary_text string, reviews_processed int, "
        "reviews_excluded int",
    )
    assert errors(V.validate_summary(summaries)) == [
        [], ["reviews_processed"], ["review_totals"], ["summary_text"],
    ]
    audit = spark.createDataFrame(
        [(0, "r", "u", "p", "ERROR", "us-east-1", 0), (1, "", "u", "p", "LOGIN", "x", -1),
         (2, "r", "u", "p", "UNKNOWN", "us-west-2", None)],
        "id int, review_id string, user_id string, product_id string, event_type string, "
        "region string, processing_duration_ms int",
    )
    assert errors(V.validate_audit(audit)) == [
        [], ["review_id", "event_type", "region", "processing_duration_ms"], [],
    ]
    typed = V.known_event_type(audit).orderBy("id").collect()
    assert [r["event_type"] for r in typed] == ["ERROR", "UNKNOWN", "UNKNOWN"]


def test_input_defaults(spark):
    df = spark.createDataFrame(
        [(0, None, None, None, None), (1, "r", "text", "toys", "4.5"), (2, "r", "t", "x", " 4 ")],
        "id int, review_id string, content string, product_category string, rating string",
    )
    a, b, c = V.input_defaults(df).orderBy("id").collect()
    assert (a["review_id"], a["content"], a["product_category"], a["rating"]) == (
        "unknown", "", "other", 3,
    )
    assert b["rating"] is None
    assert b["rating_error"] == "invalid literal for int() with base 10: '4.5'"
    assert (c["rating"], c["rating_error"]) == (4, None)


def test_normalise_input(spark):
    names = [
        "review_id", "product_id", "user_id", "content", "rating", "region",
        "product_category", "compliance_mode", "api_request_id", "source_ip", "user_agent",
    ]
    struct = "struct<" + ",".join(f"{n}:string" for n in names) + ">"

    def given(**values):
        return tuple(values.get(n) for n in names)

    full = dict(review_id="r1", content="Great product!", product_id="p", user_id="u")
    body = (
        '{"review_id": "r1", "content": "Good product", "product_id": "p", "user_id": "u", '
        '"rating": 4, "region": "eu-west-1", "product_category": "electronics"}'
    )
    cases = [
        ((None, given(**full, rating="5")), None),
        ((body, None), None),
        ((None, given(**(full | {"user_id": None}))), "Missing required field: user_id"),
        ((None, given(**(full | {"content": "   "}))), "Review content cannot be empty"),
        ((None, given(**(full | {"content": "x" * 5001}))),
         "Review content exceeds maximum length of 5000 characters"),
        ((None, given(**full, rating="6")), "Rating must be between 1 and 5"),
        (("invalid json", None), "Invalid JSON in request body"),
    ]
    df = spark.createDataFrame(
        [(i, *row) for i, (row, _) in enumerate(cases)], f"id int, body string, input {struct}"
    )
    got = V.normalise_input(df).orderBy("id").collect()
    assert [r["error"] for r in got] == [e for _, e in cases]
    assert (got[0]["region"], got[0]["product_category"]) == ("us-east-1", "other")
    assert (got[1]["region"], got[1]["rating"]) == ("eu-west-1", 4)
    assert got[2]["rating"] == 3


@pytest.mark.parametrize("n", [1, 5])
def test_strip_and_shorter_than(spark, n):
    texts = ["", " ", "abcd", "abcde", " abcde ", "　ab cd\x1c", "a" + " " * 300 + "b",
             " " * 300 + "abc", " " * 300 + "abcdef", "\x85x ", "plain text"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)],
                               "id int, t string")
    got = df.select(
        "id", strip(F.col("t")).alias("s"), shorter_than(F.col("t"), n).alias("short")
    ).orderBy("id").collect()
    assert [r["s"] for r in got] == [t.strip() for t in texts] + [None]
    assert [r["short"] for r in got] == [len(t.strip()) < n for t in texts] + [True]


def test_numbers_as_python_reads_them(spark):
    from reviewgate.functions.numbers import python_float

    texts = ["7d", "7", "3.5F", "1e3", " 2.5 ", "seven", "0x10", "-.5", "inf", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(python_float(F.col("t"))).collect()]
    assert got == [None, 7.0, None, 1000.0, 2.5, None, None, -0.5, float("inf"), None, None]
    ratings = spark.createDataFrame([(4.0,), (4.7,), (None,)], "r double")
    assert [r[0] for r in ratings.select(V.whole_number(F.col("r"))).collect()] == [4, 4, None]
