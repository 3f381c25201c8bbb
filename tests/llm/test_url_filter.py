import re

from reviewgate.llm import url_filter as U
from reviewgate.llm.queries import QUERIES, URL_RULES


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [
        r
        for r in URL_RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return (best.name, best.verdict) if best else (None, None)


URLS = [
    None, "", "no scheme", "://", "http://", "http://ORG", "http://org/", "http://x.org/a?b#c",
    "http://xorg/", "http://example.org/es/1", "http://m.example.org/en/12", "http://a.example.org/en/2",
    "http://example.com/fr/", "http://example.com/fr", "http://example.com/de/x", "http://É.com/de/",
    "http://a.net/x?u=http://b.org/", "http://a.net?x/y", "http://a.net#/y", "x\nhttp://a.com/fr/\nb",
    "http://host.net/" + "p" * 50_000, "HTTP://A.COM/DE/",
]


def test_parts_and_rules_against_brute_force(pages):
    frame = pages([(i, u, None) for i, u in enumerate(URLS * 2)], clashing=True)
    rows = U.judge(frame, URL_RULES, [0.0] * U.DIMENSIONS).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        url = URLS[r.page_id % len(URLS)]
        assert (r.host, r.path) == plain_parts(url), url
        name, verdict = plain_rule(r.host, r.path)
        assert r.rule == name
        assert r.verdict == (verdict or "allow")


def test_model_learns_and_rules_outrank_it(spark, pages):
    labelled = spark.createDataFrame(
        [(f"http://spam{i % 7}.net/casino/{i}", True) for i in range(60)]
        + [(f"http://news{i % 7}.net/story/{i}", False) for i in range(60)]
        + [(None, True), ("http://a.net/", None)],
        "url string, blocked boolean",
    )
    weights = U.train(labelled)
    assert weights == U.train(labelled.repartition(7))
    rows = U.judge(
        pages([(1, "http://spam9.net/casino/999", ""), (2, "http://news9.net/story/999", ""),
               (3, "http://spam9.org/casino/1", "")]),
        URL_RULES, weights,
    ).collect()
    assert {r.page_id: r.verdict for r in rows} == {1: "block", 2: "allow", 3: "allow"}


def test_query_against_brute_force(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op9_url_filter"](spark, sf).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path) == plain_parts(urls[r.page_id])
        name, verdict = plain_rule(r.host, r.path)
        assert r.rule == name
        assert r.verdict == verdict or (verdict is None and r.verdict in ("allow", "block"))


def test_score_against_plain_sum(spark, pages):
    weights = [((i * 37) % 101 - 50) / 50 for i in range(U.DIMENSIONS)]
    frame = U.with_parts(pages([(1, "http://a.net/b/c", None)]).select("url"))
    row = frame.select(U.features().alias("x"), U.margin(U.features(), weights).alias("m")).first()
    # Intercept, host and path: three characters each between their end marks.
    assert len(row.x) == 1 + (len("a.net") + 2 - 2) + (len("/b/c") + 2 - 2)
    want = 0.0
    for i in row.x:
        want += weights[i]
    assert abs(row.m - want / len(row.x) ** 0.5) < 1e-12


def test_empty_tables(spark, pages):
    nothing = spark.createDataFrame([], "url string, blocked boolean")
    weights = U.train(nothing)
    assert set(weights) == {0.0}
    assert U.judge(pages([]), URL_RULES, weights).count() == 0


def test_no_python(pages):
    judged = U.judge(pages([(1, "u", "")]), URL_RULES, [0.0] * U.DIMENSIONS)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_url_in_very_many_rows_is_one_example(spark):
    rows = [(f"http://spam{i % 7}.net/casino/{i}", True) for i in range(60)]
    rows += [(f"http://news{i % 7}.net/story/{i}", False) for i in range(60)]
    schema = "url string, blocked boolean"
    once = U.train(spark.createDataFrame(rows, schema))
    hot = spark.createDataFrame(rows + rows[:1] * 3000, schema).repartition(6)
    assert U.train(hot, max_labelled=500) == once


def test_training_urls_are_chosen_where_they_are_read(spark, tmp_path):
    """The scan has as many tasks as the table has parts; only the chosen rows meet in one."""
    path = str(tmp_path / "urls")
    spark.range(400).selectExpr(
        "concat('http://h', id % 9, '.net/', id) as url", "id % 3 = 0 as blocked"
    ).repartition(6).write.parquet(path)
    seen = []
    real = U.materialise

    def noted(df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    U.materialise = noted
    try:
        U.train(spark.read.parquet(path), rounds=1)
    finally:
        U.materialise = real
    assert "Coalesce 1" not in seen[0]
    assert seen[0].index("SinglePartition") < seen[0].index("HashAggregate") if "SinglePartition" in seen[0] else "Exchange RoundRobin" in seen[0]
