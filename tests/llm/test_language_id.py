import pytest

from reviewgate.llm import language_id
from reviewgate.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model(spark, sf):
    return language_id.train(spark.read.parquet(f"{sf}/documents.parquet"))


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_language_id"](spark, sf).collect()
    assert len(rows) == len(truth)
    apart = [r for r in rows if r.held_out]
    assert apart and sum(r.lang_pred == truth[r.doc_id] for r in apart) >= 0.95 * len(apart)
    assert all(0 <= r.score <= 1 for r in rows)


def test_fold_is_the_stated_one(spark):
    import zlib

    ids = [*range(200), -5, None]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    rows = frame.select("doc_id", language_id.held_out(frame.doc_id).alias("h")).collect()
    for r in rows:
        want = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert r.h == want


def test_backoff_to_shorter_ngrams(docs):
    frame = docs([(1, "schön über", "de"), (2, "house above", "en")])
    own = language_id.train(frame)
    assert own.word_score("schön") is not None
    assert own.predict("schönste")[0] == "de"
    assert own.predict("houses")[0] == "en"
    assert own.word_score("日") is None
    lang, score = own.predict("日本")
    assert lang in ("de", "en") and score == pytest.approx(0.5)


def test_cases(docs, model):
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the thing " * 50_000), (4, "the"), (None, "la")]
    found = language_id.identify(docs(rows, clashing=True), model).collect()
    got = sorted((r.doc_id or 0, r.lang_pred, r.score > 0) for r in found)
    assert [x[:2] for x in got if x[0] in (1, 2, 3)] == [(i, "und") for i in (1, 2, 3)]
    assert [x[1] for x in got if x[0] == 4] == ["en", "en"]
    assert all(x[2] == (x[1] != "und") for x in got)
    kept = language_id.keep_identified(docs(rows, clashing=True), model)
    assert kept.count() == 3
    assert kept.columns == docs(rows, clashing=True).columns


def test_empty_and_unlabelled_training(docs, model):
    assert language_id.identify(docs([]), model).count() == 0
    for rows in ([], [(1, "the", None)]):
        nothing = language_id.train(docs(rows))
        assert nothing.predict("the thing") == ("und", 0.0)


def test_bounds_of_the_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    small = language_id.train(docs, max_train_docs=50, max_words=40, max_grams=30)
    assert len(small.languages) == 4 and len(small.entries) <= 70 * 4


def test_numerals_that_are_no_digits_are_no_letters(docs, model):
    rows = [(1, "½ ² ① Ⅷ ٣"), (2, "²the² ½thing"), (3, "the thing")]
    found = {r.doc_id: r for r in language_id.identify(docs(rows), model).collect()}
    assert (found[1].lang_pred, found[1].score) == ("und", 0.0)
    assert found[2][1:] == found[3][1:]
    assert language_id.counted_words("a² b Ⅷc") == {"a": 1, "b": 1, "c": 1}


def test_a_language_with_two_rows_is_learned(spark):
    many = spark.range(40_000).selectExpr(
        "id as doc_id", "concat('the house of ', id % 997, ' is here and there') as text", "'en' as lang"
    )
    few = spark.createDataFrame(
        [(-1, "dziękuję bardzo proszę", "pl"), (-2, "gdzie jest dworzec", "pl")], many.schema
    )
    hot = spark.range(20_000).selectExpr("-100 - id as doc_id", "'hot text' as text", "'de' as lang")
    own = language_id.train(many.unionByName(few).unionByName(hot), max_train_docs=300)
    assert set(own.languages) == {"en", "pl", "de"}
    assert own.predict("dziękuję")[0] == "pl" and own.predict("the house")[0] == "en"
    assert own.predict("hot")[0] == "de"


def test_predictions_against_plain_scores(docs):
    """Brute force: every word of a small table scored by the stated rule."""
    import math
    import random
    from collections import Counter

    draw = random.Random(3)
    words = {"aa": ["mala", "kota", "dom", "las"], "bb": ["house", "cat", "wood", "mal"]}
    rows = [
        (i, " ".join(draw.choices(words[lang], k=6)), lang)
        for i, lang in enumerate(draw.choices(["aa", "bb"], k=40))
    ]
    own = language_id.train(docs(rows))
    counts = {lang: Counter() for lang in words}
    for text, lang in {(t, x) for _, t, x in rows}:
        for w in text.split():
            counts[lang][f"w{w}"] += 1
            for n in range(1, language_id.LONGEST + 1):
                for g in language_id.grams(w, n):
                    counts[lang][f"{n}{g}"] += 1
    kinds = {
        (k, lang): sum(n for e, n in c.items() if e[0] == k)
        for lang, c in counts.items()
        for k in "w1234"
    }

    def entry(e, lang):
        n, total = counts[lang][e], kinds[e[0], lang]
        largest = max(kinds[e[0], x] for x in words)
        return math.log((n + 0.5) / (total + 1)) if n else -math.log(2 * largest + 2)

    known = {e for c in counts.values() for e in c}
    order = sorted(words, key=lambda x: (-kinds["w", x], x))
    for text in ("mala dom", "malakota", "house kot", "zzz", "wo", "cats dom dom"):
        total = dict.fromkeys(order, 0.0)
        for w in text.split():
            found = [f"w{w}"] if f"w{w}" in known else []
            for n in range(language_id.LONGEST, 0, -1):
                found = found or [f"{n}{g}" for g in language_id.grams(w, n) if f"{n}{g}" in known]
            for lang in order if found else []:
                total[lang] += sum(entry(e, lang) for e in found) / len(found)
        best = max(order, key=lambda x: (round(total[x], 4), -order.index(x)))
        lang, score = own.predict(text)
        assert lang == best
        want = 1 / sum(math.exp(x - total[best]) for x in total.values())
        assert score == pytest.approx(want, rel=1e-3)
