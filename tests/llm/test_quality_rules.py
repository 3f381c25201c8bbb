import random
import re
from collections import Counter

from reviewgate.llm import quality_rules as Q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines),
        len(lines) - len(set(lines)),
        len(covered),
    )


def cases(prose):
    draw = random.Random(3)
    yield from prose[:40]
    yield from [None, "", " ", "a", "a b", "a b c", "a b c a b c", "a a a a a a", "x\x0by\x0cz\r\nx"]
    yield from ["a\x1cb\x85c d", "|#|\n|#|\n\n  \n|#|", "é ü\n" * 40]
    for _ in range(150):
        sep = draw.choice([" ", "\n", "  ", "\t"])
        yield sep.join(draw.choice("abcd") for _ in range(draw.randint(0, 60)))
    yield "one two three four " * 30_000


def test_measures_against_brute_force(docs, prose):
    texts = list(cases(prose))
    frame = docs([(i, t) for i, t in enumerate(texts)], clashing=True)
    rows = Q.ledger(frame).select("doc_id", "measured.*", "failed").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[x] for x in Q.MEASURES) == plain(texts[r.doc_id]), texts[r.doc_id][:80]
        assert bool(r.failed & 1) == (r.n_words < 50)
        assert bool(r.failed & 2) == (100 * r.n_repeat_words > 50 * r.n_words)


def test_exact_way_when_hashes_meet(docs, prose, monkeypatch):
    """With next to no hash bits left windows meet all the time; counts stay right."""
    texts = list(cases(prose))[:-1]
    frame = docs([(i, t) for i, t in enumerate(texts)])
    for bits, most in ((60, 1 << 22), (22, 20)):
        monkeypatch.setattr(Q, "START_BITS", bits)
        monkeypatch.setattr(Q, "MOST_STARTS", most)
        rows = Q.ledger(frame).select("doc_id", "measured.n_repeat_words").collect()
        assert all(r.n_repeat_words == plain(texts[r.doc_id])[5] for r in rows)


def test_policies_and_ablations(docs):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good), (2, "short"), (3, good + " #" * 40), (4, None), (5, "a b c " * 40)]
    book = Q.ledger(docs(rows))
    kept = {r.doc_id: r.k for r in book.select("doc_id", Q.passes(Q.CURRENT).alias("k")).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False}
    base = book.filter(Q.passes(Q.BASE)).count()
    assert base == 2
    found = {r.rule: r for r in Q.ablations(book, Q.POLICIES["v1"]).collect()}
    assert found["too_short"].n_failed == 2 and found["too_short"].n_only_this == 2
    assert found["symbol_heavy"].n_failed == 1
    assert found["symbol_heavy"].n_kept_without == 2


def test_stage_keeps_columns_and_repeated_rows(docs):
    good = " ".join(f"word{i}" for i in range(60))
    frame = docs([(1, good), (1, good), (None, good), (2, None)], clashing=True)
    kept = Q.keep_passing(frame)
    assert kept.columns == frame.columns
    assert kept.count() == 3


def test_empty_table(docs):
    assert Q.ledger(docs([])).count() == 0
    assert Q.keep_passing(docs([])).count() == 0
    assert {r.n_failed for r in Q.ablations(Q.ledger(docs([]))).collect()} == {0}


def test_no_python_and_no_shuffle(docs):
    plan = Q.ledger(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
