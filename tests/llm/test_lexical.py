import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from reviewgate.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(rows, items, k=20):
    """Every document with every item, by the formula."""
    docs = [(d, split(t)) for d, t, *_ in rows]
    docs = [(d, w) for d, w in docs if w]
    n, total = len(docs), sum(len(w) for _, w in docs)
    having = Counter(t for _, w in docs for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for d, w in docs:
            tf, m = Counter(w), 100 - 25 + (25 * len(w) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * having[t] + 1)))
                * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m))
                for t in split(text)
                if tf[t]
            )
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        scored.sort(key=lambda x: x[:3])
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(scored[:k])]
    return sorted(out, key=str)


def got(frame):
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.fixture
def items(spark):
    def make(rows):
        return spark.createDataFrame(rows, "item_id long, text string, score long, rank long")

    return lambda rows: make([(*r, 0, 0) for r in rows])


def test_terms_are_whole_and_only_ascii_is_lowered():
    for text in ("Ab ab-AB_ab", "É é  x", "a1 1a a\x00b {c}~[d]", "", "  ", "ÀB c"):
        assert L.terms(text.encode()) == split(text)
        assert L.size(L.guarded(text.encode())) == len(split(text))
    own = L.Items.of([(0, "ab b aba".encode())])
    found = own.counts(L.guarded(b"ab ab aba,abab b-ab"))
    assert {t: found[n] for t, n in own.number.items()} == {"ab": 3, "b": 1, "aba": 1}


def test_against_the_formula(docs, items, prose):
    draw = random.Random(3)
    words = split(" ".join(prose[:40]))
    rows = [(i, t) for i, t in enumerate(prose[:120])]
    rows += [(1000 + i, " ".join(draw.choices(words, k=draw.randint(1, 60)))) for i in range(150)]
    asked = [(i, " ".join(draw.choices(words, k=draw.randint(1, 30)))) for i in range(25)]
    want = plain(rows, asked)
    assert got(L.rank_documents(docs(rows, clashing=True, partitions=7), items(asked))) == want
    # Blocks of few terms, and few rows to a sum, change nothing.
    assert got(L.rank_documents(docs(rows), items(asked), block_terms=40)) == want
    few = plain(rows, asked, k=3)
    assert got(L.rank_documents(docs(rows, partitions=40), items(asked), k=3)) == few


def test_ties_and_repeated_rows(docs, items):
    rows = [(i, "red fox") for i in range(60, 0, -1)] + [(7, "red fox"), (None, "red fox")]
    rows += [(100 + i, "blue hen") for i in range(300)]
    asked = [(1, "red"), (1, "red"), (2, "fox fox red"), (3, "hen")]
    want = plain(rows, asked)
    assert got(L.rank_documents(docs(rows, partitions=5), items(asked))) == want
    assert [x[2] for x in want if x[0] == 2][:1] == [None]


def test_cases(docs, items):
    long = "alpha beta " * 50_000 + "gamma"
    rows = [(1, None), (2, ""), (3, " ,;-"), (4, long), (5, "Gamma GAMMA"), (6, "x" * 100_000)]
    asked = [(1, "gamma"), (2, None), (3, ""), (4, "..."), (None, "beta"), (6, "x" * 100_000)]
    want = plain(rows, asked)
    assert {x[0] for x in want} == {1, None, 6}
    assert got(L.rank_documents(docs(rows, clashing=True), items(asked))) == want
    assert got(L.rank_documents(docs([]), items(asked))) == []
    assert got(L.rank_documents(docs(rows), items([]))) == []
    assert got(L.rank_documents(docs(rows), items([(1, "absent")]))) == []


def test_a_term_in_every_document_has_a_weight_of_its_own(docs, items):
    """ln of (2 N + 2) / (2 N + 1) rounds down to nothing above 500 documents."""
    rows = [(i, "the end") for i in range(600)]
    assert got(L.rank_documents(docs(rows), items([(1, "the")]))) == plain(rows, [(1, "the")]) == []


def test_sums_stay_exact_beyond_doubles():
    own = L.Items.of([(0, b"a")])
    all_of = L.Corpus(10**10, 10**13, np.ones(1, np.int64))
    weights = all_of.weights()
    counts = Counter({0: 10**8})
    m = 75 + (25 * 10**8 * 10**10) // 10**13
    want = int(weights[0]) * ((10**9 * 10**8) // (1000 * 10**8 + 12 * m))
    assert L.scores_of(own, [(10**8, counts)], weights, all_of).tolist() == [[want]]
