import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from reviewgate.llm import backoff_lm as B
from reviewgate.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


def split(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


class Plain:
    """The formula, token by token, from whole counts."""

    def __init__(self, rows, order):
        self.order, self.counts = order, [Counter() for _ in range(order + 1)]
        self.going_on = Counter()
        for key, text, *_ in rows:
            if held(key):
                continue
            full = ["<begin>", *split(text)]
            for end in range(1, len(full)):
                for k in range(1, order + 1):
                    if end - k + 1 >= 0:
                        gram = tuple(full[end - k + 1 : end + 1])
                        self.counts[k][gram] += 1
                        self.going_on[gram[:-1]] += 1
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])
        self.new = [
            (sum(c == 1 for c in x.values()) + 1) / (sum(x.values()) + 2) if x else 0.5
            for x in self.counts
        ]

    def chance(self, history, word):
        k = len(history) + 1
        if k == 1:
            if not self.n:
                return 1 / (self.v + 1)
            return (1 - self.new[1]) * self.counts[1][word,] / self.n + self.new[1] / (self.v + 1)
        shorter = self.chance(history[1:], word)
        if not self.going_on[history]:
            return shorter
        seen = self.counts[k][(*history, word)] / self.going_on[history]
        return (1 - self.new[k]) * seen + self.new[k] * shorter

    def row(self, key, text):
        tokens = split(text)
        full = ("<begin>", *tokens)
        counts = [self.counts[1][t,] for t in tokens]
        return (
            key, held(key), len(tokens), sum(c > 0 for c in counts), self.n,
            sum(math.log10((c + 1) / (self.n + self.v + 1)) for c in counts),
            sum(
                math.log10(self.chance(full[max(0, i - self.order + 1) : i], full[i]))
                for i in range(1, len(full))
            ),
        )


def same(frame, rows, order=2):
    model = Plain(rows, order)
    order_of = lambda x: (x[0] is not None, x[0] or 0, x[2], round(x[6], 6))
    want = sorted((model.row(key, text) for key, text, *_ in rows), key=order_of)
    assert frame.columns == [
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
    ]
    got = sorted(map(tuple, frame.collect()), key=order_of)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for have, meant in zip(got, want):
        assert have[5:] == pytest.approx(meant[5:], rel=1e-9)
    return got


def texts(draw, n, words=30):
    return [
        (i, " ".join(f"w{min(draw.randint(0, words), draw.randint(0, words))}" for _ in range(draw.randint(0, 40))))
        for i in range(n)
    ]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_the_formula(docs, order):
    draw = random.Random(order)
    rows = texts(draw, 120) + [(500 + i, f"NEW{i} w1 W2 ,") for i in range(40)]
    assert 5 < sum(held(k) for k, _ in rows) < 60
    frame = docs(rows, clashing=True, partitions=5)
    same(B.score_texts(frame, order=order), rows, order)
    # Small blocks and many buckets change nothing.
    same(B.score_texts(frame, order=order, block_bytes=300, bucket_ngrams=50), rows, order)


def test_whole_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = same(queries.QUERIES["op12_backoff_lm"](spark, sf), rows)
    out = [x for x in got if x[1]]
    # What the histories tell is worth more than what backing off costs.
    assert sum(x[6] for x in out) > sum(x[5] for x in out)


def test_each_state_shares_out_one():
    """Over all words and the unknown one, from every state."""
    draw = random.Random(9)
    block = B._Block()
    for key, text in texts(draw, 60, words=12):
        block.add(key, held(key), text.encode())
    block.add(1000, True, b"unknown")
    assert not held(0)
    names = ["block", "keys", "held", "sizes", "ids", "words", "n_ids", "n_train", "n_train_docs"]
    row = dict(zip(names, block.row("x")))
    for order in (1, 2, 3):
        _, _, grams = B.grams_of_row(row, order)
        totals = [g.counts for g in grams]
        new = [(np.sum(t == 1) + 1) / (t.sum() + 2) for t in totals]
        corpus = B.Corpus(row["n_train"], row["n_train_docs"], int((totals[0] > 0).sum()), new)
        automaton = B.Automaton.of(grams, totals, corpus)
        known = [w for w in range(1, automaton.n_words) if totals[0][w]]
        unknown = next(w for w in range(2, automaton.n_words) if not totals[0][w])
        assert len(automaton.failure) == len(automaton.failure_weights)
        for state in range(len(automaton.failure)):
            assert automaton.failure[state] < state or state == 0
            automaton.start = state
            total = sum(10 ** automaton.score([w]) for w in [*known, unknown])
            assert total == pytest.approx(1, abs=1e-9)


def test_ends_and_known_words():
    assert B.words("Àb AB\x0b\x1cc d e".encode()) == [
        x.encode() for x in ("Àb", "ab", "\x1cc d e")
    ]


def test_cases(docs):
    long = "alpha beta " * 60_000
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, "Alpha"), (5, "Alpha"), (None, "beta alpha")]
    # A held-out id: its words are known only where others have them.
    out = next(i for i in range(100, 200) if held(i))
    rows += [(out, "alpha gamma delta"), (out, "alpha gamma delta")]
    same(B.score_texts(docs(rows, clashing=True), block_bytes=100_000), rows)
    only = [(out, "alpha beta"), (out, None)]
    got = same(B.score_texts(docs(only)), only)
    assert {x[4] for x in got} == {0} and {x[3] for x in got} == {0}
    assert B.score_texts(docs([])).collect() == []
