import zlib

import numpy as np
import pytest

from reviewgate.llm import cotraining as C
from reviewgate.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # enough labels to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    apart = {
        r.doc_id: r.quality
        for r in labels.collect()
        if zlib.crc32(f"t{r.doc_id}".encode()) % 3 == 0
    }
    known = spark.createDataFrame(
        [(r.doc_id, r.quality) for r in labels.collect() if r.doc_id not in apart],
        "doc_id long, quality int",
    )
    model = C.train(docs, known)
    rows = C.score(docs, model).collect()
    assert len(rows) == docs.count()
    right = [(r.kept == bool(apart[r.doc_id])) for r in rows if r.doc_id in apart]
    assert sum(right) >= 0.95 * len(right)


def within(text, meta, picks=30, contents=None):
    """The surest rows in plain Python, each content once."""
    contents = list(range(len(text))) if contents is None else contents
    used = set()

    def surest(weights):
        out, new = [], set()
        for v, x in ((0, text), (1, meta)):
            p = 1 / (1 + np.exp(-np.clip(x @ weights[v], -30, 30)))
            for label, sure in ((0.0, 1 - p), (1.0, p)):
                rows = {}
                for i in range(len(text)):
                    if sure[i] >= C.SURE and contents[i] not in used:
                        rows.setdefault(contents[i], i)
                best = sorted(rows.values(), key=lambda i: (-sure[i], contents[i]))[:picks]
                new |= {contents[i] for i in best}
                out.append((v, label, text[best], meta[best]))
        used.update(new)
        return out

    return surest


def test_surest_rows_against_plain_python(docs, prose):
    """Over several rounds, with copies of one text on a third of the rows."""
    draw = np.random.default_rng(4)
    rows = [(i, t, "en", f"s{i % 7}", len(t)) for i, t in enumerate(prose[:60])]
    rows += [(100 + i, prose[0], "en", "s0", 9) for i in range(30)]
    features = C._featured(docs(rows, partitions=5), "doc_id")
    stored = features.collect()
    text, meta = C._unpacked([bytes(r.packed) for r in stored])
    want = within(text, meta, 4, [r.content for r in stored])
    got = C.surest_rows(features, set(), 4)
    some = 0
    for _ in range(4):
        weights = [draw.normal(size=C.TEXT_SIZE) * 3, draw.normal(size=C.META_SIZE) * 3]
        for a, b in zip(got(weights), want(weights), strict=True):
            assert a[:2] == b[:2]
            assert np.array_equal(a[2], b[2]) and np.array_equal(a[3], b[3])
            some += len(a[2])
    assert some > 20


def test_all_labelled_rows_still_exchange_labels(docs, prose, spark, monkeypatch):
    """Labelled rows outside the sample are the pool, without their labels."""
    rows = [(i, f"{t} {i}", "en", "good", len(t)) for i, t in enumerate(prose[:60])]
    rows += [(100 + i, "*** ### $$$ " * (i + 3), None, "junk", 7) for i in range(60)]
    known = spark.createDataFrame([(r[0], int(r[0] < 100)) for r in rows], "doc_id long, quality int")
    given, plain = [], C.surest_rows

    def counted(features, used, picks):
        surest = plain(features, used, picks)

        def run(weights):
            out = surest(weights)
            given.append(sum(len(x[2]) for x in out))
            return out

        return run

    monkeypatch.setattr(C, "surest_rows", counted)
    C.train(docs(rows), known, max_labelled=30)
    assert sum(given) >= 20


def test_one_id_on_many_rows_keeps_the_bound(docs, spark):
    rows = [(1, f"text number {i}") for i in range(2_000)] + [(2, "other")]
    features = C._featured(docs(rows), "doc_id")
    known = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 0.0)], "k long, label double")
    assert len(C._labelled(features, known, 50)) == 50


def test_views_teach_each_other():
    """Few labels, two independent views: rounds beat none on the weaker view."""
    draw = np.random.default_rng(1)

    def make(n):
        y = (draw.random(n) < 0.5).astype(float)
        text = np.zeros((n, C.TEXT_SIZE))
        meta = np.zeros((n, C.META_SIZE))
        text[:, :10] = draw.normal(size=(n, 10)) * 0.6 + (2 * y - 1)[:, None]
        meta[np.arange(n), np.where(y > 0, draw.integers(0, 12, n), draw.integers(10, 22, n))] = 1
        text[:, -1] = meta[:, -1] = 1
        return text, meta, y

    text, meta, y = make(16)
    pool = make(600)
    test = make(600)
    seen = (text, meta, y, np.zeros(len(y), bool))

    def right(rounds):
        model = C.co_train(seen, within(*pool[:2]), rounds)
        return ((test[1] @ model.meta > 0) == (test[2] > 0)).mean()

    assert right(3) > right(0)


def test_newton_finds_the_optimum():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(200, 5))
    y = (x[:, 0] + draw.normal(size=200) > 0).astype(float)
    weights = C.fit(x, y)
    slope = x.T @ (1 / (1 + np.exp(-x @ weights)) - y) + C.RIDGE * weights
    assert np.abs(slope).max() < 1e-6


@pytest.mark.parametrize(
    "labels, want", [([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0), ([(None, 1), (1, None)], 0.5)]
)
def test_without_two_classes(spark, docs, labels, want):
    frame = docs([(1, "a"), (2, None), (3, "")])
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = C.score(frame, C.train(frame, known)).collect()
    assert all(abs(r.score - want) < 1e-9 for r in rows)


def test_cases(spark, docs, prose):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(prose[:40])]
    rows += [(100 + i, "*** ### $$$ " * (i + 3), None, "junk", 7) for i in range(40)]
    rows += [(7, prose[7], "en", "s", 5), (200, None), (201, ""), (None, "x"), (202, "w " * 90_000)]
    frame = docs(rows, clashing=True)
    known = spark.createDataFrame(
        [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(7, 1), (999, 0)],
        "doc_id long, quality int",
    )
    found = C.score(frame, C.train(frame, known)).collect()
    assert len(found) == len(rows)
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in found)
    by_id = {r.doc_id: r.kept for r in found}
    assert sum(by_id[i] for i in range(40)) >= 38
    assert sum(by_id[100 + i] for i in range(40)) <= 2


def test_sample_bound(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = C._sample(docs.select("doc_id"), "doc_id", 50).count()
    assert 20 <= some <= 50


def test_empty_table(spark, docs):
    frame = docs([])
    known = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert C.score(frame, C.train(frame, known)).count() == 0


def test_query_scores_every_row(spark, sf):
    rows = QUERIES["op6_cotraining"](spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
