import random

import numpy as np
import pytest

from reviewgate.llm import decontaminate as D


@pytest.fixture
def items(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


def plain_score(item, text):
    """Smith-Waterman cell by cell."""
    before, best = [0] * (len(text) + 1), 0
    for a in item:
        row = [0]
        for j, b in enumerate(text):
            step = D.MATCH if a == b and a > 0 else D.MISMATCH
            row.append(max(0, before[j] + step, before[j + 1] + D.GAP, row[j] + D.GAP))
        before = row
        best = max(best, *row)
    return best / (D.MATCH * len(item))


def test_alignment_against_cell_by_cell():
    draw = random.Random(5)
    for _ in range(300):
        item = [draw.randint(1, 6) for _ in range(draw.randint(1, 20))]
        text = [draw.randint(0, 6) for _ in range(draw.randint(0, 40))]
        score, begin, end = D.align(np.array(item), np.array(text, np.int64))
        assert score == plain_score(item, text)
        if score:
            assert plain_score(item, text[begin:end]) == score


def changed(text, every, draw):
    """A copy with every so manieth word replaced, dropped or doubled."""
    out = []
    for i, word in enumerate(text.split()):
        kind = draw.choice("rdi") if i % every == every - 1 else "k"
        out += {"k": [word], "r": ["other"], "d": [], "i": [word, "more"]}[kind]
    return " ".join(out)


def test_exact_and_edited_copies(docs, prose, items):
    draw = random.Random(6)
    known = [r for r in items.collect() if len(D.words(r.text)) >= 20][:12]
    clean = prose[:30]
    rows = [(1000 + i, t) for i, t in enumerate(clean)]
    want = set()
    for n, r in enumerate(known):
        for k, every in enumerate((10_000, 8, 5, 4, 3)):
            body = clean[(n + k) % len(clean)].split()
            middle = len(body) // 2
            passage = changed(r.text, every, draw)
            text = " ".join([*body[:middle], passage.upper() if k == 1 else passage, *body[middle:]])
            rows.append((n * 10 + k, text))
            block = D.Items.of([(r.item_id, r.text)])
            # Random edits may leave less than a leak; every other one has to be found.
            if D.align(block.words_of(0), block.numbered(text))[0] >= D.LEAST_SCORE:
                want.add((n * 10 + k, r.item_id))
    assert len(want) >= 54
    found = D.find_leaks(docs(rows, clashing=True), items).collect()
    already = {
        (r.doc_id, r.item_id)
        for r in D.find_leaks(docs([(1000 + i, t) for i, t in enumerate(clean)]), items).collect()
    }
    got = {(r.doc_id, r.item_id) for r in found}
    assert want <= got
    extra = {d for d, _ in got - want if d >= 1000}
    assert extra == {d for d, _ in already}
    for r in found:
        if r.doc_id % 10 == 0 and r.doc_id < 1000 and (r.doc_id, r.item_id) in want:
            assert r.score == 1.0


def test_against_aligning_everything(spark, sf, items):
    """Every document with every item, whole: the seeds lose no leak and add none."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()
    known = items.collect()
    block = D.Items.of([(r.item_id, r.text) for r in known])
    want = set()
    for r in rows:
        text = block.numbered(r.text)
        for at, item in enumerate(block.ids):
            if D.align(block.words_of(at), text)[0] >= D.LEAST_SCORE:
                want.add((r.doc_id, item))
    frame = spark.createDataFrame(rows)
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(frame, items).collect()}
    assert got == want


def edited(words, draw):
    """A copy with any edits that leave it a leak, or nearly one."""
    out = []
    for word in words:
        kind = draw.choices("krdi", (draw.uniform(2, 6), 1, 1, 1))[0]
        out += {"k": [word], "r": ["x"], "d": [], "i": [word, "y"]}[kind]
    return out


def test_seeds_find_what_aligning_everything_finds():
    """Items of all lengths over few words, any rarity of their seeds, dense edits, long texts."""
    draw = random.Random(11)
    leaks = 0
    for trial in range(150):
        vocabulary = [f"w{i}" for i in range(draw.choice([4, 30, 400]))]
        rows = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(1, 40)))) for i in range(8)]
        plain = D.Items.of(rows)
        counts = {int(c): draw.randint(0, 9) for c in plain.codes}
        block = D.Items.of(rows, counts if trial % 2 else None)
        item = draw.choice(rows)[1].split()
        parts = draw.choices(vocabulary, k=60), edited(item, draw), draw.choices(vocabulary, k=60)
        text = " ".join(w for part in parts for w in part)
        numbers = block.numbered(text)
        want = {
            block.ids[i]: score
            for i in range(len(block.ids))
            if (score := D.align(block.words_of(i), numbers)[0]) >= D.LEAST_SCORE
        }
        leaks += len(want)
        assert {x[0]: x[1] for x in D.leaks_of(block, ['a b', text, None]).get(1, [])} == want
    assert leaks > 200


@pytest.mark.parametrize(
    "change",
    [
        lambda w: [x if i % 3 != 2 else "other" for i, x in enumerate(w)],  # two of three kept
        lambda w: [x for i, x in enumerate(w) if i % 3 != 2],  # every third dropped
        lambda w: [y for x in w for y in (x, "more")][:-1],  # a word after each
        lambda w: w[: (len(w) + 1) // 2],  # the first half only
    ],
)
def test_copies_at_the_edge_of_a_leak(items, change):
    known = [(r.item_id, r.text) for r in items.collect()]
    block = D.Items.of(known)
    found = 0
    for item, text in known:
        copy = " ".join(change(D.words(text)))
        score = D.align(block.words_of(block.ids.index(item)), block.numbered(copy))[0]
        assert (item in {x[0] for x in D.leaks_of(block, [copy]).get(0, [])}) == (score >= D.LEAST_SCORE)
        found += score >= D.LEAST_SCORE
    assert found >= 0.9 * len(known)


def test_a_leak_over_the_border_of_two_pieces(items, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 32)
    item, text = max(((r.item_id, r.text) for r in items.collect()), key=lambda x: len(x[1]))
    block = D.Items.of([(item, text)])
    for before in range(0, 200, 7):
        for after in (0, 150):
            found = D.leaks_of(block, ["zz " * before + text + " zz" * after])[0]
            assert [x[:2] for x in found] == [(item, 1.0)]


def test_texts_of_one_batch_do_not_meet(items):
    """An item cut over two texts is found in neither if no half is a leak of its own."""
    text = max((r.text for r in items.collect()), key=len)
    block, w = D.Items.of([(1, text)]), D.words(text)
    cut = [w[i : i + len(w) // 3] for i in range(0, len(w), len(w) // 3)]
    found = D.leaks_of(block, [" ".join(x) for x in cut] + [text])
    assert list(found) == [len(cut)]


def test_seed_counts_against_counting_pairs(docs, prose, items):
    from collections import Counter

    rows = [(r.item_id, r.text) for r in items.collect()]
    texts = [*prose[:20], None, "", rows[0][1]]
    block = D.Items.of(rows)
    want, wanted = Counter(), {(a, b) for _, t in rows for w in [D.words(t)]
                               for d in (1, 2) for a, b in zip(w, w[d:])}
    for t in texts:
        w = D.words(t)
        want.update(p for d in (1, 2) for p in zip(w, w[d:]) if p in wanted)
    number, base = block.number, len(block.number) + 1
    got = D._counted(docs(list(enumerate(texts))), "text", rows)
    for (a, b), n in want.items():
        assert got.get(number[a] * base + number[b], 0) == n


def test_a_passage_in_every_document_is_found(docs, prose, items):
    passage = max((r.text for r in items.collect()), key=len)
    frame = docs([(i, f"{t} {passage}") for i, t in enumerate(prose[:50])])
    found = D.find_leaks(frame, items).filter("score = 1").select("doc_id").distinct()
    assert found.count() == 50



def test_an_edited_passage_in_many_documents_is_found(docs, prose, items):
    """Every fifth word replaced, so no six words in a row, in more documents than 0.1%."""
    known = [r for r in items.collect() if len(D.words(r.text)) >= 20][:4]
    rows, want = [], set()
    for n, r in enumerate(known):
        passage = " ".join(
            "other" if i % 5 == 4 else w for i, w in enumerate(D.words(r.text))
        )
        for k in range(12):
            rows.append((100 * n + k, f"{prose[k]} {passage} {prose[k + 12]}"))
            want.add((100 * n + k, r.item_id))
    frame = docs(rows)
    assert want <= {(r.doc_id, r.item_id) for r in D.find_leaks(frame, items).collect()}
    assert D.keep_clean(frame, items).count() == 0


def test_short_items_are_found_at_any_frequency(spark, docs, prose):
    """Items of three to five words, in more documents than 0.1%."""
    texts = ["zebra quartz lantern", "amber violin copper tide", "nine pale foxes dig wells"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(100 * n + k, f"{prose[k]} {x} {prose[k]}") for n, x in enumerate(texts) for k in range(8)]
    found = D.find_leaks(docs(rows), items).filter("score = 1").collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, d // 100) for d, _ in rows}


def test_no_alignment_scores_over_its_bound():
    draw = random.Random(7)
    leaks = 0
    for _ in range(500):
        item = np.array([draw.randint(1, 9) for _ in range(draw.randint(3, 20))])
        text = np.array([draw.randint(0, 9) for _ in range(draw.randint(1, 60))])
        score = D.align(item, text)[0]
        if score >= D.LEAST_SCORE:
            leaks += 1
            assert score <= D.score_bound(item, text)
    assert leaks > 50


def test_blocks_of_items_change_nothing(docs, prose, items):
    texts = [f"{t} {r.text}" for t, r in zip(prose, items.collect())]
    frame = docs(list(enumerate(texts)))
    whole = {(r.doc_id, r.item_id, r.score) for r in D.find_leaks(frame, items).collect()}
    cut = D.find_leaks(frame, items.limit(8), block_words=100)
    ids = {r.item_id for r in items.limit(8).collect()}
    assert {(r.doc_id, r.item_id, r.score) for r in cut.collect()} == {
        x for x in whole if x[1] in ids
    }


def test_cases(spark, docs, items):
    known = items.orderBy("item_id").first()
    rows = [(1, None), (2, ""), (3, known.text), (3, known.text), (None, known.text)]
    rows.append((4, "filler words " * 40_000 + known.text))
    found = D.find_leaks(docs(rows, clashing=True), items).filter(f"item_id = {known.item_id}")
    assert sorted((r.doc_id or 0) for r in found.collect()) == [0, 3, 3, 4]
    frame = docs(rows, clashing=True)
    kept = D.keep_clean(frame, items)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
    odd = spark.createDataFrame(
        [(1, None), (2, ""), (3, "two words"), (None, known.text)], "item_id long, text string"
    )
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(docs(rows), odd).collect()} == {
        (3, None), (None, None), (4, None)
    }
    assert D.find_leaks(docs(rows), odd.limit(0)).count() == 0
    assert D.find_leaks(docs([]), items).count() == 0
    assert D.keep_clean(docs(rows), odd.limit(0)).count() == len(rows)
    assert D.keep_clean(docs([]), items).count() == 0
