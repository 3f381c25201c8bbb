import zlib
from collections import Counter, defaultdict

import pytest

from reviewgate.llm import sharding


def check(rows, found, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(
        (k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, *_ in rows
    )
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(0 <= s < shards for s in slots)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1


@pytest.mark.parametrize("bucket_rows", [7, 100, 1 << 20])
def test_law_and_mixture(docs, bucket_rows):
    rows = [
        (i, f"text {i % 50}", "en", "hot" if i % 3 == 0 else f"src{i % 4}") for i in range(900)
    ]
    found = sharding.interleaved(docs(rows), 8, bucket_rows=bucket_rows).collect()
    check(rows, found, 8)
    source = {r[0]: r[3] for r in rows}
    total = Counter(source.values())
    for shard in range(8):
        mixture = Counter(source[r.doc_id] for r in found if r.shard == shard)
        for name, n in total.items():
            assert abs(mixture[name] - n / 8) <= 2


def test_buckets_do_not_change_the_result(docs):
    rows = [(i, str(i), None, f"s{i % 3}") for i in range(300)]
    results = [
        {(r.doc_id, r.shard, r.slot) for r in sharding.interleaved(docs(rows), bucket_rows=n).collect()}
        for n in (5, 64, 10_000)
    ]
    assert results[0] == results[1] == results[2]


def test_cases(docs):
    rows = [(1, None), (2, ""), (2, ""), (None, "x"), (None, "x"), (3, "é" * 100_000, None, "a")]
    rows += [(4, "y", None, ""), (4, "z", None, None)]
    found = sharding.interleaved(docs(rows, clashing=True), 3, bucket_rows=2).collect()
    check(rows, found, 3)
    assert len({r.shard for r in sharding.interleaved(docs(rows[:2]), 16).collect()}) == 2


def test_empty_table(docs):
    assert sharding.interleaved(docs([])).count() == 0
