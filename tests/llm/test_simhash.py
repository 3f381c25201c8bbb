import random
import re

import xxhash

from reviewgate.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Smallest index reachable over links of at most four bits."""
    n = len(prints)
    group = list(range(n))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return [root(i) for i in range(n)]


def near(prints, draw):
    """A print within a few bits of an earlier one."""
    found = draw.choice(prints)
    for bit in draw.sample(range(64), draw.randint(0, 6)):
        found ^= 1 << bit
    return found


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_is_the_stated_one(prose):
    for text in [*prose[:40], None, "", " \n", "One", "A b", "x y z", "A b\tc d e", "É À"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def all_links(spark, prints, hot_key):
    frame = spark.createDataFrame([(signed(x),) for x in set(prints)], "fp long")
    found = simhash.components(simhash.links(frame, hot_key), "a", "b").collect()
    return {r.node: r.root for r in found}


def check_groups(spark, prints, hot_key):
    prints = sorted(set(prints), key=signed)
    roots = all_links(spark, prints, hot_key)
    want = plain_groups(prints)
    for i, x in enumerate(prints):
        assert roots.get(signed(x), signed(x)) == signed(prints[want[i]])


def test_links_against_all_pairs(spark):
    draw = random.Random(7)
    prints = [draw.getrandbits(64) for _ in range(120)]
    for _ in range(400):
        prints.append(near(prints, draw))
    check_groups(spark, prints, simhash.HOT_KEY)


def test_hot_keys_lose_no_link(spark, monkeypatch):
    """All prints share a segment, so that its keys are cut into parts."""
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    draw = random.Random(8)
    for first, width in simhash.SEGMENTS:
        mask = ((1 << width) - 1) << first
        prints = [draw.getrandbits(64) & ~mask for _ in range(40)]
        for _ in range(160):
            prints.append(near(prints, draw) & ~mask)
        check_groups(spark, prints, 10)


def test_long_runs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "READ_ROWS", 16)
    draw = random.Random(9)
    prints = [draw.getrandbits(64)]
    for _ in range(150):
        prints.append(near(prints[:5], draw))
    check_groups(spark, prints, simhash.HOT_KEY)


def test_chain_is_one_component(spark):
    value, prints = 0, [0]
    for step in range(16):
        for bit in range(4):
            value |= 1 << (step * 4 + bit)
        prints.append(value)
    assert set(all_links(spark, prints, simhash.HOT_KEY).values()) == {min(map(signed, prints))}


def edited(text, places):
    words = text.split()
    for i in places:
        words[i % len(words)] += "x"
    return " ".join(words)


def test_groups_of_rows(docs, prose):
    long = " ".join(prose[0].split() * 40)
    rows = [
        (5, prose[1]),
        (3, prose[1]),
        (3, prose[1]),
        (9, long),
        (8, edited(long, [5])),
        (7, None),
        (6, ""),
        (None, prose[2]),
        (2, prose[2]),
        (None, prose[3]),
        (1, " \n\t"),
        (11, prose[4]),
    ]
    found = simhash.near_duplicates(docs(rows, clashing=True)).collect()
    got = [(r.doc_id, r.component_id) for r in found]
    want = [(5, 3), (3, 3), (3, 3), (9, 8), (8, 8), (7, 1), (6, 1), (1, 1), (2, 2), (11, 11)]
    assert sorted(got, key=str) == sorted([*want, (None, 2), (None, None)], key=str)


def test_one_row_of_each_group_stays(docs, prose):
    rows = [
        (5, prose[1], "en"),
        (3, prose[1], "fr"),
        (3, prose[1], "de"),
        (3, prose[4]),
        (None, prose[2]),
        (2, prose[2]),
        (None, prose[3], "b"),
        (None, prose[3], "a"),
        (7, None),
        (6, ""),
    ]
    frame = docs(rows, clashing=True)
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    got = sorted([(r.doc_id, r.text, r.lang) for r in kept.collect()], key=str)
    want = [(3, prose[1], "de"), (3, prose[4], None), (2, prose[2], None), (None, prose[3], "a")]
    assert got == sorted([*want, (6, "", None)], key=str)


def test_a_key_of_a_head_on_another_text_goes(docs, prose):
    """Key 5 heads its own group, and stands on a second text whose group 3 heads."""
    rows = [(5, prose[1]), (3, prose[2]), (5, prose[2]), (7, prose[4])]
    kept = simhash.keep_one(docs(rows)).collect()
    want = [(3, prose[2]), (5, prose[1]), (7, prose[4])]
    assert sorted((r.doc_id, r.text) for r in kept) == want


def test_empty_table(docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    assert simhash.keep_one(docs([])).count() == 0


def test_result_against_brute_force(spark, sf):
    from reviewgate.llm.queries import QUERIES

    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    texts.sort(key=lambda r: r.doc_id)
    prints = [plain_fingerprint(r.text) for r in texts]
    groups = plain_groups(prints)
    want = {
        r.doc_id: (f"{x:016x}", texts[g].doc_id) for r, x, g in zip(texts, prints, groups)
    }
    got = QUERIES["op8_simhash"](spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want
