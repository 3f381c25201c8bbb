import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from reviewgate.llm import conversation_repair as C
from reviewgate.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]")
SHAPE = re.compile(r"(s?(ua)+)?")
TURN = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
CLASHING = ["place", "first", "audit", "fault", "copy", "dropped", "slot", "digest", "of"]


@pytest.fixture
def turns(spark):
    def make(rows, partitions=3):
        schema = T.StructType(TURN.fields + [T.StructField(x, T.LongType()) for x in CLASHING])
        full = [tuple(r) + (0,) * len(CLASHING) for r in rows]
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make


def after_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        own += [(turn, role, text)] * (2 if fault == 3 else 1)
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2])))
    return out


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        words = WORD.findall(text)
        if not words:
            out.append("b")
        elif (role, text) in seen:
            out.append("d")
        else:
            out.append("-" if words[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def plain_repair(rows, found):
    """Left to right, the least (cost, audit, lines) of each state, with up to two insertions."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {"u": "user", "a": "assistant"}

    def padded(best):
        for _ in range(2):
            for (q, (cost, audit, lines)), x in itertools.product(list(best.items()), "ua"):
                if (q, x) in after:
                    new = (cost + 3, audit + "I", lines + (f"{names[x]}:",))
                    to = after[q, x]
                    best[to] = min(best.get(to, new), new)
        return best

    best = {0: (0, "", ())}
    for (_, role, text), fault in zip(rows, found):
        following = {}
        for q, (cost, audit, lines) in padded(best).items():
            options = [(q, 4, "D", ())]
            if fault not in "bd":
                more = 3 * (fault == "t")
                if (q, role[:1]) in after:
                    options.append((after[q, role[:1]], more, "K", (f"{role}:{text}",)))
                options += [
                    (after[q, x], 3 + more, "R", (f"{names[x]}:{text}",))
                    for x in "ua"
                    if (q, x) in after
                ]
            for to, price, letter, line in options:
                new = (cost + price, audit + letter, lines + line)
                following[to] = min(following.get(to, new), new)
        best = following
    return min(x for q, x in padded(best).items() if q in (0, 3))


def plain(rows):
    out = []
    for conv, own in after_damage(rows).items():
        found = faults(own)
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        first = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        cost, audit, lines = plain_repair(own, found)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *[found.count(x) for x in "bdt"], illegal, cost, audit, digest))
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0))


def got(frame):
    assert frame.columns == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        "repaired_sha256",
    ]
    return sorted(map(tuple, frame.collect()), key=lambda x: (x[0] is not None, x[0] or 0))


def drawn(draw, conversations, longest):
    roles = ["user", "assistant", "system", "tool", "User", "", None]
    texts = ["Yes.", "No!", "Why?", "cut", " ", "", "a.b", "end. \n", None, " "]
    out = []
    for conv in range(conversations):
        for turn in range(draw.randint(1, longest)):
            role = draw.choices(roles, (8, 8, 3, 1, 1, 1, 1))[0]
            text = draw.choice(texts) if draw.random() < 0.4 else f"text {conv} {turn}."
            out.append((conv, None if draw.random() < 0.03 else turn, role, text))
    return out


def test_agenda_against_every_edit_sequence():
    """All edit sequences with up to two insertions in a gap, on short conversations."""
    draw = random.Random(4)
    for _ in range(60):
        codes = [draw.choice("sua-") + draw.choice("--tbd") for _ in range(draw.randint(0, 4))]
        best = None
        gaps = [range(3)] * (len(codes) + 1)
        choices = [C.readings(x) for x in codes]
        for pads, edits in itertools.product(itertools.product(*gaps), itertools.product(*choices)):
            audit, cost = "I" * pads[0], 3 * sum(pads)
            for (letter, _, price), n in zip(edits, pads[1:]):
                audit, cost = audit + letter + "I" * n, cost + price
            if best is not None and (cost, audit) >= best:
                continue
            kinds = [["u", "a"]] * pads[0]
            for (_, x, _), n in zip(edits, pads[1:]):
                kinds += ([[x]] if x else []) + [["u", "a"]] * n
            if any(SHAPE.fullmatch("".join(x)) for x in itertools.product(*kinds)):
                best = (cost, audit)
        assert C.compose([C.span_items(codes)]) == best
        # Cut anywhere, spans give the same.
        for cut in range(len(codes) + 1):
            halves = [C.span_items(codes[:cut]), C.span_items(codes[cut:])]
            assert C.compose(halves) == best


def test_against_plain_repair(turns):
    draw = random.Random(8)
    rows = drawn(draw, 60, 12)
    want = plain(rows)
    assert got(C.repaired_digests(C.damaged(turns(rows)))) == want
    assert sum(x[6] for x in want) > 100


def test_long_conversations_in_small_spans(turns):
    """Over many tasks and spans, among short ones."""
    draw = random.Random(12)
    rows = drawn(draw, 8, 6) + [(100, t, r, x) for _, t, r, x in drawn(draw, 1, 1)]
    for turn in range(700):
        rows.append((50, turn, draw.choice(["user", "assistant"]), f"t {turn % 500}" + "." * (turn % 3)))
    frame = C.damaged(turns(rows, 5))
    want = plain(rows)
    assert got(C.repaired_digests(frame, span_rows=16)) == want
    assert got(C.repaired_digests(frame)) == want


def test_repaired_rows_are_whole(turns):
    rows = drawn(random.Random(2), 30, 9)
    frame = C.damaged(turns(rows))
    plans = C.plan_repairs(frame)
    by_conv = {}
    for r in C.repaired_rows(frame, plans).collect():
        by_conv.setdefault(r.conv_id, []).append(r)
    for plan in plans.collect():
        own = by_conv.get(plan.conv_id, [])
        assert [r.slot for r in own] == list(range(len(own)))
        assert "".join(r.edit for r in own) == plan.audit.replace("D", "")
        assert SHAPE.fullmatch("".join(r.role[0] for r in own))


def test_cases(turns):
    long = "word " * 200_000 + "."
    ids = range(400)
    gone = next(i for i in ids if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    calm = [i for i in ids if all(zlib.crc32(f"{i}:{t}".encode()) % 20 > 4 for t in (0, 1, 5))][:4]
    rows = [(gone, 0, "user", "Hello.")]
    rows += [(calm[0], 0, "user", long), (calm[0], 1, "assistant", "Yes.")]
    rows += [(calm[1], 0, "user", "Same."), (calm[1], 0, "user", "Same."), (calm[1], 5, "assistant", "Ok.")]
    rows += [(calm[2], None, None, None), (calm[2], None, "user", "A."), (calm[2], 1, "tool", "B")]
    rows += [(None, 0, "user", "C."), (None, None, "assistant", "D."), (None, 3, None, "E.")]
    want = plain(rows)
    assert got(C.repaired_digests(C.damaged(turns(rows)))) == want
    empty = hashlib.sha256(b"").hexdigest()
    assert (gone, 0, 0, 0, 0, 0, 0, "", empty) in want
    assert C.repaired_digests(C.damaged(turns([]))).collect() == []


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    want = plain([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
    assert got(queries.QUERIES["op13_conversation_repair"](spark, sf)) == want
