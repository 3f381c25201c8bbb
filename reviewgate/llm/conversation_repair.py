"""Conversation structure repair by a lightest-derivation agenda (operator 13).

A conversation is to read as ``(s?(ua)+)?`` in the initials of its roles. Rows are kept, given
the role user or assistant, or deleted, and empty rows may be put in anywhere. Repairs are
deductions in a weighted hypergraph. Items are spans: [i, j, p, q] says that rows i to j lead
from reading state p to q. A span joins the reading of the next row, an inserted row, or the
span that follows it; an item's weight is its cost and then its audit, the initials of its
edits. Weights only grow under these rules and keep their order, so Knuth's agenda pops each
item once, with its lightest derivation, until the goal item is final.

(Audits of different lengths keep their order, too: of two audits of one item, none begins the
other at the same cost, since the letters tell the states and each insertion costs.)

Rows are ordered by turn, nulls first, then role, the text's digest and copy. Only narrow rows
are shuffled for the plan: they are dealt by ranges of that order, so that a long conversation
lies in many tasks, and cut into spans of at most ``SPAN_ROWS`` rows. The spans' items are
deduced in parallel; a conversation's spans meet as a few items each. The texts are shuffled
once, sorted, and edited as they stream past their conversation's audit; nothing of a
conversation is held but its audit.

Cases: nulls in role or text stand for one space; a null id is one conversation, a null turn
comes first and counts in no gap; a text of any length passes in its batch; of equal rows the
later ones are duplicates; a conversation without rows has no edits; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewgate.session import materialise

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
NEW_ROLE, DELETED, INSERTED, CUT_SHORT = 3, 4, 3, 3
SPAN_ROWS = 1024
LINE_BITS = 33
#: Reading states: nothing yet, after s, after u, after a.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {
    (NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
WHOLE = (NONE, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}

Weight = tuple[int, str]


# Damage, to test the repair


def damaged(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Rows with faults by the checksum of ``conv:turn`` modulo 20, with ``dropped`` and ``copy``."""
    space = F.lit(" ")
    named = [F.coalesce(F.col(x).cast("string"), space) for x in (conv, turn)]
    fault = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    rows = conversations.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"),
        fault.alias("fault"),
    )
    changed = (
        F.when(F.col("fault").isin(0, 1), F.lit(""))
        .when(F.col("fault") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
    )
    copies = F.sequence(F.lit(0), F.when(F.col("fault") == 3, 1).otherwise(0))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        changed.alias("text"),
        (F.col("fault") == 0).alias("dropped"),
        F.explode(copies).alias("copy"),
    )


# Deductions


def readings(code: str) -> list[tuple[str, str, int]]:
    """What a row may become: letter of the edit, role's initial ('' if deleted), cost.

    The code is the initial of the role and the row's fault.
    """
    initial, fault = code[0], code[1]
    out = [("D", "", DELETED)]
    if fault not in "bd":
        more = CUT_SHORT if fault == "t" else 0
        out += [("K", initial, more)]
        out += [("R", x, NEW_ROLE + more) for x in ROLES]
    return out


def lightest(axioms: list, deduce, goals=None) -> dict:
    """Knuth's agenda: final weights of all items, or of those before the first goal.

    ``axioms`` are (weight, item); ``deduce(item, weight, final)`` gives the (weight, item) that
    follow from a new final item and those that are final already.
    """
    agenda, final = list(axioms), {}
    heapq.heapify(agenda)
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        if goals is not None and item in goals:
            break
        for derived in deduce(item, weight, final):
            if derived[1] not in final:
                heapq.heappush(agenda, derived)
    return final


def span_items(codes: list[str]) -> list[tuple[int, int, int, str]]:
    """Items over all rows of a span: state before, state after, cost, audit."""
    rows = [readings(x) for x in codes]

    def deduce(item, weight, final):
        """An item [0, j, p, q] with the reading of row j, or with an insertion."""
        (j, p, q), (cost, audit) = item, weight
        for x in ROLES:
            if (q, x) in NEXT:
                yield (cost + INSERTED, audit + "I"), (j, p, NEXT[q, x])
        if j < len(rows):
            for letter, x, price in rows[j]:
                to = q if not x else NEXT.get((q, x))
                if to is not None:
                    yield (cost + price, audit + letter), (j + 1, p, to)

    final = lightest([((0, ""), (0, p, p)) for p in range(4)], deduce)
    return [(p, q, *w) for (j, p, q), w in final.items() if j == len(rows)]


def compose(spans: list[list[tuple[int, int, int, str]]]) -> Weight:
    """The lightest derivation of a whole conversation from the items of its spans."""
    following = [{} for _ in spans]
    for at, items in enumerate(spans):
        for p, q, cost, audit in items:
            following[at].setdefault(p, []).append((q, cost, audit))

    def deduce(item, weight, final):
        """An item [0, j, none, q] with the span item [j, k, q, r]."""
        at, q = item
        if at < len(spans):
            for r, cost, audit in following[at].get(q, ()):
                yield (weight[0] + cost, weight[1] + audit), (at + 1, r)

    goals = {(len(spans), q) for q in WHOLE}
    final = lightest([((0, ""), (0, NONE))], deduce, goals)
    return next(final[x] for x in goals if x in final)


# The plan


def _order(rows: DataFrame) -> DataFrame:
    """Narrow rows of all conversations in order, with a growing ``place``."""
    stripped = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(stripped == "", "b")
        .when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), "t")
        .otherwise("-")
    )
    initial = F.left("role", F.lit(1))
    narrow = rows.select(
        "conv_id",
        "turn",
        "role",
        F.md5(F.col("text").cast("binary")).alias("digest"),
        "copy",
        "dropped",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"),
        fault.alias("fault"),
    )
    by = [F.asc_nulls_first(x) for x in ("conv_id", "turn", "role", "digest", "copy")]
    placed = narrow.repartitionByRange(*by).sortWithinPartitions(*by)
    return materialise(
        placed.withColumn("place", F.monotonically_increasing_id()), "conversation-rows"
    )


def _codes(ordered: DataFrame) -> DataFrame:
    """The rows that are left, with their first fault; a text seen earlier is a duplicate."""
    left = ordered.filter("not dropped")
    same = ["conv_id", "role", "digest"]
    first = left.filter("fault != 'b'").groupBy(*same).agg(F.min("place").alias("first"))
    first = first.select(*[F.col(x).alias(f"of_{x}") for x in same], "first")
    met = [F.col(x).eqNullSafe(F.col(f"of_{x}")) for x in same]
    rows = left.join(first, met[0] & met[1] & met[2], "left")
    fault = F.when(F.col("place") > F.col("first"), "d").otherwise(F.col("fault"))
    return rows.select("conv_id", "turn", "place", "initial", fault.alias("fault"))


SPANS = "first long, codes string, items array<struct<p:int,q:int,cost:long,audit:string>>"


def _spans(rows: DataFrame, span_rows: int) -> DataFrame:
    """Items of each span of at most ``span_rows`` rows of a conversation."""
    line = F.col("place").bitwiseAND((1 << LINE_BITS) - 1)
    span = F.struct(
        F.shiftrightunsigned("place", LINE_BITS).alias("part"),
        F.floor(line / span_rows).alias("span"),
    )
    row = F.struct("place", F.concat("initial", "fault").alias("code"))
    # A group holds span_rows rows at most.
    grouped = rows.groupBy("conv_id", span.alias("at")).agg(
        F.min("place").alias("first"), F.sort_array(F.collect_list(row)).alias("rows")
    )
    codes = F.array_join(F.transform("rows", lambda x: x["code"]), "")
    conv = rows.schema["conv_id"]
    schema = T.StructType([conv, *T.StructType.fromDDL(SPANS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        for batch in batches:
            codes = batch.column(2).to_pylist()
            items = [
                [
                    {"p": p, "q": q, "cost": cost, "audit": audit}
                    for p, q, cost, audit in span_items([x[i : i + 2] for i in range(0, len(x), 2)])
                ]
                for x in codes
            ]
            columns = [*batch.columns, pa.array(items, fields.field("items").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=fields)

    return grouped.select("conv_id", "first", codes.alias("codes")).mapInArrow(run, schema)


def illegal_pairs(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


def plan_repairs(rows: DataFrame, span_rows: int = SPAN_ROWS) -> DataFrame:
    """Per conversation its faults, gaps and the cheapest repair: cost and audit.

    ``rows`` are those of ``damaged``; a conversation whose rows are all dropped has no faults.
    """
    ordered = _order(rows)
    codes = _codes(ordered)
    spans = _spans(codes, span_rows).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("first", "codes", "items"))).alias("spans")
    )
    conv = rows.schema["conv_id"]
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType(
        [conv, *[T.StructField(x, T.LongType()) for x in counts], T.StructField("audit", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(1).to_pylist():
                codes = "".join(x["codes"] for x in spans)
                faults = codes[1::2]
                cost, audit = compose(
                    [[(y["p"], y["q"], y["cost"], y["audit"]) for y in x["items"]] for x in spans]
                )
                out.append(
                    (*[faults.count(x) for x in "bdt"], illegal_pairs(codes[::2]), cost, audit)
                )
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], schema.names
            )

    repairs = spans.mapInArrow(run, schema)
    turn = F.when(~F.col("dropped"), F.col("turn"))
    whole = ordered.groupBy("conv_id").agg(
        F.coalesce(
            F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)
        ).cast("long").alias("gaps")
    )
    whole = whole.withColumnRenamed("conv_id", "of")
    joined = whole.join(repairs, F.col("of").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(
        F.col("of").alias("conv_id"),
        "gaps",
        *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
    )


# The repaired rows


def repaired_rows(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``slot``, ``edit``, ``turn``, ``role``, ``text``.

    Partitions hold whole conversations, and their rows come in order. Inserted rows have no
    turn. Each conversation's audit comes before its rows, which need not be held.
    """
    none = F.lit(None)
    texts = rows.filter("not dropped").select(
        "conv_id", none.cast("string").alias("audit"), "turn", "role", "text",
        F.md5(F.col("text").cast("binary")).alias("digest"), "copy",
    )
    heads = plans.select(
        "conv_id", "audit", none.cast(rows.schema["turn"].dataType).alias("turn"),
        none.cast("string").alias("role"), none.cast("string").alias("text"),
        none.cast("string").alias("digest"), none.cast("int").alias("copy"),
    )
    order = [F.asc_nulls_first("conv_id"), F.desc_nulls_last("audit")]
    order += [F.asc_nulls_first(x) for x in ("turn", "role", "digest", "copy")]
    lined = heads.union(texts).repartition("conv_id").sortWithinPartitions(*order)
    schema = T.StructType(
        [
            rows.schema["conv_id"], T.StructField("slot", T.LongType()),
            T.StructField("edit", T.StringType()), rows.schema["turn"],
            T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        conv, audit, at, slot, state = None, "", 0, 0, NONE

        def inserted():
            """The insertions that come next."""
            nonlocal at, slot, state
            while audit[at : at + 1] == "I":
                x = next(x for x in ROLES if (state, x) in NEXT)
                yield conv, slot, "I", None, ROLES[x], ""
                at, slot, state = at + 1, slot + 1, NEXT[state, x]

        for batch in batches:
            out = []
            for own, head, turn, role, text, *_ in zip(*[c.to_pylist() for c in batch.columns]):
                if head is not None:
                    conv, audit, at, slot, state = own, head, 0, 0, NONE
                    out += inserted()
                    continue
                letter, at = audit[at], at + 1
                if letter != "D":
                    x = role[0] if letter == "K" else next(x for x in ROLES if (state, x) in NEXT)
                    out.append((conv, slot, letter, turn, role if letter == "K" else ROLES[x], text))
                    slot, state = slot + 1, NEXT[state, x]
                out += inserted()
            columns = list(zip(*out)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields
            )

    return lined.select("conv_id", "audit", "turn", "role", "text").mapInArrow(run, schema)


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of each repaired conversation, ``role:text`` by lines, as its rows stream past.

    Takes the rows as ``repaired_rows`` leaves them: whole conversations, in order.
    """
    conv = repaired.schema["conv_id"]
    schema = T.StructType([conv, T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        conv, digest = None, None

        def done(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields
            )

        for batch in batches:
            out = []
            for own, slot, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                line = f"{role}:{text}".encode()
                if slot == 0:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = own, hashlib.sha256(line)
                else:
                    digest.update(b"\n" + line)
            yield done(out)
        if digest is not None:
            yield done([(conv, digest.hexdigest())])

    return repaired.select("conv_id", "slot", "role", "text").mapInArrow(run, schema)


def repaired_digests(rows: DataFrame, span_rows: int = SPAN_ROWS) -> DataFrame:
    """The plan of every conversation with the digest of what it makes of it."""
    plans = materialise(plan_repairs(rows, span_rows), "conversation-plans")
    found = digests(repaired_rows(rows, plans)).withColumnRenamed("conv_id", "of")
    joined = plans.join(found, F.col("of").eqNullSafe(F.col("conv_id")), "left").drop("of")
    return joined.withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))
    )
