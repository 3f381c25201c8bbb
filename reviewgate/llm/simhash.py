"""SimHash near-duplicates by deletion-variant signatures (operator 8).

A fingerprint has 64 bits, one per bit position: set if set in over half of the
hashes of the text's 4-word shingles. Two texts are linked if their fingerprints
differ in at most four bits. Cut into three segments, such a pair has a segment that
differs in at most one bit. So every distinct fingerprint is indexed under each of its
segments with each bit in turn left out (64 keys); equal keys meet, and only pairs
within four bits pass. Equal texts share one fingerprint and meet before that, in
a grouping that is combined before the shuffle.

A key shared by very many fingerprints (found on a sample, which only steers the
work) is cut further: the bits outside the segment are split into five pieces, of
which a linked pair has one in common. Both ways find every link. Within a key the
links are reduced to a spanning tree where they are found, so a group of n fingerprints
sends at most n - 1 links per key.

Cases: a null text, an empty one and one of white space only have fingerprint zero,
which links like any other; fewer than four words are one shingle; rows with equal
doc_id stay rows of their own; a null doc_id never names a group unless all its
members have none; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewgate.llm.components import components
from reviewgate.session import materialise

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PIECES = MAX_BITS + 1
#: Fingerprints under one key beyond which it is cut further.
HOT_KEY = 10_000
SAMPLED = 64
#: Hashes of which the bits are counted at once.
BLOCK = 4096
#: Rows of sorted keys looked at together.
READ_ROWS = 1 << 16
#: Largest list of hot keys that is broadcast.
MAX_BROADCAST_KEYS = 100_000


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = WORD.findall((text or "").encode().translate(LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    last = ends[SHINGLE - 1 :] or ends[-1:]
    first = [0, *[x + 1 for x in ends[: len(last) - 1]]]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        [digest(joined[i:j], SEED) for i, j in zip(first, last)], np.uint64, len(last)
    )
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``fp`` (the fingerprint's bits as a signed long)."""
    schema = T.StructType(
        [T.StructField(key, docs.schema[key].dataType), T.StructField("fp", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x) for x in batch.column(1).to_pylist()]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def variants(prints: DataFrame) -> DataFrame:
    """``key`` and ``fp``: each segment with each of its bits left out."""
    keys = []
    for first, width in SEGMENTS:
        segment = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            left = F.lit(((1 << width) - 1) & ~(1 << bit))
            keys.append(F.lit((first + bit) << 22).bitwiseOR(segment.bitwiseAND(left)))
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _piece(piece: Column) -> Column:
    """Bits of one of five pieces of what lies outside the key's segment, and its number."""
    at = F.shiftrightunsigned(F.col("key"), 22)
    cases = None
    for first, width in SEGMENTS:
        low = F.col("fp").bitwiseAND(F.lit((1 << first) - 1))
        high = F.shiftrightunsigned("fp", first + width) if first + width < 64 else F.lit(0)
        rest = F.shiftleft(high.cast("long"), first).bitwiseOR(low)
        found = at < first + width
        cases = F.when(found, rest) if cases is None else cases.when(found, rest)
    wide = -(-(64 - min(w for _, w in SEGMENTS)) // PIECES)
    bits = F.expr(f"shiftrightunsigned(rest, cast(piece * {wide} as int))")
    return cases, bits.bitwiseAND(F.lit((1 << wide) - 1))


def _spread_hot(keyed: DataFrame, prints: DataFrame, hot_key: int) -> DataFrame:
    """``key``, ``part`` and ``fp``; hot keys are cut into parts, all others have part -1."""
    sample = prints.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0)
    hot = (
        variants(sample).groupBy("key").count().filter(F.col("count") * SAMPLED > hot_key)
    ).select("key")
    hot = materialise(hot, "hot-keys")
    n = hot.count()
    if n == 0:
        return keyed.select("key", F.lit(-1).cast("long").alias("part"), "fp")
    marks = hot.withColumn("hot", F.lit(True))
    marked = keyed.join(F.broadcast(marks) if n <= MAX_BROADCAST_KEYS else marks, "key", "left")
    rest, bits = _piece(F.col("piece"))
    pieces = F.when(
        F.col("hot"), F.sequence(F.lit(0), F.lit(PIECES - 1))
    ).otherwise(F.array(F.lit(-1)))
    cut = marked.select("key", "fp", F.explode(pieces).alias("piece")).withColumn("rest", rest)
    part = F.when(F.col("piece") < 0, F.lit(-1).cast("long")).otherwise(
        bits * PIECES + F.col("piece")
    )
    return cut.select("key", part.alias("part"), "fp")


def _tree(prints: np.ndarray) -> list[tuple[int, int]]:
    """A spanning tree of the links among distinct fingerprints, in blocks."""
    n = len(prints)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree = []
    step = max(1, (1 << 22) // n)
    for i in range(0, n, step):
        apart = np.bitwise_count(prints[i : i + step, None] ^ prints[None, i:])
        for x, y in zip(*np.nonzero(apart <= MAX_BITS)):
            if x < y and (p := root(i + int(x))) != (q := root(i + int(y))):
                parent[max(p, q)] = min(p, q)
                tree.append((i + int(x), i + int(y)))
    return tree


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal key and part; rows come sorted by them."""
    waiting, n = [], 0
    for batch in batches:
        waiting.append(
            np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        )
        n += batch.num_rows
        if n >= READ_ROWS:
            rows = np.concatenate(waiting, axis=1)
            # The last run may go on in the next batch.
            same = (rows[:2] == rows[:2, -1:]).all(axis=0)
            cut = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
            if cut:
                yield from _links(rows[:, :cut])
            waiting, n = [rows[:, cut:]], 0
    if waiting:
        yield from _links(np.concatenate(waiting, axis=1))


def _links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    prints = rows[2].view(np.uint64)
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
    if not len(new):
        return
    begins = np.flatnonzero(new)
    sizes = np.diff(np.append(begins, rows.shape[1]))
    left, right = [], []
    # Runs of two, which are by far the most, all at once.
    twos = begins[sizes == 2]
    close = twos[np.bitwise_count(prints[twos] ^ prints[twos + 1]) <= MAX_BITS]
    left.append(close)
    right.append(close + 1)
    for begin, size in zip(begins[sizes > 2], sizes[sizes > 2]):
        for x, y in _tree(prints[begin : begin + size]):
            left.append([begin + x])
            right.append([begin + y])
    a = rows[2][np.concatenate(left).astype(np.int64)]
    b = rows[2][np.concatenate(right).astype(np.int64)]
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(prints: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct ``fp`` within four bits that connect all such pairs."""
    spread = _spread_hot(variants(prints), prints, hot_key)
    ordered = spread.repartition("key", "part").sortWithinPartitions("key", "part")
    return ordered.mapInArrow(_runs, "a long, b long").distinct()


def grouped_rows(
    docs: DataFrame, key: str = "doc_id", text: str = "text", hot_key: int = HOT_KEY
) -> DataFrame:
    """``id``, ``fp``, ``root`` (a fingerprint naming the group) and ``component_id``."""
    rows = materialise(
        fingerprints(docs, key, text).select(F.col(key).alias("id"), "fp"), "fingerprints"
    )
    prints = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-prints")
    found = components(links(prints.select("fp"), hot_key), "a", "b")
    grouped = prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(grouped.select("fp", "root").join(named, "root"), "fp")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", hot_key: int = HOT_KEY
) -> DataFrame:
    """Key, ``fp`` and ``component_id`` (smallest key of the group), one row per row."""
    found = grouped_rows(docs, key, text, hot_key)
    return found.select(F.col("id").alias(key), "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, that with the smallest key, with its own columns.

    Of rows that share that key, or have none in a group without keys, the first by
    text and then by the other columns stays.
    """
    rows = materialise(
        grouped_rows(docs, key, text)
        .filter(F.col("id").eqNullSafe(F.col("component_id")))
        .select("id", "fp", "root"),
        "group-heads",
    )
    single = F.col("n") == 1
    # How many of all rows have the key of a head: others with it may be in other groups.
    every = docs.select(F.col(key).alias("_head"), F.lit(1).alias("n"), F.lit(False).alias("head"))
    own = rows.select(F.col("id").alias("_head"), F.lit(0).alias("n"), F.lit(True).alias("head"))
    counted = materialise(
        every.union(own)
        .groupBy("_head")
        .agg(F.sum("n").alias("n"), F.max("head").alias("head"))
        .filter("head")
        .select("_head", "n"),
        "heads-by-key",
    )
    heads = counted.filter(single & F.col("_head").isNotNull()).select("_head")
    kept = docs.join(heads.hint("shuffle_hash"), F.col(key) == F.col("_head"), "left_semi")
    shared = counted.filter(~single | F.col("_head").isNull()).select("_head")
    if shared.isEmpty():
        return kept
    return kept.union(_first_of_shared(docs, rows, shared, key, text))


def _first_of_shared(
    docs: DataFrame, rows: DataFrame, shared: DataFrame, key: str, text: str
) -> DataFrame:
    """The rows to keep among those whose key is null or not theirs alone."""
    asked = docs.join(shared, F.col(key).eqNullSafe(F.col("_head")), "left_semi")
    whole = asked.select(
        F.col(text).alias("text"),
        F.col(key).alias("id"),
        F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"),
    )
    schema = T.StructType([T.StructField("fp", T.LongType()), *whole.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x) for x in batch.column(0).to_pylist()]
            signed = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([signed, *batch.columns], schema.names)

    roots = rows.select(F.col("id").alias("_id"), F.col("fp").alias("_fp"), "root").distinct()
    printed = whole.mapInArrow(run, schema)
    met = printed.join(
        roots, F.col("id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp"))
    )
    first = met.groupBy("root").agg(F.min(F.struct("text", "row")).alias("first"))
    return first.select("first.row.*")
