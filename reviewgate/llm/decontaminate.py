"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman (operator 4).

Seeds join passages of the documents to test items; a passage that shares enough seeds with an
item is aligned with it by Smith-Waterman over words, which scores exact, edited and paraphrased
copies at any place in a text. The score is the alignment's share of a perfect one;
``LEAST_SCORE`` or more is a leak.

A seed is a pair of words at distance one or two. The seeds lose no leak: an alignment that scores
half of a perfect one over n item words has m matches and at most 2 m - n other words, so of its
m - 1 steps from match to match at least (n - 2) / 2 hold no more than one other word. Each of
these is a pair at distance one or two in the item as in the text, and begins at a word of its
own. An item therefore needs only its rarest seed places, as many as make sure that a leak shares
``wanted`` of them within twice the item's length. How rare a seed is, is counted over all documents
first; the counts only choose places and decide how much is compared, never what is found.

The corpus is read twice a block of items, once to count and once to search, and never shuffled:
the items are the query set that every task holds. They go out in blocks of at most
``BLOCK_WORDS`` words, so what is broadcast has a fixed largest size.

Cases: null and empty texts match nothing; an item of fewer than three words proves no
leak and is not searched; equal items are found once each; repeated documents are
rows of their own; of equally good alignments the one ending first counts; very long texts are
searched in overlapping pieces; an empty table on either side gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"\w+")
#: Shorter items prove nothing.
LEAST_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
BLOCK_WORDS = 1_000_000
#: Words of a text searched at once.
PIECE = 1 << 14


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@dataclass
class Items:
    """A block of test items: word numbers (from 1), and seeds with the items that have them."""

    ids: list
    #: Words of all items in a row, and where each item begins.
    flat: np.ndarray
    begins: np.ndarray
    number: dict[str, int]
    #: Sorted seed codes, and for each its range in the owners.
    codes: np.ndarray
    ranges: np.ndarray
    owners: np.ndarray
    #: Seeds of an item that a leak shares at least.
    wanted: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple], counts: dict[int, int] | None = None) -> Items:
        """Items with their rarest seed places by ``counts`` (code to occurrences), or with
        equal ones taken in order."""
        number: dict[str, int] = {}
        ids, texts = [], []
        for item, text in rows:
            found = words(text)
            if len(found) >= LEAST_WORDS:
                ids.append(item)
                texts.append([number.setdefault(w, len(number) + 1) for w in found])
        sizes = np.array([len(x) for x in texts], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flat = np.array([w for x in texts for w in x], np.int64)
        # Places of one item: all but its last word. Its second seed may be missing.
        place = np.flatnonzero(np.isin(np.arange(len(flat)), begins[1:] - 1, invert=True))
        owner = np.searchsorted(begins, place, "right") - 1
        second = place + 2 < begins[owner + 1]
        base = len(number) + 1
        near = flat[place] * base + flat[place + 1]
        far = np.where(second, flat[place] * base + flat[np.minimum(place + 2, len(flat) - 1)], -1)
        close = (sizes - 1) // 2  # (n - 2) / 2, rounded up
        wanted = 1 + (close - 1) // 4
        kept = sizes - 1 - close + wanted
        if counts:
            seen = np.array([counts.get(x, 0) for x in near.tolist()], np.int64)
            seen += np.array([counts.get(x, 0) for x in far.tolist()], np.int64)
        else:
            seen = np.zeros(len(place), np.int64)
        order = np.lexsort((place, seen, owner))
        rank = np.arange(len(order)) - (begins[:-1] - np.arange(len(sizes)))[owner[order]]
        rare = order[rank < kept[owner[order]]]
        code = np.concatenate([near[rare], far[rare]])
        own = np.concatenate([owner[rare], owner[rare]])
        pairs = np.unique(np.stack([code, own], axis=1)[code >= 0], axis=0).reshape(-1, 2)
        codes, first = np.unique(pairs[:, 0], return_index=True)
        ranges = np.append(first, len(pairs)).astype(np.int64)
        return cls(ids, flat, begins, number, codes, ranges, pairs[:, 1], wanted)

    def words_of(self, item: int) -> np.ndarray:
        return self.flat[self.begins[item] : self.begins[item + 1]]

    def numbered(self, text: str | None) -> np.ndarray:
        return self.joined([text])[0][:-2]

    def joined(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of texts in a row, each followed by two that match nothing, so that no
        seed reaches into the next; and where each ends."""
        get, numbers, ends = self.number.get, [], []
        for text in texts:
            numbers += [get(w, 0) for w in words(text)]
            numbers += (0, 0)
            ends.append(len(numbers))
        return np.array(numbers, np.int64), np.array(ends, np.int64)

    def found(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a text where a seed begins, and which seed."""
        places, seeds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(self.codes):
            for distance in (1, 2):
                a, b = numbers[:-distance], numbers[distance:]
                known = np.flatnonzero((a > 0) & (b > 0))
                code = a[known] * (len(self.number) + 1) + b[known]
                at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                hit = self.codes[at] == code
                places.append(known[hit])
                seeds.append(at[hit])
        return np.concatenate(places), np.concatenate(seeds)


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: share of a perfect score, and its span of words in the text."""
    width = len(text)
    steps = -GAP * np.arange(width + 1)
    before = np.zeros(width + 1, np.int64)
    # Where the alignment that ends in a cell began.
    origin = np.arange(width + 1)
    best, end, begin = 0, 0, 0
    columns = np.arange(width + 1)
    for word in item:
        same = (text == word) & (word > 0)
        diagonal = before[:-1] + np.where(same, MATCH, MISMATCH)
        down = before[1:] + GAP
        cell = np.zeros(width + 1, np.int64)
        cell[1:] = np.maximum(np.maximum(diagonal, down), 0)
        start = columns.copy()
        start[1:] = np.where(
            cell[1:] == 0,
            columns[1:],
            np.where(diagonal >= down, origin[:-1], origin[1:]),
        )
        # A run of gaps along the text, from the best cell to the left.
        raised = cell + steps
        top = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised == top, columns, 0))
        before = top - steps
        origin = start[source]
        at = int(before.argmax())
        if before[at] > best:
            best, end, begin = int(before[at]), at, int(origin[at])
    return best / (MATCH * len(item)), begin, end


def _shared(items: Items, numbers: np.ndarray) -> np.ndarray:
    """(item, place) of seeds from which on a passage holds as many as a leak must."""
    begun, seeds = items.found(numbers)
    first = items.ranges[seeds]
    count = items.ranges[seeds + 1] - first
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    owner = items.owners[np.repeat(first, count) + step]
    # Seeds of an alignment begin at different words, so one of an item counts per place.
    width = max(1, len(numbers))
    own = np.unique(owner * width + np.repeat(begun, count))
    owner, place = own // width, own % width
    last = np.arange(len(own)) + items.wanted[owner] - 1
    inside = np.minimum(last, len(own) - 1)
    size = items.begins[owner + 1] - items.begins[owner]
    enough = (last < len(own)) & (owner[inside] == owner) & (place[inside] - place < 2 * size)
    return np.stack([owner[enough], place[enough]], axis=1)


def _passages(items: Items, numbers: np.ndarray) -> np.ndarray:
    """``_shared`` of long rows of words, in pieces that overlap by the widest alignment."""
    if not len(items.ids):
        return np.zeros((0, 2), np.int64)
    more = 2 * int(np.diff(items.begins).max()) + 2
    found = [
        _shared(items, numbers[low : low + PIECE + more]) + [0, low]
        for low in range(0, max(1, len(numbers) - more), PIECE)
    ]
    return np.unique(np.concatenate(found), axis=0)


def _candidates(items: Items, numbers: np.ndarray) -> dict[int, list]:
    """For each item that may leak, spans of the text to align; each leak lies in one whole."""
    spans: dict[int, list] = {}
    for item, at in _passages(items, numbers).tolist():
        size = int(items.begins[item + 1] - items.begins[item])
        low, high = max(0, at - 2 * size), min(len(numbers), at + 2 * size + 2)
        own = spans.setdefault(item, [])
        if own and low <= own[-1][1]:
            own[-1][1] = high
        else:
            own.append([low, high])
    return spans


def score_bound(item: np.ndarray, text: np.ndarray) -> float:
    """No alignment that scores at least ``LEAST_SCORE`` scores more than this.

    A word of the text that the item lacks costs one, any other gains at most a match; and
    such an alignment spans at most twice the item's words (matches m and other words e of
    the text: 2 m - e is at least the item's size, which is at least m).
    """
    gains = np.where(np.isin(text, item), MATCH, max(MISMATCH, GAP))
    total = np.concatenate([[0], np.cumsum(gains)])
    widest = 2 * len(item) + 1
    # The least total among those up to so many words before, in doubling steps.
    least = np.concatenate([np.full(widest - 1, total.max()), total])
    have = 1
    while have < widest:
        step = min(have, widest - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return (total - least).max() / (MATCH * len(item))


def leaks_of(items: Items, texts: list[str | None]) -> dict[int, list[tuple]]:
    """For the texts with leaks, item id, score and word span of each, best place per item."""
    numbers, ends = items.joined(texts)
    # A passage over the end of a text is one too many; the text itself decides.
    places = _passages(items, numbers)[:, 1]
    begins = np.append(0, ends)
    out = {}
    for i in np.unique(np.searchsorted(ends, places, "right")).tolist():
        found = _aligned(items, numbers[begins[i] : ends[i] - 2])
        if found:
            out[i] = found
    return out


def _aligned(items: Items, numbers: np.ndarray) -> list[tuple]:
    """The leaks of one text."""
    out = []
    for item, spans in _candidates(items, numbers).items():
        target = items.words_of(item)
        step, most = 64 * len(target), (0.0, 0, 0)
        for low, high in spans:
            if score_bound(target, numbers[low:high]) < LEAST_SCORE:
                continue
            # Long spans in overlapping windows, so that none grows with the text.
            for i in range(low, high, step):
                score, begin, end = align(target, numbers[i : min(high, i + step + 4 * len(target))])
                if score > most[0]:
                    most = (score, i + begin, i + end)
        if most[0] >= LEAST_SCORE:
            out.append((items.ids[item], *most))
    return out


def _blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[list[tuple]]:
    """The items, in blocks of so many words at most (a longer item is a block)."""
    block, size = [], 0
    for row in benchmark.select(item, text).filter(F.col(text).isNotNull()).toLocalIterator():
        n = len(words(row[1]))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


def _counted(docs: DataFrame, text: str, block: list[tuple]) -> dict[int, int]:
    """How often each seed of a block stands in the documents: at most two a word of the block."""
    every = Items.of(block)
    base = len(every.number) + 1
    codes = []
    for distance in (1, 2):
        place = np.arange(max(0, len(every.flat) - distance))
        codes.append(every.flat[place] * base + every.flat[place + distance])
    every.codes = np.unique(np.concatenate(codes))
    shared = docs.sparkSession.sparkContext.broadcast(every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(len(own.codes), np.int64)
        for batch in batches:
            numbers = own.joined(batch.column(0).to_pylist())[0]
            for low in range(0, len(numbers), 1 << 20):
                # A seed begins in one piece and reaches at most two words further.
                begun, seeds = own.found(numbers[low : low + (1 << 20) + 2])
                np.add.at(total, seeds[begun < 1 << 20], 1)
        some = np.flatnonzero(total)
        for low in range(0, len(some), 1 << 16):
            part = some[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.codes[part]), pa.array(total[part])], ["code", "n"]
            )

    found = docs.select(text).mapInArrow(run, "code long, n long")
    found = found.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Key, ``item_id``, ``score``, ``first_word`` and ``end_word``: one row per leak."""
    spark = docs.sparkSession
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("item_id", benchmark.schema[item].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("end_word", T.LongType()),
        ]
    )
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, item, item_text, block_words):
        shared = spark.sparkContext.broadcast(Items.of(block, _counted(docs, text, block)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            own = shared.value
            for batch in batches:
                leaks = leaks_of(own, batch.column(1).to_pylist())
                found = [
                    (batch.column(0)[i].as_py(), *leak) for i, some in leaks.items() for leak in some
                ]
                columns = list(zip(*found)) or [[]] * len(schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema))],
                    schema.names,
                )

        out = out.union(docs.select(key, text).mapInArrow(run, schema))
    return out


def keep_clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows without a leak of any item, with their own columns."""
    spark, rows = docs.sparkSession, docs
    at = docs.columns.index(text)
    for block in _blocks(benchmark, item, item_text, block_words):
        shared = spark.sparkContext.broadcast(Items.of(block, _counted(rows, text, block)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                leaks = leaks_of(own, batch.column(at).to_pylist())
                clean = [i not in leaks for i in range(batch.num_rows)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
