"""Ranked lexical search by an Aho-Corasick scan of the documents (operator 11).

One automaton holds the terms of all items, each between two guards. A document is scanned as
it is, with every separator turned into the guard, so that only whole terms match; the outputs
of the automaton give the term frequencies and lead from a term to its items. There is no index
of the documents. The first scan counts documents per term, documents and terms in all; the
second scores and keeps each task's best rows per item, which are then ranked in two steps.

Terms are the maximal runs of characters other than ASCII separators; only A-Z are lower-cased.
The weight of a term is floor(1000 * ln((2 N + 2) / (2 df + 1))); all other arithmetic is on
integers, so scores don't depend on the order of rows.

The items are the query set that every task holds. They go out in blocks of ``BLOCK_TERMS``
terms with two scans each, so what is broadcast has a largest size (an item of more terms is a
block of its own).

Cases: a null or empty text has no term: such a document is never ranked and not counted in N,
such an item has no rows; a text of any length is scanned whole; equal scores go by ascending
``doc_id``, nulls first, and repeated documents are rows of their own; repeated items are each
ranked; an empty table on either side gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_TERMS = 50_000
#: Cells (documents times items) that are summed at once.
CELLS = 2_000_000
SLICES = 16
GUARD = ord(" ")


def _guarded() -> bytes:
    """For each byte: a term's byte stays, A-Z are lower-cased, the rest is a guard."""
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        out[b] = ord(c.lower()) if c.isalnum() else GUARD
    return bytes(out)


GUARDED = _guarded()


def guarded(text: bytes | None) -> bytes:
    return b" " + (text or b"").translate(GUARDED) + b" "


def terms(text: bytes | None) -> list[str]:
    return [x.decode() for x in guarded(text).split(b" ") if x]


@dataclass
class Items:
    """A block of items: its terms, and for each term the items that hold it, how often."""

    ids: list
    number: dict[str, int]
    #: The items of term t stand from begins[t] to begins[t + 1].
    begins: np.ndarray
    owners: np.ndarray
    repeats: np.ndarray
    _automaton: list = field(default_factory=list, repr=False)

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        number: dict[str, int] = {}
        places = []
        for row, (_, text) in enumerate(rows):
            for term, n in Counter(terms(text)).items():
                places.append((number.setdefault(term, len(number)), row, n))
        flat = np.array(sorted(places), np.int64).reshape(-1, 3)
        begins = np.searchsorted(flat[:, 0], np.arange(len(number) + 1))
        return cls([x[0] for x in rows], number, begins, flat[:, 1], flat[:, 2])

    def __getstate__(self):
        return self.__dict__ | {"_automaton": []}

    @property
    def automaton(self):
        """Built once per worker; it doesn't travel."""
        if not self._automaton:
            made = ahocorasick.Automaton()
            for term, t in self.number.items():
                made.add_word(f" {term} ", t)
            made.make_automaton()
            self._automaton.append(made)
        return self._automaton[0]

    def counts(self, text: bytes) -> Counter:
        """How often each term stands in a guarded text."""
        return Counter(map(itemgetter(1), self.automaton.iter(text.decode())))


def size(text: bytes) -> int:
    """Terms of a guarded text, from the guards alone."""
    guard = np.frombuffer(text, np.uint8) == GUARD
    return int(np.count_nonzero(guard[:-1] & ~guard[1:]))


def blocks(
    items: DataFrame, item: str, text: str, block_terms: int
) -> Iterator[list[tuple]]:
    block, n = [], 0
    rows = items.select(item, F.col(text).cast("binary")).filter(F.col(text).isNotNull())
    for row in rows.toLocalIterator():
        own = size(guarded(row[1]))
        if own and block and n + own > block_terms:
            yield block
            block, n = [], 0
        if own:
            block.append((row[0], row[1]))
            n += own
    if block:
        yield block


@dataclass
class Corpus:
    """Statistics over all documents: with a term, terms in all, documents per term."""

    documents: int
    terms: int
    having: np.ndarray

    def weights(self) -> np.ndarray:
        top = 2 * self.documents + 2
        return np.array(
            [math.floor(1000 * math.log(top / (2 * n + 1))) for n in self.having.tolist()],
            np.int64,
        )


def corpus(docs: DataFrame, shared, text: str) -> Corpus:
    """The first scan. Each task adds up its own counts; only sums are shuffled."""
    n_terms = len(shared.value.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, having, documents, total = shared.value, np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            for value in batch.column(0):
                value = guarded(value.as_py())
                n = size(value)
                if n:
                    documents, total = documents + 1, total + n
                    having[list(own.counts(value))] += 1
        found = np.flatnonzero(having)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(found, [-1, -2])), pa.array(np.append(having[found], [documents, total]))],
            ["term", "n"],
        )

    sums = docs.select(F.col(text).cast("binary")).mapInArrow(run, "term long, n long")
    having, rest = np.zeros(n_terms, np.int64), {-1: 0, -2: 0}
    # One row per term of the block at most.
    for term, n in sums.groupBy("term").agg(F.sum("n")).collect():
        if term < 0:
            rest[term] = n
        else:
            having[term] = n
    return Corpus(rest[-1], rest[-2], having)


def _length_part(n: int, all_of: Corpus) -> int:
    return 100 - 25 + (25 * n * all_of.documents) // all_of.terms


class Best:
    """The best rows of each item so far: (score, key) with the highest score first."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.rows: list[list[tuple]] = [[] for _ in range(n_items)]
        #: A row needs at least this score; zero is never ranked.
        self.least = np.ones(n_items, np.int64)

    @staticmethod
    def order(row: tuple) -> tuple:
        score, key = row
        return (-score, key is not None, 0 if key is None else key)

    def add(self, scores: np.ndarray, keys: list) -> None:
        """``scores``: one row per key, one column per item."""
        where, items = np.nonzero(scores >= self.least)
        for row, item, score in zip(where.tolist(), items.tolist(), scores[where, items].tolist()):
            self.rows[item].append((score, keys[row]))
        for item in set(items.tolist()):
            if len(self.rows[item]) >= 4 * self.k:
                self.cut(item)

    def cut(self, item: int) -> None:
        rows = sorted(self.rows[item], key=self.order)[: self.k]
        self.rows[item] = rows
        if len(rows) == self.k:
            self.least[item] = rows[-1][0]

    def all(self) -> Iterator[tuple]:
        for item in range(len(self.rows)):
            self.cut(item)
            for score, key in self.rows[item]:
                yield item, score, key


def scores_of(own: Items, found: list[tuple], weights: np.ndarray, all_of: Corpus) -> np.ndarray:
    """Scores of some documents, given as (terms, counts), for all items."""
    out = np.zeros(len(found) * len(own.ids), np.int64)
    for row, (n, counts) in enumerate(found):
        if not counts:
            continue
        t = np.fromiter(counts.keys(), np.int64, len(counts))
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        gained = weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 12 * _length_part(n, all_of)))
        first = own.begins[t]
        many = own.begins[t + 1] - first
        at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        np.add.at(out, row * len(own.ids) + own.owners[at], np.repeat(gained, many) * own.repeats[at])
    return out.reshape(len(found), len(own.ids))


def best_per_task(
    docs: DataFrame, shared, all_of: Corpus, key: str, text: str, k: int, first_row: int,
    item_type: T.DataType,
) -> DataFrame:
    """The second scan: item's row and id, key and score of each task's best."""
    schema = T.StructType(
        [
            T.StructField("item_row", T.LongType()),
            T.StructField("item_id", item_type),
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("score", T.LongType()),
        ]
    )
    weights = all_of.weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        own = shared.value
        best, step = Best(len(own.ids), k), max(1, CELLS // max(1, len(own.ids)))
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for begin in range(0, len(keys), step):
                found = []
                for value in batch.column(1).slice(begin, step):
                    value = guarded(value.as_py())
                    counts = own.counts(value)
                    found.append((size(value) if counts else 0, counts))
                best.add(scores_of(own, found, weights, all_of), keys[begin : begin + step])
        rows = [(first_row + i, own.ids[i], x, score) for i, score, x in best.all()]
        columns = list(zip(*rows)) or [[]] * len(schema)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema))], schema.names
        )

    return docs.select(key, F.col(text).cast("binary")).mapInArrow(run, schema)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``item_id``, ``rank`` from 1, key and ``score``: each item's ``k`` best documents."""
    spark = docs.sparkSession
    item_type = items.schema[item].dataType
    found, rows = None, 0
    for block in blocks(items, item, item_text, block_terms):
        shared = spark.sparkContext.broadcast(Items.of(block))
        part = best_per_task(
            docs, shared, corpus(docs, shared, text), key, text, k, rows, item_type
        )
        found, rows = part if found is None else found.union(part), rows + len(block)
    if found is None:
        return spark.createDataFrame(
            [],
            T.StructType(
                [
                    T.StructField("item_id", item_type),
                    T.StructField("rank", T.IntegerType()),
                    T.StructField(key, docs.schema[key].dataType),
                    T.StructField("score", T.LongType()),
                ]
            ),
        )
    order = [F.desc("score"), F.asc_nulls_first(key)]
    # Every task sends k rows an item: cut them in slices before an item's rows meet.
    sliced = found.withColumn("slice", F.pmod(F.xxhash64(key, "score"), F.lit(SLICES)))
    for by in (("item_row", "slice"), ("item_row",)):
        window = Window.partitionBy(*by).orderBy(*order)
        sliced = sliced.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    return sliced.select("item_id", "rank", key, "score")
