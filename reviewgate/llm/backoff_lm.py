"""Language-model scoring by a weighted backoff automaton (operator 12).

The n-grams seen in training become states and arcs. An arc carries the smoothed log
probability of a word after its state's words; a state's failure arc carries the weight of
backing off to the state without its first word. A text is one walk from left to right: it
takes the arc of the next word, or failure arcs until there is one, and adds up the weights.

    p(w | h) = (1 - B_k) c(h w) / c(h) + B_k p(w | h'),   p(w) = (1 - B_1) c(w) / N + B_1 / (V + 1)

with h' = h without its first word and k words in h w; after an unseen h it is p(w | h'). An
unseen word after a seen h costs B_k and then what it costs after h', which is what failure
arcs do. B_k is the share of n-grams of length k that occur once among all occurrences, the
usual estimate of how much of a new text is new; it is learned from the corpus. The
probabilities of all V words and of the unknown one add up to one in each state.

The model is as large as the corpus has n-grams, so no task holds it. Texts are gathered into
blocks of bounded size. Each block counts its own n-grams; these counts meet by a hash of the
n-gram in buckets, whose number follows the number of tokens, and the totals go back to the
blocks that hold the n-gram. Each block then builds the part of the automaton that its texts
can reach, and walks it. A frequent n-gram sends one count a block, however often it occurs;
nothing is broadcast and only a few sums come to the driver.

N-grams are told apart by 64-bit hashes; at 10^9 different ones a single chance match is
expected with a probability of 3%, and it would add two counts.

Cases: a null or empty text has the end token only; a null id is training data; a text of any
length is scored whole, in a block of its own if it is longer than a block; repeated rows count
and are scored each; without training rows every token is the unknown one; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewgate.session import materialise

ORDER = 2
BLOCK_BYTES = 4 << 20
#: N-grams that a bucket receives, about.
BUCKET_NGRAMS = 1_000_000
BEGIN, END = 0, 1
MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(key: Column) -> Column:
    """Left out of training; a null id is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words(text: bytes | None) -> list[bytes]:
    """Only A-Z are lower-cased, and only ASCII white space separates words."""
    return (text or b"").lower().split()


# Blocks


def _packed(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.tobytes(), 1)


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def block_schema(key: T.DataType) -> T.StructType:
    return _struct(
        block=T.StringType(), keys=T.ArrayType(key), held=T.ArrayType(T.BooleanType()),
        sizes=T.ArrayType(T.IntegerType()), ids=T.BinaryType(), words=T.BinaryType(),
        n_ids=T.LongType(), n_train=T.LongType(), n_train_docs=T.LongType(),
    )


class _Block:
    """Texts of one block as numbers: the end is 1, words follow in order of appearance."""

    def __init__(self):
        self.keys, self.held, self.sizes, self.bytes = [], [], [], 0
        self.ids: list[int] = []
        self.number: dict[bytes, int] = {}

    def add(self, key, held: bool, text: bytes | None) -> None:
        found, number = words(text), self.number
        self.ids += [number.setdefault(w, len(number) + 2) for w in found]
        self.ids.append(END)
        self.keys.append(key)
        self.held.append(held)
        self.sizes.append(len(found) + 1)
        self.bytes += len(text or b"") + 64

    def row(self, name: str) -> list:
        hashes = [xxhash.xxh64_intdigest(w) for w in self.number]
        train = [n for n, held in zip(self.sizes, self.held) if not held]
        return [
            name, self.keys, self.held, self.sizes, _packed(np.array(self.ids, np.int32)),
            np.array(hashes, np.uint64).tobytes(), len(self.ids), sum(train), len(train),
        ]


def _arrow(rows: list, schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = list(zip(*rows)) or [[]] * len(schema)
    fields = to_arrow_schema(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)


def to_blocks(docs: DataFrame, key: str, text: str, block_bytes: int) -> DataFrame:
    schema = block_schema(docs.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, block = TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            keys, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, value in enumerate(batch.column(2)):
                value = value.as_py()
                if block.keys and block.bytes + len(value or b"") > block_bytes:
                    yield from _arrow([block.row(f"{part}-{made}")], schema).to_batches()
                    made, block = made + 1, _Block()
                block.add(keys[i], held[i], value)
        if block.keys:
            yield from _arrow([block.row(f"{part}-{made}")], schema).to_batches()

    rows = docs.select(
        F.col(key), held_out(F.col(key)).alias("held"), F.col(text).cast("binary").alias("text")
    )
    return rows.mapInArrow(run, schema)


# N-grams of a block


@dataclass
class Grams:
    """The different n-grams of one length in a block.

    Of gram g: its hash, count in training texts, last word, the gram before the last word
    (``context``) and the one without the first word (``suffix``), one shorter each.
    """

    hashes: np.ndarray
    counts: np.ndarray
    last: np.ndarray
    context: np.ndarray
    suffix: np.ndarray


def grams_of(
    ids: np.ndarray, sizes: np.ndarray, held: np.ndarray, hashes: np.ndarray, order: int
) -> list[Grams]:
    """N-grams of length 1 to ``order``; texts begin with an extra mark and end with the end."""
    n_words = len(hashes) + 2
    starts = np.cumsum(sizes) - sizes
    # Put the mark before each text.
    full = np.insert(ids.astype(np.int64), starts, BEGIN)
    train = np.repeat(~held, sizes + 1)
    depth = np.arange(len(full)) - np.repeat(starts + np.arange(len(sizes)), sizes + 1)
    own = np.concatenate([np.array([11, 13], np.uint64), hashes])
    # The mark is no token: it is a history only, and not counted.
    ones = Grams(
        own, np.bincount(full[train & (depth > 0)], minlength=n_words), np.arange(n_words),
        np.zeros(n_words, np.int64), np.zeros(n_words, np.int64),
    )
    out, at = [ones], full
    for k in range(2, order + 1):
        # at[p]: the gram of length k - 1 that ends at p.
        ends = np.flatnonzero(depth >= k - 1)
        codes = at[ends - 1] * n_words + full[ends]
        codes, first, which = np.unique(codes, return_index=True, return_inverse=True)
        context, last = codes // n_words, codes % n_words
        before = out[-1].hashes[context]
        mixed = (before ^ (before >> np.uint64(29))) * MIX + own[last] + np.uint64(k)
        seen = train[ends]
        out.append(
            Grams(
                mixed, np.bincount(which[seen], minlength=len(codes)), last, context,
                at[ends[first]],
            )
        )
        at = np.full(len(full), -1)
        at[ends] = which
    return out


def grams_of_row(row: dict, order: int) -> tuple[np.ndarray, np.ndarray, list[Grams]]:
    ids, sizes = _unpacked(row["ids"], np.int32), np.array(row["sizes"], np.int64)
    held = np.array(row["held"], bool)
    return ids, sizes, grams_of(ids, sizes, held, np.frombuffer(row["words"], np.uint64), order)


def _dealt(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets, and which n-grams each holds, in the order in which they are sent."""
    bucket = (hashes >> np.uint64(16)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    names, begins = np.unique(bucket[order], return_index=True)
    for name, own in zip(names.tolist(), np.split(order, begins[1:])):
        yield name, own


SENT = _struct(
    block=T.StringType(), length=T.IntegerType(), bucket=T.LongType(), hashes=T.BinaryType(),
    counts=T.BinaryType(),
)
TOTALS = _struct(
    block=T.StringType(), length=T.IntegerType(), bucket=T.LongType(), n_seen=T.LongType(),
    n_once=T.LongType(), n_all=T.LongType(), totals=T.BinaryType(),
)


def send_counts(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for k, grams in enumerate(grams_of_row(row, order)[2], 1):
                    # The mark that begins a text has as many counts as the end.
                    hashes, counts = (x[1:] if k == 1 else x for x in (grams.hashes, grams.counts))
                    rows = [
                        (row["block"], k, b, hashes[own].tobytes(), _packed(counts[own]))
                        for b, own in _dealt(hashes, buckets)
                    ]
                    yield from _arrow(rows, SENT).to_batches()

    columns = ("block", "sizes", "held", "ids", "words")
    return blocks.select(*columns).mapInArrow(run, SENT)


def add_up(table: pa.Table) -> pa.Table:
    """One bucket: the sum of each n-gram over all blocks, sent back to each block."""
    rows = table.to_pylist()
    sizes = [len(r["hashes"]) // 8 for r in rows]
    hashes = np.frombuffer(b"".join(r["hashes"] for r in rows), np.uint64)
    counts = np.concatenate([_unpacked(r["counts"], np.int64) for r in rows])
    names, which = np.unique(hashes, return_inverse=True)
    totals = np.zeros(len(names), np.int64)
    np.add.at(totals, which, counts)
    back = np.split(totals[which], np.cumsum(sizes)[:-1])
    # The bucket's own sums go with its first row.
    sums = [int(np.count_nonzero(totals)), int(np.count_nonzero(totals == 1)), int(totals.sum())]
    out = [
        (r["block"], r["length"], r["bucket"], *(sums if i == 0 else (0, 0, 0)), _packed(own))
        for i, (r, own) in enumerate(zip(rows, back))
    ]
    return _arrow(out, TOTALS)


# The automaton


@dataclass
class Corpus:
    """Training data: tokens, texts, different words, and for each length the share of
    occurrences that are the only one of their n-gram (with one more on either side)."""

    tokens: int
    documents: int
    words: int
    new: list[float]


@dataclass
class Automaton:
    """States are numbered from the empty history (0). ``arcs``: state * n_words + word to arc."""

    n_words: int
    start: int = 0
    arcs: dict[int, int] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)
    targets: list[int] = field(default_factory=list)
    failure: list[int] = field(default_factory=lambda: [0])
    failure_weights: list[float] = field(default_factory=lambda: [0.0])

    @classmethod
    def of(cls, grams: list[Grams], totals: list[np.ndarray], corpus: Corpus) -> Automaton:
        """From the corpus' counts of a block's n-grams."""
        order, n_words = len(grams), len(grams[0].hashes)
        out, none = cls(n_words), np.zeros(n_words, np.int64)
        totals = [totals[0].copy(), *totals[1:]]
        # As a history, the mark that begins a text was seen once a text.
        totals[0][BEGIN] = corpus.documents
        chance = np.full(n_words, 1 / (corpus.words + 1))
        if corpus.tokens:
            chance = (1 - corpus.new[0]) * totals[0] / corpus.tokens + corpus.new[0] * chance
        weights, targets, arcs, before = [], [], [], none
        for k, (own, total) in enumerate(zip(grams, totals), 1):
            # Any word leads on from the empty history, others only where training saw it.
            there = np.arange(1, n_words) if k == 1 else np.flatnonzero(total > 0)
            if k > 1:
                seen = total / np.maximum(totals[k - 2][own.context], 1)
                chance = (1 - corpus.new[k - 1]) * seen + corpus.new[k - 1] * chance[own.suffix]
            shorter = before[own.suffix] if k > 1 else none
            arcs.append((before[own.context[there]] if k > 1 else 0) * n_words + own.last[there])
            weights.append(np.log10(chance[there]))
            if k < order:
                # What training saw and saw going on is a state, and fails to its suffix.
                real = (total > 0) & (own.last != END)
                states = np.where(real, len(out.failure) - 1 + np.cumsum(real), 0)
                out.failure += shorter[real].tolist()
                out.failure_weights += [math.log10(corpus.new[k])] * int(real.sum())
                before = states
            else:
                states = shorter
            targets.append(states[there])
            if k == 1 and order > 1:
                out.start = int(states[BEGIN])
        out.arcs = {arc: i for i, arc in enumerate(np.concatenate(arcs).tolist())}
        out.weights = np.concatenate(weights).tolist()
        out.targets = np.concatenate(targets).tolist()
        return out

    def score(self, ids: list[int]) -> float:
        """Log probability of a text: one walk from left to right."""
        arcs, weights, targets, n_words = self.arcs, self.weights, self.targets, self.n_words
        failure, failure_weights = self.failure, self.failure_weights
        state, total = self.start, 0.0
        for word in ids:
            arc = arcs.get(state * n_words + word)
            while arc is None:
                total += failure_weights[state]
                state = failure[state]
                arc = arcs.get(state * n_words + word)
            total += weights[arc]
            state = targets[arc]
        return total


def score_block(
    row: dict, back: list[dict], order: int, buckets: int, corpus: Corpus
) -> list[tuple]:
    """Key, held out, tokens, known tokens, base score and score of a block's texts."""
    ids, sizes, grams = grams_of_row(row, order)
    sent = {(r["length"], r["bucket"]): r["totals"] for r in back}
    totals = []
    for k, own in enumerate(grams, 1):
        total, skip = np.zeros(len(own.hashes), np.int64), int(k == 1)
        for bucket, which in _dealt(own.hashes[skip:], buckets):
            total[which + skip] = _unpacked(sent[k, bucket], np.int64)
        totals.append(total)
    automaton = Automaton.of(grams, totals, corpus)
    counts = totals[0][ids]
    begins = np.cumsum(sizes) - sizes
    known = np.add.reduceat((counts > 0).astype(np.int64), begins).tolist()
    base = np.add.reduceat(np.log10((counts + 1) / (corpus.tokens + (corpus.words + 1))), begins).tolist()
    out, n = [], corpus.tokens
    for i, (begin, size) in enumerate(zip(begins.tolist(), sizes.tolist())):
        score = automaton.score(ids[begin : begin + size].tolist())
        out.append((row["keys"][i], row["held"][i], size, known[i], n, base[i], score))
    return out


def score_texts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    block_bytes: int = BLOCK_BYTES,
    bucket_ngrams: int = BUCKET_NGRAMS,
) -> DataFrame:
    """Key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``base_score`` is that of single tokens with one added to each count.
    """
    blocks = materialise(to_blocks(docs, key, text, block_bytes), "lm-blocks")
    tokens, documents, ids = blocks.agg(
        *[F.coalesce(F.sum(x), F.lit(0)) for x in ("n_train", "n_train_docs", "n_ids")]
    ).first()
    buckets = max(1, math.ceil(ids * order / bucket_ngrams))
    totals = materialise(
        send_counts(blocks, order, buckets).groupBy("length", "bucket").applyInArrow(add_up, TOTALS),
        "lm-totals",
    )
    # One row per length.
    sums = totals.groupBy("length").agg(*[F.sum(x).alias(x) for x in ("n_seen", "n_once", "n_all")])
    by_length = {r.length: r for r in sums.collect()}
    new = [
        (r.n_once + 1) / (r.n_all + 2) if (r := by_length.get(k)) else 0.5
        for k in range(1, order + 1)
    ]
    corpus = Corpus(tokens, documents, by_length[1].n_seen if by_length else 0, new)
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("train_tokens", T.LongType()),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def run(texts: pa.Table, back: pa.Table) -> pa.Table:
        rows = [
            x
            for row in texts.to_pylist()
            for x in score_block(row, back.to_pylist(), order, buckets, corpus)
        ]
        return _arrow(rows, schema)

    texts = blocks.select("block", "keys", "held", "sizes", "ids", "words")
    return (
        texts.groupBy("block")
        .cogroup(totals.select("block", "length", "bucket", "totals").groupBy("block"))
        .applyInArrow(run, schema)
    )
