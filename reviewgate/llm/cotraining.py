"""Quality classifier by co-training two views (operator 6).

One logistic regression sees the text (hashed words and measures of its surface), the other
the page's metadata only (source, language, stated length). Both start from the labelled
rows. In each round each view goes over all other rows and labels those it is surest of, which
go to the other's training rows; labelled rows outside the sample take part without their
labels. At the end each view is calibrated on labelled rows kept apart, and
the calibrated log odds are added, less the prior that both contain.

Bounds, all parameters: the models are fitted on ``max_labelled`` labelled rows of different
content at most, chosen by a hash, and on the ``picks`` surest rows of each view, class and
round. Only their feature vectors come to the driver. The vectors of all rows are written
once; a round reads them, keeps the surest of each task and shuffles only these. Rows of equal
content count once, so a group of copies cannot fill the list. Scoring is a projection of all
rows with the weights in hand: no shuffle.

Cases: a null text counts as empty, null metadata as a value of its own; labels that are
null or of no document are not used, of several for one document each counts; a labelled id on
many rows gives its different contents, within the bound; with fewer than two
classes every score is the labelled share (0.5 without labels); an even score keeps; rows
are independent, so copies and repeated rows score alike; texts are read whole; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewgate.session import materialise

WORD = re.compile(r"\S+")
HASHED_WORDS = 256
SURFACE = 8
TEXT_SIZE = HASHED_WORDS + SURFACE + 1
SOURCES, LANGS, LENGTHS = 64, 16, 24
META_SIZE = SOURCES + LANGS + LENGTHS + 1
MAX_LABELLED = 3_000
ROUNDS = 3
#: Probability from which a view is sure, and the rows of a class it labels in a round.
SURE, PICKS = 0.9, 150
#: Groups that find their surest rows before these meet.
SPREAD = 64
RIDGE = 1.0
WORD_CACHE = 300_000
_places: dict[str, int] = {}


def _place(word: str) -> int:
    at = _places.get(word)
    if at is None:
        if len(_places) >= WORD_CACHE:
            _places.clear()
        at = _places[word] = zlib.crc32(word.lower().encode()) % HASHED_WORDS
    return at


def text_view(text: str | None) -> np.ndarray:
    """Features of a whole text; the last is the intercept."""
    out = np.zeros(TEXT_SIZE)
    out[-1] = 1
    words = Counter(WORD.findall(text or ""))
    n = sum(words.values())
    if not n:
        return out
    places = [_place(w) for w in words]
    counts = np.fromiter(words.values(), np.float64, len(words))
    hashed = np.bincount(places, counts, HASHED_WORDS)
    out[:HASHED_WORDS] = hashed / np.linalg.norm(hashed)
    upper = sum(k for w, k in words.items() if w.isupper())
    plain = sum(k for w, k in words.items() if w[-1].isalpha())
    lone = sum(k for w, k in words.items() if not any(map(str.isalnum, w)))
    chars = sum(len(w) * k for w, k in words.items())
    lines = text.split("\n")
    out[HASHED_WORDS:-1] = [
        upper / n,
        plain / n,
        lone / n,
        chars / n / 10,
        len(words) / n,
        np.log1p(n) / 5,
        len(set(lines)) / len(lines),
        len(lines) / n,
    ]
    return out


def meta_places(source: str | None, lang: str | None, n_chars: int | None) -> tuple[int, ...]:
    """The features of the metadata that are one, but for the intercept, which is last."""
    length = 0 if n_chars is None else min(LENGTHS - 1, 1 + max(0, int(n_chars)).bit_length())
    return (
        zlib.crc32(f"s{source}".encode()) % SOURCES,
        SOURCES + zlib.crc32(f"l{lang}".encode()) % LANGS,
        SOURCES + LANGS + length,
    )


def meta_views(places: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places), META_SIZE))
    out[:, -1] = 1
    out[np.arange(len(places))[:, None], places] = 1
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Logistic regression by Newton's method."""
    weights = np.zeros(x.shape[1])
    for _ in range(12):
        p = _sigmoid(x @ weights)
        slope = x.T @ (p - y) + ridge * weights
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class CoModel:
    """Weights of both views, their calibration (slope, shift) and the prior log odds."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray
    prior: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, ...]:
        """Calibrated probability of good quality by text, by metadata and by both."""
        a = self.text_scale[0] * (text @ self.text) + self.text_scale[1]
        b = self.meta_scale[0] * (meta @ self.meta) + self.meta_scale[1]
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b - self.prior)


def _constant(share: float) -> CoModel:
    odds = float(np.log(share / (1 - share))) if 0 < share < 1 else 30.0 * (2 * share - 1)
    fixed = np.array([0.0, odds])
    return CoModel(np.zeros(TEXT_SIZE), np.zeros(META_SIZE), fixed, fixed, odds)


#: View that chose them, their label, and both views of the rows.
Chosen = list[tuple[int, float, np.ndarray, np.ndarray]]


def co_train(
    labelled: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray],
    surest: Callable[[list[np.ndarray]], Chosen],
    rounds: int = ROUNDS,
) -> CoModel:
    """Fit both views. ``labelled``: text, metadata, label and whether it only calibrates.
    ``surest`` gives for the weights of both views the rows they are surest of, each once."""
    text, meta, y, apart = labelled
    seen = ~apart
    if not len(y) or y.min() == y.max() or y[seen].min(initial=1) == y[seen].max(initial=0):
        return _constant(float(y.mean()) if len(y) else 0.5)
    views = [text, meta]
    #: For each view the rows it learns from, with the other view's labels.
    given: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

    def fitted(v: int) -> np.ndarray:
        x = np.concatenate([views[v][seen], *[rows for rows, _ in given[v]]])
        return fit(x, np.concatenate([y[seen], *[z for _, z in given[v]]]))

    for _ in range(rounds):
        chosen = surest([fitted(0), fitted(1)])
        for v, label, *both in chosen:
            rows = both[1 - v]
            given[1 - v].append((rows, np.full(len(rows), label)))
        if not any(len(rows) for _, _, rows, _ in chosen):
            break
    weights = [fitted(0), fitted(1)]
    check = apart if len(set(y[apart])) == 2 else seen
    scales = []
    for v in (0, 1):
        margin = views[v][check] @ weights[v]
        scales.append(fit(np.stack([margin, np.ones(len(margin))], axis=1), y[check], 1e-3))
    share = float(y[check].mean())
    return CoModel(weights[0], weights[1], *scales, float(np.log(share / (1 - share))))


def _views(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Text features and metadata places of a batch."""
    columns = [batch.column(first + i).to_pylist() for i in range(4)]
    text = np.array([text_view(x) for x in columns[0]])
    places = np.array([meta_places(*x) for x in zip(*columns[1:])], np.int64)
    return text.reshape(-1, TEXT_SIZE), places.reshape(-1, 3)


def _unpacked(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both views of written rows."""
    both = np.frombuffer(b"".join(packed), np.float32).reshape(-1, TEXT_SIZE + 3)
    return both[:, :TEXT_SIZE].astype(np.float64), meta_views(both[:, TEXT_SIZE:].astype(np.int64))


def _featured(docs: DataFrame, key: str) -> DataFrame:
    """``k``, a hash of the row's content and its packed features, written once."""
    content = F.xxhash64("text", "source", "lang", "n_chars")
    rows = docs.select(
        F.col(key).alias("k"), content.alias("content"), "text", "source", "lang", "n_chars"
    )
    schema = T.StructType(
        [
            T.StructField("k", docs.schema[key].dataType),
            T.StructField("content", T.LongType()),
            T.StructField("packed", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate(_views(batch, 2), axis=1).astype(np.float32)
            packed = pa.array([x.tobytes() for x in both], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), packed], schema.names
            )

    return materialise(rows.mapInArrow(run, schema), "quality-features")


def _sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most so many rows, by a hash of the key; about so many go into the last sort."""
    n = rows.count()
    if n <= most:
        return rows
    part = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 32))
    some = rows.filter(part < int(1.2 * most / n * (1 << 32)))
    return some.orderBy(part, *rows.columns).limit(most)


def _labelled(
    features: DataFrame, known: DataFrame, most: int
) -> list[tuple[int, float, bytes]]:
    """(content, label, features) of the labelled rows to learn from."""
    # A sample of bounded size, so it may be broadcast.
    chosen = F.broadcast(_sample(known.distinct(), "k", most))
    rows = features.join(chosen, "k").dropDuplicates(["content", "label"])
    kept = _sample(rows.select("content", "label", "packed"), "content", most).collect()
    return sorted((r.content, r.label, bytes(r.packed)) for r in kept)


def surest_rows(features: DataFrame, used: set[int], picks: int = PICKS):
    """For ``co_train``: the rows of a written table that each view is surest of. Contents in
    ``used`` are left out, and what is chosen joins them."""

    def surest(weights: list[np.ndarray]) -> Chosen:
        gone = np.array(sorted(used), np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple]] = [[], [], [], []]

            def cut(slot: int) -> None:
                # Rows of equal content count once.
                found = {x[1]: x for x in best[slot]}
                best[slot] = sorted(found.values())[:picks]

            for batch in batches:
                content = batch.column(0).to_numpy(zero_copy_only=False)
                free = np.flatnonzero(~np.isin(content, gone))
                packed = batch.column(1)
                views = _unpacked(packed.take(pa.array(free)).to_pylist())
                for v in (0, 1):
                    p = _sigmoid(views[v] @ weights[v])
                    for label, sure in ((0, 1 - p), (1, p)):
                        slot = 2 * v + label
                        for i in np.flatnonzero(sure >= SURE).tolist():
                            at = int(free[i])
                            best[slot].append((-float(sure[i]), int(content[at]), packed[at]))
                        if len(best[slot]) > 4 * picks:
                            cut(slot)
            for slot in range(4):
                cut(slot)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([slot] * len(best[slot]), pa.int32()),
                        pa.array([x[0] for x in best[slot]], pa.float64()),
                        pa.array([x[1] for x in best[slot]], pa.int64()),
                        pa.array([x[2].as_py() for x in best[slot]], pa.binary()),
                    ],
                    ["slot", "doubt", "content", "packed"],
                )

        schema = "slot int, doubt double, content long, packed binary"
        rows = features.select("content", "packed").mapInArrow(run, schema)
        rows = rows.groupBy("slot", "content").agg(
            F.min("doubt").alias("doubt"), F.first("packed").alias("packed")
        )
        # Each group of contents finds its surest, then those meet.
        for part in (F.pmod("content", F.lit(SPREAD)), F.lit(0)):
            order = Window.partitionBy("slot", part).orderBy("doubt", "content")
            rows = rows.withColumn("place", F.row_number().over(order))
            rows = rows.filter(F.col("place") <= picks).drop("place")
        found = sorted((r.slot, r.doubt, r.content, bytes(r.packed)) for r in rows.collect())
        used.update(x[2] for x in found)
        return [
            (slot // 2, float(slot % 2), *_unpacked([x[3] for x in found if x[0] == slot]))
            for slot in range(4)
        ]

    return surest


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    label: str = "quality",
    max_labelled: int = MAX_LABELLED,
    picks: int = PICKS,
) -> CoModel:
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("label"))
    known = known.filter("k is not null and label is not null")
    features = _featured(docs, key)
    labelled = _labelled(features, known, max_labelled)
    y = np.array([x[1] for x in labelled])
    apart = np.array([zlib.crc32(str(x[0]).encode()) % 4 == 0 for x in labelled], bool)
    surest = surest_rows(features, {x[0] for x in labelled}, picks)
    return co_train((*_unpacked([x[2] for x in labelled]), y, apart), surest)


def score(docs: DataFrame, model: CoModel, key: str = "doc_id") -> DataFrame:
    """Key, ``text_score``, ``meta_score``, ``score`` and ``kept`` for every row."""
    schema = T.StructType(
        [T.StructField(key, docs.schema[key].dataType)]
        + [T.StructField(x, T.DoubleType()) for x in ("text_score", "meta_score", "score")]
        + [T.StructField("kept", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, places = _views(batch, 1)
            found = model.scores(text, meta_views(places))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, found), pa.array(found[2] >= 0.5)], schema.names
            )

    return docs.select(key, "text", "source", "lang", "n_chars").mapInArrow(run, schema)
