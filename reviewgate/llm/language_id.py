"""Language identification with word-first backoff (operator 2).

A word that training saw is scored by its log frequency per language. An unseen word
is scored by its longest known character n-grams: of length 4, else 3, 2 and 1. The
language with the largest sum wins.

Training counts words and n-grams in Spark over a sample of labelled rows. Bounds, all
parameters and all for each language: ``max_train_docs`` different texts (on average; chosen
by a hash of the text, at every size alike), ``max_words`` and ``max_grams`` entries of the
model, the most frequent first. So the model that goes to the executors has a fixed largest
size per language, and a language with two rows is learned beside one with a billion.

Cases: a null text, or one without a letter, is ``und`` with score 0. A text of which
no n-gram is known gets the language with most training words and the score of a tie.
Equal sums go to the language first in that order. An empty training table leaves
every text ``und``. Null languages are not learned. Rows are independent, so repeated
rows need no rule; texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewgate.session import materialise

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
LONGEST = 4
#: Bound of what a worker remembers of words; what is forgotten is looked up again.
WORD_CACHE = 300_000
GATHERED_WORDS = 200_000
#: Bounds for each language: different labelled texts, known words and known n-grams.
MAX_TRAIN_DOCS = 1_500
MAX_WORDS = 15_000
MAX_GRAMS = 10_000


def counted_words(text: str | None) -> Counter:
    """Words of a text: runs of letters. Numerals that are no digits, like those of a
    fraction or a Roman numeral, are none and part words."""
    found = Counter(WORD.findall(text.lower())) if text else Counter()
    for word in [x for x in found if not x.isalpha()]:
        n = found.pop(word)
        for part in "".join(x if x.isalpha() else " " for x in word).split():
            found[part] += n
    return found


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between its end marks."""
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class LanguageModel:
    """Log frequencies: one row per entry, one column per language."""

    languages: list[str]
    entries: dict[str, int]
    table: np.ndarray
    #: Words met lately by their row in ``_scores``; row 0, all zero, says nothing.
    _lately: dict[str, int] = field(default_factory=dict)
    _scores: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "_lately": {}, "_scores": None}

    def word_score(self, word: str) -> np.ndarray | None:
        """Per language; None if not even a letter of it is known."""
        at = self.entries.get(f"w{word}")
        if at is not None:
            return self.table[at]
        for n in range(LONGEST, 0, -1):
            known = [i for g in grams(word, n) if (i := self.entries.get(f"{n}{g}")) is not None]
            if known:
                return self.table[known].mean(axis=0)
        return None

    def predict(self, text: str | None) -> tuple[str, float]:
        words = counted_words(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0
        lately = self._lately
        if self._scores is None or len(lately) + len(words) >= len(self._scores):
            lately.clear()
            self._scores = np.zeros((max(WORD_CACHE, len(words)) + 1, len(self.languages)))
        rows = []
        for word in words:
            row = lately.get(word)
            if row is None:
                score = self.word_score(word)
                row = lately[word] = 0 if score is None else len(lately) + 1
                if row:
                    self._scores[row] = score
            rows.append(row)
        total = np.fromiter(words.values(), np.float64, len(words)) @ self._scores[rows]
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def _entries(words: dict[str, Counter]) -> pa.RecordBatch:
    """Counted words of each language with the n-grams they hold."""
    langs, names, numbers = [], [], []
    for lang, counted in words.items():
        found: Counter = Counter()
        for word, n in counted.items():
            names.append(f"w{word}")
            numbers.append(n)
            for size in range(1, LONGEST + 1):
                for gram in grams(word, size):
                    found[f"{size}{gram}"] += n
        names += found
        numbers += found.values()
        langs += [lang] * (len(names) - len(langs))
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(names, pa.string()), pa.array(numbers, pa.int64())],
        ["lang", "entry", "n"],
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per language and entry, to be summed; sent on when many have gathered."""
    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.setdefault(lang, Counter()).update(counted_words(text))
        if sum(map(len, words.values())) > GATHERED_WORDS:
            yield _entries(words)
            words = {}
    yield _entries(words)


def train(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_train_docs: int = MAX_TRAIN_DOCS,
    max_words: int = MAX_WORDS,
    max_grams: int = MAX_GRAMS,
) -> LanguageModel:
    """Learn from the rows of ``docs`` whose language is known; nothing else is read.

    Every language is learned from its own sample of different texts and keeps its own most
    frequent entries, so one with few rows is known as well as it can be beside large ones.
    """
    labelled = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    labelled = labelled.filter("lang is not null")
    # One row per language, as the model has one column for each.
    rows = labelled.groupBy("lang").agg(F.approx_count_distinct("text", 0.02).alias("of_lang"))
    share = F.lit(max_train_docs) / F.col("of_lang") * F.lit(1 << 32)
    # A text in very many rows is one text: equal ones meet before they are shuffled.
    labelled = (
        labelled.join(F.broadcast(rows), "lang")
        .filter(F.pmod(F.xxhash64("text"), F.lit(1 << 32)) < share)
        .select("lang", "text")
        .distinct()
    )
    counts = (
        labelled.mapInArrow(_counted, "lang string, entry string, n long")
        .groupBy("lang", "entry")
        .agg(F.sum("n").alias("n"))
    )
    counts = materialise(counts.withColumn("kind", F.substring("entry", 1, 1)), "language-counts")
    sizes = {
        (row.kind, row.lang): row.n
        for row in counts.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()
    }
    # Of each language the first max_words and max_grams by count.
    is_word = F.col("kind") == "w"
    first = Window.partitionBy("lang", is_word).orderBy(F.desc("n"), "entry")
    best = counts.withColumn("rank", F.row_number().over(first)).filter(
        F.col("rank") <= F.when(is_word, max_words).otherwise(max_grams)
    )
    by_entry = (
        counts.join(best.select("entry").distinct(), "entry")
        .groupBy("kind", "entry")
        .agg(F.sum("n").alias("n"), F.collect_list(F.struct("lang", "n")).alias("by_lang"))
    )
    kept = by_entry.orderBy(F.desc("n"), "entry").toArrow().to_pylist()
    weight = Counter({x: 0 for _, x in sizes})
    for (k, x), n in sizes.items():
        weight[x] += n if k == "w" else 0
    languages = sorted(weight, key=lambda x: (-weight[x], x))
    column = {x: i for i, x in enumerate(languages)}
    table = np.zeros((len(kept), len(languages)), dtype=np.float32)
    # Half a count of the largest sample for languages without the entry, so that a language
    # of few rows is not the likeliest for what it has never seen.
    largest = {k: max(n for (j, _), n in sizes.items() if j == k) for k, _ in sizes}
    absent = {k: -np.log(2.0 * n + 2) for k, n in largest.items()}
    for i, row in enumerate(kept):
        kind = row["kind"]
        table[i] = absent[kind]
        for x in row["by_lang"]:
            table[i, column[x["lang"]]] = np.log((x["n"] + 0.5) / (sizes[kind, x["lang"]] + 1))
    return LanguageModel(languages, {row["entry"]: i for i, row in enumerate(kept)}, table)


def _predictions(values: list[str | None], model: LanguageModel) -> tuple[list, list]:
    found = [model.predict(x) for x in values]
    return [x[0] for x in found], [x[1] for x in found]


def identify(
    docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Key, ``lang_pred`` and ``score`` (the winner's share of the likelihood)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _predictions(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                schema.names,
            )

    return docs.select(key, text).mapInArrow(run, schema)


def keep_identified(
    docs: DataFrame, model: LanguageModel, text: str = "text", least: float = 0.5
) -> DataFrame:
    """The rows with a language that is likelier than all others together."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _predictions(batch.column(at).to_pylist(), shared.value)
            keep = [x != UNKNOWN and s >= least for x, s in zip(langs, scores)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: Column, folds: int = 5) -> Column:
    """The fold that is never trained on."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % folds == 0, F.lit(False))
