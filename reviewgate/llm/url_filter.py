"""URL verdicts by rules and a logistic regression (operator 9), in built-in functions alone.

Rules name a host and the beginning of a path; the longest that fits decides. Every other
url is judged by a logistic regression on hashed character n-grams of its host and path,
trained from a small labelled url table: at most about ``MAX_LABELLED`` rows, chosen by a
hash of the url. Training is full-batch: each round sums the gradient per hashed feature in
Spark, in whole numbers so that no order of adding matters, and brings the ``DIMENSIONS``
sums to the driver. Judging is a projection: no shuffle, the weights are one constant.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
judged by the model's intercept; without labelled rows all weights are zero; an even score
allows; equal urls get equal verdicts, as rows are independent; urls of any length are
read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewgate.llm.frames import let
from reviewgate.session import materialise

ALLOW, BLOCK = "allow", "block"
DIMENSIONS = 1024
GRAM = 3
MAX_LABELLED = 2_000
ROUNDS = 15
RATE = 0.5
DECAY = 1e-3
#: Gradients are added as whole numbers of this unit.
UNIT = 1 << 30


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and the paths that begin as given."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host, path = F.col("host"), F.col("path")
        return (
            (host == self.host) | host.endswith(f".{self.host}")
        ) & path.startswith(self.path)


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    after = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    value = F.coalesce(F.col(url), F.lit(""))
    return pages.withColumns(
        {
            "host": F.translate(
                F.regexp_extract(value, after, 1),
                string.ascii_uppercase,
                string.ascii_lowercase,
            ),
            "path": F.regexp_extract(value, after, 2),
        }
    )


def ruled(rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda x: (len(x.name), x.name)):
        name = F.when(rule.fits(), F.lit(rule.name)).otherwise(name)
        verdict = F.when(rule.fits(), F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def features(dimensions: int = DIMENSIONS) -> Column:
    """Hashed n-grams of ``host`` and ``path``; 0 is the intercept."""

    def hashed(kind: str, value: Column) -> Column:
        chars = F.filter(F.split(F.concat(F.lit("^"), value, F.lit("$")), ""), lambda x: x != "")
        return let(
            chars,
            lambda x: F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(x) - GRAM, F.lit(0))),
                lambda i: (
                    F.pmod(
                        F.xxhash64(F.lit(kind), *[F.get(x, i + k) for k in range(GRAM)]),
                        F.lit(dimensions - 1),
                    )
                    + 1
                ).cast("int"),
            ),
        )

    return F.concat(
        F.array(F.lit(0)), hashed("host", F.col("host")), hashed("path", F.col("path"))
    )


def margin(found: Column, weights: list[float]) -> Column:
    """Sum of the weights of a row's features, over the root of their number."""
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    return let(
        found,
        lambda x: F.aggregate(
            x, F.lit(0.0), lambda total, i: total + F.get(table, i)
        )
        / F.sqrt(F.size(x).cast("double")),
    )


def train(
    labelled: DataFrame,
    url: str = "url",
    blocked: str = "blocked",
    max_labelled: int = MAX_LABELLED,
    rounds: int = ROUNDS,
) -> list[float]:
    """Weights by hashed feature, from urls and whether each is to be blocked."""
    # Different urls only: one that stands in very many rows is one example.
    rows = (
        labelled.select(F.col(url).alias("url"), F.col(blocked).alias("blocked"))
        .filter("url is not null and blocked is not null")
        .distinct()
    )
    n = rows.count()
    if n > max_labelled:
        keep = int(max_labelled / n * (1 << 32))
        rows = rows.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 32)) < keep)
    rows = with_parts(rows).select(
        F.when(F.col("blocked"), 1.0).otherwise(0.0).alias("y"), features().alias("x")
    )
    # Chosen where they are read; then few enough for one file.
    rows = materialise(rows.repartition(1), "labelled-urls")
    n = max(1, rows.count())
    weights, squares = [0.0] * DIMENSIONS, [0.0] * DIMENSIONS
    for _ in range(rounds):
        error = 1 / (1 + F.exp(-margin(F.col("x"), weights))) - F.col("y")
        each = F.round(error / F.sqrt(F.size("x").cast("double")) * UNIT).cast("long")
        gradient = (
            rows.select(each.alias("g"), F.explode("x").alias("i"))
            .groupBy("i")
            .agg(F.sum("g").alias("g"))
            .collect()
        )
        for row in gradient:
            g = row.g / UNIT / n + DECAY * weights[row.i]
            squares[row.i] += g * g
            if g:
                weights[row.i] -= RATE * g / math.sqrt(squares[row.i])
    return weights


def judge(
    pages: DataFrame, rules: list[Rule], weights: list[float], key: str = "page_id", url: str = "url"
) -> DataFrame:
    """Key, ``host``, ``path``, ``rule``, ``verdict`` and the model's ``score`` for blocking."""
    parts = with_parts(pages.select(F.col(key), F.col(url).alias("url")))
    name, verdict = ruled(rules)
    scored = parts.withColumns(
        {"rule": name, "by_rule": verdict, "margin": margin(features(), weights)}
    )
    modelled = F.when(F.col("margin") > 0, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return scored.select(
        key,
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", modelled).alias("verdict"),
        (1 / (1 + F.exp(-F.col("margin")))).alias("score"),
    )
