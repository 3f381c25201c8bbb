"""Connected components of a graph whose links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewgate.session import materialise


def _smallest(pairs: DataFrame) -> DataFrame:
    """Each node ``a`` with the smallest of its neighbours ``b`` and itself."""
    return pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root`` (its smallest reachable node) for every node of ``edges``.

    Alternates two steps until nothing changes: larger neighbours are tied to the
    smallest neighbour, then smaller neighbours are. Every round is written to the
    shared folder; a node's minimum is combined before the shuffle and a node with many
    links is the side of a join that adaptive execution splits.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    links = materialise(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    before = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.join(_smallest(both), "a")
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        large = materialise(large, "links")
        least = _smallest(large)
        # Smaller neighbours and the node itself, to the smallest of them.
        small = (
            large.join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .filter("a <> b")
            .distinct()
        )
        links = materialise(small, "links")
        state = links.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
            F.count_distinct("a").alias("nodes"),
        ).first()
        # Done when every node has one link and no root has a link of its own.
        if state == before or (state.n == state.nodes and _flat(links)):
            break
        before = state
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _flat(links: DataFrame) -> bool:
    return links.join(links.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()
