"""Array and map helpers that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_strings() -> Column:
    return F.array().cast("array<string>")


def listed(*pairs: tuple[Column, Column | str]) -> Column:
    """Ordered array of the texts whose condition holds.

    A concatenation of one-element arrays keeps order and repeats, and unlike a
    filter lambda it is compiled with the rest of the stage. A NULL condition
    counts as false.
    """
    return F.concat(
        *[
            F.when(
                cond, F.array(F.lit(text) if isinstance(text, str) else text)
            ).otherwise(no_strings())
            for cond, text in pairs
        ]
    )


def same_text(text: Column | str, keys: list[str]) -> Column:
    """Map with the same text under every key."""
    value = F.lit(text) if isinstance(text, str) else text
    return F.create_map(*[x for key in keys for x in (F.lit(key), value)])


def text_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def fill_keys(col: Column, keys: list[str], default: str) -> Column:
    """Add ``default`` under the listed keys the map lacks (NULL map = empty)."""
    present = F.coalesce(col, F.create_map().cast("map<string,string>"))
    missing = [
        F.when(
            ~F.map_contains_key(present, key),
            F.create_map(F.lit(key), F.lit(default)),
        ).otherwise(F.create_map().cast("map<string,string>"))
        for key in keys
    ]
    return F.map_concat(present, *missing)


def empty_to_null(col: Column) -> Column:
    return F.when(F.size(col) > 0, col)


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)
