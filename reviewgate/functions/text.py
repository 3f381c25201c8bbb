"""Text and number formatting with the rounding a report reader expects.

``format_number`` with a pattern rounds the exact binary value half-even, which
is what ``'%.2f'`` does in Python; Spark's ``round`` and ``format_string`` round
the shortest decimal form half-up and differ on values such as 2.675.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewgate.constants import BLANKS


def strip(col: Column) -> Column:
    """Remove blanks of any kind from both ends, without a regex.

    ``btrim`` with a character set indexes every character of the text first, so
    a text that has no blank at either end is passed through untouched.
    """
    blanks = F.lit(BLANKS)
    clean = ~blanks.contains(F.left(col, F.lit(1))) & ~blanks.contains(
        F.right(col, F.lit(1))
    )
    return F.when(clean, col).otherwise(F.btrim(col, blanks))


def shorter_than(col: Column, n: int, probe: int = 64) -> Column:
    """Whether the stripped text has fewer than ``n`` characters.

    The stripped head of a text is part of the stripped text, so a head with
    enough characters settles it; only other texts are stripped whole.
    """
    head = F.btrim(F.left(col, F.lit(probe)), F.lit(BLANKS))
    return F.coalesce((F.length(head) < n) & (F.length(strip(col)) < n), F.lit(True))


def fixed(col: Column, digits: int) -> Column:
    """The number with exactly ``digits`` decimals, as text."""
    return F.call_function("format_number", col, F.lit("0." + "0" * digits))


def rounded(col: Column, digits: int) -> Column:
    return fixed(col.cast("double"), digits).cast("double")


def isoformat(ts: Column) -> Column:
    """ISO 8601 text; the fraction appears only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, whole).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def parse_iso(col: Column) -> Column:
    """ISO text to timestamp; a trailing Z or offset is honoured."""
    return F.try_to_timestamp(col)


def fill(template: str, values: dict[str, Column]) -> Column:
    """Put columns into a prompt text.

    The text is cut at its ``{name}`` marks and concatenated, so braces or marks
    inside a value are never looked at.
    """
    marks = "|".join(re.escape(name) for name in values)
    pieces = re.split(r"\{(" + marks + r")\}", template)
    parts = [
        values[piece].cast("string") if i % 2 else F.lit(piece)
        for i, piece in enumerate(pieces)
        if i % 2 or piece
    ]
    return F.concat(*parts)
