"""Score and sum helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sums of money and scores are taken over decimals: the result is then the same
# whatever the partitioning, the task order or the number of retried tasks.
EXACT = "decimal(18,10)"


def clamp(col: Column, default: float = 0.0) -> Column:
    """Clamp to [0, 10]; NULL takes the default first (``least`` skips NULL)."""
    value = F.coalesce(col.cast("double"), F.lit(default))
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), value))


def in_score_range(col: Column) -> Column:
    return F.coalesce(col.between(0, 10), F.lit(False))


def python_float(text: Column) -> Column:
    """Text to double; type suffixes and hexadecimal forms are no numbers."""
    odd = F.rlike(text, F.lit(r"(?i)[0-9.][df]\s*$|x"))
    return F.when(~odd, text.try_cast("double"))


def exact_sum(col: Column) -> Column:
    return F.sum(col.cast(EXACT))


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    """``top / bottom`` as double, ``empty`` when the bottom is not positive."""
    return F.when(
        bottom > 0, F.try_divide(top.cast("double"), bottom.cast("double"))
    ).otherwise(F.lit(empty))


def call_cost(input_tokens: Column, output_tokens: Column) -> Column:
    from reviewgate.constants import USD_PER_1K_INPUT_TOKENS, USD_PER_1K_OUTPUT_TOKENS

    def part(tokens: Column, price: float) -> Column:
        return F.coalesce(tokens, F.lit(0)).cast("double") / F.lit(1000.0) * F.lit(price)

    return part(input_tokens, USD_PER_1K_INPUT_TOKENS) + part(
        output_tokens, USD_PER_1K_OUTPUT_TOKENS
    )
