"""Quality rules as a bitmask ledger (operator 3), in built-in functions alone.

``measure`` takes every measurement once, ``ledger`` evaluates every rule once and
keeps the failures as bits of one integer beside the measurements. Policies are
versioned masks: judging by another policy, and counting what each rule alone
removes, are bitwise operations on the ledger and never touch the text again.

Cases: a null or empty text has no words, so it fails ``too_short``; texts of any
length are measured whole; rows are independent, so ties and repeated rows need no
rule; an empty table gives an empty ledger and ablations of zero; columns of the
input are neither lost nor mixed up with the ledger's, which sit in one struct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewgate.llm.frames import let

SYMBOLS = "[#*$%&|<>]"
WINDOW = 3
#: Low bits of a packed window that hold its start, and the words they suffice for.
START_BITS = 22
MOST_STARTS = 1 << START_BITS
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject under it."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BIT[name] for name in self.rules)


def _m(name: str) -> Column:
    return F.col(f"measured.{name}")


#: Every rule that a ledger holds; its place is its bit, so rules are only appended.
RULES = {
    "too_short": lambda: _m("n_words") < 50,
    "repetitive": lambda: 100 * _m("n_repeat_words") > 50 * _m("n_words"),
    "symbol_heavy": lambda: 10 * _m("n_symbols") > _m("n_words"),
    "repeated_lines": lambda: 10 * _m("n_dup_lines") > 3 * _m("n_lines"),
    "short_words": lambda: _m("word_chars") < 2 * _m("n_words"),
    "long_words": lambda: _m("word_chars") > 25 * _m("n_words"),
}
BIT = {name: i for i, name in enumerate(RULES)}
BASE = Policy("base", ("too_short", "repetitive"))
POLICIES = {
    "v1": Policy("v1", (*BASE.rules, "symbol_heavy", "repeated_lines")),
    "v2": Policy("v2", tuple(RULES)),
}
CURRENT = POLICIES["v2"]


def _covered(positions: Column) -> Column:
    """Words that windows starting at these ascending positions cover together."""
    return let(
        positions,
        lambda starts: F.aggregate(
            F.transform(
                starts,
                lambda at, k: F.least(
                    F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - at, F.lit(WINDOW))
                ),
            ),
            F.lit(0).cast("long"),
            lambda total, n: total + n,
        ),
    )


def _starts(words: Column) -> Column:
    return F.when(
        F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)
    ).otherwise(F.array().cast("array<int>"))


def _window_at(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i + k) for k in range(WINDOW)]


def _same_window(words: Column, i: Column, j: Column) -> Column:
    same = [x == y for x, y in zip(_window_at(words, i), _window_at(words, j))]
    return same[0] & same[1] & same[2]


def _repeated_exactly(words: Column) -> Column:
    """Starts of repeated windows: sort the windows themselves, compare neighbours."""
    windows = F.transform(
        _starts(words),
        lambda i: F.struct(
            *[x.alias(f"w{k}") for k, x in enumerate(_window_at(words, i))], i.alias("at")
        ),
    )

    def alike(x: Column, y: Column) -> Column:
        same = [x[f"w{k}"] == y[f"w{k}"] for k in range(WINDOW)]
        return F.coalesce(same[0] & same[1] & same[2], F.lit(False))

    return let(
        F.sort_array(windows),
        lambda ordered: F.transform(
            F.filter(
                ordered,
                lambda x, k: alike(x, F.get(ordered, k + 1))
                | ((k > 0) & alike(x, F.get(ordered, F.greatest(k - 1, F.lit(0))))),
            ),
            lambda x: x["at"],
        ),
    )


def _repeated(words: Column) -> Column:
    """Words in windows that occur twice or more.

    Windows are sorted as one long each, hash above and start below, so that equal ones
    are neighbours. Neighbours with equal hashes are then compared word by word; should
    two differ, or the text have too many words for such a long, the windows are
    sorted themselves. So the count is exact either way.
    """
    hash_mask = F.lit(-(1 << START_BITS)).cast("long")
    start_mask = F.lit((1 << START_BITS) - 1).cast("long")
    packed = F.transform(
        _starts(words),
        lambda i: F.xxhash64(*_window_at(words, i)).bitwiseAND(hash_mask).bitwiseOR(i),
    )

    def pair(x: Column, y: Column) -> Column:
        """Equal hashes: the bits above the start agree."""
        return F.coalesce(x.bitwiseXOR(y).bitwiseAND(hash_mask) == 0, F.lit(False))

    def start(x: Column) -> Column:
        return x.bitwiseAND(start_mask).cast("int")

    fast = let(
        F.sort_array(packed),
        lambda ordered: let(
            F.filter(
                ordered,
                lambda x, k: pair(x, F.get(ordered, k + 1))
                | ((k > 0) & pair(x, F.get(ordered, F.greatest(k - 1, F.lit(0))))),
            ),
            lambda met: F.when(
                ~F.exists(
                    F.transform(
                        met,
                        lambda x, k: pair(x, F.get(met, k + 1))
                        & ~_same_window(words, start(x), start(F.get(met, k + 1))),
                    ),
                    lambda differ: F.coalesce(differ, F.lit(False)),
                ),
                F.transform(met, start),
            ),
        ),
    )
    found = F.when(F.size(words) <= MOST_STARTS, fast)
    return _covered(F.sort_array(F.coalesce(found, _repeated_exactly(words))))


def measured(text: Column) -> Column:
    """All measurements of a text, as one struct of long values."""
    value = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    words = F.filter(F.split(value, "[ \\t-\\r]+"), lambda x: x != "")
    counts = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated(w).alias("n_repeat_words"),
        ),
    )
    by_line = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    return let(
        F.struct(counts.alias("c"), by_line.alias("l")),
        lambda x: F.struct(
            x["c"]["n_words"].alias("n_words"),
            x["c"]["word_chars"].alias("word_chars"),
            F.regexp_count(value, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            x["l"]["n_lines"].alias("n_lines"),
            x["l"]["n_dup_lines"].alias("n_dup_lines"),
            x["c"]["n_repeat_words"].alias("n_repeat_words"),
        ),
    )


def _bits() -> Column:
    bits = F.lit(0).cast("long")
    for name, failed in RULES.items():
        bits = bits.bitwiseOR(F.when(failed(), F.lit(1 << BIT[name])).otherwise(0).cast("long"))
    return bits


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``measured`` and ``failed`` (bit set: the rule failed)."""
    taken = docs.select(F.col(key), measured(F.col(text)).alias("measured"))
    return taken.select(key, "measured", _bits().alias("failed"))


def passes(policy: Policy, failed: Column | None = None) -> Column:
    failed = F.col("failed") if failed is None else failed
    return failed.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(book: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """One row per rule of a policy: rows it fails, rows only it removes, rows kept without it."""
    within = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))
    totals = book.agg(
        *[
            F.count_if(test(name)).alias(f"{kind}_{name}")
            for name in policy.rules
            for kind, test in (
                ("failed", lambda n: within.bitwiseAND(F.lit(1 << BIT[n]).cast("long")) != 0),
                ("alone", lambda n: within == (1 << BIT[n])),
                (
                    "kept",
                    lambda n: within.bitwiseAND(
                        F.lit(policy.mask & ~(1 << BIT[n])).cast("long")
                    )
                    == 0,
                ),
            )
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(policy.version).alias("policy"),
                F.lit(name).alias("rule"),
                F.col(f"failed_{name}").alias("n_failed"),
                F.col(f"alone_{name}").alias("n_only_this"),
                F.col(f"kept_{name}").alias("n_kept_without"),
            )
            for name in policy.rules
        ]
    )
    return totals.select(F.inline(rows))


def keep_passing(
    docs: DataFrame, policy: Policy = CURRENT, text: str = "text"
) -> DataFrame:
    """The rows that a policy keeps, with their own columns and no others."""
    own = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"))
    book = own.select("row", measured(F.col(f"row.{text}")).alias("measured"))
    return (
        book.select("row", _bits().alias("failed")).filter(passes(policy)).select("row.*")
    )
