"""Reading model responses: fence removal, strict and tolerant JSON parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewgate.constants import BLANKS, FENCED_OBJECT, OUTER_BRACES
from reviewgate.functions.numbers import python_float
from reviewgate.functions.text import strip

# First character of a JSON text, and the type it stands for.
_PYTHON_NAMES = [
    ("{", "dict"),
    ('"', "str"),
    ("n", "NoneType"),
    ("t", "bool"),
    ("f", "bool"),
]


def without_fence(response: Column) -> Column:
    """Strip, and drop the markers of a code fence that opens the text."""
    text = strip(response)

    def dropped(opening: str) -> Column:
        body = F.replace(text, F.lit(opening + "\n"), F.lit(""))
        return F.btrim(F.replace(body, F.lit("\n```"), F.lit("")), F.lit(BLANKS))

    return (
        F.when(F.startswith(text, F.lit("```json")), dropped("```json"))
        .when(F.startswith(text, F.lit("```")), dropped("```"))
        .otherwise(text)
    )


def whole_json(text: Column) -> Column:
    """The text as a variant, NULL unless all of it is one JSON value.

    ``try_parse_json`` stops after the first value and ignores what follows, a
    remark of the model for instance. So the text is parsed as the first element
    of an array whose second element is its own hash: anything after the value
    breaks the array or moves the hash away from the second place. Prose is told
    by its first or last character and not parsed at all, because a failed parse
    costs an exception.
    """
    mark = F.xxhash64(text).cast("string")
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark, F.lit("]")))
    second = F.to_json(F.try_variant_get(pair, "$[1]", "variant"))
    bare = F.btrim(text, F.lit(" \t\n\r"))
    plausible = F.lit('{["-0123456789tfn').contains(F.left(bare, F.lit(1))) & F.lit(
        '}]"0123456789el'
    ).contains(F.right(bare, F.lit(1)))
    return F.when(
        plausible & (bare != "") & (second == mark),
        F.try_variant_get(pair, "$[0]", "variant"),
    )


def strict_json(response: Column) -> Column:
    return whole_json(without_fence(response))


def tolerant_json(response: Column) -> Column:
    """Whole text, else the first fenced object, else first ``{`` to last ``}``."""
    return F.coalesce(
        whole_json(response),
        whole_json(F.regexp_extract(response, FENCED_OBJECT, 1)),
        whole_json(F.regexp_extract(response, OUTER_BRACES, 0)),
    )


def member(doc: Column, key: str) -> Column:
    """The member as a variant; SQL NULL only when it is absent."""
    return F.try_variant_get(doc, f"$.{key}", "variant")


def member_json(doc: Column, key: str) -> Column:
    """The member as JSON text, whose first character tells its type.

    Both type and number are read from this text: a variant's own casts and its
    schema function build an expression or a schema per row.
    """
    return F.to_json(member(doc, key))


def is_object(json: Column) -> Column:
    return json.startswith("{")


def is_number(json: Column) -> Column:
    """Numbers as Python sees them: JSON booleans count."""
    digits = F.lit("-0123456789").contains(F.left(json, F.lit(1))) & (json != "")
    return digits | json.isin("true", "false")


def number(json: Column) -> Column:
    """The number, also of a text that holds one; a boolean is 1 or 0."""
    return (
        F.when(json == "true", 1.0)
        .when(json == "false", 0.0)
        .otherwise(python_float(F.btrim(json, F.lit('"'))))
    )


def python_type(json: Column) -> Column:
    """How the type of a JSON value reads in a Python error text."""
    chain = F.when(json.startswith("["), "list")
    for start, name in _PYTHON_NAMES:
        chain = chain.when(json.startswith(start), name)
    whole = F.rlike(json, F.lit("^-?[0-9]+$"))
    return chain.when(whole, "int").otherwise("float")


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def as_strings(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<string>")
