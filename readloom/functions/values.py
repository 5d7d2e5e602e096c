"""Column expressions for loosely written values: missing marks, numbers, flags.

White space means blanks, tabs, carriage returns and line feeds; it never matters
around a value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\r\n"
# What counts as missing, true and false, in lower case.
MISSING_MARKS = ("", ".", "-", "?", "na", "n/a", "null")
TRUE_MARKS = ("", "1", "true", "t", "yes", "y")
FALSE_MARKS = ("0", "false", "f", "no", "n")
# The spelling of numbers.
INTEGER = r"^[+-]?[0-9]+\z"
DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
SPECIAL = r"(?i)^[+-]?(?:nan|inf|infinity)\z"


def trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITE))


def is_missing(value: Column) -> Column:
    """Null, or one of the missing marks; never null itself."""
    return F.coalesce(F.lower(trimmed(value)).isin(*MISSING_MARKS), F.lit(True))


def is_integer(value: Column) -> Column:
    return F.coalesce(trimmed(value).rlike(INTEGER), F.lit(False))


def is_float(value: Column) -> Column:
    text = trimmed(value)
    return F.coalesce(text.rlike(DECIMAL) | text.rlike(SPECIAL), F.lit(False))


def to_double(value: Column) -> Column:
    """Double of a valid float spelling, else null."""
    text = trimmed(value)
    low = F.lower(text)
    return (
        F.when(text.rlike(DECIMAL), text.try_cast("double"))
        .when(low.rlike(r"^[+-]?nan\z"), F.lit(float("nan")))
        .when(low.rlike(r"^\+?inf(?:inity)?\z"), F.lit(float("inf")))
        .when(low.rlike(r"^-inf(?:inity)?\z"), F.lit(float("-inf")))
    )


def canonical_integer(value: Column) -> Column:
    """Plain digits of any length, ``-`` only before a negative number; null if invalid."""
    text = trimmed(value)
    digits = F.ltrim(F.regexp_replace(text, r"^[+-]", ""), F.lit("0"))
    plain = F.when(digits == "", F.lit("0")).when(
        text.startswith("-"), F.concat(F.lit("-"), digits)
    ).otherwise(digits)
    return F.when(text.rlike(INTEGER), plain)


def canonical_float(value: Column) -> Column:
    """Four decimals, ``NaN``, ``Inf`` or ``-Inf``; null if invalid."""
    number = to_double(value)
    return (
        F.when(number.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(number), F.lit("NaN"))
        .when(number == float("inf"), F.lit("Inf"))
        .when(number == float("-inf"), F.lit("-Inf"))
        .otherwise(F.format_string("%.4f", number))
    )


def canonical_character(value: Column) -> Column:
    text = trimmed(value)
    return F.when(F.length(text) == 1, text)


def canonical_flag(value: Column) -> Column:
    """A flag that is there without a value is set: null and empty mean true."""
    low = F.coalesce(F.lower(trimmed(value)), F.lit(""))
    return F.when(low.isin(*TRUE_MARKS), F.lit("true")).when(low.isin(*FALSE_MARKS), F.lit("false"))


_SCALAR = {
    "integer": canonical_integer,
    "float": canonical_float,
    "character": canonical_character,
    "string": trimmed,
}


def _one(kind: str, value: Column) -> Column:
    return F.when(~is_missing(value), _SCALAR[kind](value))


def _many(kind: str, value: Column, arity: Column) -> Column:
    parts = F.transform(F.split(value, ",", -1), lambda part: _one(kind, part))
    whole = (F.size(parts) == arity) & F.forall(parts, lambda part: part.isNotNull())
    return F.when(whole, F.array_join(parts, ","))


def canonical(value: Column, kind: Column, arity: Column) -> Column:
    """Canonical text of ``value`` under a declared type, null where missing or invalid.

    ``kind`` holds integer, float, character, string or flag in any case; ``arity`` is
    the number of comma-separated members (at most 1: the value is not a list).
    """
    kind = F.lower(trimmed(kind))
    result = F.when(kind == "flag", canonical_flag(value))
    for name in _SCALAR:
        result = result.when((kind == name) & (arity > 1), _many(name, value, arity))
        result = result.when(kind == name, _one(name, value))
    return result
