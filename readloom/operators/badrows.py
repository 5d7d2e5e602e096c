"""Rows that fail to parse: typed rows on one side, failing lines with a reason on the other.

Lines are read permissively under an explicit schema; the raw line is kept. Lines the
reader calls corrupt, and all that hold a quote, are reclassified by quoting and count, and
every value by casts.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import values as V
from readloom.operators.fences import fenced


class FileColumn(NamedTuple):
    """A column lines must have: name, type (String, Integer, Float) and whether a value must be there."""

    name: str
    kind: str
    required: bool


_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^"\t]*+)'
_LINE = rf"(?s)^{_FIELD}(?:\t{_FIELD})*+\z"
#: The reader refuses lines of more columns; those are counted without it.
_READER_COLUMNS = 20000
# Line ends inside a line would end the record for the reader; it sees stand-ins instead.
_ENDS, _STAND_INS, _ESCAPE = "\r\n", "\ue00d\ue00a", "\ue00e"


def _restored(value: Column) -> Column:
    """Line ends for stand-ins; a stand-in after the escape is itself."""
    for end, mark in zip(_ENDS, _STAND_INS):
        value = F.regexp_replace(value, f"(?<!{_ESCAPE})((?:{_ESCAPE}{_ESCAPE})*){mark}", f"$1{end}")
    return F.regexp_replace(value, f"{_ESCAPE}([{_STAND_INS}{_ESCAPE}])", "$1")


def read_columns(columns: DataFrame, table: str, max_columns: int = 10000) -> list[FileColumn]:
    """The declared columns of ``table`` in order; more than ``max_columns`` is an error."""
    rows = (
        columns.where(F.col("table_name") == table).select("ordinal", "column_name", "type", "required")
        .limit(max_columns + 1).collect()
    )
    if len(rows) > max_columns:
        raise ValueError(f"more than {max_columns} columns are declared for {table}")
    return [FileColumn(r.column_name, r.type, bool(r.required)) for r in sorted(rows, key=lambda r: r.ordinal)]


def _tabs(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\t"), F.lit("")))


def is_data(line: Column, columns: Sequence[FileColumn]) -> Column:
    """False for null, blank and ``#`` lines and for headers (with a byte order mark or a CR)."""
    plain = F.regexp_replace(F.regexp_replace(line, "^﻿", ""), r"\r\z", "")
    header = F.lit("\t".join(c.name for c in columns))
    return F.coalesce((V.trimmed(line) != "") & ~plain.startswith("#") & (plain != header), F.lit(False))


def classify_lines(lines: DataFrame, columns: Sequence[FileColumn], line: str = "c0") -> DataFrame:
    """The data lines with ``fields`` (the reader's), ``reason`` and ``bad_columns`` beside their columns.

    ``reason`` is null for lines that fit, else the first that applies of ``quoting``,
    ``column_count`` and ``invalid_value`` (``bad_columns`` then names the columns). A final CR
    is no part of the line; tabs separate outside quotes; a field that begins with a quote
    must end with one, inner quotes doubled; no other quote may occur. A required column
    must not be missing, and number columns must be missing or valid. Line ends inside a line
    and lines of any length are values like others. Null lines and empty tables give no
    rows; repeated lines are judged each.
    """
    text = F.col("__text")
    names = [f"c{i}" for i in range(len(columns))]
    schema = ", ".join(f"{n} string" for n in names) + ", corrupt string"
    options = {
        "sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt",
        "maxColumns": str(_READER_COLUMNS + 1000), "maxCharsPerColumn": "-1",
    }
    quoted = text.contains('"')
    broken = quoted & ~text.rlike(_LINE)
    # Outside quotes: what is left when quoted fields are taken out.
    outside = F.regexp_replace(text, r'"[^"]*+(?:""[^"]*+)*+"', "")
    n_fields = F.when(quoted, _tabs(outside)).otherwise(_tabs(text)) + 1
    narrow = (_tabs(text) <= _READER_COLUMNS) | (~broken & (n_fields <= _READER_COLUMNS))
    # The stand-ins themselves, should a line hold them, are escaped by a third mark.
    # Few lines hold any of them; all others are read as they are.
    escaped = F.translate(F.regexp_replace(text, f"([{_STAND_INS}{_ESCAPE}])", f"{_ESCAPE}$1"), _ENDS, _STAND_INS)
    read = F.from_csv(F.when(narrow, F.when(F.col("__marked"), escaped).otherwise(text)), schema, options)
    corrupt = F.col("__read.corrupt").isNotNull() | F.col("__read").isNull()
    values = F.array(*[
        F.when(F.col("__marked"), _restored(F.coalesce(F.col(f"__read.{n}"), F.lit("")))).otherwise(F.coalesce(F.col(f"__read.{n}"), F.lit(""))) for n in names
    ])
    bad = []
    for i, c in enumerate(columns):
        value = F.element_at("fields", i + 1)
        missing = V.is_missing(value)
        wrong = F.lit(False)
        if c.kind.lower() == "integer":
            wrong = ~missing & ~V.is_integer(value)
        elif c.kind.lower() == "float":
            wrong = ~missing & ~V.is_float(value)
        bad.append(F.when(wrong | (missing if c.required else F.lit(False)), F.lit(c.name)))
    kept = [c for c in lines.columns if c not in ("fields", "reason", "bad_columns")]
    data = (
        lines.select(*[F.col(f"`{c}`") for c in kept])
        .where(is_data(F.col(f"`{line}`"), columns))
        .withColumn("__text", F.regexp_replace(F.col(f"`{line}`"), r"\r\z", ""))
        .withColumn("__marked", text.rlike(f"[{_ENDS}{_STAND_INS}{_ESCAPE}]"))
    )
    split = fenced(
        fenced(data, __read=read),
        __structure=F.when((corrupt | quoted) & broken, "quoting").when(
            (corrupt | quoted) & (n_fields != len(columns)), "column_count"
        ),
        fields=values,
    )
    fits = F.col("__structure").isNull()
    judged = fenced(split, bad_columns=F.when(fits, F.array_compact(F.array(*bad))))
    return judged.select(
        *[F.col(f"`{c}`") for c in kept],
        F.when(fits, F.col("fields")).alias("fields"),
        F.coalesce("__structure", F.when(F.size("bad_columns") > 0, "invalid_value")).alias("reason"),
        "bad_columns",
    )


def failing_lines(classified: DataFrame) -> DataFrame:
    return classified.where("reason is not null")


def typed_rows(classified: DataFrame, columns: Sequence[FileColumn], keep: Sequence[str] = ()) -> DataFrame:
    """The lines that fit as typed columns beside ``keep``; missing values are null.

    An integer beyond 64 bits is null in its column, and stands in ``uncast``, a map of column names to what the line says. A kept
    column that clashes with a declared one or with ``uncast`` gets the prefix ``line_``.
    """
    names = {c.name for c in columns} | {"uncast"}
    out, lost = [], []
    for i, c in enumerate(columns):
        value = V.trimmed(F.element_at("fields", i + 1))
        kind, told = c.kind.lower(), ~V.is_missing(F.element_at("fields", i + 1))
        cast = value.try_cast("bigint") if kind == "integer" else V.to_double(value) if kind == "float" else value
        out.append(F.when(told, cast).alias(c.name))
        if kind == "integer":
            lost.append(F.when(told & cast.isNull(), F.struct(F.lit(c.name).alias("name"), value.alias("value"))))
    entries = F.filter(F.array(*lost), lambda e: e.isNotNull()) if lost else F.array()
    uncast = F.map_from_entries(entries.cast("array<struct<name:string,value:string>>"))
    return classified.where("reason is null").select(
        *[F.col(f"`{k}`").alias(f"line_{k}" if k in names else k) for k in keep], *out, uncast.alias("uncast")
    )
