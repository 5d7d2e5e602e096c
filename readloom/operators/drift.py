"""Tables whose fields change from file to file: path-value maps, type statistics, changes.

Declarations and records are read as path-value maps. One table of statistics by file and path (a
column and a field id) says what is declared there and which raw types occur. Changes compare the
statistics of each file with those of the one before it; the projection takes from them under
which name a file's field is in force.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import values as V
from readloom.operators.fences import fenced

_LINE = r"(?s)^##(INFO|FORMAT)\s*=\s*<(.*)>\s*\z"
_ENTRY = r'(?s)\s*([A-Za-z_][A-Za-z0-9_.]*)\s*=\s*("(?:[^"\\]|\\.)*+"\s*|[^,]*+(?:,(?!\s*[A-Za-z_][A-Za-z0-9_.]*\s*=)[^,]*+)*+)(?:,|\z)'


def _unquoted(text: Column) -> Column:
    text = V.trimmed(text)
    inner = F.regexp_replace(F.regexp_replace(text, r'(?s)^"(.*)"\z', "$1"), r"\\(.)", "$1")
    return F.when(text.startswith('"'), V.trimmed(inner)).otherwise(text)


def declaration_map(line: Column) -> Column:
    """Keys and values of a ``##INFO=<...>`` or ``##FORMAT=<...>`` line, the first of each key.

    Any order of keys, white space, quotes (with escapes) and commas inside values are
    understood. Null for other lines.
    """
    whole = F.regexp_extract_all(F.regexp_extract(line, _LINE, 2), F.lit(_ENTRY), F.lit(0))
    entries = F.transform(whole, lambda e: F.struct(
        F.lower(V.trimmed(F.substring_index(e, "=", 1))).alias("k"), F.regexp_replace(F.split(e, "=", 2)[1], r",\z", "").alias("v")
    ))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    values = F.transform(keys, lambda k: _unquoted(F.filter(entries, lambda e: e["k"] == k)[0]["v"]))
    return F.when(line.rlike(_LINE), F.map_from_arrays(keys, values))


def letters_and_digits(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def about_key(description: Column) -> Column:
    """64 bits of a description's letters and digits in lower case; 0 if it has none."""
    about = F.coalesce(letters_and_digits(description), F.lit(""))
    return F.when(about == "", F.lit(0).cast("long")).otherwise(F.xxhash64(about))


def declaration_paths(headers: DataFrame, file: str = "file_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """One row per declaration: ``file_id, column_name, field_id, place, declared``, the last a map of its keys and values.

    ``place`` orders the declarations of a field: by ``order`` (null: last), then by a hash of the line.
    Lines without an id, null lines and other lines declare nothing. Every line is parsed once.
    """
    told = headers.select(
        F.col(file).alias("file_id"), F.coalesce(F.col(order).cast("long"), F.lit(2**31 - 1)).alias("__order"), V.trimmed(F.col(line)).alias("__line")
    ).where(F.coalesce(F.col("__line").rlike(_LINE), F.lit(False)) & F.col("file_id").isNotNull())
    mapped = fenced(told, column_name=F.regexp_extract("__line", _LINE, 1), declared=declaration_map(F.col("__line")))
    place = F.shiftleft("__order", 32) + F.pmod(F.xxhash64("__line"), F.lit(1 << 32))
    return mapped.select(
        "file_id", "column_name", F.col("declared")["id"].alias("field_id"), place.alias("place"), "declared"
    ).where(F.coalesce(F.col("field_id"), F.lit("")) != "")


# Raw types of values, from narrow to wide.
RAW_TYPES = ("Missing", "Integer", "Float", "String")


def path_statistics(declarations: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """One row per file and path (column and field): what is declared, and how many values of which raw type there are.

    ``file_id, column_name, field_id, declared, declared_type, type_key, about_key, n_declared`` and
    ``n_missing, n_integer, n_float, n_string``. Of repeated declarations the first counts.
    ``values`` are paths with a ``value`` (see ``project_typed``); fields that are declared and
    never used, or used and never declared, have their row too. Keys are 64-bit hashes, so that what decides
    on changes is of fixed width and combines in hash tables before the shuffle.
    """
    declared_type = F.coalesce(F.col("declared")["type"], F.lit(""))
    keys = ["file_id", "column_name", "field_id"]
    rows = declarations.select(
        *keys, "place", "declared", declared_type.alias("declared_type"), F.xxhash64(F.lower(declared_type)).alias("type_key"),
        about_key(F.col("declared")["description"]).alias("about_key"),
    )
    if values is not None:
        told = values.where("column_name is not null and field_id is not null").select(*keys, raw_type(F.col("value")).alias("raw"))
        rows = rows.unionByName(told, allowMissingColumns=True)
    else:
        rows = rows.withColumn("raw", F.lit(None).cast("string"))
    first = [F.min_by(c, "place").alias(c) for c in ("declared", "declared_type", "type_key", "about_key")]
    return rows.groupBy(*keys).agg(
        *first, F.count("place").alias("n_declared"), *[F.count_if(F.col("raw") == t).alias(f"n_{t.lower()}") for t in RAW_TYPES]
    )


def declared_fields(headers: DataFrame, file: str = "file_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """The path statistics of the declarations alone."""
    return path_statistics(declaration_paths(headers, file, order, line))


def path_type_statistics(statistics: DataFrame) -> DataFrame:
    """``file_id, path, declared_type, raw_type, n_values``: how often each raw type occurs at a path of a file."""
    counts = F.array(*[F.struct(F.lit(t).alias("raw_type"), F.col(f"n_{t.lower()}").alias("n_values")) for t in RAW_TYPES])
    return statistics.select(
        "file_id", F.concat_ws("/", "column_name", "field_id").alias("path"), "declared_type",
        F.inline(F.filter(counts, lambda c: c["n_values"] > 0)),
    )


def file_pairs(files: DataFrame, file: str = "file_id", series: str = "series_id", created: str = "created_at") -> DataFrame:
    """``file_id, previous_id, next_id``: each file and those beside it in its series.

    Ordered by ``created``, then by id; files without series or id are left out, a file
    listed twice counts once. A window that only looks one row away streams through its
    sorted partition, so a long series needs no memory.
    """
    once = (
        files.select(F.col(file).alias("file_id"), F.col(series).alias("__series"), F.col(created).alias("__created"))
        .where(F.col("file_id").isNotNull() & F.col("__series").isNotNull())
        .groupBy("file_id").agg(F.min(F.struct("__series", "__created")).alias("__s"))
        .select("file_id", "__s.*")
    )
    order = Window.partitionBy("__series").orderBy("__created", "file_id")
    return once.select("file_id", F.lag("file_id").over(order).alias("previous_id"), F.lead("file_id").over(order).alias("next_id"))


def field_changes(statistics: DataFrame, pairs: DataFrame) -> DataFrame:
    """``file_id, column_name, change_kind, field_id, new_id`` against the file before, from the path statistics.

    A field that is gone and a new one with the same description (letters and digits only,
    any case, not empty) make a ``renamed`` row; if several agree, they pair in order of
    their ids. Others are ``removed`` or ``added``. ``type`` tells that the type of a kept or
    renamed field differs in more than case; ``field_id`` is then the id in this file.

    Each field stands once for its own file and once for the next one; both meet in one aggregation.
    """
    side = statistics.where("n_declared > 0").select("file_id", "column_name", "field_id", "type_key", "about_key").join(pairs, "file_id")
    meeting = side.select(
        F.inline(F.array(
            F.struct(F.when(F.col("previous_id").isNotNull(), F.col("file_id")).alias("file_id"), F.lit(True).alias("now")),
            F.struct(F.col("next_id").alias("file_id"), F.lit(False).alias("now")),
        )),
        "column_name", "field_id", "type_key", "about_key",
    ).where("file_id is not null")
    of = lambda c, now: F.max(F.when(F.col("now") == now, F.col(c)))
    both = meeting.groupBy("file_id", "column_name", "field_id").agg(
        of("type_key", True).alias("new_type"), of("type_key", False).alias("old_type"),
        of("about_key", True).alias("new_about"), of("about_key", False).alias("old_about"),
    )
    kept = F.col("new_type").isNotNull() & F.col("old_type").isNotNull()
    about = F.coalesce("new_about", "old_about")
    single = both.where(F.col("new_type").isNull() | F.col("old_type").isNull() | (F.col("new_type") != F.col("old_type"))).select(
        "file_id", "column_name", "field_id", "new_type", "old_type", kept.alias("kept"), F.col("old_type").isNull().alias("is_new"), about.alias("about"),
        # Fields that pair with none by description.
        F.when(kept | (about == 0), F.concat_ws("\u0001", F.col("old_type").isNull(), "field_id")).otherwise("").alias("slot"),
    )
    keys = ["file_id", "column_name", "about", "slot"]
    rank = F.row_number().over(Window.partitionBy(*keys, "is_new").orderBy("field_id"))
    matched = single.repartition(*keys).withColumn("n", rank).groupBy(*keys, "n").agg(
        F.max("kept").alias("kept"), F.max("new_type").alias("new_type"), F.max("old_type").alias("old_type"),
        F.max(F.when(F.col("is_new"), F.col("field_id"))).alias("new_id"), F.max(F.when(~F.col("is_new"), F.col("field_id"))).alias("old_id"),
    )

    def row(kind: str, field: Column, new: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("change_kind"), field.alias("field_id"), (F.lit("") if new is None else new).alias("new_id"))

    new, old = F.col("new_id"), F.col("old_id")
    own = (
        F.when(F.col("kept"), F.lit(None))
        .when(new.isNull(), row("removed", old)).when(old.isNull(), row("added", new)).otherwise(row("renamed", old, new))
    )
    retyped = F.when(F.col("new_type") != F.col("old_type"), row("type", F.coalesce(new, old)))
    rows = F.filter(F.array(own, retyped), lambda r: r.isNotNull())
    return matched.select("file_id", "column_name", F.inline(rows))


def raw_type(value: Column) -> Column:
    """What a raw value looks like: Missing, Integer, Float or String."""
    return (
        F.when(V.is_missing(value), "Missing").when(V.is_integer(value), "Integer")
        .when(V.is_float(value), "Float").otherwise("String")
    )


def canonical_ids(fields: DataFrame, declared: DataFrame) -> DataFrame:
    """``file_id, column_name, field_id, canonical_id``: file fields under the names in force.

    A field has the name in force that equals its id, else the one whose description
    agrees; others keep their own id.
    """
    known = declared.select(
        F.col("column_name").alias("__c"), F.col("field_id").alias("__id"), about_key(F.col("description")).alias("__about")
    ).where("__id is not null")
    by_about = known.where("__about <> 0").groupBy("__c", "__about").agg(F.min("__id").alias("__by_about"))
    return (
        fields.join(known.select("__c", "__id").distinct(), (F.col("column_name") == F.col("__c")) & (F.col("field_id") == F.col("__id")), "left")
        .drop("__c")
        .join(by_about, (F.col("column_name") == F.col("__c")) & (F.col("about_key") == F.col("__about")), "left")
        .select("file_id", "column_name", "field_id", F.coalesce("__id", "__by_about", "field_id").alias("canonical_id"))
    )


def project_typed(
    paths: DataFrame, ids: DataFrame, attributes: Sequence, entity: str = "record_id", records: DataFrame | None = None,
    formats: Sequence = (),
) -> DataFrame:
    """One row per record with typed columns; what no column takes is reported, not lost.

    ``paths`` has ``file_id``, the entity, ``column_name``, ``field_id`` and ``value``, and for
    values of samples ``sample`` (from 1; else null); ``ids`` are canonical ids. ``attributes``
    are those of INFO. Those of FORMAT (``formats``) have a column ``FORMAT/id``, an array
    with one member for each sample. ``others`` maps fields that are not in force to their raw
    values, ``failed_casts`` those whose value does not fit the type in force; fields of a
    sample are named ``FORMAT/id/sample``. Records of ``records`` (``file_id`` and the entity)
    without any path have a row without values.

    Values are gathered by record and sample, then by record: work grows with the samples, not their square.
    """
    from readloom.operators.eav import _typed, typed_value

    if "sample" not in paths.columns:
        paths = paths.withColumn("sample", F.lit(None).cast("int"))
    if records is not None:
        paths = paths.unionByName(records.select("file_id", entity), allowMissingColumns=True)
    named = paths.join(ids, ["file_id", "column_name", "field_id"], "left").withColumn(
        "canonical_id", F.coalesce("canonical_id", "field_id")
    )
    every = [*(("INFO", a) for a in attributes), *(("FORMAT", a) for a in formats)]
    known = paths.sparkSession.createDataFrame(
        [(i, c, a.name, a.kind, a.arity) for i, (c, a) in enumerate(every)],
        "__i int, column_name string, canonical_id string, __kind string, __arity int",
    )
    cells = fenced(
        named.join(F.broadcast(known), ["column_name", "canonical_id"], "left"),
        __text=V.canonical(F.col("value"), F.col("__kind"), F.col("__arity")),
    )
    name = F.when(F.col("sample").isNull(), F.col("canonical_id")).otherwise(
        F.concat_ws("/", "column_name", "canonical_id", "sample")
    )
    cell = F.struct(name.alias("name"), F.coalesce("value", F.lit("")).alias("value"))

    def entries(cells: str) -> Column:
        keys = F.array_distinct(F.transform(cells, lambda c: c["name"]))
        return F.transform(keys, lambda k: F.struct(
            k.alias("name"), F.array_max(F.transform(F.filter(cells, lambda c: c["name"] == k), lambda c: c["value"])).alias("value")
        ))

    parts = cells.groupBy("file_id", entity, "sample").agg(
        *[F.max(F.when(F.col("__i") == i, F.col("__text"))).alias(f"__c{i}") for i in range(len(every))],
        F.collect_set(F.when(F.col("__i").isNull() & F.col("canonical_id").isNotNull(), cell)).alias("__others"),
        F.collect_set(F.when(
            F.col("__i").isNotNull() & F.col("__text").isNull() & ~V.is_missing(F.col("value")), cell
        )).alias("__failed"),
    ).withColumns({c: entries(c) for c in ("__others", "__failed")})
    of_info = range(len(attributes))
    of_format = range(len(attributes), len(every))
    wide = parts.groupBy("file_id", entity).agg(
        *[F.max(f"__c{i}").alias(f"__c{i}") for i in of_info],
        F.array_sort(F.collect_list(F.when(
            F.col("sample").isNotNull(), F.struct("sample", *[f"__c{i}" for i in of_format])
        ))).alias("__samples"),
        *[F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("__others", "__failed")],
    )

    def by_sample(i: int, attribute) -> Column:
        return F.transform("__samples", lambda s: typed_value(s[f"__c{i}"], attribute))

    return wide.select(
        "file_id", entity, *[_typed(f"__c{i}", a).alias(a.name) for i, a in zip(of_info, attributes)],
        *[by_sample(i, a).alias(f"FORMAT/{a.name}") for i, a in zip(of_format, formats)],
        F.map_from_entries("__others").alias("others"), F.map_from_entries("__failed").alias("failed_casts"),
    )
