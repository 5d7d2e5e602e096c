"""Attribute-value rows into one wide row per entity."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import values as V
from readloom.operators.fences import fenced


class Attribute(NamedTuple):
    """A declared attribute: its column name, type and number of list members (0 and 1: none)."""

    name: str
    kind: str
    arity: int = 1


def attribute_key(attribute: Column, prefix: str = "") -> Column:
    """The spelling under which attributes are compared: trimmed, lower case, no ``prefix``."""
    low = F.lower(V.trimmed(attribute))
    if prefix:
        low = F.when(low.startswith(prefix.lower()), F.substr(low, F.lit(len(prefix) + 1))).otherwise(low)
    return V.trimmed(low)


def discover_attributes(
    rows: DataFrame, attribute: str = "attribute", value: str = "value", prefix: str = ""
) -> DataFrame:
    """Every attribute that occurs, with what its values look like.

    One row per spelling-free attribute: ``attribute_key``, ``n_rows``, ``n_missing``,
    ``n_integer``, ``n_float``, ``n_flag``, ``n_list`` (with a comma) and ``inferred_type``,
    the narrowest type that holds all values that are not missing. Null attributes form
    the row whose key is null; an empty table gives no rows.
    """
    v = F.col("__value")
    told = ~V.is_missing(v)
    flag = V.canonical_flag(v).isNotNull()
    integer, number = V.is_integer(v) & told, V.is_float(v) & told
    counted = (
        rows.select(attribute_key(F.col(attribute), prefix).alias("attribute_key"), F.col(value).alias("__value"))
        .groupBy("attribute_key")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(~told).alias("n_missing"),
            F.count_if(integer).alias("n_integer"),
            F.count_if(number).alias("n_float"),
            F.count_if(flag).alias("n_flag"),
            F.count_if(told & v.contains(",")).alias("n_list"),
        )
    )
    n = F.col("n_rows") - F.col("n_missing")
    return counted.withColumn(
        "inferred_type",
        F.when(n == 0, "Flag")
        .when(F.col("n_integer") == n, "Integer")
        .when(F.col("n_float") == n, "Float")
        .when(F.col("n_flag") == F.col("n_rows"), "Flag")
        .otherwise("String"),
    )


def declared_attributes(
    fields: DataFrame,
    name: str = "field_id",
    kind: str = "type",
    arity: str = "number_of_values",
    max_attributes: int = 5000,
) -> list[Attribute]:
    """Read a table of declarations; more than ``max_attributes`` of them is an error, not a cut."""
    found = (
        fields.select(F.col(name).alias("n"), F.col(kind).alias("k"), F.col(arity).cast("int").alias("a"))
        .where(F.col("n").isNotNull() & F.col("k").isNotNull())
        .limit(max_attributes + 1)
        .collect()
    )
    if len(found) > max_attributes:
        raise ValueError(f"more than {max_attributes} attributes are declared")
    unique = {row.n.strip().lower(): Attribute(row.n.strip(), row.k, row.a or 0) for row in sorted(found, reverse=True)}
    return sorted(unique.values())


def typed_value(text: Column, attribute: Attribute) -> Column:
    """Canonical text under the type of its attribute."""
    kind = attribute.kind.strip().lower()
    if kind == "flag":
        return text == "true"
    cast = {
        "integer": lambda part: part.try_cast("bigint"),
        "float": V.to_double,
        "character": lambda part: part,
        "string": lambda part: part,
    }[kind]
    return F.transform(F.split(text, ",", -1), cast) if attribute.arity > 1 else cast(text)


def _typed(name: str, attribute: Attribute) -> Column:
    return typed_value(F.col(f"`{name}`"), attribute)


def _may_fill(seen, attribute: Attribute) -> bool:
    """Whether an attribute with the type counts of ``discover_attributes`` can hold a value of the declared type."""
    told = seen.n_rows - seen.n_missing
    if attribute.kind.strip().lower() == "flag":
        return seen.n_flag > 0
    if attribute.arity > 1:
        return seen.n_list > 0
    return {"integer": seen.n_integer, "float": seen.n_float}.get(attribute.kind.strip().lower(), told) > 0


def pivot_attributes(
    rows: DataFrame,
    attributes: Sequence[Attribute] | None,
    entity: str = "entity_id",
    attribute: str = "attribute",
    value: str = "value",
    newest: Sequence[str] = ("loaded_at",),
    prefix: str = "",
    typed: bool = True,
    max_attributes: int = 5000,
) -> DataFrame:
    """One row per entity, one column per declared attribute.

    Attributes and types are found first: of those that are declared (``attributes``) the ones with
    values that look like the declared type, or, if None, all of them with their inferred types (more than
    ``max_attributes`` is an error). An attribute without such values is an empty column. Each column is then one conditional aggregation: of the valid values for a
    cell the greatest by the columns ``newest`` counts (nulls count as oldest; remaining
    ties go to the greater text), exact repeats change nothing, missing and invalid values
    fill nothing. With ``typed`` columns have their types (lists are arrays; integers beyond
    64 bits become null and are named in ``uncast``), otherwise canonical text.

    Rows without entity form no entity and are left out; entities without any valid cell
    keep their row. Extra columns of ``rows`` are ignored. The aggregation combines before
    the shuffle, so an entity with most of the rows costs one row a task.
    """
    keyed = rows.select(
        F.col(entity).alias("__entity"),
        attribute_key(F.col(attribute), prefix).alias("__key"),
        F.col(value).alias("__value"),
        F.struct(*[F.col(c) for c in newest]).alias("__order"),
    ).where(F.col("__entity").isNotNull())
    seen = discover_attributes(rows, attribute, value, prefix).where("attribute_key is not null and attribute_key <> ''")
    if attributes is None:
        found = seen.select("attribute_key", "inferred_type").limit(max_attributes + 1).collect()
        if len(found) > max_attributes:
            raise ValueError(f"the rows hold more than {max_attributes} attributes")
        attributes = sorted(Attribute(r.attribute_key, r.inferred_type, int(r.inferred_type != "Flag")) for r in found)
        present = {a.name for a in attributes}
    else:
        names = [a.name.lower() for a in attributes]
        found = {r.attribute_key: r for r in seen.where(F.col("attribute_key").isin(names)).collect()}
        present = {a.name.lower() for a in attributes if a.name.lower() in found and _may_fill(found[a.name.lower()], a)}
    spark = rows.sparkSession
    known = spark.createDataFrame(
        [(i, a.name.lower(), a.kind, a.arity) for i, a in enumerate(attributes) if a.name.lower() in present],
        "__i int, __key string, __kind string, __arity int",
    )
    cells = fenced(
        keyed.join(F.broadcast(known), "__key", "left"),
        __text=V.canonical(F.col("__value"), F.col("__kind"), F.col("__arity")),
    )
    best = F.struct("__order", "__text")
    filled = F.col("__text").isNotNull()
    wide = cells.groupBy("__entity").agg(
        *[
            (F.max(F.when((F.col("__i") == i) & filled, best)).getField("__text") if a.name.lower() in present
             else F.max(F.lit(None).cast("string"))).alias(f"__c{i}")
            for i, a in enumerate(attributes)
        ],
        F.count(F.lit(1)).alias("__n"),
    )
    if not typed:
        return wide.select(
            F.col("__entity").alias(entity), *[F.col(f"__c{i}").alias(a.name) for i, a in enumerate(attributes)]
        )
    columns = [_typed(f"__c{i}", a).alias(a.name) for i, a in enumerate(attributes)]
    lost = F.filter(
        F.array(*[
            F.when(F.exists(F.split(f"__c{i}", ",", -1), lambda p: p.try_cast("bigint").isNull()), F.lit(a.name))
            for i, a in enumerate(attributes) if a.kind.strip().lower() == "integer"
        ]).cast("array<string>"),
        lambda name: name.isNotNull(),
    )
    return wide.select(F.col("__entity").alias(entity), *columns, lost.alias("uncast"))


def filled_cells(
    wide: DataFrame, entity: str, attribute: str = "field_id", value: str = "field_value"
) -> DataFrame:
    """The cells of an untyped wide table that hold something, as rows."""
    names = [c for c in wide.columns if c != entity]
    cells = F.array(*[F.struct(F.lit(c).alias("a"), F.col(f"`{c}`").alias("v")) for c in names])
    return (
        wide.select(F.col(entity), F.inline(F.filter(cells, lambda cell: cell["v"].isNotNull())))
        .toDF(entity, attribute, value)
    )
