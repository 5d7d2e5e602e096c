"""Queries over attribute rows, drifting headers, broken lines and packed fields, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import values as V
from readloom.operators import badrows, drift, eav, packed


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _attributes(spark: SparkSession, folder: str, column: str) -> list[eav.Attribute]:
    return eav.declared_attributes(table(spark, folder, "column_fields").where(F.col("column_name") == column))


def _info_wide(spark: SparkSession, folder: str, typed: bool) -> DataFrame:
    return eav.pivot_attributes(
        table(spark, folder, "info_rows"), _attributes(spark, folder, "INFO"),
        "site_id", "attribute", "info_value", ("loaded_at", "row_id"), "INFO/", typed,
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return eav.filled_cells(_info_wide(spark, folder, typed=False), "site_id")


def p1_wide(spark: SparkSession, folder: str) -> DataFrame:
    return _info_wide(spark, folder, typed=True)


def p1_attributes(spark: SparkSession, folder: str) -> DataFrame:
    return eav.discover_attributes(table(spark, folder, "info_rows"), "attribute", "info_value", "INFO/")


def _fields(spark: SparkSession, folder: str) -> DataFrame:
    return drift.declared_fields(table(spark, folder, "vcf_headers"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.field_changes(_fields(spark, folder), drift.file_pairs(table(spark, folder, "vcf_files")))


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    """INFO and FORMAT of all records as paths and raw values, those of FORMAT once for each sample (from 1).

    The values of a sample stand in the order of the FORMAT items; values without an item are
    named by their position, ``#1`` and so on, items without a value are null.
    """
    records = table(spark, folder, "vcf_records").select(F.struct("file_id", "record_id").alias("id"), "info", "format", "samples")
    entries = packed.unpack(records, "id", {c: packed.VCF_PACKINGS[c] for c in ("info", "format")})
    split = F.split("item", "=", 2)
    info = entries.where("column_name = 'info'").select(
        "id.file_id", "id.record_id", F.lit("INFO").alias("column_name"), F.lit(None).cast("int").alias("sample"),
        F.btrim(split[0]).alias("field_id"), F.get(split, 1).alias("value"),
    )
    # Union and aggregation instead of a join: records without FORMAT or with null ids stay.
    named = (
        entries.where("column_name = 'format'").select("id", F.struct("item_pos", "item").alias("item"))
        .unionByName(records.select("id", "samples"), allowMissingColumns=True)
        .groupBy("id").agg(F.array_sort(F.collect_list("item"))["item"].alias("items"), F.max("samples").alias("samples"))
        .select("id", "items", F.posexplode("samples").alias("sample", "values"))
        .withColumn("values", F.coalesce(F.split("values", ":", -1), F.array().cast("array<string>")))
    )
    position = F.sequence(F.lit(0), F.greatest(F.size("items"), F.size("values")) - 1)
    values = named.where("size(items) > 0 or size(values) > 0").withColumn("at", F.explode(position))
    return info.unionByName(values.select(
        "id.file_id", "id.record_id", F.lit("FORMAT").alias("column_name"), (F.col("sample") + 1).alias("sample"),
        F.coalesce(F.get("items", F.col("at")), F.concat(F.lit("#"), F.col("at") + 1)).alias("field_id"),
        V.trimmed(F.get("values", F.col("at"))).alias("value"),
    ))


def p2_types(spark: SparkSession, folder: str) -> DataFrame:
    return drift.path_type_statistics(drift.path_statistics(drift.declaration_paths(table(spark, folder, "vcf_headers")), _paths(spark, folder)))


def p2_table(spark: SparkSession, folder: str) -> DataFrame:
    ids = drift.canonical_ids(_fields(spark, folder), table(spark, folder, "column_fields"))
    return drift.project_typed(
        _paths(spark, folder), ids, _attributes(spark, folder, "INFO"),
        records=table(spark, folder, "vcf_records"), formats=_attributes(spark, folder, "FORMAT"),
    )


LINE_TABLES = ("tsv_with_header_spaces", "no_format")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    declared = table(spark, folder, "tsv_columns")
    parts = [
        badrows.failing_lines(
            badrows.classify_lines(table(spark, folder, t).select("line_id", "c0"), badrows.read_columns(declared, t))
        ).select(F.lit(t).alias("table_name"), "line_id", "reason")
        for t in LINE_TABLES
    ]
    return parts[0].unionByName(parts[1])


def _typed_lines(name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        columns = badrows.read_columns(table(spark, folder, "tsv_columns"), name)
        return badrows.typed_rows(badrows.classify_lines(table(spark, folder, name), columns), columns, ["line_id"])

    return query


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return packed.unpack(table(spark, folder, "vcf_records"), "record_id", packed.VCF_PACKINGS)


QUERIES = {
    "p1_found": p1_found,
    "p1_wide": p1_wide,
    "p1_attributes": p1_attributes,
    "p2_found": p2_found,
    "p2_types": p2_types,
    "p2_table": p2_table,
    "p4_found": p4_found,
    "p4_rows_spaces": _typed_lines("tsv_with_header_spaces"),
    "p4_rows_plain": _typed_lines("no_format"),
    "p6_found": p6_found,
}
