"""Text of reads and variant records, written and read again; covariates, pairwise alignment blocks, coverage archives."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions import sequence as S
from readloom.session import checkpoint_folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all machines share."""
    return os.path.join(checkpoint_folder(spark), f"{name}-{uuid.uuid4().hex}")


def fastq_lines(reads: DataFrame, header: Column, sequence: Column, scores: Column, encoding: str = "sanger") -> DataFrame:
    """``value`` of four lines a read; a read without scores has the greatest one throughout, more scores than bases are cut."""
    text = F.coalesce(sequence, F.lit(""))
    n = F.length(text)
    full = F.coalesce(scores, F.array().cast("array<tinyint>"))
    padded = F.slice(F.concat(full, F.array_repeat(F.lit(40).cast("tinyint"), F.greatest(n - F.size(full), F.lit(0)))), F.lit(1), n)
    return reads.select(F.concat_ws("\n", F.concat(F.lit("@"), F.coalesce(header, F.lit(""))), text, F.lit("+"), S.encode_quality(padded, encoding)).alias("value"))


def fasta_lines(rows: DataFrame, header: Column, sequence: Column, width: int = 0) -> DataFrame:
    """``value`` of a header and the sequence, on lines of ``width`` letters if told."""
    text = F.coalesce(sequence, F.lit(""))
    if width:
        text = F.regexp_replace(F.regexp_replace(text, f"(.{{{width}}})", "$1\n"), r"\n\z", "")
    return rows.select(F.concat_ws("\n", F.concat(F.lit(">"), F.coalesce(header, F.lit(""))), text).alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def _meta(kind: str, name: str, number: str, type_: str, about: str) -> str:
    escaped = about.replace("\\", "\\\\").replace('"', '\\"')
    return f'##{kind}=<ID={name},Number={number},Type={type_},Description="{escaped}">'


class VcfHeader:
    """What a variant file declares: INFO and FORMAT fields (name, number, type, description) and samples."""

    def __init__(self, samples: Sequence[str] = ()):
        self.samples = list(samples)
        self.fields: list[tuple[str, str, str, str, str]] = []

    def declare(self, kind: str, name: str, number: str | int, type_: str, about: str) -> VcfHeader:
        """Declare a field of ``INFO`` or ``FORMAT``; a name declared twice is an error."""
        if kind not in ("INFO", "FORMAT"):
            raise ValueError(f"no column {kind!r} to declare fields of")
        if any(f[:2] == (kind, name) for f in self.fields):
            raise ValueError(f"{kind} field {name!r} is declared already")
        self.fields.append((kind, name, str(number), type_, about))
        return self

    def lines(self) -> list[str]:
        columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
        if self.samples:
            columns += ["FORMAT", *self.samples]
        return ["##fileformat=VCFv4.1", *[_meta(*f) for f in self.fields], "\t".join(columns)]


def info_text(entries: Sequence[tuple[str, Column]]) -> Column:
    """``ID=value`` entries joined by ``;``: nulls are left out, booleans are flags, arrays are joined by commas, nothing is ``.``."""
    parts = [
        F.when(value.isNotNull(), F.concat(F.lit(f"{name}="), value.cast("string"))) for name, value in entries
    ]
    return F.coalesce(F.nullif(F.concat_ws(";", *parts), F.lit("")), F.lit("."))


def flag_text(name: str, value: Column) -> Column:
    """A flag by name if it is set, else null."""
    return F.when(F.coalesce(value, F.lit(False)), F.lit(name))


def vcf_lines(records: DataFrame, header: VcfHeader) -> DataFrame:
    """``value`` of the records: ``chrom, pos, ref`` and, where there are such columns, ``id, alt`` (array or text), ``qual, filter``
    (array or text), ``info`` (text or map), ``format`` (array or text) and ``samples`` (an array in the header's order). What is unknown is ``.``."""
    kinds = {f.name: f.dataType for f in records.schema.fields}

    def told(c: str, sep: str, default: str = ".") -> Column:
        if c not in kinds:
            return F.lit(default)
        value = F.col(c)
        if isinstance(kinds[c], T.MapType):
            entry = F.transform(F.array_sort(F.map_entries(value)), lambda e: F.when(e["value"] == "true", e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"])))
            value = F.array_join(entry, sep)
        elif isinstance(kinds[c], T.ArrayType):
            value = F.array_join(value, sep)
        return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(default))

    qual = F.col("qual") if "qual" in kinds else F.lit(None).cast("double")
    number = F.when(qual == F.floor(qual), qual.cast("long").cast("string")).otherwise(qual.cast("string"))
    columns = [told("chrom", ""), told("pos", ""), told("id", ";"), told("ref", ""), told("alt", ","), F.coalesce(number, F.lit(".")), told("filter", ";"), told("info", ";")]
    if header.samples:
        columns += [told("format", ":"), F.array_join(F.transform("samples", lambda s: F.coalesce(s, F.lit("."))), "\t")]
    return records.select(F.concat_ws("\t", *columns).alias("value"))


def write_vcf(records: DataFrame, header: VcfHeader, path: str, ordered: bool = True) -> None:
    """A folder of text parts in order of place: the header is a part of its own that sorts first, the records follow by ranges."""
    rows = records.orderBy("chrom", "pos") if ordered else records
    lines = vcf_lines(rows, header)
    lines.write.mode("overwrite").text(path)
    spark = records.sparkSession
    # Part files are read in order of their names; the header's is before all.
    spark.createDataFrame([(line,) for line in header.lines()], "value string").coalesce(1).write.mode("append").text(path)


def read_covariates(spark: SparkSession, path: str) -> DataFrame:
    """A row per sample with a column per covariate of a tab-delimited file; ``N/A`` and nothing are null."""
    rows = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).csv(path)
    trimmed = lambda c: F.trim(F.col(f"`{c}`"))
    return rows.select(*[F.when(~trimmed(c).isin("N/A", ""), trimmed(c)).alias(c.strip()) for c in rows.columns])


def covariate_values(covariates: DataFrame, sample: str, name: str) -> DataFrame:
    """``sample, value``: values of a covariate, several ones are separated by ``|``."""
    return covariates.select(F.col(f"`{sample}`").alias("sample"), F.explode(F.split(F.col(f"`{name}`"), "[|]")).alias("value"))


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """``score, target, target_start, target_length, target_strand, target_size, target_bases`` and the same of ``query`` for each
    block of two aligned sequences. Blocks are paragraphs; those without a score or without two sequences are left out."""
    blocks = spark.read.text(path, lineSep="\n\n").select(F.split("value", "\n").alias("lines"))
    score = F.regexp_extract(F.get(F.filter("lines", lambda x: x.startswith("a ")), 0), r"score=([-0-9.eE+]+)", 1).try_cast("double")
    sequences = F.transform(F.filter("lines", lambda x: x.startswith("s ")), lambda x: F.split(F.trim(x), r"\s+"))
    rows = blocks.select(score.alias("score"), sequences.alias("s")).where("score is not null and size(s) >= 2")

    def side(k: int, name: str) -> list[Column]:
        s = F.col("s")[k]
        return [
            s[1].alias(name), s[2].cast("long").alias(f"{name}_start"), s[3].cast("long").alias(f"{name}_length"), s[4].alias(f"{name}_strand"),
            s[5].cast("long").alias(f"{name}_size"), s[6].alias(f"{name}_bases"),
        ]

    return rows.where("size(s[0]) >= 7 and size(s[1]) >= 7").select("score", *side(0, "target"), *side(1, "query"))


def maf_variations(bases: Column, other: Column) -> Column:
    """Places (from 1 in the alignment) at which two aligned sequences differ, with both bases."""
    places = F.sequence(F.lit(1), F.greatest(F.length(bases), F.lit(1)))
    at = lambda s, i: F.upper(F.substr(s, i, F.lit(1)))
    rows = F.transform(places, lambda i: F.struct(i.alias("place"), at(bases, i).alias("from"), at(other, i).alias("to")))
    return F.filter(rows, lambda r: r["from"] != r["to"])


def without_matching(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines of a source but those in which a pattern is found, before anything is parsed."""
    return lines.where(~F.coalesce(F.col("value").rlike(pattern), F.lit(False)))


def write_archive(runs: DataFrame, path: str, name: str = "coverage") -> None:
    """Runs of coverage by target, one folder for each, in order of position: a target is read without the others."""
    runs.repartition("target").sortWithinPartitions("target", "position").withColumn("name", F.lit(name)).write.mode("overwrite").partitionBy("name", "target").parquet(path)


def read_archive(spark: SparkSession, path: str, name: str = "coverage", targets: Sequence | None = None) -> DataFrame:
    runs = spark.read.parquet(path).where(F.col("name") == name)
    chosen = runs if targets is None else runs.where(F.col("target").isin(list(targets)))
    return chosen.select("target", "position", "length", "depth")


def archive_totals(spark: SparkSession, path: str, name: str = "coverage") -> DataFrame:
    """``target, bases, sites``: what an archive holds of each target."""
    return read_archive(spark, path, name).groupBy("target").agg(F.sum(F.col("depth") * F.col("length")).alias("bases"), F.sum(F.when(F.col("depth") > 0, F.col("length")).otherwise(0)).alias("sites"))
