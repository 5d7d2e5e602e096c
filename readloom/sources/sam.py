"""SAM text, read and written: fields in columns, spans from CIGAR, spliced parts and variations from CIGAR and MD."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

VARIATIONS = T.ArrayType(
    T.StructType(
        [T.StructField("from", T.StringType()), T.StructField("to", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("read_index", T.IntegerType())]
    )
)


def _ops(cigar: Column) -> Column:
    return F.arrays_zip(
        F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1)), lambda n: n.cast("int")).alias("n"),
        F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1)).alias("op"),
    )


def _length(cigar: Column, ops: str) -> Column:
    return F.aggregate(_ops(cigar), F.lit(0), lambda t, o: t + F.when(F.instr(F.lit(ops), o["op"]) > 0, o["n"]).otherwise(0))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Mapped records: names, flags, 0-based position, lengths, clips, MD and splice count."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("value not like '@%' and trim(value) <> ''").where(F.size(f) >= 11)
    md = F.filter(F.slice(f, 12, 1 << 20), lambda t: t.startswith("MD:Z:"))
    flag, cigar = f[1].cast("int"), f[5]
    return rows.select(
        f[0].alias("name"), flag.alias("flag"), f[2].alias("target"), (f[3].cast("int") - 1).alias("position"),
        f[4].cast("int").alias("mapping_quality"), cigar.alias("cigar"), F.when(f[6] == "=", f[2]).otherwise(F.nullif(f[6], F.lit("*"))).alias("mate_target"),
        (F.nullif(f[7].cast("int"), F.lit(0)) - 1).alias("mate_position"), f[8].cast("int").alias("insert_size"), f[9].alias("sequence"), f[10].alias("quality_text"),
        F.substr(F.get(md, 0), F.lit(6)).alias("md"), (flag.bitwiseAND(16) != 0).alias("reverse"),
        _length(cigar, "MDN=X").alias("target_length"), _length(cigar, "MI=X").alias("query_length"),
        _length(F.regexp_extract(cigar, r"^(\d+S)", 1), "S").alias("clip_left"), _length(F.regexp_extract(cigar, r"(\d+S)$", 1), "S").alias("clip_right"),
        F.size(F.filter(_ops(cigar), lambda o: o["op"] == "N")).alias("splices"),
    ).where((F.col("flag").bitwiseAND(4) == 0) & (F.col("cigar") != "*"))


ENTRIES = T.ArrayType(
    T.StructType(
        [
            T.StructField("fragment_index", T.IntegerType()), T.StructField("position", T.LongType()), T.StructField("target_length", T.IntegerType()),
            T.StructField("query_length", T.IntegerType()), T.StructField("query_position", T.IntegerType()), T.StructField("variations", VARIATIONS),
        ]
    )
)


def reference_of(md: str | None) -> list[str]:
    """The aligned reference as MD tells it: ``=`` where it equals the read, else its base."""
    out: list[str] = []
    for number, letters in re.findall(r"(\d+)|(\^?[A-Za-z]+)", md or ""):
        out += ["="] * int(number) if number else list(letters.lstrip("^"))
    return out


def entries_of(sequence: str, cigar: str, md: str | None, reverse: bool, start: int = 0) -> list[dict]:
    """The parts of a record between splices, each with its differences to the reference.

    A difference is (from, to, position in the part's span, read index from 1). A sequence of ``*``, or one that ends
    before the CIGAR does, shows no substitutions and no inserted bases (``N``) where it is unknown; ``=`` in it is the
    reference's base. Deleted bases that MD doesn't tell are ``N``.
    """
    sequence = "" if sequence == "*" else sequence
    reference, ops = reference_of(md), [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    n = max(len(sequence), sum(k for k, op in ops if op in "MIS=X"))
    index = lambda i: n - i if reverse else i + 1
    out: list[dict] = []
    read = ref = 0
    place, part = start, None
    for length, op in ops:
        if op in "MID=X" and part is None:
            part = {"fragment_index": len(out), "position": place, "target_length": 0, "query_length": 0, "query_position": read, "variations": []}
            out.append(part)
        if op in "M=X":
            for k in range(min(length, max(len(sequence) - read, 0))):
                base, to = reference[ref + k] if ref + k < len(reference) else "=", sequence[read + k]
                if base not in ("=", to) and to != "=":
                    part["variations"].append({"from": base, "to": to, "position": part["target_length"] + k, "read_index": index(read + k)})
            read, ref, place = read + length, ref + length, place + length
            part["target_length"] += length
            part["query_length"] += length
        elif op == "I":
            to = sequence[read : read + length].ljust(length, "N")
            part["variations"].append({"from": "-" * length, "to": to, "position": part["target_length"], "read_index": index(read)})
            read += length
            part["query_length"] += length
        elif op == "D":
            gone = "".join(reference[ref : ref + length]).ljust(length, "N")
            part["variations"].append({"from": gone, "to": "-" * length, "position": part["target_length"], "read_index": index(max(read - 1, 0))})
            ref, place = ref + length, place + length
            part["target_length"] += length
        elif op == "N":
            place, part = place + length, None
        elif op == "S":
            read += length
    return out


def variations_of(sequence: str, cigar: str, md: str | None, reverse: bool) -> list[dict]:
    """Differences of the whole record, positions counted from its start."""
    return [v | {"position": v["position"] + e["position"]} for e in entries_of(sequence, cigar, md, reverse) for v in e["variations"]]


@pandas_udf(VARIATIONS)
def variations(sequence: pd.Series, cigar: pd.Series, md: pd.Series, reverse: pd.Series) -> pd.Series:
    return pd.Series([variations_of(s or "", c or "", m, bool(r)) for s, c, m, r in zip(sequence, cigar, md, reverse)])


@pandas_udf(ENTRIES)
def _entries(sequence: pd.Series, cigar: pd.Series, md: pd.Series, reverse: pd.Series, position: pd.Series) -> pd.Series:
    return pd.Series([entries_of(s or "", c or "", m, bool(r), int(p)) for s, c, m, r, p in zip(sequence, cigar, md, reverse, position)])


def alignment_entries(records: DataFrame) -> DataFrame:
    """One row per spliced part of the records of ``read_sam``; other columns stay.

    ``fragment_index`` counts the parts of a record from 0, ``next_position`` and ``previous_position`` are those of
    the parts beside it (null at the ends), ``position`` and the lengths are the part's own.
    """
    kept = [c for c in records.columns if c not in ("position", "target_length", "query_length", "splices")]
    parts = records.withColumn("__e", _entries("sequence", "cigar", "md", "reverse", "position"))
    beside = lambda step: F.get("__e", F.col("__i") + step)["position"]
    return (
        parts.select(*kept, "__e", F.posexplode("__e").alias("__i", "__p"))
        .select(*kept, "__p.*", F.when(F.col("__i") > 0, beside(-1)).alias("previous_position"), beside(1).alias("next_position"))
    )


SAM_COLUMNS = ("name", "flag", "target", "position", "mapping_quality", "cigar", "mate_target", "mate_position", "insert_size", "sequence", "quality_text")


def sam_lines(records: DataFrame) -> DataFrame:
    """Records as SAM text lines (``value``), the inverse of ``read_sam``: positions from 1, ``*`` for what is unknown, MD as a tag."""
    def told(c: str, missing: str) -> Column:
        if c not in records.columns:
            return F.lit(missing)
        value = F.col(c) + 1 if c.endswith("position") else F.col(c)
        return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(missing))

    missing = {"flag": "0", "position": "0", "mapping_quality": "255", "mate_position": "0", "insert_size": "0"}
    fields = [told(c, missing.get(c, "*")) for c in SAM_COLUMNS]
    tags = F.when(F.col("md").isNotNull(), F.concat(F.lit("MD:Z:"), F.col("md"))) if "md" in records.columns else F.lit(None).cast("string")
    return records.select(F.concat_ws("\t", *fields, tags).alias("value"))


def write_sam(records: DataFrame, path: str, targets: DataFrame | None = None) -> None:
    """SAM text in part files; ``targets`` (``target, length``) gives the header, a part file of its own that sorts first."""
    sam_lines(records).write.mode("overwrite").text(path)
    if targets is not None:
        head = targets.orderBy("target").select(F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "target"), F.concat(F.lit("LN:"), F.col("length").cast("string"))).alias("value"))
        head.coalesce(1).write.mode("append").text(path)
