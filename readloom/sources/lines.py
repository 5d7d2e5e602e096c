"""Text files by line: numbered lines, FASTA and FASTQ records, annotations, variant files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.session import cut_lineage


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, value`` from 0, for files of any size: splits are counted, then summed up.

    Lines of one split have consecutive ids; the numbers of lines of the splits before give
    the rest.
    """
    lines = cut_lineage(
        spark.read.text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
            F.monotonically_increasing_id().alias("id"), F.col("value"),
        )
    )
    splits = lines.groupBy("file", "at").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "at", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(starts, ["file", "at"]).select("file", (F.col("id") - F.col("first") + F.col("before")).alias("line_no"), "value")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``header, description, sequence`` of FASTA records, split at ``>`` that begins a line."""
    records = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", r"^\s*>", "").alias("r"))
    header = F.regexp_replace(F.split("r", "\n", 2)[0], r"\r$", "")
    rest = F.coalesce(F.get(F.split("r", "\n", 2), 1), F.lit(""))
    return records.where("trim(r) <> '' and r not like ';%'").select(
        F.split(header, r"\s", 2)[0].alias("header"), F.get(F.split(header, r"\s", 2), 1).alias("description"),
        F.regexp_replace(rest, r"\s", "").alias("sequence"),
    )


def read_fasta_blocks(spark: SparkSession, path: str, size: int = 4096) -> DataFrame:
    """``target, block, bases`` of FASTA files: blocks of equal length, put together from lines.

    No task holds more than the lines of a block; the name is the header's first word. Comments (``;``) and blank lines are no bases.
    """
    from readloom.operators.prefix import running

    told = numbered_lines(spark, path).select("file", "line_no", F.regexp_replace("value", r"\s+$", "").alias("v")).where("v <> '' and v not like ';%'")
    head = F.col("v").startswith(">")
    marked = told.withColumns({"__head": head.cast("long"), "__n": F.when(head, 0).otherwise(F.length("v"))})
    placed = cut_lineage(running(marked, ["file"], "line_no", {"record": ("sum", "__head"), "upto": ("sum", "__n")}))
    starts = placed.where("__head = 1").select("file", "record", F.split(F.substr("v", F.lit(2)), r"\s", 2)[0].alias("target"), F.col("upto").alias("base"))
    lines = placed.where("__head = 0").join(starts, ["file", "record"]).withColumn("at", F.col("upto") - F.col("base") - F.col("__n"))
    block = F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("__n") - 1) / size)))
    cut = lines.withColumn("block", block)
    first, last = F.greatest(F.col("block") * size - F.col("at"), F.lit(0)), F.least((F.col("block") + 1) * size - F.col("at"), F.col("__n"))
    pieces = cut.select("target", "block", F.struct("at", F.substr("v", (first + 1).cast("int"), (last - first).cast("int")).alias("p")).alias("piece"))
    return pieces.groupBy("target", "block").agg(F.array_join(F.array_sort(F.collect_list("piece"))["p"], "").alias("bases"))


_SKIPPED = ("#", ";")


def _between(value: str) -> bool:
    """Blank lines and comments, which may stand before a record."""
    return not value.strip() or value.startswith(_SKIPPED)


def _split_states(batches):
    """Per split of a file: for each of the four states at its start, the state at its end and the records begun.

    State 0 waits for a record, where blank lines and comments are skipped; states 1 to 3 take the next
    line whatever it is.
    """
    import pyarrow as pa

    here, state, begun, rows = None, [], [], []
    for batch in batches:
        for file, at, value in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (file, at) != here:
                if here is not None:
                    rows.append((*here, state, begun))
                here, state, begun = (file, at), [0, 1, 2, 3], [0, 0, 0, 0]
            skip = _between(value)
            for k in range(4):
                if state[k]:
                    state[k] = (state[k] + 1) % 4
                elif not skip:
                    state[k], begun[k] = 1, begun[k] + 1
    if here is not None:
        rows.append((*here, state, begun))
    kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
    columns = zip(*rows) if rows else ((),) * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "at", "ends", "begun"])


def _split_records(batches):
    """Rows of four parts by record; a split's first and last may be pieces."""
    import pyarrow as pa

    here, state, index, record = None, 0, 0, [None] * 4

    def out(rows):
        names = ["file", "read_index", "h", "s", "plus", "q"]
        kinds = (pa.string(), pa.int64(), *(pa.string(),) * 4)
        columns = zip(*rows) if rows else ((),) * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        rows = []
        for file, at, value, first, before in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if (file, at) != here:
                if any(v is not None for v in record):
                    rows.append((here[0], index, *record))
                here, state, index, record = (file, at), first, before - 1, [None] * 4
            if state == 0:
                if _between(value):
                    continue
                index += 1
            record[state] = value
            state = (state + 1) % 4
            if state == 0:
                rows.append((file, index, *record))
                record = [None] * 4
        yield out(rows)
    if any(v is not None for v in record):
        yield out([(here[0], index, *record)])


def _wrapped_records(batches):
    """Records whose sequence and qualities take several lines, file by file in order."""
    import pyarrow as pa

    here, index, head, sequence, plus, quality = None, -1, None, "", None, ""
    rows = []

    def close():
        nonlocal head, sequence, plus, quality
        if head is not None:
            rows.append((here, index, head, sequence, plus, quality))
        head, sequence, plus, quality = None, "", None, ""

    def out():
        kinds = (pa.string(), pa.int64(), *(pa.string(),) * 4)
        columns = zip(*rows) if rows else ((),) * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "read_index", "h", "s", "plus", "q"])

    for batch in batches:
        for file, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if file != here:
                close()
                here, index = file, -1
            value = value.rstrip("\r")
            if head is None:
                if not _between(value):
                    head, index = value, index + 1
            elif plus is None:
                if value.startswith("+"):
                    plus = value
                else:
                    sequence += value.strip()
            else:
                quality += value
                if len(quality) >= len(sequence):
                    close()
        yield out()
        rows.clear()
    close()
    yield out()


def read_fastq(spark: SparkSession, path: str, wrapped: bool = False) -> DataFrame:
    """``file, read_index, header, sequence, quality_text, complete`` of FASTQ records, numbered from 0 by file.

    Comments (``#``, ``;``) and blank lines are skipped between records only: a quality line may begin with ``#``,
    and a read may be blank. Records whose parts don't fit (no ``@`` or ``+``, other length of
    qualities, cut off) have ``complete`` false. Line ends may have a CR; an empty file gives no rows.

    Records have four lines. Splits of a file are read apart: what a split does to each of the four
    states it may begin in is composed over the splits of the file (one row a split), then each
    is read from its state. With ``wrapped`` sequences and qualities may take several lines; a file is
    then read in order by one task, in a stream.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), "value"
    )
    schema = "file string, read_index long, h string, s string, plus string, q string"
    if wrapped:
        ordered = lines.repartition("file").sortWithinPartitions("file", "at", "id").select("file", "value")
        records = ordered.mapInArrow(_wrapped_records, schema)
    else:
        states = cut_lineage(lines.select("file", "at", "value").mapInArrow(_split_states, "file string, at long, ends array<int>, begun array<long>"))
        start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<at:long,state:int,before:long>>").alias("told"))
        step = lambda acc, x: F.struct(
            F.get(x["ends"], acc["state"]).alias("state"), (acc["n"] + F.get(x["begun"], acc["state"])).alias("n"),
            F.concat(acc["told"], F.array(F.struct(x["at"].alias("at"), acc["state"].alias("state"), acc["n"].alias("before")))).alias("told"),
        )
        starts = states.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "ends", "begun"))).alias("x")).select(
            "file", F.inline(F.aggregate("x", start, step)["told"])
        )
        placed = lines.join(F.broadcast(starts) if states.count() <= 200_000 else starts, ["file", "at"])
        # A broadcast join keeps the order of lines; beyond its bound they are ordered again.
        if states.count() > 200_000:
            placed = placed.repartition("file", "at").sortWithinPartitions("file", "at", "id")
        pieces = cut_lineage(placed.select("file", "at", "value", "state", "before").mapInArrow(_split_records, schema))
        whole = F.col("h").isNotNull() & F.col("s").isNotNull() & F.col("plus").isNotNull() & F.col("q").isNotNull()
        joined = pieces.where(~whole).groupBy("file", "read_index").agg(*[F.max(c).alias(c) for c in ("h", "s", "plus", "q")])
        records = pieces.where(whole).unionByName(joined)
    clean = records.select("file", "read_index", *[F.regexp_replace(c, r"\r\z", "").alias(c) for c in ("h", "s", "plus", "q")])
    fits = F.col("h").startswith("@") & F.col("plus").startswith("+") & (F.length("s") == F.length("q"))
    return clean.select(
        "file", "read_index", F.substr("h", F.lit(2)).alias("header"), F.col("s").alias("sequence"), F.col("q").alias("quality_text"),
        F.coalesce(fits, F.lit(False)).alias("complete"),
    )


def read_annotations(spark: SparkSession, path: str, line_sep: str | None = None, failing: bool = False) -> DataFrame:
    """Segments of six-column files: ``chrom, strand, annotation_id, segment_id, start, end``.

    Lines with fewer columns or a start or end that is no integer are no segments; with ``failing`` these come
    out instead, as ``line, reason`` (``column_count`` or ``invalid_value``). Blank lines, comments and a header are neither.
    """
    lines = spark.read.text(path, lineSep=line_sep) if line_sep else spark.read.text(path)
    f = F.split(F.regexp_replace("value", r"\r\z", ""), "\t")
    header = F.lower(F.get(f, 4)).contains("start") & F.get(f, 4).try_cast("int").isNull()
    data = lines.where("value not like '#%' and trim(value) <> ''").where(~F.coalesce(header, F.lit(False)))
    start, end = F.get(f, 4).try_cast("int"), F.get(f, 5).try_cast("int")
    reason = F.when(F.size(f) < 6, "column_count").when(start.isNull() | end.isNull(), "invalid_value")
    if failing:
        return data.where(reason.isNotNull()).select(F.col("value").alias("line"), reason.alias("reason"))
    return data.where(reason.isNull()).select(
        f[0].alias("chrom"), f[1].alias("strand"), f[2].alias("annotation_id"), f[3].alias("segment_id"), start.alias("start"), end.alias("end")
    )


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header lines and records (INFO as map, samples as strings by position) of variant files."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\r$", "").alias("line"))
    f = F.split("line", "\t")
    entries = F.transform(F.array_distinct(F.transform(F.split(F.get(f, 7), ";"), lambda e: F.split(e, "=", 2)[0])), lambda k: k)
    value = lambda k: F.coalesce(F.get(F.split(F.filter(F.split(F.get(f, 7), ";"), lambda e: F.split(e, "=", 2)[0] == k)[0], "=", 2), 1), F.lit("true"))
    records = lines.where("line not like '#%' and trim(line) <> ''").select(
        "file", f[0].alias("chrom"), F.get(f, 1).try_cast("long").alias("pos"), F.get(f, 2).alias("id"), F.get(f, 3).alias("ref"),
        F.split(F.get(f, 4), ",").alias("alt"), F.get(f, 5).try_cast("double").alias("qual"), F.split(F.get(f, 6), ";").alias("filter"),
        F.map_from_arrays(entries, F.transform(entries, value)).alias("info"), F.split(F.get(f, 8), ":").alias("format"),
        F.slice(f, 10, 1 << 20).alias("samples"),
    )
    return lines.where("line like '#%'"), records


def write_lines(df: DataFrame, path: str, columns: list[str], header: str | None = None, sep: str = "\t") -> None:
    """Delimited text with nulls as nothing; every part file with rows begins with the header, if any."""
    row = F.array_join(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]), sep)
    out = df.select(row.alias("value"))
    if header is not None:
        def lead(batches):
            import pyarrow as pa

            for i, batch in enumerate(batches):
                if i == 0:
                    kind = batch.schema.field(0).type
                    yield pa.RecordBatch.from_arrays([pa.array([header], kind)], schema=batch.schema)
                yield batch

        out = out.mapInArrow(lead, "value string")
    out.write.mode("overwrite").text(path)


def bed_graph(runs: DataFrame) -> DataFrame:
    """Coverage runs as bedGraph columns, positions from 1."""
    return runs.where("depth <> 0").select("target", (F.col("position") + 1).alias("start"), (F.col("position") + 1 + F.col("length")).alias("end"), "depth")


def wiggle(runs: DataFrame, resolution: int) -> DataFrame:
    """``target, start, average``: mean depth in windows of fixed size, aligned to multiples of it."""
    b = F.explode(F.sequence(F.floor(F.col("position") / resolution), F.floor((F.col("position") + F.col("length") - 1) / resolution)))
    cut = runs.where("depth <> 0").withColumn("b", b)
    inside = F.least(F.col("position") + F.col("length"), (F.col("b") + 1) * resolution) - F.greatest("position", F.col("b") * resolution)
    return (
        cut.groupBy("target", "b").agg((F.sum(F.col("depth") * inside) / resolution).alias("average"))
        .select("target", (F.col("b") * resolution + 1).alias("start"), "average")
    )
