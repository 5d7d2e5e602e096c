"""Counts by annotated element, formulas that combine them, pairs of samples, wide results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.intervals import range_join
from readloom.operators.prefix import running
from readloom.session import cut_lineage

# Intercept, slope of log(raw), slope of the log ratio of weighted to raw, and what is added first.
FORMULAS = {
    "FORMULA2": (-1.57361718748031, 1.0, -3.62887641327823, 0.0),
    "FORMULA3": (-0.843924877396631, 0.887303234304011, -3.45874660923795, 1.0),
    "FORMULA4": (-1.4050204825287, 1.0, -3.5820783386146, 0.0),
}


def combine_by_formula(raw: Column, weighted: Column, name: str = "FORMULA2") -> Column:
    """A corrected count; raw 0 stays 0, and without weight the raw count stays."""
    intercept, slope, ratio, add = FORMULAS[name]
    log_raw = F.log(raw + add)
    value = F.exp(intercept + slope * log_raw + ratio * (F.log(weighted + add) - log_raw))
    return F.when(raw == 0, 0.0).when(weighted == 0, raw.cast("double")).otherwise(F.greatest(value, F.lit(0.0)))


def introns(segments: DataFrame) -> DataFrame:
    """Gaps between the segments of each annotation: ``target, annotation_id, start, end``."""
    order = Window.partitionBy("target", "annotation_id").orderBy(F.col("start").asc_nulls_last(), "end").rowsBetween(Window.unboundedPreceding, -1)
    gaps = segments.withColumn("__upto", F.max("end").over(order)).where(F.col("start") > F.col("__upto"))
    return gaps.select("target", "annotation_id", F.col("__upto").alias("start"), F.col("start").alias("end"))


def gene_counts(reads: DataFrame, segments: DataFrame, width: int, block: int = 1 << 16, most_broadcast: int = 1 << 17) -> DataFrame:
    """``target, annotation_id, n``: reads that overlap a gene less those that lie within one of its introns.

    With S(x) reads that start before x and E(x) that end up to x, S(end) - E(start) reads overlap a gene and
    E(b) - S(a) + (reads across both a and b) lie in its intron from a to b. S and E are running counts, read off at the bounds of
    segments; pairs are made only of reads that reach across a whole intron, of equal ones once. A gene without
    any start or end has none. The table of S and E is broadcast up to ``most_broadcast`` places, shuffled beyond.
    """
    keys = ["target", "annotation_id"]
    rows = segments.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    spans = cut_lineage(
        reads.select("target", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
        .where("target is not null and start < end").groupBy("target", "start", "end").agg(F.count(F.lit(1)).alias("n"))
    )
    zero = F.lit(0).cast("long")
    events = spans.select("target", F.lit(False).alias("asked"), F.inline(F.array(
        F.struct(F.col("start").alias("at"), F.col("n").alias("s"), zero.alias("e")), F.struct(F.col("end").alias("at"), zero.alias("s"), F.col("n").alias("e")),
    )))
    asked = rows.where("target is not null").select("target", F.explode(F.array("start", "end")).alias("at")).where("at is not null").distinct()
    # Read twice, for the blocks and for their rows.
    places = cut_lineage(
        events.unionByName(asked.select("target", F.lit(True).alias("asked"), "at", zero.alias("s"), zero.alias("e")))
        .groupBy("target", "at").agg(F.max("asked").alias("asked"), F.sum("s").alias("s"), F.sum("e").alias("e"))
    )
    read = running(places, ["target"], "at", {"starts": ("sum", "s"), "ends": ("sum", "e")}, block)
    table = cut_lineage(read.where("asked").select("target", "at", (F.col("starts") - F.col("s")).alias("started"), "ends"))

    order = Window.partitionBy(*keys).orderBy(F.col("start").asc_nulls_last(), "end")
    cut = rows.select(
        "*", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("upto"),
        F.lag(F.lit(1)).over(order).isNull().alias("first"), F.lead(F.lit(1)).over(order).isNull().alias("last"),
    )
    intron = F.coalesce(F.col("annotation_id").isNotNull() & (F.col("start") > F.col("upto")), F.lit(False))
    bounds = cut.select(*keys, F.inline(F.array(
        F.struct(F.when(F.col("first") | intron, F.col("start")).alias("at"), (-F.col("first").cast("int") - intron.cast("int")).alias("side")),
        F.struct(F.when(intron, F.col("upto")).alias("at"), F.lit(1).alias("side")),
        F.struct(F.when(F.col("last"), F.greatest("upto", "end")).alias("at"), F.when(F.col("last"), 2).alias("side")),
    ))).where("at is not null or side = 2")
    found = bounds.join(F.broadcast(table) if table.count() <= most_broadcast else table, ["target", "at"], "left")
    n = F.sum(F.coalesce(F.when(F.col("side") < 0, F.col("side") * F.col("ends")).otherwise(F.col("started")), F.lit(0)))
    whole = F.bool_or(F.col("side") < 0) & F.bool_or((F.col("side") == 2) & F.col("at").isNotNull())
    counts = found.groupBy(*keys).agg(F.when(whole, n).otherwise(0).alias("n"))

    # A read across an intron takes in a base on either side.
    longest = spans.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0
    if longest < 3:
        return counts
    short = introns(rows).where(F.col("annotation_id").isNotNull() & (F.col("end") - F.col("start") + 2 <= longest))
    gaps = cut_lineage(short.select(*keys, F.col("start").alias("a"), F.col("end").alias("b")))
    across = gaps.select("target", "a", "b", (F.col("a") - 1).alias("l_start"), (F.col("b") + 1).alias("l_end")).distinct()
    pairs = range_join(across, spans.withColumnsRenamed({"start": "r_start", "end": "r_end"}), ["target"], width, "contained")
    more = gaps.join(pairs.groupBy("target", "a", "b").agg(F.sum("n").alias("m")), ["target", "a", "b"]).groupBy(*keys).agg(F.sum("m").alias("m"))
    return counts.join(more, keys, "left").select(*keys, (F.col("n") - F.coalesce("m", F.lit(0))).alias("n"))


def shared_segments(segments: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Segments (``target, annotation_id, start, end``) that overlap no segment of another annotation.

    No pairs are made. Equal intervals are one row (two annotations at one interval overlap each other), each start knows its furthest
    end and the furthest of another annotation, and running maxima of both are read off at the ends: a segment overlaps another
    annotation if that one reaches beyond its start from a start before its end. Segments without a target, annotation or
    length overlap nothing.
    """
    keys = ["target", "annotation_id", "start", "end"]
    plain = F.col("target").isNotNull() & F.col("annotation_id").isNotNull() & F.coalesce(F.col("start") < F.col("end"), F.lit(False))
    # Read for the starts, the ends and the verdict.
    spans = cut_lineage(
        segments.where(plain).groupBy("target", "start", "end")
        .agg(F.min("annotation_id").alias("__low"), F.max("annotation_id").alias("__high"), F.count(F.lit(1)).alias("__n"))
    )
    top = F.struct(F.col("end").alias("end"), F.col("__high").alias("annotation"))
    other = (F.col("__low") != F.col("__top.annotation")) | (F.col("__high") != F.col("__top.annotation"))
    starts = (
        spans.withColumn("__top", F.max(top).over(Window.partitionBy("target", "start"))).groupBy("target", "start")
        .agg(F.first("__top").alias("__top"), F.max(F.when(other, F.col("end"))).alias("__second"))
    )
    # Where two annotations meet, the shorter reach is a runner-up; the best runner-up so far is never behind the true one.
    met = running(starts, ["target"], "start", {"__before": ("max", "__top")}, block, strict=True)
    lesser = F.when(F.col("__before.annotation") != F.col("__top.annotation"), F.least("__before.end", "__top.end"))
    events = met.select("target", F.col("start").alias("__at"), "__top", F.greatest("__second", lesser).alias("__second"), F.lit(False).alias("__asked"))
    asked = spans.select("target", F.col("end").alias("__at")).distinct().withColumn("__asked", F.lit(True))
    reached = (
        running(events.unionByName(asked, allowMissingColumns=True), ["target"], "__at", {"__reach": ("max", "__top"), "__next": ("max", "__second")}, block, strict=True)
        .where("__asked").select("target", F.col("__at").alias("end"), "__reach", "__next")
    )
    furthest = F.when(F.col("__reach.annotation") != F.col("__low"), F.col("__reach.end")).otherwise(F.col("__next"))
    alone = (
        spans.where("__low = __high").join(reached, ["target", "end"]).where(~F.coalesce(furthest > F.col("start"), F.lit(False)))
        .select("target", F.col("__low").alias("annotation_id"), "start", "end", "__n")
    )
    if set(segments.columns) != set(keys):
        found = segments.where(plain).join(alone.drop("__n"), keys, "left_semi")
    else:
        found = alone.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).drop("__n")
    return found.unionByName(segments.where(~plain)).select(*segments.columns)


def sample_pairs(samples: DataFrame, most: int = 2000) -> DataFrame:
    """``a, b, kind``: unordered pairs within a group, ordered by group between groups.

    Samples are a dimension of one row a library; more than ``most`` are an error.
    """
    known = samples.select("sample", "grp").where("sample is not null").distinct().limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"more than {most} samples to pair")
    rows = [(a["sample"], b["sample"], a["grp"] == b["grp"]) for a in known for b in known if (a["grp"] == b["grp"] and a["sample"] < b["sample"]) or a["grp"] < b["grp"]]
    pairs = samples.sparkSession.createDataFrame(rows, "a string, b string, same boolean")
    return pairs.select("a", "b", F.when(F.col("same"), "within").otherwise("between").alias("kind"))


def wide_counts(matrix: DataFrame, samples: Sequence[str]) -> DataFrame:
    """One row per element, one column per sample, 0 where nothing was counted."""
    return matrix.groupBy("element").agg(*[F.sum(F.when(F.col("sample") == s, F.col("count")).otherwise(0)).alias(s) for s in samples])


def informative_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those columns with a value that is neither 0 nor NaN nor null."""
    told = lambda c: F.max(F.coalesce((F.col(f"`{c}`") != 0) & ~F.isnan(F.col(f"`{c}`").cast("double")), F.lit(False)))
    row = df.agg(*[told(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"c{i}"]]


def spacing(sites: DataFrame, target: str, position: str) -> DataFrame:
    """``distance, n``: distances between neighbouring sites of a target, counted."""
    from readloom.operators.prefix import neighbours

    near = neighbours(sites.select(target, position).distinct(), [target], position, [position])
    return near.where(F.col(f"previous_{position}").isNotNull()).groupBy((F.col(position) - F.col(f"previous_{position}")).alias("distance")).agg(F.count(F.lit(1)).alias("n"))


def code_genotype(genotype: Column, ref: Column, alt: Column) -> Column:
    """Alleles ``A/C`` as numbers in reference, alternatives; one allele is doubled, unknown ones are ``.``."""
    alleles = F.concat(F.array(ref), alt)
    codes = F.transform(F.split(genotype, "[/|]"), lambda a: F.coalesce((F.nullif(F.array_position(alleles, a), F.lit(0)) - 1).cast("string"), F.lit(".")))
    return F.when(F.size(codes) == 1, F.concat_ws("/", codes[0], codes[0])).otherwise(F.array_join(codes, "/"))
