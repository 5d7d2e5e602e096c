"""Coverage against annotations: merged streams of runs, what was captured, bins of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.intervals import anchor_clusters, islands
from readloom.operators.prefix import neighbours, running
from readloom.session import cut_lineage


def merge_runs(streams: Sequence[DataFrame], block: int = 1 << 16) -> DataFrame:
    """``target, position, length, depth_0, depth_1, ...``: a row for every stretch in which no stream changes.

    Streams have ``target, position, length, depth``; outside its runs a stream is 0. Stretches where all are 0 come out
    between others too. Changes are summed by position before anything is ordered.
    """
    changes = []
    for i, runs in enumerate(streams):
        rows = runs.where("length > 0 and depth <> 0").select("target", F.inline(F.array(
            F.struct(F.col("position").cast("long").alias("position"), F.col("depth").cast("long").alias("change")),
            F.struct((F.col("position") + F.col("length")).cast("long").alias("position"), (-F.col("depth")).cast("long").alias("change")),
        )))
        changes.append(rows.select("target", "position", *[(F.col("change") if k == i else F.lit(0).cast("long")).alias(f"c{k}") for k in range(len(streams))]))
    every = changes[0]
    for more in changes[1:]:
        every = every.unionByName(more)
    names = [f"c{k}" for k in range(len(streams))]
    events = cut_lineage(every.groupBy("target", "position").agg(*[F.sum(c).alias(c) for c in names]).where(" or ".join(f"{c} <> 0" for c in names)))
    found = running(events, ["target"], "position", {f"depth_{k}": ("sum", c) for k, c in enumerate(names)}, block, carry=["position"])
    return found.where("next_position is not null").select(
        "target", "position", (F.col("next_position") - F.col("position")).alias("length"), *[f"depth_{k}" for k in range(len(streams))]
    )


def captured_depths(runs: DataFrame, annotations: DataFrame, block: int = 1 << 16) -> DataFrame:
    """``depth`` with sites and bases in annotations and outside, and how many of each are at least that deep.

    ``annotations`` are intervals (``target, start, end``), merged first. One row a depth.
    """
    from readloom.operators.intervals import merge_overlaps

    whole = merge_overlaps(annotations, "target", "start", "end", block=block).select(
        "target", F.col("start").alias("position"), (F.col("end") - F.col("start")).alias("length"), F.lit(1).alias("depth")
    )
    both = merge_runs([runs, whole], block)
    bases = F.col("depth_0") * F.col("length")
    inside = F.col("depth_1") > 0
    tally = both.groupBy(F.col("depth_0").alias("depth")).agg(
        F.sum(F.when(inside, F.col("length")).otherwise(0)).alias("sites_in"), F.sum(F.when(inside, 0).otherwise(F.col("length"))).alias("sites_out"),
        F.sum(F.when(inside, bases).otherwise(0)).alias("bases_in"), F.sum(F.when(inside, 0).otherwise(bases)).alias("bases_out"),
    )
    # As many rows as different depths, however large the genome.
    down = Window.orderBy(F.col("depth").desc())
    return tally.select("*", *[F.sum(c).over(down).alias(f"{c}_upto") for c in ("sites_in", "sites_out", "bases_in", "bases_out")])


def capture_statistics(depths: DataFrame, percentiles: Sequence[float] = (0.9, 0.75, 0.5)) -> DataFrame:
    """One row of the table of ``captured_depths``: enrichment efficiency, mean depths, depths at percentiles.

    The efficiency is the share of captured bases among all. A mean is over covered sites. The depth at a percentile is the
    least depth that at most that share of the covered sites reaches (``depth_90`` and so on; ``captured_90``
    of captured sites), or the greatest.
    """
    covered = F.col("depth") >= 1
    total = lambda c: F.coalesce(F.sum(F.when(covered, F.col(c))), F.lit(0))
    # As many rows as different depths.
    whole = Window.partitionBy(F.lit(1))
    steps = depths.select(
        "*", (F.col("sites_in_upto") + F.col("sites_out_upto")).alias("all_upto"),
        F.sum(F.when(covered, F.col("sites_in")).otherwise(0)).over(whole).alias("captured"),
        F.sum(F.when(covered, F.col("sites_in") + F.col("sites_out")).otherwise(0)).over(whole).alias("covered"),
    )

    def at(upto: str, sites: str, p: float):
        # One above the last depth that too many sites reach.
        beyond = F.max(F.when(F.col(upto) > F.col(sites) * p, F.col("depth")))
        return F.least(F.coalesce(beyond + 1, F.lit(0)), F.max("depth"))

    one = steps.agg(
        total("bases_in").alias("bi"), total("bases_out").alias("bo"), total("sites_in").alias("si"), total("sites_out").alias("so"),
        *[at("all_upto", "covered", p).alias(f"depth_{round(p * 100)}") for p in percentiles],
        *[at("sites_in_upto", "captured", p).alias(f"captured_{round(p * 100)}") for p in percentiles],
    )
    share = lambda a, b: a / F.nullif(b, F.lit(0))
    return one.select(
        share(F.col("bi"), F.col("bi") + F.col("bo")).alias("enrichment_efficiency"), share(F.col("bi") + F.col("bo"), F.col("si") + F.col("so")).alias("mean_depth"),
        share(F.col("bi"), F.col("si")).alias("mean_depth_captured"), share(F.col("bo"), F.col("so")).alias("mean_depth_outside"),
        *[c for c in one.columns if c.startswith(("depth_", "captured_"))],
    )


def adaptive_bins(runs: DataFrame, block: int = 1 << 16) -> DataFrame:
    """``target, start, length, average, greatest``: stretches of runs with depth and stretches without, in turn."""
    near = cut_lineage(neighbours(cut_lineage(runs), ["target"], "position", ["depth"], block))
    turns = F.col("previous_depth").isNull() | ((F.col("previous_depth") == 0) != (F.col("depth") == 0))
    numbered = islands(near, ["target"], "position", turns, block)
    return numbered.groupBy("target", "island").agg(
        F.min("position").alias("start"), F.sum("length").alias("length"), (F.sum(F.col("depth") * F.col("length")) / F.sum("length")).alias("average"), F.max("depth").alias("greatest")
    ).drop("island")


def fixed_site_bins(runs: DataFrame, sites: int, block: int = 1 << 16) -> DataFrame:
    """``target, start, length, average, greatest``: runs in order, as many as hold at least ``sites`` covered sites.

    A bin begins with the run after the one that filled the last. By covered sites before each run that is a chain of anchors
    at least ``sites`` apart. The average is over covered sites; ``start`` is the first covered place.
    """
    told = F.when(F.col("depth") != 0, F.col("length")).otherwise(0)
    before = running(cut_lineage(runs).withColumn("__sites", told), ["target"], "position", {"before": ("sum", "__sites")}, block, strict=True)
    placed = before.withColumn("before", F.coalesce("before", F.lit(0)).cast("long"))
    binned = anchor_clusters(cut_lineage(placed), "target", "before", sites - 1)
    start = F.min(F.when(F.col("depth") != 0, F.col("position")))
    return binned.groupBy("target", "anchor").agg(
        start.alias("start"), (F.max(F.col("position") + F.col("length")) - start).alias("length"),
        (F.sum(F.col("depth") * F.col("length")) / F.nullif(F.sum("__sites"), F.lit(0))).alias("average"), F.max("depth").alias("greatest"),
    ).where("start is not null").drop("anchor")
