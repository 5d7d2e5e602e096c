"""Methylation beyond sites and regions: contexts, conversion, strands, and how unusual a difference is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom import registry
from readloom.functions import numeric
from readloom.functions.sequence import complement
from readloom.operators.indels import with_window
from readloom.operators.intervals import anchor_clusters
from readloom.operators.prefix import running


def with_context(sites: DataFrame, blocks: DataFrame, position: str = "position", strand: str = "strand", size: int = 4096) -> DataFrame:
    """``sites`` with ``context``, the base of the site and the one after it on its strand (``CG``, ``CA``, ...).

    ``position`` counts from 0; null outside the genome and where the strand's next base is off it.
    """
    placed = with_window(sites, blocks, position, size)
    at = (F.col(position) - F.col("window_start") + 1).cast("int")
    here, ahead, behind = (F.substr("window", at + k, F.lit(1)) for k in (0, 1, -1))
    forward = F.concat(here, ahead)
    back = F.concat(complement(here), complement(behind))
    told = F.upper(F.when(F.col(strand) == "-", F.when(at >= 2, back)).otherwise(forward))
    return placed.withColumn("context", F.when((at >= 1) & (F.length(told) == 2), told)).select(*sites.columns, "context")


def context_statistics(sites: DataFrame, least_depth: int = 10, least_rate: float = 10.0) -> DataFrame:
    """``sample, n_sites, conversion_rate`` and for each of CpA, CpC, CpG, CpT the reads (``n_``) and the unconverted ones (``m_``).

    ``sites`` have ``sample, context, c, cm`` (converted and not). The conversion rate is the share of converted reads outside
    CpG, in percent, over all sites; contexts count sites of at least ``least_depth`` reads and ``least_rate`` percent methylation.
    """
    depth = F.col("c") + F.col("cm")
    cytosine = sites.where(F.col("context").startswith("C"))
    told = (depth >= least_depth) & (100 * F.col("cm") >= least_rate * depth)
    outside = F.col("context") != "CG"
    columns = []
    for base in "ACGT":
        here = told & (F.col("context") == f"C{base}")
        columns += [F.sum(F.when(here, depth).otherwise(0)).alias(f"n_cp{base.lower()}"), F.sum(F.when(here, F.col("cm")).otherwise(0)).alias(f"m_cp{base.lower()}")]
    converted, all_ = F.sum(F.when(outside, F.col("c"))), F.sum(F.when(outside, depth))
    return cytosine.groupBy("sample").agg(F.count(F.lit(1)).alias("n_sites"), (100 * converted / F.nullif(all_, F.lit(0))).alias("conversion_rate"), *columns)


def depth_histogram(sites: DataFrame, bounds: Sequence[int] = (0, 1, 5, 10, 20, 50, 100, 1000)) -> DataFrame:
    """``sample, least_depth, n``: sites by depth, in bins that begin at ``bounds``."""
    depth = F.col("c") + F.col("cm")
    least = F.lit(bounds[0])
    for b in bounds[1:]:
        least = F.when(depth >= b, F.lit(b)).otherwise(least)
    return sites.groupBy("sample", least.alias("least_depth")).agg(F.count(F.lit(1)).alias("n"))


def strand_similarity(sites: DataFrame, width: int, n: int, least_sites: int = 1) -> DataFrame:
    """``target, start, end, n_forward, n_reverse, score``: the ``n`` windows in which both strands are most alike.

    ``sites`` have ``target, position, strand, rate``. Windows begin with a site and are ``width`` long, the next one
    begins with the first site after it. The score is the difference of the strands' sums of rates, ties go to
    earlier windows.
    """
    known = sites.where("rate is not null")
    placed = anchor_clusters(known.select("target", "position", "strand", "rate"), "target", "position", width - 1)
    side = lambda s, c: F.sum(F.when(F.col("strand") == s, c).otherwise(0))
    windows = placed.groupBy("target", F.col("anchor").alias("start")).agg(
        side("+", F.lit(1)).alias("n_forward"), side("-", F.lit(1)).alias("n_reverse"),
        F.abs(side("+", F.col("rate")) - side("-", F.col("rate"))).alias("score"),
    ).where((F.col("n_forward") >= least_sites) & (F.col("n_reverse") >= least_sites))
    told = windows.select("target", "start", (F.col("start") + width).alias("end"), "n_forward", "n_reverse", "score")
    return told.orderBy("score", "target", "start").limit(n)


# How far two samples' counts (unconverted and converted of a and b) differ; ``covariate`` is the sum of all four.
def _stat3(cma: Column, ca: Column, cmb: Column, cb: Column) -> Column:
    a, b = cma - ca, cmb - cb
    return F.when(a * b > 0, F.greatest(F.abs(a), F.abs(b))).otherwise(F.abs(a) + F.abs(b))


def _linear_midpoint(total: Column) -> Column:
    """The middle of the linear bin of a sum: 0 to 100, 100 to 1000, then thousands."""
    k = F.floor(total / 1000)
    return F.when(total < 100, 50).when(k == 0, 550).otherwise(k * 1000 + 500)


def _minus_log10(p: Column) -> Column:
    return F.least(-F.log10(p), F.lit(323.3062153431158))


@registry.register("pair_statistic", "stat4")
def stat4(cma: Column, ca: Column, cmb: Column, cb: Column) -> Column:
    """stat3 over the middle of the linear bin of all reads, at most 20."""
    return F.least(_stat3(cma, ca, cmb, cb) / _linear_midpoint(cma + ca + cmb + cb), F.lit(20.0))


@registry.register("pair_statistic", "chi_square")
def chi_square_pair(cma: Column, ca: Column, cmb: Column, cb: Column) -> Column:
    """-log10 p of b's counts with a's, scaled to as many reads, as expected ones; 0 where a count is 0."""
    ratio = (cmb + cb) / (cma + ca)
    x = F.pow(cmb - cma * ratio, 2) / (cma * ratio) + F.pow(cb - ca * ratio, 2) / (ca * ratio)
    known = F.least(cma, ca, cmb, cb) > 0
    return F.when(known, _minus_log10(numeric.chi_square_p(F.when(known, x).otherwise(0.0).cast("double"), F.lit(1.0)))).otherwise(0.0)


@registry.register("pair_statistic", "fisher")
def fisher_pair(cma: Column, ca: Column, cmb: Column, cb: Column) -> Column:
    """-log10 of Fisher's p, at most that of the least number."""
    return _minus_log10(F.greatest(numeric.fisher_p(*[c.cast("double") for c in (ca, cma, cb, cmb)]), F.lit(4.9e-324)))


@registry.register("pair_statistic", "pass_through")
def pass_through(cma: Column, ca: Column, cmb: Column, cb: Column) -> Column:
    """The first value as it is."""
    return cma


def density_scale(statistic_range: float, most: int = 10_000) -> float:
    """Bins a unit so that a statistic of this range has ``most`` of them."""
    return float(round(most / statistic_range))


def empirical_fdr(null: DataFrame, tests: DataFrame, keys: Sequence[str], statistic: str, scale: float = 100.0) -> DataFrame:
    """``tests`` with ``empirical_fdr``: 1 - (y + 1) / (r + y + 1), r and y null and test values that reach the bin.

    Only counts by bin are ordered; nulls have no rate.
    """
    bin_of = F.round(F.col(statistic) * scale).cast("long")
    side = lambda df, c: df.select(*keys, bin_of.alias("__bin")).where("__bin is not null").groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias(c))
    both = side(null, "__r").unionByName(side(tests, "__y"), allowMissingColumns=True)
    bins = both.groupBy(*keys, "__bin").agg(F.coalesce(F.sum("__r"), F.lit(0)).alias("__r"), F.coalesce(F.sum("__y"), F.lit(0)).alias("__y"))
    upto = running(bins.withColumn("__down", -F.col("__bin")), list(keys), "__down", {"__nr": ("sum", "__r"), "__ny": ("sum", "__y")}, 1 << 12)
    rate = 1 - (F.col("__ny") + 1) / (F.col("__nr") + F.col("__ny") + 1)
    told = upto.select(*keys, "__bin", rate.alias("empirical_fdr"))
    return tests.withColumn("__bin", bin_of).join(told, [*keys, "__bin"], "left").select(*tests.columns, "empirical_fdr")


def group_rates(sites: DataFrame) -> DataFrame:
    """``target, position, grp, c, cm, rate``: counts of a group's samples; NaN without reads."""
    rows = sites.groupBy("target", "position", "grp").agg(F.sum("c").alias("c"), F.sum("cm").alias("cm"))
    n = F.col("c") + F.col("cm")
    return rows.withColumn("rate", F.when(n > 0, 100 * F.col("cm") / n).otherwise(F.lit(float("nan"))))


def counts_of_records(records: DataFrame, samples: Sequence[str]) -> DataFrame:
    """``target, position, sample, strand, c, cm`` from the records of ``read_vcf`` with FORMAT fields C and Cm."""
    value = lambda name: F.get(F.split(F.col("s.text"), ":"), (F.array_position("format", F.lit(name)) - 1).cast("int")).try_cast("int")
    named = F.arrays_zip(F.array(*[F.lit(s) for s in samples]).alias("name"), F.col("samples").alias("text"))
    rows = records.where(F.array_contains("format", "C") & F.array_contains("format", "Cm")).select(
        F.col("chrom").alias("target"), (F.col("pos") - 1).alias("position"), F.col("info")["Strand"].alias("strand"), "format", F.explode(named).alias("s")
    )
    return rows.select("target", "position", F.col("s.name").alias("sample"), "strand", value("C").alias("c"), value("Cm").alias("cm")).where("sample is not null and c is not null and cm is not null")


def simulated_reads(regions: DataFrame, length: int, per_region: int, rate: Column, seed: int = 1) -> DataFrame:
    """``region, read, start, strand, sequence``: bisulfite reads drawn from ``regions`` (``region, sequence``).

    Places, strands and conversions are hashes of region, read and base: the same on every run. A methylated C stays with
    probability ``rate``, all others read as T.
    """
    draw = lambda *salt: F.pmod(F.xxhash64("region", "read", *[F.lit(s) for s in salt], F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    reads = regions.where(F.length("sequence") >= length).withColumn("read", F.explode(F.sequence(F.lit(0), F.lit(per_region - 1))))
    start = F.floor(draw("start") * (F.length("sequence") - length + 1)).cast("int")
    placed = reads.withColumn("start", start).withColumn("strand", F.when(draw("strand") < 0.5, "+").otherwise("-"))
    plain = F.upper(F.substr("sequence", F.col("start") + 1, F.lit(length)))
    bases = F.split(F.when(F.col("strand") == "+", plain).otherwise(F.reverse(complement(plain))), "")
    kept = lambda i: F.pmod(F.xxhash64("region", "read", i, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) < rate
    read = F.array_join(F.transform(bases, lambda b, i: F.when((b == "C") & ~kept(i), F.lit("T")).otherwise(b)), "")
    return placed.withColumn("sequence", read).select("region", "read", "start", "strand", "sequence")
