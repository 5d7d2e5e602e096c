"""Pileups, genotype filters, calls, group comparison and methylation over long allele counts.

Observations have ``target, position, sample, allele, ref, forward`` and ``read_index``;
allele counts one row per ``target, position, sample, allele``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom import registry

SITE = ["target", "position"]
KEY = [*SITE, "sample"]
# The order of alleles in count strings.
ALLELE_ORDER = ("A", "T", "C", "G")


def explode_bases(alignments: DataFrame) -> DataFrame:
    """Base observations of alignments: reference bases between variations, and the variations.

    ``alignments`` has ``sample, target, position, length, reverse, query_index`` and
    ``variations`` (array of from, to, offset from 0). Null and empty alignments observe nothing.
    """
    base = F.explode(F.sequence(F.lit(0), F.col("length") - 1))
    rows = alignments.where("length > 0").select("*", base.alias("offset"))
    hit = F.filter(F.coalesce("variations", F.array().cast(alignments.schema["variations"].dataType)), lambda v: v["offset"] == F.col("offset"))
    found = F.get(hit, 0)
    return rows.select(
        "sample", "target", (F.col("position") + F.col("offset")).alias("position"),
        F.coalesce(found["to"], F.lit("=")).alias("allele"), found["from"].alias("ref"), (~F.col("reverse")).alias("forward"),
        F.when(F.col("reverse"), F.col("length") - F.col("offset")).otherwise(F.col("offset") + 1).alias("read_index"),
    )


def allele_counts(observed: DataFrame) -> DataFrame:
    """``target, position, sample, allele, n, n_forward, n_reverse, is_ref``, counted before any shuffle of sites."""
    return observed.groupBy(*KEY, "allele").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("forward")).alias("n_forward"),
        F.count_if(~F.col("forward")).alias("n_reverse"), F.max(F.col("allele") == F.col("ref")).alias("is_ref"),
    )


def site_gate(observed: DataFrame, distinct_read_indices: int, support: int) -> DataFrame:
    """Sites with at least so many different read indices and **more** than ``support`` variant observations."""
    other = F.col("allele") != F.col("ref")
    return (
        observed.groupBy(*SITE).agg(
            F.count_distinct(F.when(other, F.col("read_index"))).alias("n_indices"), F.count_if(other).alias("n_variant")
        )
        .where((F.col("n_indices") >= distinct_read_indices) & (F.col("n_variant") > support))
    )


Filter = Callable[[DataFrame], DataFrame]


def quality_filter(observed: DataFrame, least: int = 30) -> DataFrame:
    """Variant observations below ``least`` quality are marked ``filtered`` (no random sparing)."""
    return observed.withColumn("filtered", (F.col("allele") != F.col("ref")) & (F.col("quality") < least))


def at_least_a_quarter(counts: DataFrame) -> DataFrame:
    """Keep alleles with at least a quarter (rounded down) of the sample's best."""
    best = F.max("n").over(Window.partitionBy(*KEY))
    return counts.withColumn("__b", best).where(F.col("n") >= F.floor(F.col("__b") / 4)).drop("__b")


def left_over(counts: DataFrame, filtered: DataFrame, support: int = 0, multiplier: int = 2) -> DataFrame:
    """Drop alleles with fewer rows than ``multiplier * (support + filtered rows)`` of the sample's site."""
    joined = counts.join(filtered, KEY, "left")
    return joined.where(F.col("n") >= multiplier * (F.coalesce("n_filtered", F.lit(0)) + support)).select(*counts.columns)


def diploid(counts: DataFrame) -> DataFrame:
    """Keep alleles of the two best counts; if more than two have them, of the best only."""
    w = Window.partitionBy(*KEY)
    ranked = counts.withColumn("__d", F.dense_rank().over(w.orderBy(F.col("n").desc())))
    top = F.count_if(F.col("__d") <= 2).over(w)
    return ranked.withColumn("__t", top).where((F.col("__d") == 1) | (F.col("__d") == 2) & (F.col("__t") <= 2)).drop("__d", "__t")


def strand_bias(counts: DataFrame, least: int = 10) -> DataFrame:
    """Drop alleles of at least ``least`` rows that one strand alone shows."""
    return counts.where(~((F.col("n") >= least) & (F.least("n_forward", "n_reverse") == 0)))


def keep_if_any_sample_keeps(counts: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Apply filters in order; an allele that survives in any sample keeps its first counts in all."""
    left = counts
    for f in filters:
        left = f(left)
    return counts.join(left.select(*SITE, "allele").distinct(), [*SITE, "allele"], "left_semi")


def genotypes(counts: DataFrame) -> DataFrame:
    """``target, position, sample, genotype, base_counts, depth, zygosity`` from kept allele counts.

    Alleles stand in the order A, T, C, G, then others; one allele is doubled in the genotype.
    """
    order = F.coalesce(F.array_position(F.array(*[F.lit(a) for a in ALLELE_ORDER]), F.col("allele")), F.lit(0))
    place = F.when(order == 0, 99).otherwise(order)
    listed = (
        counts.where("n > 0").groupBy(*KEY)
        .agg(F.array_sort(F.collect_list(F.struct(place.alias("o"), "allele", "n"))).alias("a"), F.sum("n").alias("depth"))
    )
    names, k = F.col("a.allele"), F.size("a")
    return listed.select(
        *KEY,
        F.when(k == 1, F.concat_ws("/", names[0], names[0])).otherwise(F.array_join(names, "/")).alias("genotype"),
        F.array_join(F.transform("a", lambda x: F.concat_ws("=", x["allele"], x["n"].cast("string"))), ",").alias("base_counts"),
        "depth",
        F.when(k == 1, "homozygous").when(k == 2, "heterozygous").otherwise("Mixture").alias("zygosity"),
    )


def allele_groups(counts: DataFrame) -> DataFrame:
    """``target, position, grp, allele, n_samples, n``: samples that show an allele, by group."""
    return counts.where("n > 0").groupBy(*SITE, "grp", "allele").agg(F.count_distinct("sample").alias("n_samples"), F.sum("n").alias("n"))


def compare_groups(counts: DataFrame, a: str, b: str) -> DataFrame:
    """Per site reference and variant counts of two groups, log2 odds ratio, its error and z."""
    from readloom.operators.stats import odds_ratio

    cell = lambda g, ref: F.sum(F.when((F.col("grp") == g) & (F.col("is_ref") == ref), F.col("n")).otherwise(0))
    s = counts.groupBy(*SITE).agg(
        cell(a, True).alias("ref_a"), cell(a, False).alias("var_a"), cell(b, True).alias("ref_b"), cell(b, False).alias("var_b")
    )
    log2, error = odds_ratio(F.col("var_a"), F.col("var_b"), F.col("ref_a"), F.col("ref_b"))
    return s.withColumn("log2_odds", log2).withColumn("error", error).withColumn("z", F.col("log2_odds") / F.col("error"))


def somatic(counts: DataFrame, tumour: object, normal: object, ratio: float = 3.0, least: int = 10) -> DataFrame:
    """Alleles of ``tumour`` that are more than ``ratio`` times as frequent as in ``normal``, both covered."""
    depth = F.sum("n").over(Window.partitionBy(*KEY))
    f = counts.withColumn("depth", depth).withColumn("freq", F.col("n") / F.col("depth"))
    t = f.where((F.col("sample") == tumour) & (F.col("depth") >= least)).select(*SITE, "allele", F.col("n").alias("n_tumour"), F.col("freq").alias("freq_tumour"))
    covered = f.where((F.col("sample") == normal) & (F.col("depth") >= least)).select(*SITE).distinct()
    n = f.where(F.col("sample") == normal).select(*SITE, "allele", F.col("freq").alias("freq_normal"))
    return (
        t.join(covered, SITE, "left_semi").join(n, [*SITE, "allele"], "left").na.fill(0.0, ["freq_normal"])
        .where(F.col("freq_tumour") > ratio * F.col("freq_normal"))
    )


def indel_rate(counts: DataFrame, indel: Column, per: int = 100_000) -> DataFrame:
    """``level, name, n_sites, n_indels, rate``: indels per observed sites, by sample and by group at once."""
    sites = counts.groupBy("sample", "grp").agg(F.count_distinct(*SITE).alias("n_sites"), F.sum(F.when(indel, F.col("n")).otherwise(0)).alias("n_indels"))
    both = sites.groupingSets([["sample"], ["grp"]], "sample", "grp").agg(F.sum("n_sites").alias("n_sites"), F.sum("n_indels").alias("n_indels"))
    return both.select(
        F.when(F.col("sample").isNotNull(), "sample").otherwise("group").alias("level"), F.coalesce("sample", "grp").alias("name"),
        "n_sites", "n_indels", (F.col("n_indels") * per / F.col("n_sites")).alias("rate"),
    )


def methylation_sites(counts: DataFrame, converted: Column) -> DataFrame:
    """``target, position, sample, c, cm, rate``: converted and unconverted rows, rate in rounded percent."""
    s = counts.groupBy(*KEY).agg(
        F.sum(F.when(converted, F.col("n")).otherwise(0)).alias("c"), F.sum(F.when(~converted, F.col("n")).otherwise(0)).alias("cm")
    )
    return s.withColumn("rate", F.when(F.col("c") + F.col("cm") > 0, F.round(100 * F.col("cm") / (F.col("c") + F.col("cm")))))


def methylation_regions(sites: DataFrame, regions: DataFrame, width: int) -> DataFrame:
    """Sums and rates of sites with coverage inside regions (``region, target, start, end``), by group."""
    from readloom.operators.intervals import range_join

    s = sites.where("c + cm > 0").select("target", F.col("position").alias("l_start"), (F.col("position") + 1).alias("l_end"), "grp", "c", "cm")
    g = regions.select("region", "target", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return (
        range_join(s, g, ["target"], width).groupBy("region", "grp")
        .agg(F.sum("c").alias("c"), F.sum("cm").alias("cm"), F.count(F.lit(1)).alias("n_sites"))
        .withColumn("rate", 100 * F.col("cm") / (F.col("c") + F.col("cm")))
    )


registry.register("genotype_filter", "at-least-a-quarter", at_least_a_quarter)
registry.register("genotype_filter", "diploid", diploid)
registry.register("genotype_filter", "strand-bias", strand_bias)
registry.register("site_format", "compare-groups", compare_groups)
registry.register("site_format", "indel-counts", indel_rate)
registry.register("site_format", "methylation", methylation_sites)
registry.register("site_format", "methylation-regions", methylation_regions)


def filtered_by(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Counts after the genotype filters of these names, one after another."""
    for name in names:
        counts = registry.named("genotype_filter", name)(counts)
    return counts
