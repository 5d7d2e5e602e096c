"""What is written about variant sites: allele frequencies, groups, somatic candidates, genotypes with indels, records.

Allele counts are long: ``target, position, sample, allele, n, is_ref``; positions count from 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom import registry
from readloom.functions import numeric
from readloom.operators.variants import ALLELE_ORDER, KEY, SITE


def _reference_and_variants(counts: DataFrame) -> DataFrame:
    side = lambda ref: F.sum(F.when(F.coalesce(F.col("is_ref"), F.lit(False)) == ref, F.col("n")).otherwise(0))
    return counts.groupBy(*KEY).agg(side(True).alias("ref"), side(False).alias("var"))


@registry.register("site_format", "allele-frequencies")
def allele_frequencies(counts: DataFrame, groups: dict[str, list], comparison: tuple[str, str], least_difference: float = 0.1) -> DataFrame:
    """Per site ``depth``, the mean share of the reference in both groups, ``effect`` and ``p``.

    Sites need a read in each sample of both groups and a sample that shows both alleles. ``p`` is of a t-test (equal variances)
    on arcsines of square roots of the shares; 1 below ``least_difference`` of the means, with less than two samples a group, or
    if nothing varies.
    """
    a, b = comparison
    listed = [(s, g) for g in (a, b) for s in groups[g]]
    mine = counts.where(F.col("sample").isin([s for s, _ in listed]))
    grp = F.lit(None).cast("string")
    for g in (a, b):
        grp = F.when(F.col("sample").isin(groups[g]), g).otherwise(grp)
    sides = _reference_and_variants(mine).withColumn("grp", grp).where("ref + var > 0").withColumn("share", F.col("ref") / (F.col("ref") + F.col("var")))
    angle = F.asin(F.sqrt("share"))
    of = lambda f, c, g: f(F.when(F.col("grp") == g, c))
    sites = sides.groupBy(*SITE).agg(
        F.sum(F.col("ref") + F.col("var")).alias("depth"), F.count(F.lit(1)).alias("n"), F.max((F.col("ref") > 0) & (F.col("var") > 0)).alias("both"),
        *[of(F.avg, F.col("share"), g).alias(f"share_{k}") for k, g in (("a", a), ("b", b))],
        *[of(F.avg, angle, g).alias(f"angle_{k}") for k, g in (("a", a), ("b", b))], *[of(F.var_samp, angle, g).alias(f"var_{k}") for k, g in (("a", a), ("b", b))],
    ).where((F.col("n") == len(listed)) & F.col("both"))
    na, nb = len(groups[a]), len(groups[b])
    df = na + nb - 2
    pooled = ((na - 1) * F.coalesce("var_a", F.lit(0.0)) + (nb - 1) * F.coalesce("var_b", F.lit(0.0))) / max(df, 1) * (1 / na + 1 / nb)
    t = F.when(pooled > 0, (F.col("angle_a") - F.col("angle_b")) / F.sqrt(pooled))
    effect = F.abs(F.col("share_a") - F.col("share_b"))
    tested = (effect >= least_difference) & F.lit(min(na, nb) >= 2) & (pooled > 0)
    p = F.when(tested, numeric.t_p(F.coalesce(t, F.lit(0.0)), F.lit(float(max(df, 1))))).otherwise(1.0)
    return sites.select(*SITE, "depth", "share_a", "share_b", effect.alias("effect"), p.alias("p"))


@registry.register("site_format", "between-groups")
def between_groups(observed: DataFrame, a: str, b: str) -> DataFrame:
    """Per site and pair of groups the counts, shares, read indices, qualities, variations, odds ratio and Fisher's p.

    ``observed`` has ``target, position, grp, allele, ref, read_index, quality``. The odds ratio has nothing added: it is null with a
    zero below the line; its error needs ten of each count. ``variations_x`` lists ``n:from/to`` from the most frequent down.
    """
    other = F.col("allele") != F.col("ref")
    counted = observed.where(F.col("grp").isin(a, b)).groupBy(*SITE, "grp", "ref", "allele").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set(F.when(other, F.col("read_index"))).alias("indices"), F.sum(F.when(other, F.col("quality"))).alias("quality")
    )
    sites = counted.groupBy(*SITE, "grp").agg(
        F.sum(F.when(other, 0).otherwise(F.col("n"))).alias("ref_count"), F.sum(F.when(other, F.col("n")).otherwise(0)).alias("var_count"),
        F.size(F.array_distinct(F.flatten(F.collect_list("indices")))).alias("n_indices"), F.sum("quality").alias("quality"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(other, F.struct((-F.col("n")).alias("m"), F.concat_ws("/", "ref", "allele").alias("v"))))),
            lambda x: F.concat_ws(":", (-x["m"]).cast("string"), x["v"]),
        ), ",").alias("variations"),
    )
    of = lambda c, g, empty: F.coalesce(F.max(F.when(F.col("grp") == g, F.col(c))), empty)
    zero = F.lit(0).cast("long")
    wide = sites.groupBy(*SITE).agg(*[
        x for k, g in (("a", a), ("b", b)) for x in (
            of("ref_count", g, zero).alias(f"ref_{k}"), of("var_count", g, zero).alias(f"var_{k}"), of("n_indices", g, F.lit(0)).alias(f"indices_{k}"),
            of("quality", g, F.lit(0)).alias(f"quality_{k}"), of("variations", g, F.lit("")).alias(f"variations_{k}"),
        )
    ])
    ra, va, rb, vb = (F.col(c).cast("double") for c in ("ref_a", "var_a", "ref_b", "var_b"))
    odds = F.when((ra * vb != 0) & (rb * va != 0), F.log2(rb * va / (ra * vb)))
    error = F.when(F.least(ra, va, rb, vb) >= 10, F.sqrt(1 / F.nullif(ra, F.lit(0.0)) + 1 / F.nullif(va, F.lit(0.0)) + 1 / F.nullif(rb, F.lit(0.0)) + 1 / F.nullif(vb, F.lit(0.0))))
    share = lambda k: F.col(f"ref_{k}") / F.nullif(F.col(f"ref_{k}") + F.col(f"var_{k}"), F.lit(0))
    quality = lambda k: F.col(f"quality_{k}") / F.nullif(F.col(f"var_{k}"), F.lit(0))
    out = wide.withColumns({"log2_odds": odds, "error": error})
    return out.select(
        *SITE, "log2_odds", "error", (F.col("log2_odds") / F.col("error")).alias("z"), numeric.fisher_p(rb, vb, ra, va).alias("fisher_p"),
        *[x for k in "ab" for x in (
            share(k).alias(f"ref_share_{k}"), F.col(f"ref_{k}"), F.col(f"var_{k}"), F.col(f"indices_{k}"), quality(k).alias(f"mean_quality_{k}"), F.col(f"variations_{k}")
        )],
    )


def within_group_p(observed: DataFrame, background: DataFrame) -> DataFrame:
    """``target, position, grp, n_variant, n_reference, rate, p``: whether a group shows more variants than its reads' places do anywhere.

    ``background`` has ``sample, read_index, n_variant, n_reference`` (see ``entries.read_index_variations``). The expected rate is that
    of the places at which the site's reads have it; p is one-sided by Fisher, of expected against observed counts.
    """
    told = background.select("sample", "read_index", F.col("n_variant").alias("__v"), F.col("n_reference").alias("__r"))
    other = F.col("allele") != F.col("ref")
    # Counted by place first: a deep site is a row for each place of a read.
    counted = observed.groupBy(*SITE, "grp", "sample", "read_index").agg(F.count_if(other).alias("v"), F.count_if(~other).alias("r"))
    joined = counted.join(told, ["sample", "read_index"], "left")
    n = F.col("v") + F.col("r")
    sites = joined.groupBy(*SITE, "grp").agg(
        F.sum("v").alias("n_variant"), F.sum("r").alias("n_reference"), (F.sum(n * F.col("__v")) / F.nullif(F.sum(n * (F.col("__v") + F.col("__r"))), F.lit(0))).alias("rate")
    )
    depth = F.col("n_variant") + F.col("n_reference")
    expected, rest = F.round(F.col("rate") * depth), F.round((1 - F.col("rate")) * depth)
    lesser = numeric.fisher_lesser_p(*[c.cast("double") for c in (expected, F.col("n_variant"), rest, F.col("n_reference"))])
    return sites.withColumn("p", F.when(F.col("rate").isNotNull(), lesser))


@registry.register("site_format", "somatic")
def somatic_sites(
    counts: DataFrame, controls: DataFrame, failed: DataFrame | None = None, aligned: DataFrame | None = None,
    most_parents: int = 0, most_germline: int = 10,
) -> DataFrame:
    """``target, position, sample, allele, n, frequency, priority, filter``: alleles of somatic samples that no control explains.

    ``controls`` has ``sample, control, kind`` (parent or germline), ``failed`` filtered reads (``target, position, sample, n_failed``),
    ``aligned`` the aligned reads (``sample, n``). An allele is a candidate unless a parent has more than its failed reads or than 5 of it,
    or a germline sample at least 10 and 1.5 times the failed reads of the sample; every control must cover the site at least half as
    deep, and the frequency be over three times that of every control. The priority is the least difference of reads
    per 100 million aligned ones to parents plus that to germline samples. ``filter`` is PASS if parents have at most
    ``most_parents`` and germline samples ``most_germline`` reads of it, else STRICT_SOMATIC.
    """
    depth = F.sum("n").over(Window.partitionBy(*KEY))
    all_ = counts.where("n > 0").select(*KEY, "allele", "n", depth.alias("depth"))
    if failed is not None:
        all_ = all_.join(failed.select(*KEY, "n_failed"), KEY, "left")
    else:
        all_ = all_.withColumn("n_failed", F.lit(0))
    if aligned is not None:
        all_ = all_.join(F.broadcast(aligned.select("sample", F.greatest(F.col("n"), F.lit(1)).alias("aligned"))), "sample", "left")
    else:
        all_ = all_.withColumn("aligned", F.lit(100_000_000))
    all_ = all_.select(*KEY, "allele", "n", "depth", F.coalesce("n_failed", F.lit(0)).alias("n_failed"), F.coalesce("aligned", F.lit(1)).alias("aligned"))
    # Samples are a dimension: their table of controls is one row a pair of samples.
    mine = all_.join(F.broadcast(controls.select("sample", "control", "kind").distinct()), "sample")
    per_sample = all_.groupBy(*KEY).agg(F.max("depth").alias("c_depth"), F.max("n_failed").alias("c_failed"), F.max("aligned").alias("c_aligned")).withColumnRenamed("sample", "control")
    of_allele = all_.select(*SITE, F.col("sample").alias("control"), "allele", F.col("n").alias("c_n"))
    met = mine.join(per_sample, [*SITE, "control"], "left").join(of_allele, [*SITE, "control", "allele"], "left").na.fill(0, ["c_n", "c_depth", "c_failed"])
    parent, germline = F.col("kind") == "parent", F.col("kind") == "germline"
    part = F.lit(1e8) * F.col("n") / F.col("aligned") - F.lit(1e8) * F.col("c_n") / F.coalesce("c_aligned", F.lit(1))
    few = F.when(parent, F.col("c_n") <= most_parents).when(germline, F.col("c_n") <= most_germline)
    sites = met.groupBy(*KEY, "allele", "n", "depth").agg(
        F.max(parent & ((F.col("c_n") > F.col("c_failed")) | (F.col("c_n") > 5))).alias("in_parent"),
        F.max(germline & (F.col("c_n") >= 10) & (F.col("c_n") >= 1.5 * F.col("n_failed"))).alias("in_germline"),
        F.max(F.when(F.col("c_depth") > 0, F.col("c_n") / F.col("c_depth")).otherwise(0.0)).alias("most"), F.min("c_depth").alias("covered"),
        F.coalesce(F.min(F.when(parent, part)), F.lit(0.0)).alias("pp"), F.coalesce(F.min(F.when(germline, part)), F.lit(0.0)).alias("gp"), F.min(few).alias("strict"),
    )
    frequency = F.col("n") / F.col("depth")
    kept = sites.where(~F.col("in_parent") & ~F.col("in_germline") & (F.col("covered") >= F.floor(F.col("depth") / 2)) & (frequency > 3 * F.col("most")))
    return kept.select(*KEY, "allele", "n", (frequency * 100).alias("frequency"), (F.col("pp") + F.col("gp")).alias("priority"), F.when(F.col("strict"), "PASS").otherwise("STRICT_SOMATIC").alias("filter"))


def controls_of(covariates: DataFrame) -> DataFrame:
    """``sample, control, kind`` from covariates (``sample-id, patient-id, kind-of-sample, parents``): germline samples of the
    same patient and the samples of parents (patient ids separated by ``|``) of each somatic sample."""
    c = covariates.select(F.col("`sample-id`").alias("sample"), F.col("`patient-id`").alias("patient"), F.col("`kind-of-sample`").alias("kind"), "parents")
    somatic = c.where("kind = 'Somatic'")
    other = c.select(F.col("sample").alias("control"), F.col("patient").alias("p"), F.col("kind").alias("k"))
    germline = somatic.join(other.where("k = 'Germline'"), F.col("patient") == F.col("p")).select("sample", "control", F.lit("germline").alias("kind"))
    listed = somatic.select("sample", F.explode(F.split("parents", "[|]")).alias("parent"))
    parents = listed.join(other, F.col("parent") == F.col("p")).select("sample", "control", F.lit("parent").alias("kind"))
    return germline.unionByName(parents).distinct()


@registry.register("genotype_filter", "remove-gaps")
def without_gap_bases(observed: DataFrame, indels: DataFrame) -> DataFrame:
    """Base observations but the gaps (``-``) at sites where the same sample has an indel."""
    at = indels.select(*KEY).distinct().withColumn("__indel", F.lit(True))
    return observed.join(at, KEY, "left").where(~((F.col("allele") == "-") & F.coalesce("__indel", F.lit(False)))).drop("__indel")


def aligned_alleles(counts: DataFrame, samples: Sequence[str] | None = None) -> DataFrame:
    """Every allele of a site for every sample there (or of ``samples``), 0 where it has none, all in the same order (``place`` from 1)."""
    alleles = counts.groupBy(*SITE, "allele").agg(F.max("is_ref").alias("is_ref"))
    order = F.array_position(F.array(*[F.lit(a) for a in ALLELE_ORDER]), F.col("allele"))
    first = Window.partitionBy(*SITE).orderBy(F.when(order > 0, order).otherwise(99), "allele")
    alleles = alleles.withColumn("place", F.row_number().over(first))
    if samples is None:
        there = counts.select(*KEY).distinct()
    else:
        there = counts.select(*SITE).distinct().withColumn("sample", F.explode(F.array(*[F.lit(s) for s in samples])))
    grid = there.join(alleles, SITE)
    return grid.join(counts.select(*KEY, "allele", "n"), [*KEY, "allele"], "left").na.fill(0, ["n"]).select(*KEY, "allele", "n", "is_ref", "place")


def with_indels(counts: DataFrame, indels: DataFrame) -> DataFrame:
    """Allele counts of bases and indels of a site as one: an indel is the allele of its ``to`` bases, its ``from`` the reference.

    ``indels`` has ``target, position, sample, from, to, n`` at the base before the indel (see ``indels.indel_support``). At a site with
    an indel a base that is the reference is written like the indel's reference, so that alleles can be compared.
    """
    plain = F.translate("to", "-", "")
    told = indels.groupBy(*SITE).agg(F.max(F.struct(F.length("from").alias("k"), F.col("from").alias("f")))["f"].alias("__ref"))
    reference = F.translate("__ref", "-", "")
    bases = counts.join(told, SITE, "left").withColumn("allele", F.when(F.col("is_ref") & F.col("__ref").isNotNull(), F.concat(F.col("allele"), reference)).otherwise(F.col("allele")))
    anchor = counts.where("is_ref").groupBy(*SITE).agg(F.max("allele").alias("__base"))
    added = indels.join(anchor, SITE, "left").select(*KEY, F.concat(F.coalesce("__base", F.lit("N")), plain).alias("allele"), "n", F.lit(False).alias("is_ref"))
    both = bases.select(*KEY, "allele", "n", "is_ref").unionByName(added)
    return both.groupBy(*KEY, "allele").agg(F.sum("n").alias("n"), F.max("is_ref").alias("is_ref"))


@registry.register("site_format", "genotypes")
def genotype_records(counts: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Records of kept allele counts: ``chrom, pos`` (from 1), ``ref``, ``alt`` and a value ``GT:BC:GB:FB:Zygosity`` of each sample.

    GT are numbers in reference, alternatives (by alphabet); BC the counts of all alleles of the site in their order, GB the
    reads of kept alleles, FB (filtered reads) ``n_filtered`` if the counts have it, else 0. A sample without reads is ``./.``.
    Sites without alternative have no record.
    """
    whole = aligned_alleles(counts, samples)
    ref = F.max(F.when(F.col("is_ref"), F.col("allele")))
    sites = whole.where("n > 0").groupBy(*SITE).agg(F.sort_array(F.collect_set(F.when(~F.coalesce("is_ref", F.lit(False)), F.col("allele")))).alias("alt"))
    named = counts.where("is_ref").groupBy(*SITE).agg(ref.alias("ref"))
    listed = sites.join(named, SITE, "left").where(F.size("alt") > 0).withColumn("ref", F.coalesce("ref", F.lit("N")))
    filtered = F.sum("n_filtered") if "n_filtered" in counts.columns else F.lit(0)
    of_sample = whole.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("place", "allele", "n"))).alias("a"), F.sum("n").alias("depth"))
    if "n_filtered" in counts.columns:
        of_sample = of_sample.join(counts.groupBy(*KEY).agg(filtered.alias("fb")), KEY, "left")
    else:
        of_sample = of_sample.withColumn("fb", F.lit(0))
    joined = of_sample.join(listed, SITE)
    alleles = F.concat(F.array("ref"), "alt")
    shown = F.filter("a", lambda x: x["n"] > 0)
    codes = F.array_sort(F.transform(shown, lambda x: F.array_position(alleles, x["allele"]).cast("int") - 1))
    k = F.size(shown)
    gt = F.when(k == 0, "./.").when(k == 1, F.concat_ws("/", codes[0].cast("string"), codes[0].cast("string"))).otherwise(F.array_join(F.transform(codes, lambda c: c.cast("string")), "/"))
    bc = F.array_join(F.transform("a", lambda x: F.concat_ws("=", x["allele"], x["n"].cast("string"))), ",")
    zygosity = F.when(k == 0, "not-typed").when(k == 1, "homozygous").when(k == 2, "heterozygous").otherwise("Mixture")
    value = F.concat_ws(":", gt, bc, F.col("depth").cast("string"), F.coalesce("fb", F.lit(0)).cast("string"), zygosity)
    order = F.array_position(F.array(*[F.lit(s) for s in samples]), F.col("sample"))
    rows = joined.groupBy(*SITE, "ref", "alt").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))["v"].alias("samples"))
    return rows.select(F.col("target").cast("string").alias("chrom"), (F.col("position") + 1).alias("pos"), "ref", "alt", F.lit("GT:BC:GB:FB:Zygosity").alias("format"), "samples")


def reference_base(counts: DataFrame, genome_base: Column | None = None) -> DataFrame:
    """``target, position, ref``: the genome's base where it is told, else the base most variations start from."""
    own = counts.where("ref is not null").groupBy(*SITE, "ref").agg(F.count(F.lit(1)).alias("m"))
    best = own.groupBy(*SITE).agg(F.max_by("ref", F.struct("m", "ref")).alias("ref"))
    return best if genome_base is None else best.withColumn("ref", F.coalesce(genome_base, "ref"))


def variation_lines(observed: DataFrame, least_indices: int = 1) -> DataFrame:
    """``target, position, from, to, n, n_indices``: variations seen at enough different places of reads; changes to N are left out."""
    told = observed.where((F.col("allele") != F.col("ref")) & (F.col("allele") != "N"))
    rows = told.groupBy(*SITE, F.col("ref").alias("from"), F.col("allele").alias("to")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("read_index").alias("n_indices"))
    return rows.where(F.col("n_indices") >= least_indices)


def annotation_penalty(first: DataFrame, second: DataFrame, alone: float = 1.0, together: float = 0.0) -> DataFrame:
    """One row ``score``: bases of only one of two annotations cost ``alone``, bases of both ``together``; common targets only."""
    from readloom.operators.capture import merge_runs
    from readloom.operators.intervals import merge_overlaps

    common = first.select("target").intersect(second.select("target"))
    flat = [
        merge_overlaps(d.join(common, "target", "left_semi"), "target", "start", "end").select(
            "target", F.col("start").alias("position"), (F.col("end") - F.col("start")).alias("length"), F.lit(1).alias("depth")
        )
        for d in (first, second)
    ]
    both = merge_runs(flat)
    cost = F.when((F.col("depth_0") > 0) & (F.col("depth_1") > 0), together).when((F.col("depth_0") > 0) | (F.col("depth_1") > 0), alone).otherwise(0.0)
    return both.agg(F.coalesce(F.sum(F.col("length") * cost), F.lit(0.0)).alias("score"))


def close_peaks(peaks: DataFrame, most_difference: float, gap: int = 0) -> DataFrame:
    """``target, start, end, value, n``: neighbouring peaks (``target, start, end, value``) as one while each differs from the one before
    by at most ``most_difference`` and lies within ``gap`` (0: any distance); the value is the mean by length."""
    from readloom.operators.intervals import islands
    from readloom.operators.prefix import neighbours

    near = neighbours(peaks.groupBy("target", "start").agg(F.max("end").alias("end"), F.avg("value").alias("value")), ["target"], "start", ["end", "value"])
    far = F.col("previous_value").isNull() | (F.abs(F.col("value") - F.col("previous_value")) > most_difference)
    if gap:
        far = far | (F.col("start") - F.col("previous_end") > gap)
    size = F.col("end") - F.col("start")
    return islands(near, ["target"], "start", far).groupBy("target", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.sum(F.col("value") * size) / F.sum(size)).alias("value"), F.count(F.lit(1)).alias("n")
    ).drop("island")
