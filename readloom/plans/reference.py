"""Queries of the interval, alignment, count-matrix and variant operators over the test tables.

The tables hold orders and events, not reads: a line item stands for a read (supplier: target,
shipping day: position, quantity: length), an event for an observed base (user: site, type:
allele, id modulo 4: sample).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import bins, numeric, sequence
from readloom.functions import values as V
from readloom.operators import align, annotation, intervals, reads, stats, tables, variants
from readloom.plans.general import table
from readloom.sources.lines import wiggle
from readloom.streaming import windows


def _day(column: str):
    return F.datediff(F.col(column), F.lit("1970-01-01")).cast("long")


def _reads(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("target"), _day("l_shipdate").alias("start"),
        (_day("l_shipdate") + F.col("l_quantity").cast("long")).alias("end"), "l_returnflag", "l_orderkey", "l_linenumber", "l_discount",
    )


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.coverage(_reads(spark, folder), "target", "start", "end", block=1 << 10)


def _regions(spark: SparkSession, folder: str) -> DataFrame:
    return _reads(spark, folder).where("l_returnflag = 'R'").select("target", "start", (F.col("start") + 30).alias("end")).distinct()


def coverage_runs(spark, folder):
    return _runs(spark, folder)


def coverage_weighted(spark, folder):
    reads = _reads(spark, folder)
    return intervals.coverage(reads, "target", "start", "end", F.round(F.col("l_discount") * 100).cast("long"), 1 << 10)


def coverage_peaks(spark, folder):
    return intervals.peaks(_runs(spark, folder), 8, 1 << 10)


def coverage_depth_tally(spark, folder):
    return intervals.depth_tally(_runs(spark, folder))


def coverage_wiggle(spark, folder):
    return wiggle(_runs(spark, folder), 30).withColumn("average", F.round("average", 6))


def start_counts(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderstatus", _day("o_orderdate").alias("start"), (_day("o_orderdate") + 30).alias("end"), "o_orderkey")
    return intervals.start_counts(orders, "o_orderstatus", "start", "end", F.col("o_orderkey") % 2 == 1)


def merged_intervals(spark, folder):
    return intervals.merge_overlaps(_reads(spark, folder), "target", "start", "end", 0, 1 << 10)


def overlap_counts(spark, folder):
    reads = _reads(spark, folder).where("l_returnflag = 'N'")
    return intervals.overlap_counts(reads, _regions(spark, folder), "target", 1 << 10)


def contained_counts(spark, folder):
    reads = _reads(spark, folder).where("l_returnflag = 'A'").select("target", F.col("start").alias("l_start"), F.col("end").alias("l_end"), "l_orderkey", "l_linenumber")
    regions = _regions(spark, folder).withColumnsRenamed({"start": "r_start", "end": "r_end"})
    pairs = intervals.range_join(reads, regions, ["target"], 32, "contained")
    return pairs.groupBy("target", "r_start", "r_end").agg(F.count(F.lit(1)).alias("n"))


def region_average_depth(spark, folder):
    found = intervals.average_depth(_runs(spark, folder), _regions(spark, folder), "target", 32)
    return found.withColumn("average_depth", F.round("average_depth", 6))


def anchor_clusters(spark, folder):
    rows = _reads(spark, folder).select("target", "start").distinct()
    return intervals.anchor_clusters(rows, "target", "start", 5)


def pileup_depth(spark, folder):
    reads = _reads(spark, folder).select(
        F.lit("s").alias("sample"), "target", F.col("start").alias("position"), (F.col("end") - F.col("start")).cast("int").alias("length"),
        F.lit(False).alias("reverse"), F.array().cast("array<struct<`from`:string,`to`:string,offset:int>>").alias("variations"),
    )
    return variants.explode_bases(reads).groupBy("target", "position").agg(F.count(F.lit(1)).alias("depth"))


def _hits(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")


def best_score(spark, folder):
    return align.best_score(_hits(spark, folder), "l_orderkey", "l_discount")


def best_score_ambiguity(spark, folder):
    return align.best_score(_hits(spark, folder), "l_orderkey", "l_discount", 1)


def gene_ambiguity(spark, folder):
    genes = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return align.gene_ambiguity(_hits(spark, folder), genes, "l_orderkey", "l_partkey", "p_brand", 2).select("l_orderkey", "l_linenumber")


def _read_set(keep: bool):
    def query(spark, folder):
        ids = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
        return align.in_read_set(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), ids, "o_orderkey", keep)

    return query


def without_ambiguous(spark, folder):
    many = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("at_least_hits"))
    return align.without_ambiguous(_hits(spark, folder), many, "l_orderkey", 4).select("l_orderkey", "l_linenumber")


def mates(spark, folder):
    rows = table(spark, folder, "lineitem")
    return align.join_mates(rows.where("l_linenumber = 1"), rows.where("l_linenumber = 2"), "l_orderkey", "l_partkey", "l_suppkey")


def alignment_difference(spark, folder):
    rows = table(spark, folder, "lineitem")
    return align.difference(rows.where("l_linenumber <= 3"), rows.where("l_linenumber >= 3"), "l_orderkey", ["l_suppkey", "l_returnflag"], "l_linenumber")


def slice_filter(spark, folder):
    return _reads(spark, folder).where(align.within_range(F.col("target"), F.col("start"), (3, 9000), (20, 9500))).select("target", "start", "end", "l_orderkey", "l_linenumber")


def pair_flags(spark, folder):
    bits = (F.col("o_orderkey") % 2048).cast("int")
    return table(spark, folder, "orders").select("o_orderkey", align.flags(bits).alias("f")).groupBy("f.paired", "f.reverse", "f.duplicate").agg(F.count(F.lit(1)).alias("n"))


def duplicate_texts(spark, folder):
    return align.tally(table(spark, folder, "documents").select(F.md5("text").alias("digest"), "doc_id"), "digest", "doc_id")


def _sequences(spark, folder):
    return table(spark, folder, "read_entries").select("read_index", "loaded_at", "sample", F.upper(V.trimmed(F.col("sequence"))).alias("sequence"), "quality_scores", "read_length")


def base_counts(spark, folder):
    return align.letter_counts(_sequences(spark, folder), "sequence", 1)


def dinucleotides(spark, folder):
    return align.letter_counts(_sequences(spark, folder), "sequence", 2)


def kmer_counts(spark, folder):
    rows = _sequences(spark, folder)
    return rows.select(F.explode(sequence.kmers(F.col("sequence"), 4)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def sequence_functions(spark, folder):
    s = F.col("sequence")
    return _sequences(spark, folder).where("sequence rlike '^[ACGTN]+$'").groupBy(
        sequence.reverse_complement(s).alias("reversed"), sequence.bisulfite(s).alias("converted"),
        F.round(sequence.gc_share(s), 6).alias("gc"), F.round(sequence.gc_correction_weight(s), 6).alias("weight"),
    ).agg(F.count(F.lit(1)).alias("n"))


def adapter_trim(spark, folder):
    s = F.col("sequence")
    cut = sequence.trim_adapter(s, "AGATCGGAAG", 4, 4)
    return _sequences(spark, folder).where("sequence is not null").select("sequence", cut.alias("c")).select(
        "sequence", F.expr("substr(sequence, c.start, c.length)").alias("trimmed")
    ).groupBy("sequence", "trimmed").agg(F.count(F.lit(1)).alias("n"))


def quality_by_cycle(spark, folder):
    by = _sequences(spark, folder).select(F.posexplode("quality_scores").alias("cycle", "q")).where("q between 0 and 93").groupBy("cycle", "q").agg(F.count(F.lit(1)).alias("m"))
    p = lambda x: F.percentile("q", F.lit(x), F.col("m"))
    return by.groupBy("cycle").agg(
        p(0.25).alias("q25"), p(0.5).alias("q50"), p(0.75).alias("q75"), F.round(F.sum(F.col("q") * F.col("m")) / F.sum("m"), 6).alias("mean"), F.sum("m").alias("n")
    )


def file_statistics(spark, folder):
    return _sequences(spark, folder).groupBy("sample").agg(
        F.count(F.lit(1)).alias("n"), F.min("read_length").alias("shortest"), F.max("read_length").alias("longest"),
        F.round(F.avg("read_length"), 6).alias("mean_length"), F.sum(F.length("sequence")).alias("bases"),
        F.count_if(F.col("quality_scores").isNull()).alias("without_quality"),
    )


def name_index(spark, folder):
    return align.dense_index(table(spark, folder, "customer").select("c_name"), "c_name")


def rolling_counts(spark, folder):
    e = table(spark, folder, "events").withColumn("s", F.unix_timestamp("ts"))
    return intervals.trailing_counts(e, ["user_id"], "s", 86400, block=1 << 18).select("event_id", "n")


def binned_totals(spark, folder):
    orders = table(spark, folder, "orders").select(F.floor("o_totalprice").cast("double").alias("n"))
    return orders.select(*[bins.bin_of(F.col("n"), s).alias(s) for s in ("by5", "linear", "log10", "log2", "small_log10")]).groupBy("linear", "log10", "log2", "small_log10").agg(
        F.count(F.lit(1)).alias("n"), F.sum("by5").alias("sum_by5")
    )


def _matrix(spark, folder, element: str = "p_brand") -> DataFrame:
    """Quantities by brand (element), nation (sample) and region (group)."""
    return (
        table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col(element).alias("element"), F.col("n_name").alias("sample"), F.col("r_name").alias("grp"))
        .agg(F.sum(F.col("l_quantity").cast("long")).alias("count"))
    )


def _normalised(m: DataFrame) -> DataFrame:
    return stats.normalised(m, stats.sample_totals(m).select("sample", F.col("total").alias("denominator")))


def _fold_change(m: DataFrame) -> DataFrame:
    s = stats.group_statistics(_normalised(m), "ASIA", "EUROPE")
    return s.select("element", *[F.round(c, 5).alias(c) for c in ("mean_a", "mean_b", "fold_change", "log2_fold_change", "fold_change_magnitude", "t", "t_equal")], "df")


def group_fold_change(spark, folder):
    return _fold_change(_matrix(spark, folder))


def group_fold_change_sparse(spark, folder):
    """Of parts, most of which most nations never sold."""
    return _fold_change(_matrix(spark, folder, "l_partkey"))


def group_t_test(spark, folder):
    return stats.with_t_p(stats.group_statistics(_normalised(_matrix(spark, folder)), "ASIA", "EUROPE")).select("element", F.round("p", 8).alias("p"))


def upper_quartiles(spark, folder):
    return stats.upper_quartiles(_matrix(spark, folder)).withColumn("factor", F.round("factor", 4))


def chi_square(spark, folder):
    found = stats.chi_square(_matrix(spark, folder), ["ASIA", "EUROPE", "AFRICA"])
    return found.withColumn("chi_square", F.round("chi_square", 6))


def chi_square_p(spark, folder):
    found = stats.chi_square(_matrix(spark, folder), ["ASIA", "EUROPE", "AFRICA"])
    return found.select("element", F.round(numeric.chi_square_p("chi_square", F.col("df").cast("double")), 10).alias("p"))


def _p_values(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", ((F.col("o_orderkey") * 7919) % 10007 / 10007.0).alias("p"))


def adjusted_bh(spark, folder):
    return stats.adjust_bh(_p_values(spark, folder), "p").select("o_orderkey", F.round("q", 9).alias("q"))


def adjusted_bonferroni(spark, folder):
    rows = _p_values(spark, folder).withColumn("p", F.col("p") / 1000)
    return stats.adjust_bonferroni(rows, "p", F.col("p") > 0).select("o_orderkey", F.round("q", 9).alias("q"))


def combined_p(spark, folder):
    found = stats.combine(_p_values(spark, folder), ["o_custkey"], "p")
    return found.select("o_custkey", "n", *[F.round(c, 8).alias(c) for c in ("p_max", "p_min", "p_median", "p_product")])


def fdr_combined(spark, folder):
    rows = _p_values(spark, folder).select("o_orderkey", "o_orderstatus", (F.col("p") * F.col("p") * F.col("p")).alias("p"))
    files = [rows.where(F.col("o_orderstatus") == s).select("o_orderkey", "p") for s in ("O", "F", "P")]
    return tables.combine_fdr(files, "p", 0.3).select("o_orderkey", "source", F.round("q", 9).alias("q"))


def _two_by_two(spark, folder):
    late = F.col("l_discount") > 0.05
    back = F.col("l_returnflag") == "R"
    return table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(back & late).alias("a"), F.count_if(back & ~late).alias("b"), F.count_if(~back & late).alias("c"), F.count_if(~back & ~late).alias("d")
    )


def odds_ratios(spark, folder):
    log2, error = stats.odds_ratio(*[F.col(c) for c in "abcd"])
    return _two_by_two(spark, folder).select("l_suppkey", F.round(log2, 8).alias("log2_odds"), F.round(error, 8).alias("error"))


def fisher_tests(spark, folder):
    return _two_by_two(spark, folder).select("l_suppkey", F.round(numeric.fisher_p(*[F.col(c).cast("double") for c in "abcd"]), 9).alias("p"))


def _observed(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select(
        F.floor(F.col("user_id") / 10).alias("target"), (F.col("user_id") % 10).alias("position"), (F.col("event_id") % 4).alias("sample"),
        F.col("event_type").alias("allele"), F.lit("view").alias("ref"), (F.col("event_id") % 2 == 0).alias("forward"),
        (F.col("event_id") % 36).alias("read_index"), (F.floor("value") % 42).alias("quality"),
    )


def _counts(spark, folder) -> DataFrame:
    return variants.allele_counts(_observed(spark, folder))


def allele_counts(spark, folder):
    return _counts(spark, folder)


def site_gate(spark, folder):
    return variants.site_gate(_observed(spark, folder), 5, 6)


def quality_left_over(spark, folder):
    marked = variants.quality_filter(_observed(spark, folder), 12)
    filtered = marked.groupBy(*variants.KEY).agg(F.count_if("filtered").alias("n_filtered"))
    return variants.left_over(variants.allele_counts(marked.where("not filtered")), filtered).select(*variants.KEY, "allele", "n")


def filter_quarter(spark, folder):
    return variants.at_least_a_quarter(_counts(spark, folder)).select(*variants.KEY, "allele", "n")


def filter_diploid(spark, folder):
    return variants.diploid(_counts(spark, folder)).select(*variants.KEY, "allele", "n")


def filter_strand_bias(spark, folder):
    merged = _counts(spark, folder).groupBy("target", "allele").agg(F.sum("n").alias("n"), F.sum("n_forward").alias("n_forward"), F.sum("n_reverse").alias("n_reverse"))
    return variants.strand_bias(merged, 3)


def filter_chain(spark, folder):
    kept = variants.keep_if_any_sample_keeps(_counts(spark, folder), [variants.at_least_a_quarter, variants.diploid, lambda c: variants.strand_bias(c, 4)])
    return kept.select(*variants.KEY, "allele", "n")


def genotype_calls(spark, folder):
    return variants.genotypes(variants.diploid(_counts(spark, folder)))


def _grouped(spark, folder):
    return _counts(spark, folder).withColumn("grp", F.when(F.col("sample") < 2, "A").otherwise("B"))


def allele_groups(spark, folder):
    return variants.allele_groups(_grouped(spark, folder))


def compared_groups(spark, folder):
    found = variants.compare_groups(_grouped(spark, folder), "A", "B")
    return found.select("target", "position", "ref_a", "var_a", "ref_b", "var_b", *[F.round(c, 8).alias(c) for c in ("log2_odds", "error", "z")])


def somatic_candidates(spark, folder):
    found = variants.somatic(_counts(spark, folder), 0, 1, 1.5, 4)
    return found.select("target", "position", "allele", "n_tumour", F.round("freq_tumour", 8).alias("freq_tumour"), F.round("freq_normal", 8).alias("freq_normal"))


def indel_rates(spark, folder):
    g = _grouped(spark, folder).withColumn("sample", F.col("sample").cast("string"))
    return variants.indel_rate(g, F.col("allele") == "purchase").withColumn("rate", F.round("rate", 6))


def _methylation(spark, folder):
    return variants.methylation_sites(_counts(spark, folder), F.col("allele") == "view")


def methylation_sites(spark, folder):
    return _methylation(spark, folder)


def methylation_regions(spark, folder):
    sites = _methylation(spark, folder).withColumn("grp", F.when(F.col("sample") < 2, "A").otherwise("B"))
    halves = sites.select("target").distinct().withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    regions = halves.select(
        F.concat_ws("-", F.lit("r"), "target", "half").alias("region"), "target",
        (F.col("half") * 5).alias("start"), (F.col("half") * 5 + 5).alias("end"),
    )
    return variants.methylation_regions(sites, regions, 5).withColumn("rate", F.round("rate", 6))


def _pairs(spark, folder):
    s = _methylation(spark, folder)
    side = lambda k, n: s.where(F.col("sample") == k).select("target", "position", F.col("c").alias(f"c{n}"), F.col("cm").alias(f"m{n}"))
    return side(0, "a").join(side(1, "b"), variants.SITE)


def pair_statistics(spark, folder):
    found = stats.pair_statistics(*[F.col(c).cast("double") for c in ("ma", "ca", "mb", "cb")])
    return _pairs(spark, folder).select("target", "position", *[F.round(e, 8).alias(n) for n, e in found.items()])


def empirical_p(spark, folder):
    found = stats.pair_statistics(*[F.col(c).cast("double") for c in ("ma", "ca", "mb", "cb")])
    rows = _pairs(spark, folder).select("target", "position", (F.col("target") % 2).alias("context"), found["stat3"].alias("s"))
    null, tests = rows.where("position < 5").select("context", "s"), rows.where("position >= 5")
    return stats.empirical_p(null, tests, ["context"], "s").select("target", "position", F.round("empirical_p", 8).alias("empirical_p"))


def props_flat(spark, folder):
    e = table(spark, folder, "events").select("event_id", F.from_json("props", "map<string,string>").alias("info"))
    return tables.flatten(tables.keep_records(e, "info", ["k"]), "info", ["k"])


def column_types(spark, folder):
    c = table(spark, folder, "customer").select(*[F.col(x).cast("string").alias(x) for x in ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")])
    return tables.infer_types(c)


def common_positions(spark, folder):
    o = table(spark, folder, "orders")
    return tables.common_positions([o.where(F.col("o_orderstatus") == s) for s in ("O", "F", "P")], ["o_custkey"])


def positions_only_in(spark, folder):
    o = table(spark, folder, "orders")
    return tables.positions_only_in([o.where(F.col("o_orderstatus") == s) for s in ("O", "F", "P")], 2, ["o_custkey"])


def genotype_concordance(spark, folder):
    calls = variants.genotypes(variants.diploid(_counts(spark, folder)))
    side = lambda k: calls.where(F.col("sample") == k).withColumn("genotype", F.replace("genotype", F.lit("view"), F.lit("ref")))
    return tables.concordance(side(0), side(1), variants.SITE, "genotype")


def transition_counts(spark, folder):
    return tables.transitions(table(spark, folder, "vcf_records"), F.col("ref_allele"), F.col("alt"))


def windows_tumbling(spark, folder):
    return windows.windowed(table(spark, folder, "events"), "ts", ["event_type"], windows.tumbling("ts", "1 day"), n=F.count(F.lit(1)), total=F.round(F.sum("value"), 4))


def windows_sliding(spark, folder):
    return windows.windowed(table(spark, folder, "events"), "ts", ["event_type"], windows.sliding("ts", "2 days", "1 day"), n=F.count(F.lit(1)))


def windows_session(spark, folder):
    return windows.windowed(table(spark, folder, "events"), "ts", ["user_id"], windows.sessions("ts", "12 hours"), n=F.count(F.lit(1)))


def _segments(spark, folder):
    """Three shipments of an order as segments of a gene on the supplier modulo 10; two of one day are there twice."""
    return _reads(spark, folder).where("l_linenumber <= 3").select(
        (F.col("l_orderkey") % 10).alias("target"), F.col("l_orderkey").alias("annotation_id"), "start", (F.col("start") + 5).alias("end")
    )


def gene_counts(spark, folder):
    reads = _reads(spark, folder).where("l_returnflag = 'A'").select((F.col("target") % 10).alias("target"), "start", (F.col("start") + 2).alias("end"))
    return annotation.gene_counts(reads, _segments(spark, folder), 512, 1 << 10)


def constitutive_segments(spark, folder):
    return annotation.shared_segments(_segments(spark, folder), 1 << 10).distinct()


def formula_counts(spark, folder):
    m = _matrix(spark, folder).groupBy("element").agg(F.sum("count").alias("raw"), F.count(F.lit(1)).alias("w"))
    value = lambda n: F.round(annotation.combine_by_formula(F.col("raw"), F.col("raw") / 2 + F.col("w"), n), 4).alias(n.lower())
    return m.select("element", value("FORMULA2"), value("FORMULA3"), value("FORMULA4"))


def sample_pairs(spark, folder):
    return annotation.sample_pairs(_matrix(spark, folder).select("sample", "grp").distinct())


def wide_counts(spark, folder):
    return annotation.wide_counts(_matrix(spark, folder), [f"NATION_{i}" for i in range(25)])


def site_spacing(spark, folder):
    return annotation.spacing(_reads(spark, folder), "target", "start")


def kmer_successors(spark, folder):
    rows = _sequences(spark, folder).withColumn("grp", F.when(F.col("read_index") % 2 == 0, "a").otherwise("b"))
    return reads.successors(rows, "sequence", "grp", 5, approximate=False)


def heptamer_weights(spark, folder):
    return reads.heptamer_weights(_sequences(spark, folder), "sequence").withColumn("weight", F.round("weight", 6))


def sex_of_samples(spark, folder):
    records = table(spark, folder, "vcf_records")
    return reads.infer_sex(records.withColumn("s", F.col("file_id") % 3), "s", "chrom")


def length_filter(spark, folder):
    return reads.length_between(_sequences(spark, folder), "read_length", 40, 60).groupBy("read_length").agg(F.count(F.lit(1)).alias("n"))


def coded_genotypes(spark, folder):
    rows = table(spark, folder, "vcf_records").where("ref_allele is not null and alt is not null")
    code = annotation.code_genotype(F.concat_ws("/", "ref_allele", "alt"), F.col("ref_allele"), F.array("alt"))
    return rows.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        coverage_runs, coverage_weighted, coverage_peaks, coverage_depth_tally, coverage_wiggle, start_counts, merged_intervals, overlap_counts,
        contained_counts, region_average_depth, anchor_clusters, pileup_depth, best_score, best_score_ambiguity, gene_ambiguity, without_ambiguous,
        mates, alignment_difference, slice_filter, pair_flags, duplicate_texts, base_counts, dinucleotides, kmer_counts, sequence_functions,
        adapter_trim, quality_by_cycle, file_statistics, name_index, rolling_counts, binned_totals, group_fold_change, group_fold_change_sparse, group_t_test, upper_quartiles,
        chi_square, chi_square_p, adjusted_bh, adjusted_bonferroni, combined_p, fdr_combined, odds_ratios, fisher_tests, allele_counts, site_gate,
        quality_left_over, filter_quarter, filter_diploid, filter_strand_bias, filter_chain, genotype_calls, allele_groups, compared_groups,
        somatic_candidates, indel_rates, methylation_sites, methylation_regions, pair_statistics, empirical_p, props_flat, column_types,
        common_positions, positions_only_in, genotype_concordance, transition_counts, windows_tumbling, windows_sliding, windows_session,
        gene_counts, constitutive_segments, formula_counts, sample_pairs, wide_counts, site_spacing, kmer_successors, heptamer_weights,
        sex_of_samples, length_filter, coded_genotypes,
    )
}
QUERIES["read_set_kept"] = _read_set(True)
QUERIES["read_set_removed"] = _read_set(False)
