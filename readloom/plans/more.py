"""Queries of collections, capture, expression, calls, methylation, text round trips and registered operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import registry
from readloom.functions import sequence
from readloom.functions import values as V
from readloom.operators import calls, capture, entries, expression, intervals, methylation, stats, variants
from readloom.plans.general import table
from readloom.plans.reference import _counts, _matrix, _observed, _pairs, _reads, _regions, _runs
from readloom.sources import lines, records, sam


def _by_flag(spark, folder) -> list[DataFrame]:
    rows = table(spark, folder, "lineitem")
    return [rows.where(F.col("l_returnflag") == f) for f in "ANR"]


def concatenated_queries(spark, folder):
    files = [f.select("l_orderkey", "l_linenumber", "l_suppkey") for f in _by_flag(spark, folder)]
    return entries.concatenate(files, "l_orderkey").withColumnRenamed("l_orderkey", "query")


def sorted_concatenation(spark, folder):
    files = [f.select("l_suppkey", F.datediff("l_shipdate", F.lit("1970-01-01")).alias("day"), "l_orderkey", "l_linenumber") for f in _by_flag(spark, folder)]
    return entries.by_position(entries.concatenate(files), "l_suppkey", "day", "l_orderkey", "l_linenumber")


def top_hits(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return entries.top_rows(rows, [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 100)


def top_hits_by_target(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return entries.top_per_key(rows, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 3)


def capped_sites(spark, folder):
    capped = entries.capped_sites(_reads(spark, folder).select("target", "start", "l_orderkey", "l_linenumber"), ["target", "start"], 2)
    return capped.groupBy("target", "start").agg(F.count(F.lit(1)).alias("n"))


def merged_targets(spark, folder):
    nations = table(spark, folder, "nation").select("n_name", F.lit(10).alias("length"))
    regions = table(spark, folder, "region").select(F.col("r_name").alias("n_name"), F.lit(20).alias("length"))
    again = table(spark, folder, "nation").select("n_name", (F.lit(10) + F.col("n_nationkey") % 2).alias("length"))
    return entries.merged_targets([nations, regions, again], "n_name", "length")


def position_slices(spark, folder):
    return entries.position_slices(_reads(spark, folder), "target", "start", 200, 30)


def named_slice(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.datediff("o_orderdate", F.lit("1970-01-01")).alias("day"))
    return entries.in_slice(orders, "o_orderstatus", "day", "O:9000", "P:9500", ["F", "O", "X", "P"])


def alignment_header(spark, folder):
    return entries.header_of(table(spark, folder, "lineitem"), "l_orderkey", "l_suppkey", "l_quantity")


def compared_records(spark, folder):
    rows = table(spark, folder, "lineitem")
    return entries.compare_records(rows.where("l_linenumber = 1"), rows.where("l_linenumber = 2"), ["l_orderkey"], ["l_suppkey", "l_returnflag", "l_linestatus"])


def compared_positions(spark, folder):
    rows = _reads(spark, folder)
    return entries.compare_positions(rows.where("l_linenumber <= 2"), rows.where("l_linenumber >= 2"), ["target", "start"], ["end", "l_returnflag"])


def _entries(spark, folder):
    changed = F.when(F.col("l_tax") > 0.04, F.array(F.struct(F.col("l_linenumber").alias("read_index"), F.lit("A").alias("to")))).otherwise(
        F.array().cast("array<struct<read_index:int,to:string>>")
    )
    return table(spark, folder, "lineitem").where("l_quantity >= 8").select(F.col("l_returnflag").alias("sample"), F.col("l_quantity").cast("int").alias("query_length"), changed.alias("variations"))


def read_index_variations(spark, folder):
    return entries.read_index_variations(_entries(spark, folder))


def base_table(spark, folder):
    return entries.base_table(table(spark, folder, "read_entries"), V.trimmed(F.col("sequence")))


def splice_counts(spark, folder):
    rows = _reads(spark, folder).select(
        "target", F.col("start").alias("position"), (F.col("end") - F.col("start")).alias("target_length"), (F.col("end") + 5).alias("next_position"),
        (F.col("l_linenumber") % 2 == 0).alias("reverse"),
    )
    return entries.splice_counts(rows)


def depth_at_places(spark, folder):
    points = table(spark, folder, "orders").select((F.col("o_custkey") % 10 + 1).alias("target"), F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long").alias("position"), "o_orderkey")
    return entries.depth_at(points, _runs(spark, folder), "target", "position", 1 << 10)


def range_of_reads(spark, folder):
    whole = intervals.merge_overlaps(_reads(spark, folder).where("l_returnflag = 'R' and l_linenumber = 1"), "target", "start", "end", block=1 << 10)
    ranges = whole.select("target", F.col("start").alias("rs"), F.col("end").alias("re"), F.concat_ws("-", "target", "start").alias("range_id"))
    reads = _reads(spark, folder).where("l_returnflag = 'A'").select("target", "start", "end", "l_orderkey", "l_linenumber")
    return entries.containing_range(reads, ranges, "target", "start", "end", "range_id", "rs", "re")


def read_chunks(spark, folder):
    return entries.chunks(table(spark, folder, "read_entries").select("read_index"), "read_index", 1000).groupBy("file").agg(
        F.count_distinct("read_index").alias("n"), F.min("read_index").alias("first"), F.max("read_index").alias("last")
    )


def _two_streams(spark, folder):
    return [intervals.coverage(_reads(spark, folder).where(F.col("l_returnflag") == f), "target", "start", "end", block=1 << 10) for f in "AR"]


def merged_runs(spark, folder):
    return capture.merge_runs(_two_streams(spark, folder), 1 << 10)


def captured_depths(spark, folder):
    return capture.captured_depths(_runs(spark, folder), _regions(spark, folder), 1 << 10)


def capture_statistics(spark, folder):
    found = capture.capture_statistics(captured_depths(spark, folder))
    return found.select(*[F.round(c, 8).alias(c) if c.startswith(("mean", "enrich")) else F.col(c) for c in found.columns])


def adaptive_bins(spark, folder):
    return capture.adaptive_bins(_runs(spark, folder), 1 << 10).withColumn("average", F.round("average", 6))


def fixed_site_bins(spark, folder):
    return capture.fixed_site_bins(_runs(spark, folder), 100, 1 << 10).withColumn("average", F.round("average", 6))


def _groups() -> dict[str, list[str]]:
    """Nations are samples; those of two regions are groups."""
    return {"ASIA": [f"NATION_{i}" for i in range(2, 25, 5)], "EUROPE": [f"NATION_{i}" for i in range(3, 25, 5)]}


def differential_expression(spark, folder):
    evaluate = ("counts", "group-averages", "fold-change", "fold-change-magnitude", "log2-fold-change")
    found = expression.differential_expression(_matrix(spark, folder, "l_partkey").drop("grp"), _groups(), [("ASIA", "EUROPE")], evaluate=evaluate)
    return found.select("element", *[F.round(F.col(f"`{c}`"), 5).alias(c) for c in found.columns if c != "element"])


def differential_expression_tests(spark, folder):
    return expression.differential_expression(
        _matrix(spark, folder, "l_partkey").drop("grp"), _groups(), [("ASIA", "EUROPE")], methods=("aligned-count", "bullard-upper-quartile"),
        evaluate=("t-test", "fisher", "chi-square", "Bonferroni", "BH"),
    )


def within_group_variability(spark, folder):
    return expression.within_group_variability(_matrix(spark, folder), _groups())


def allele_frequencies(spark, folder):
    found = calls.allele_frequencies(_counts(spark, folder), {"A": [0, 1], "B": [2, 3]}, ("A", "B"))
    return found.select("target", "position", "depth", *[F.round(c, 8).alias(c) for c in ("share_a", "share_b", "effect")])


def allele_frequency_tests(spark, folder):
    return calls.allele_frequencies(_counts(spark, folder), {"A": [0, 1], "B": [2, 3]}, ("A", "B")).select("target", "position", F.round("p", 8).alias("p"))


def _grouped_observed(spark, folder):
    return _observed(spark, folder).withColumn("grp", F.when(F.col("sample") < 2, "A").otherwise("B"))


def between_groups(spark, folder):
    found = calls.between_groups(_grouped_observed(spark, folder), "A", "B").drop("fisher_p")
    told = ("log2_odds", "error", "z", "ref_share_a", "ref_share_b", "mean_quality_a", "mean_quality_b")
    return found.select(*[F.round(c, 7).alias(c) if c in told else F.col(c) for c in found.columns])


def within_group_discovery(spark, folder):
    observed = _grouped_observed(spark, folder).withColumn("read_index", (F.col("read_index") + 1).cast("int"))
    other = F.col("allele") != F.col("ref")
    background = observed.groupBy("sample", "read_index").agg(F.count_if(other).alias("n_variant"), F.count_if(~other).alias("n_reference"))
    found = calls.within_group_p(observed, background)
    return found.select("target", "position", "grp", "n_variant", "n_reference", F.round("rate", 8).alias("rate"))


def somatic_sites(spark, folder):
    pairs = [(0, 1, "germline"), (0, 2, "parent"), (3, 1, "germline")]
    controls = spark.createDataFrame(pairs, "sample long, control long, kind string")
    found = calls.somatic_sites(_counts(spark, folder), controls, most_parents=5)
    return found.select("target", "position", "sample", "allele", "n", F.round("frequency", 6).alias("frequency"), F.round("priority", 4).alias("priority"), "filter")


def genotype_records(spark, folder):
    counts = variants.filtered_by(_counts(spark, folder), ["at-least-a-quarter", "diploid"]).withColumn("sample", F.col("sample").cast("string"))
    return calls.genotype_records(counts, ["0", "1", "2", "3"])


def variation_lines(spark, folder):
    return calls.variation_lines(_observed(spark, folder), 3)


def annotation_penalty(spark, folder):
    reads = _reads(spark, folder)
    return calls.annotation_penalty(reads.where("l_returnflag = 'A'"), reads.where("l_returnflag = 'R'"), 1.0, 0.25)


def close_peaks(spark, folder):
    peaks = intervals.peaks(_runs(spark, folder), 8, 1 << 10).select("target", "start", (F.col("start") + F.col("length")).alias("end"), F.col("count").cast("double").alias("value"))
    return calls.close_peaks(peaks, 20.0).withColumn("value", F.round("value", 6))


def pair_statistic_stat4(spark, folder):
    value = registry.named("pair_statistic", "stat4")(*[F.col(c).cast("double") for c in ("ma", "ca", "mb", "cb")])
    return _pairs(spark, folder).select("target", "position", F.round(value, 8).alias("stat4"))


def empirical_fdr(spark, folder):
    told = stats.pair_statistics(*[F.col(c).cast("double") for c in ("ma", "ca", "mb", "cb")])
    rows = _pairs(spark, folder).select("target", "position", (F.col("target") % 2).alias("context"), told["stat3"].alias("s"))
    null, tests = rows.where("position < 5").select("context", "s"), rows.where("position >= 5")
    found = methylation.empirical_fdr(null, tests, ["context"], "s", methylation.density_scale(20))
    return found.select("target", "position", F.round("empirical_fdr", 8).alias("empirical_fdr"))


def density_p(spark, folder):
    told = registry.named("pair_statistic", "stat4")(*[F.col(c).cast("double") for c in ("ma", "ca", "mb", "cb")])
    total = F.col("ma") + F.col("ca") + F.col("mb") + F.col("cb")
    rows = _pairs(spark, folder).select("target", "position", F.when(total < 10, 0).otherwise(1).alias("context"), told.alias("s"))
    null, tests = rows.where("position < 5").select("context", "s"), rows.where("position >= 5")
    return stats.empirical_p(null, tests, ["context"], "s", methylation.density_scale(20)).select("target", "position", F.round("empirical_p", 8).alias("density_p"))


def group_rates(spark, folder):
    sites = variants.methylation_sites(_counts(spark, folder), F.col("allele") == "view").withColumn("grp", F.when(F.col("sample") < 2, "A").otherwise("B"))
    return methylation.group_rates(sites).withColumn("rate", F.round("rate", 6))


def depth_histogram(spark, folder):
    return methylation.depth_histogram(variants.methylation_sites(_counts(spark, folder), F.col("allele") == "view"))


def strand_similarity(spark, folder):
    sites = _reads(spark, folder).select(
        "target", F.col("start").alias("position"), F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-").alias("strand"), F.round(F.col("l_discount") * 100).alias("rate")
    )
    return methylation.strand_similarity(sites, 30, 20, 3)


def _clean(spark, folder):
    text = F.regexp_replace(F.upper(V.trimmed(F.col("sequence"))), "[^ACGTN]", "")
    return table(spark, folder, "read_entries").where("sequence is not null").select(
        F.concat_ws(" ", F.concat_ws("/", "read_index", F.date_format("loaded_at", "yyyyMMddHHmmss")), "sample").alias("header"), text.alias("sequence"),
        F.transform(F.filter("quality_scores", lambda q: q.between(0, 60)), lambda q: q.cast("tinyint")).alias("scores"),
    )


def fastq_round_trip(spark, folder):
    """All reads written as FASTQ and read again: empty reads, and qualities that begin with ``#``."""
    path = records.shared_path(spark, "fastq")
    records.write_text(records.fastq_lines(_clean(spark, folder), F.col("header"), F.col("sequence"), F.col("scores")), path)
    return lines.read_fastq(spark, path).where("complete").select("header", "sequence", F.ascii(F.substr("quality_text", F.lit(1), F.lit(1))).alias("first_code"))


def fasta_round_trip(spark, folder):
    path = records.shared_path(spark, "fasta")
    records.write_text(records.fasta_lines(_clean(spark, folder).where("sequence <> ''"), F.regexp_replace("header", " ", "_"), F.col("sequence"), 20), path)
    return lines.read_fasta(spark, path).select("header", "sequence")


def sam_round_trip(spark, folder):
    """Line items as spliced alignments written as SAM, read again and split at their splices."""
    n = F.col("l_quantity").cast("int")
    rows = table(spark, folder, "lineitem").where("l_quantity >= 3").select(
        F.concat_ws(".", "l_orderkey", "l_linenumber").alias("name"), F.when(F.col("l_linenumber") % 2 == 0, 16).otherwise(0).alias("flag"),
        F.concat(F.lit("t"), F.col("l_suppkey")).alias("target"), F.datediff("l_shipdate", F.lit("1970-01-01")).alias("position"), F.lit(30).alias("mapping_quality"),
        F.concat(n - 1, F.lit("M"), F.col("l_linenumber") * 10, F.lit("N1M")).alias("cigar"), F.lit("*").alias("sequence"),
    )
    path = records.shared_path(spark, "sam")
    sam.write_sam(rows, path)
    return sam.alignment_entries(sam.read_sam(spark, path)).select("name", "target", "fragment_index", "position", "target_length", F.coalesce("next_position", F.lit(-1)).alias("next_position"), "reverse")


def vcf_round_trip(spark, folder):
    """The places of all variant records written as a variant file and read again."""
    rows = table(spark, folder, "vcf_records").where("pos is not null and chrom is not null").select(
        "chrom", "pos", F.col("record_id").cast("string").alias("id"), F.coalesce("ref_allele", F.lit("N")).alias("ref"), F.array(F.lit("A"), F.lit("<DEL>")).alias("alt"),
        F.create_map(F.lit("RID"), F.col("record_id").cast("string"), F.lit("DB"), F.lit("true")).alias("info"), F.array(F.lit("GT"), F.lit("DP")).alias("format"),
        F.array(F.lit("0/1:3"), F.lit(None).cast("string")).alias("samples"),
    )
    header = records.VcfHeader(["s1", "s2"]).declare("INFO", "RID", 1, "Integer", "Number of the record").declare("INFO", "DB", 0, "Flag", "Known")
    path = records.shared_path(spark, "vcf")
    records.write_vcf(rows, header.declare("FORMAT", "GT", 1, "String", "Genotype").declare("FORMAT", "DP", 1, "Integer", "Depth"), path)
    back = lines.read_vcf(spark, path)[1]
    return back.select("chrom", "pos", "id", F.col("info")["RID"].cast("long").alias("rid"), F.col("info")["DB"].alias("db"), F.size("alt").alias("n_alt"), F.col("samples")[0].alias("first_sample"))


def archive_round_trip(spark, folder):
    path = records.shared_path(spark, "archive")
    records.write_archive(_runs(spark, folder), path)
    return records.archive_totals(spark, path)


def end_barcodes(spark, folder):
    text = F.regexp_replace(F.upper(V.trimmed(F.col("sequence"))), "[^ACGT]", "")
    told = table(spark, folder, "read_entries").where("sequence is not null").select(sequence.best_end_barcode(text, ["TACGCT", "GGATCC", "AACCGG"], 1, 4).alias("b"))
    return told.groupBy("b.barcode_index", "b.length", "b.differences", "b.ambiguous").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        concatenated_queries, sorted_concatenation, top_hits, top_hits_by_target, capped_sites, merged_targets, position_slices, named_slice, alignment_header,
        compared_records, compared_positions, read_index_variations, base_table, splice_counts, depth_at_places, range_of_reads, read_chunks, merged_runs,
        captured_depths, capture_statistics, adaptive_bins, fixed_site_bins, differential_expression, differential_expression_tests, within_group_variability,
        allele_frequencies, allele_frequency_tests, between_groups, within_group_discovery, somatic_sites, genotype_records, variation_lines, annotation_penalty,
        close_peaks, pair_statistic_stat4, empirical_fdr, density_p, group_rates, depth_histogram, strand_similarity, fastq_round_trip, fasta_round_trip,
        sam_round_trip, vcf_round_trip, archive_round_trip, end_barcodes,
    )
}
