"""Interval, alignment, statistics, variant and source operators against brute force on small fixtures."""

import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readloom.functions import bins, numeric, sequence
from readloom.operators import align, intervals, stats, tables, variants
from readloom.operators.prefix import neighbours, running
from readloom.sources import lines, sam

SPANS = "target string, start long, end long, extra int"
spans_of = st.lists(
    st.tuples(st.sampled_from(["a", "b", None]), st.integers(-20, 60), st.integers(0, 15)).map(lambda t: (t[0], t[1], t[1] + t[2], 1)),
    min_size=1, max_size=60,
)


def depth_of(spans):
    depth = Counter()
    for t, s, e, _ in spans:
        if t is not None:
            depth.update((t, p) for p in range(s, e))
    return depth


@settings(max_examples=6, deadline=None)
@given(spans_of)
def test_coverage_and_peaks(spark, spans):
    df = spark.createDataFrame(spans, SPANS)
    runs = intervals.coverage(df, "target", "start", "end", block=8)
    got = Counter()
    rows = runs.collect()
    for r in rows:
        for p in range(r.position, r.position + r.length):
            got[r.target, p] += r.depth
    assert +got == depth_of(spans)
    found = {(r.target, r.start, r.length) for r in intervals.peaks(runs, 1, 8).collect()}
    deep = {k for k, v in depth_of(spans).items() if v > 1}
    expected = set()
    for t, p in deep:
        if (t, p - 1) not in deep:
            n = 1
            while (t, p + n) in deep:
                n += 1
            expected.add((t, p, n))
    assert found == expected


@settings(max_examples=6, deadline=None)
@given(spans_of)
def test_merging_and_overlap_counts(spark, spans):
    df = spark.createDataFrame(spans, SPANS)
    whole = [s for s in spans if s[0] is not None and s[1] < s[2]]
    merged = {(r.target, r.start, r.end, r.n) for r in intervals.merge_overlaps(df, "target", "start", "end", 0, 8).collect()}
    expected, last = [], None
    for t, s, e, _ in sorted(whole):
        if last and last[0] == t and s <= last[2]:
            last[2], last[3] = max(last[2], e), last[3] + 1
        else:
            last = [t, s, e, 1]
            expected.append(last)
    assert merged == {tuple(x) for x in expected}
    regions = spark.createDataFrame([("a", 0, 10), ("b", -5, 3), ("a", 55, 60), ("c", 0, 5)], "target string, start long, end long")
    counts = {(r.target, r.start): r.n_overlapping for r in intervals.overlap_counts(df, regions, "target", 8).collect()}
    depths = {(r.target, r.start): r.average_depth for r in intervals.average_depth(intervals.coverage(df, "target", "start", "end", block=8), regions, "target", 8).collect()}
    depth = depth_of(spans)
    for t, s, e in (("a", 0, 10), ("b", -5, 3), ("a", 55, 60), ("c", 0, 5)):
        assert counts[t, s] == sum(x[0] == t and x[1] < e and x[2] > s for x in whole)
        assert depths[t, s] == pytest.approx(sum(depth[t, p] for p in range(s, e)) / (e - s))


@settings(max_examples=6, deadline=None)
@given(spans_of, spans_of, st.integers(1, 20))
def test_range_join(spark, left, right, width):
    a = spark.createDataFrame([(t, s, e, i) for i, (t, s, e, _) in enumerate(left)], "target string, l_start long, l_end long, l int")
    b = spark.createDataFrame([(t, s, e, i) for i, (t, s, e, _) in enumerate(right)], "target string, r_start long, r_end long, r int")
    good = lambda x: x[0] is not None and x[1] < x[2]
    for how, test in (("overlap", lambda x, y: x[1] < y[2] and y[1] < x[2]), ("contained", lambda x, y: x[1] >= y[1] and x[2] <= y[2])):
        got = Counter((r.l, r.r) for r in intervals.range_join(a, b, ["target"], width, how).collect())
        assert got == Counter((i, j) for i, x in enumerate(left) for j, y in enumerate(right) if good(x) and good(y) and x[0] == y[0] and test(x, y))


def test_anchor_clusters_compare_with_the_first(spark):
    df = spark.createDataFrame([("a", p) for p in (0, 4, 8, 9, 10, 30, 35, 36)] + [("b", 5), (None, 1)], "t string, p long")
    got = {(r.t, r.p): r.anchor for r in intervals.anchor_clusters(df, "t", "p", 8).collect()}
    assert [got["a", p] for p in (0, 4, 8, 9, 10, 30, 35, 36)] == [0, 0, 0, 9, 9, 30, 30, 30] and got["b", 5] == 5


def test_running_and_neighbours(spark):
    rows = [("k", p, v) for p, v in ((1, 5), (3, None), (3, 2), (20, 1), (None, 9))]
    df = spark.createDataFrame(rows, "k string, p long, v long")
    got = {(r.p, r.v): (r.s, r.m) for r in running(df, ["k"], "p", {"s": ("sum", "v"), "m": ("max", "v")}, 4).collect()}
    assert got[1, 5] == (14, 9) and got[3, 2] == (16, 9) and got[20, 1] == (17, 9)
    near = {r.p: (r.previous_p, r.next_p) for r in neighbours(df.where("v is not null"), ["k"], "p", ["p"], 4).collect()}
    assert near[1] == (None, 3) and near[3] == (1, 20) and near[20] == (3, None)
    assert running(df.limit(0), ["k"], "p", {"s": ("sum", "v")}).count() == 0


def test_best_score_and_difference(spark):
    df = spark.createDataFrame([(1, 0.5, "x"), (1, 0.5, "y"), (1, 0.1, "z"), (2, 0.0, "x"), (3, 0.9, "x"), (None, 1.0, "x"), (4, None, "x")], "q int, s double, t string")
    assert {(r.q, r.t) for r in align.best_score(df, "q", "s").collect()} == {(1, "x"), (1, "y"), (3, "x")}
    assert {(r.q, r.t) for r in align.best_score(df, "q", "s", 1).collect()} == {(3, "x")}
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "x"), (3, 1, None)], "q int, o int, t string")
    b = spark.createDataFrame([(1, 1, "y"), (3, 1, "x"), (4, 1, "x")], "q int, o int, t string")
    got = {r.q: (r.only_in, r.differs) for r in align.difference(a, b, "q", ["t"], "o").collect()}
    assert got == {2: ("first", None), 3: (None, "t"), 4: ("second", None)}


def test_dense_index(spark):
    names = [f"n{random.Random(i).randrange(90):03d}" for i in range(300)]
    got = {r.n: r["index"] for r in align.dense_index(spark.createDataFrame([(n,) for n in names] + [(None,)], "n string"), "n").collect()}
    assert got == {n: i for i, n in enumerate(sorted(set(names)))}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.none(), st.just(math.nan), st.floats(0, 1)), min_size=1, max_size=60))
def test_bh_is_the_textbook_one(spark, ps):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
    got = {r.i: r.q for r in stats.adjust_bh(df, "p").collect()}
    known = sorted(p for p in ps if p is not None and p == p)
    raw = {p: p * len(ps) / sum(k <= p for k in known) for p in known}
    for i, p in enumerate(ps):
        expected = min(1.0, min(raw[k] for k in known if k >= p)) if p is not None and p == p else 1.0
        assert got[i] == pytest.approx(expected)


def test_tails():
    # Published values: tables of t, chi-square and Poisson, the tea tasting, Fisher's twins.
    assert numeric.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert numeric.chi_square_upper(5.991, 2) == pytest.approx(0.05, abs=1e-4)
    assert numeric.poisson_upper(3, 2.0) == pytest.approx(1 - math.exp(-2) * 5)
    assert numeric.fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert numeric.fisher_greater(3, 1, 1, 3) == pytest.approx(0.2428571428)
    assert numeric.fisher_two_sided(2, 10, 15, 3) == pytest.approx(0.0005367241)
    assert numeric.fisher_r_by_2([3, 1], [1, 3]) == pytest.approx(numeric.fisher_two_sided(3, 1, 1, 3))
    assert math.isnan(numeric.fisher_two_sided(math.nan, 1, 1, 1))


def test_combine(spark):
    ps = [("a", 0.1), ("a", 0.2), ("a", 0.9), ("b", 0.0), ("b", 0.5), ("c", None)]
    got = {r.k: r for r in stats.combine(spark.createDataFrame(ps, "k string, p double"), ["k"], "p", full_series=True).collect()}
    q = 0.1 * 0.2 * 0.9
    assert got["a"].p_product == pytest.approx(q * (1 - math.log(q) + math.log(q) ** 2 / 2))
    assert (got["a"].p_median, got["a"].p_min, got["b"].p_product) == (0.2, 0.1, 0.0) and "c" not in got


def test_groups_and_comparisons():
    assert stats.parse_groups("A=s1,s2/B=s3") == {"A": ["s1", "s2"], "B": ["s3"]}
    assert stats.parse_comparisons("A/B,A,A/C") == [("A", "B"), ("A", "C")]


def test_sequence_functions(spark):
    row = spark.createDataFrame([("AAGATCGGAAGCC",)], "s string").select(
        sequence.reverse_complement(F.col("s")).alias("r"), sequence.color_space(F.lit("ACGTN")).alias("c"),
        sequence.kmers(F.lit("ACNGT"), 2).alias("k"), sequence.motif_count(F.lit("AAAA"), "AA").alias("m"),
        sequence.mismatches(F.lit("ACGT"), F.lit("AGG")).alias("d"), sequence.decode_quality(F.lit("!I")).alias("q"),
        sequence.encode_quality(F.array(F.lit(0), F.lit(40))).alias("e"), sequence.best_barcode(F.lit("ACGTTT"), ["ACGA", "CCCC"], 1).alias("b"),
        sequence.trim_adapter(F.col("s"), "AGATCGGAAG", 4, 4).alias("t"), sequence.trim_adapter(F.lit("TTTTTTTAGAT"), "AGATCGGAAG", 4, 4).alias("u"),
    ).first()
    assert row.r == "GGCTTCCGATCTT" and row.c == "A1314" and row.k == ["AC", "GT"] and row.m == 3
    assert row.d == 2 and row.q == [0, 40] and row.e == "!I" and (row.b.barcode_index, row.b.differences, row.b.ambiguous) == (0, 1, False)
    assert (row.t.start, row.t.length) == (12, 2) and (row.u.start, row.u.length) == (1, 7)


def test_bins(spark):
    got = spark.createDataFrame([(float(n),) for n in (0, 99, 100, 8, 1500)], "n double").select(*[bins.bin_of(F.col("n"), s).alias(s) for s in bins.STRATEGIES]).collect()
    assert [r.linear for r in got] == [0, 0, 1, 0, 2] and [r.log10 for r in got] == [0, 2, 2, 1, 3] and [r.small_log10 for r in got] == [0, 0, 1, 0, 2]


def test_filters_and_calls(spark):
    counts = spark.createDataFrame(
        [("t", 1, "s", "A", 20, 10, 10, True), ("t", 1, "s", "C", 6, 3, 3, False), ("t", 1, "s", "G", 6, 6, 0, False), ("t", 1, "s", "T", 2, 1, 1, False),
         ("t", 1, "z", "T", 9, 5, 4, False), ("t", 2, "s", "G", 12, 12, 0, False)],
        "target string, position int, sample string, allele string, n long, n_forward long, n_reverse long, is_ref boolean",
    )
    kept = lambda d: {(r.position, r["sample"], r.allele) for r in d.collect()}
    assert kept(variants.at_least_a_quarter(counts)) == {(1, "s", "A"), (1, "s", "C"), (1, "s", "G"), (1, "z", "T"), (2, "s", "G")}
    assert kept(variants.diploid(counts)) == {(1, "s", "A"), (1, "z", "T"), (2, "s", "G")}
    assert (2, "s", "G") not in kept(variants.strand_bias(counts))
    assert (1, "s", "T") in kept(variants.keep_if_any_sample_keeps(counts, [variants.at_least_a_quarter]))
    calls = {(r.position, r["sample"]): (r.genotype, r.base_counts, r.zygosity) for r in variants.genotypes(counts).collect()}
    assert calls[1, "s"] == ("A/T/C/G", "A=20,T=2,C=6,G=6", "Mixture") and calls[1, "z"] == ("T/T", "T=9", "homozygous")


def test_pileup(spark):
    v = "array<struct<`from`:string,`to`:string,offset:int>>"
    rows = [("s", "t", 5, 3, False, 1, [("A", "G", 1)]), ("s", "t", 6, 2, True, 2, None), ("s", "t", 6, 0, True, 3, None)]
    df = spark.createDataFrame(rows, f"sample string, target string, position int, length int, reverse boolean, query_index int, variations {v}")
    got = Counter((r.position, r.allele, r.read_index) for r in variants.explode_bases(df).collect())
    assert got == Counter({(5, "=", 1): 1, (6, "G", 2): 1, (7, "=", 3): 1, (6, "=", 2): 1, (7, "=", 1): 1})


def test_tables(spark):
    df = spark.createDataFrame([("1", "1", "x", ""), (" ", "2.5", "1", None), ("-3", "-Inf", None, "")], "a string, b string, c string, d string")
    assert {r.column_name: r.type for r in tables.infer_types(df).collect()} == {"a": "Integer", "b": "Float", "c": "String", "d": "Unknown"}
    a = spark.createDataFrame([(1, "0/1"), (2, "A/A"), (3, "A/C")], "pos int, gt string")
    b = spark.createDataFrame([(1, "0/1"), (2, "ref/A"), (4, "A/C")], "pos int, gt string")
    assert {r.kind: r.n for r in tables.concordance(a, b, ["pos"], "gt").collect()} == {"same": 1, "missed_one": 1}
    assert [r.pos for r in tables.positions_only_in([a, b], 0, ["pos"]).collect()] == [3]


def test_text_sources(spark, tmp_path):
    fq = tmp_path / "x.fq"
    fq.write_text("# made\n@r1 a\nACGT\n+\n@@II\n@r2\nAC\n+\nI\n")
    got = {r.header: (r.sequence, r.quality_text, r.complete) for r in lines.read_fastq(spark, str(fq)).collect()}
    assert got == {"r1 a": ("ACGT", "@@II", True), "r2": ("AC", "I", False)}
    tricky = tmp_path / "y.fq"
    tricky.write_text("\n#c\n;d\n@r1\nACGT\n+\n#III\n@r2\n\n+\n\n\n# between\n@r3\r\nAC\r\n+r3\r\n##\r\n@cut\nA\n")
    rows = {r.header: (r.read_index, r.sequence, r.quality_text, r.complete) for r in lines.read_fastq(spark, str(tricky)).collect()}
    assert rows == {"r1": (0, "ACGT", "#III", True), "r2": (1, "", "", True), "r3": (2, "AC", "##", True), "cut": (3, "A", None, False)}
    wrapped = tmp_path / "z.fq"
    wrapped.write_text(";c\n@one\nGATACCA\nCATCA\n+again\n@234\n>67890\n+2\n\n#c\n@two\nTAG\n+\n#23\n")
    rows = [(r.read_index, r.header, r.sequence, r.quality_text, r.complete) for r in lines.read_fastq(spark, str(wrapped), wrapped=True).orderBy("read_index").collect()]
    assert rows == [(0, "one", "GATACCACATCA", "@234>67890+2", True), (1, "two", "TAG", "#23", True)]
    fa = tmp_path / "x.fa"
    fa.write_text(">c1 first one\nACGT\nAC>GT\n>c2\nTT\n")
    assert {r.header: (r.description, r.sequence) for r in lines.read_fasta(spark, str(fa)).collect()} == {"c1": ("first one", "ACGTAC>GT"), "c2": (None, "TT")}
    vcf = tmp_path / "x.vcf"
    vcf.write_text("##fileformat=VCFv4.1\n#CHROM\tPOS\n1\t5\t.\tA\tC,G\t9.5\tPASS\tDP=3;DB;DP=4\tGT:DP\t0/1:2\t1/1:3\n")
    headers, records = lines.read_vcf(spark, str(vcf))
    row = records.first()
    assert headers.count() == 2 and row.alt == ["C", "G"] and row.info == {"DP": "3", "DB": "true"} and row.samples == ["0/1:2", "1/1:3"]
    ann = tmp_path / "x.tsv"
    ann.write_text("#h\rchr1\t+\tg\ts1\t5\t9\rbad line\r")
    assert [tuple(r) for r in lines.read_annotations(spark, str(ann), "\r").collect()] == [("chr1", "+", "g", "s1", 5, 9)]
    assert [tuple(r) for r in lines.read_annotations(spark, str(ann), "\r", failing=True).collect()] == [("bad line", "column_count")]
    lines.write_lines(spark.createDataFrame([(1, None)], "a int, b string").coalesce(1), str(tmp_path / "out"), ["a", "b"], "a\tb")
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_sam(spark, tmp_path):
    path = tmp_path / "x.sam"
    path.write_text("@HD\tVN:1\nr\t16\tc\t11\t30\t2S3M1I2M2D1M\t*\t0\t0\tTTACGTCAG\tIIIIIIIII\tMD:Z:1T3^GG1\nu\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    row = sam.read_sam(spark, str(path)).withColumn("v", sam.variations("sequence", "cigar", "md", "reverse")).first()
    assert (row.position, row.target_length, row.query_length, row.clip_left, row.clip_right) == (10, 8, 7, 2, 0)
    assert [(v["from"], v["to"], v["position"], v["read_index"]) for v in row.v] == [("T", "C", 1, 6), ("-", "T", 3, 4), ("GG", "--", 5, 2)]


def test_reads_in_many_splits(spark, tmp_path):
    """Splits that end anywhere in a record, with qualities and names that look like comments and records."""
    draw = random.Random(5)
    names = {}
    for f in range(2):
        text = "# top\n"
        for i in range(400):
            n = draw.choice([0, 1, 5, 30])
            bases, quality = "".join(draw.choice("ACGT") for _ in range(n)), "".join(draw.choice("#;@+I") for _ in range(n))
            names[f"f{f}r{i}"] = (i, bases, quality)
            text += f"@f{f}r{i}\n{bases}\n+\n{quality}\n" + draw.choice(["", "", "\n", "# between\n\n"])
        (tmp_path / f"{f}.fq").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = {r.header: (r.read_index, r.sequence, r.quality_text) for r in lines.read_fastq(spark, str(tmp_path / "*.fq")).where("complete").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == names


def test_spliced_and_unknown_sam(spark, tmp_path):
    path = tmp_path / "x.sam"
    path.write_text(
        "@SQ\tSN:c\tLN:900\n"
        "spliced\t0\tc\t101\t30\t2S4M100N3M1I2M50N2M\t*\t0\t0\tTTACGTCCGATTAC\tIIIIIIIIIIIIII\tMD:Z:2A4T3\n"
        "nothing\t256\tc\t11\t30\t3M1D2M\t=\t51\t7\t*\t*\tMD:Z:1A1^C2\n"
        "equal\t16\tc\t11\t30\t3M\t*\t0\t0\t=G=\tIII\tMD:Z:1A1\n"
        "short\t0\tc\t11\t30\t9M\t*\t0\t0\tAC\tII\tMD:Z:1T7\n"
    )
    records = sam.read_sam(spark, str(path))
    got = {}
    for r in sam.alignment_entries(records).collect():
        v = [(x["from"], x["to"], x["position"], x["read_index"]) for x in r.variations]
        got[r.name, r.fragment_index] = (r.position, r.target_length, r.query_length, r.query_position, r.previous_position, r.next_position, v)
    assert got["spliced", 0] == (100, 4, 4, 2, None, 204, [("A", "G", 2, 5)])
    assert got["spliced", 1] == (204, 5, 6, 6, 100, 259, [("-", "A", 3, 10), ("T", "T", 3, 11)][:1])
    assert got["spliced", 2] == (259, 2, 2, 12, 204, None, [])
    assert got["nothing", 0] == (10, 6, 5, 0, None, None, [("C", "-", 3, 3)])
    assert got["equal", 0][-1] == [("A", "G", 1, 2)] and got["short", 0][-1] == [("T", "C", 1, 2)]
    assert records.where("name = 'nothing'").select("mate_target", "mate_position", "insert_size").first()[:] == ("c", 50, 7)
    sam.write_sam(records, str(tmp_path / "out"), spark.createDataFrame([("c", 900)], "target string, length int"))
    again = sam.read_sam(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.select(*records.columns).collect()), key=str) == sorted(map(tuple, records.collect()), key=str)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SPANS)
    assert intervals.coverage(empty, "target", "start", "end").count() == 0
    assert intervals.merge_overlaps(empty, "target", "start", "end").count() == 0
    assert stats.adjust_bh(spark.createDataFrame([], "p double"), "p").count() == 0
    assert align.tally(spark.createDataFrame([], "v string, i int"), "v", "i").count() == 0


def test_streams_match_batches(spark, tmp_path):
    from readloom.streaming import windows

    data = [(f"2024-01-0{d} 0{h}:00:00", k, float(h)) for d in (1, 2) for h in range(9) for k in "ab"]
    batch = spark.createDataFrame(data, "ts string, k string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    view = lambda d: windows.windowed(d, "ts", ["k"], windows.tumbling("ts", "4 hours"), "1 hour", n=F.count(F.lit(1)))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = view(stream).writeStream.outputMode("complete").format("memory").queryName("streamed").start()
    query.processAllAvailable()
    query.stop()
    assert Counter(map(tuple, spark.table("streamed").collect())) == Counter(map(tuple, view(batch).collect()))
